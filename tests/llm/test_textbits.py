"""Arrow batches as Spark makes them for the operators."""

from __future__ import annotations

import os
from pathlib import Path

import pyarrow as pa

from tidemark.llm import textbits


def test_spark_makes_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "n"])

    df = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat(cast(id % 10 AS string), 4000) AS text")
    textbits.map_batches(df, lambda batches: batches, "id long, text string")
    seen = df.mapInArrow(sizes, "bytes long, n long").collect()
    assert sum(r["n"] for r in seen) == 6000
    assert max(r["bytes"] for r in seen) < 1.1 * textbits.CUT


def test_a_smaller_limit_of_the_session_stays(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for small in ("1000000", "1m", "512k"):
            spark.conf.set(name, small)
            textbits.small_batches(spark)
            assert spark.conf.get(name) == small
        spark.conf.set(name, "64m")
        textbits.small_batches(spark)
        assert int(spark.conf.get(name)) == textbits.CUT
    finally:
        spark.conf.set(name, before)


def test_an_idle_worker_gives_freed_memory_back(spark):
    def fill(batches):
        for b in batches:
            blocks = [b"x" * 100_000 for _ in range(4000)]
            textbits._powers["held"] = b"y" * 100_000  # lies above the 400 MB and stays
            del blocks
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()])], ["pid"])

    def release(batches):
        textbits._powers.pop("held", None)
        yield from batches

    try:
        (row,) = textbits.map_batches(spark.range(0, 1, 1, 1), fill, "pid long").collect()
        pages = int(Path(f"/proc/{row['pid']}/statm").read_text().split()[1])
        assert pages * os.sysconf("SC_PAGE_SIZE") < 300e6
    finally:
        spark.range(0, 1, 1, 1).mapInArrow(release, "id long").collect()
