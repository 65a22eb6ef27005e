"""Stored day sketches, sequential samples and stream summaries."""

from __future__ import annotations

import math
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import history, sampling
from tidemark.streaming import top


def test_quantiles_read_only_new_days(spark, tmp_path):
    rng = random.Random(5)
    data = [(f"2024-01-{d:02d}", k, rng.lognormvariate(d / 10, 1)) for d in range(1, 15) for k in ("a", "b") for _ in range(300)]
    data += [("2024-01-03", "c", None), ("2024-01-03", None, 4.0)]
    path, store = str(tmp_path / "events"), str(tmp_path / "sketches")
    made = spark.createDataFrame(data, "day string, k string, v double").withColumn("day", F.to_date("day"))
    made.write.partitionBy("day").parquet(path)
    events = spark.read.parquet(path)
    history.refresh(events, "day", ["k"], "v", store, "2024-01-08")
    assert history.newest_day(spark, store) == "2024-01-07"
    new = history.new_days(events, "day", store, "2024-01-15").select("v", "_metadata.file_path")
    assert "PartitionFilters: [isnotnull(day" in new._jdf.queryExecution().executedPlan().toString()
    read = {os.path.basename(os.path.dirname(r.file_path)) for r in new.collect()}
    assert read == {f"day=2024-01-{d:02d}" for d in range(8, 15)}
    # the old days may be gone: a refresh does not read them
    for d in range(1, 8):
        shutil.rmtree(f"{path}/day=2024-01-{d:02d}")
    events = spark.read.parquet(path)
    history.refresh(events, "day", ["k"], "v", store, "2024-01-15")
    history.refresh(events, "day", ["k"], "v", store, "2024-01-15")
    got = history.quantiles(spark, store, ["k"], F.trunc("day", "week"), {"p50": 0.5, "p99": 0.99}).collect()
    for r in got:
        own = sorted(v for d, k, v in data if k == r.k and v is not None and (d < "2024-01-08") == (str(r.period) == "2024-01-01"))
        assert r.samples == len(own)
        for p, x in ((0.5, r.p50), (0.99, r.p99)):
            assert sum(v < x for v in own) / len(own) <= p + 0.01 and sum(v <= x for v in own) / len(own) >= p - 0.01
    assert {r.k for r in got} == {"a", "b", None}
    changed = history.change_of(spark.createDataFrame([("a", 1, 10.0), ("a", 2, 12.0), ("a", 3, 14.5), ("b", 1, 0.0), ("b", 2, 1.0)], "k string, period int, p99 double"), ["k"], "p99")
    assert [(r.change_pct, r.degraded) for r in sorted(changed.collect())] == [(None, False), (20.0, False), (20.8333, True), (None, False), (None, False)]


def test_incomplete_beta_is_the_binomial_tail():
    for n, p in ((1, 0.3), (10, 0.001), (50, 0.5), (400, 0.02)):
        for k in {k for k in (0, 1, n // 3, n - 1) if k < n}:
            upto = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert sampling.beta_share(1 - p, n - k, k + 1) == pytest.approx(upto, abs=1e-10)
    low, high = sampling.bounds(3, 50, 0.05)
    assert sum(math.comb(50, i) * low**i * (1 - low) ** (50 - i) for i in range(3)) == pytest.approx(0.975, abs=1e-9)
    assert sum(math.comb(50, i) * high**i * (1 - high) ** (50 - i) for i in range(4)) == pytest.approx(0.025, abs=1e-9)
    assert sampling.bounds(0, 0, 0.05) == (0.0, 1.0) and sampling.bounds(0, 9, 0.05)[0] == 0 and sampling.bounds(9, 9, 0.05)[1] == 1


@pytest.mark.parametrize(("wrong", "rows_", "want", "stage"), [(0, 30_000, "PASS", 64), (3000, 30_000, "FAIL", 1), (1, 900, "FAIL", 100), (0, 500, "PASS", 100), (1, 1000, "PASS", 100)])
def test_sampling_stops_when_it_knows(spark, wrong, rows_, want, stage):
    source = spark.range(rows_).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("s"), F.lit(1).alias("v"))
    target = source.withColumn("v", F.when(F.col("k") < wrong, 2).otherwise(1))
    got = sampling.sampled_parity(source, target, ["k"], ["k", "s", "v"], "s").collect()
    whole = next(r for r in got if r.stratum is None)
    assert whole.verdict == want and whole.stage_pct <= stage
    parts = [r for r in got if r.stratum is not None]
    assert sum(r.sampled for r in parts) == whole.sampled and sum(r.wrong for r in parts) == whole.wrong
    assert whole.lower_pct <= 100 * (1 - whole.wrong / whole.sampled) <= whole.upper_pct


def test_top_items_of_a_stream(spark, tmp_path):
    rng = random.Random(11)
    root = str(tmp_path / "top")
    step = top.top_items_step(root, "item", tracked=200)
    seen: dict[str, int] = {}
    for batch in range(4):
        items = [f"i{int(rng.paretovariate(0.9))}" for _ in range(3000)] + [None]
        for i in items[:-1]:
            seen[i] = seen.get(i, 0) + 1
        df = spark.createDataFrame([(i,) for i in items], "item string").repartition(3)
        step(df, batch)
        if batch == 2:
            step(df, batch)  # delivered again
    found = top.top_items(spark, root, 3, 20).collect()
    want = sorted(seen, key=lambda i: -seen[i])[:10]
    got = {r.item: r["count"] for r in found}
    assert set(want) <= set(got) and {r["rows"] for r in found} == {12_000}
    assert all(abs(got[i] - seen[i]) <= 4 * 12_000 / 200 for i in got)
    with pytest.raises(ValueError, match="no state"):
        top.top_items(spark, root, 9)
    assert rows(top.top_items(spark, root, 0, 1).select("scope")) == [("",)]
