"""Headline queries, timed: prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans.registry import load_all
from pyspark.sql import functions as F

from tidemark.functions.scalars import money_sum
from tidemark.session import get_session, scratch_path

QUERIES = [
    "recon_summary",
    "recon_segments",
    "row_diff",
    "row_diff_columns",
    "fk_orphans",
    "pk_duplicates",
    "repair_full",
    "cdc_net",
    "cdc_apply",
    "cdc_conflicts",
    "top_statements_total",
    "wait_share",
    "head_blockers",
    "snapshot_delta",
    "heartbeat_runs",
    "latency_quantiles",
    "resample_5m",
    "job_success_rate",
    "four_table_join",
    "etl_daily_revenue",
    "report_findings",
    "stream_rates",
    "stream_cdc_apply",
]
#: Rows of the table that stands for the reference's storage benchmark (10 million retail rows).
RETAIL_ROWS = 10_000_000
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def retail(spark, sf_dir: str) -> dict[str, float]:
    """Revenue by priority over about 10 million rows: the orders table repeated, written as Parquet and read back."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    copies = max(1, RETAIL_ROWS // max(1, orders.count()))
    path = scratch_path(spark, "retail")
    orders.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).write.parquet(path)
    rows = spark.read.parquet(path)
    plans = {
        "retail_10m_double_sum": rows.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("revenue")),
        "retail_10m_exact_sum": rows.groupBy("o_orderpriority").agg(money_sum(F.col("o_totalprice")).alias("revenue")),
    }
    out = {}
    for name, df in plans.items():
        taken = []
        for _ in range(REPEATS + 1):
            started = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        out[name] = round(statistics.median(taken[1:]), 4)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"),
    )
    spark.sparkContext.setLogLevel("OFF")
    entries = load_all()

    def once(name: str) -> float:
        started = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    times = {}
    for name in QUERIES:
        once(name)
        repeats = 1 if name.startswith("stream") else REPEATS
        times[name] = round(statistics.median(once(name) for _ in range(repeats)), 4)
    times |= retail(spark, sf_dir)
    total = round(sum(times.values()), 4)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
