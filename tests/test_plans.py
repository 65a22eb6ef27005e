"""Shapes of physical plans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import summary
from tidemark.plans.reconciliation import SPEC
from tidemark.plans.registry import load_all

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CollectLimit")
ENTRIES = load_all()
LAZY = sorted(n for n in ENTRIES if not n.startswith("stream"))


def text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_slow_operators(spark, sf, name):
    plan = text(ENTRIES[name].run(spark, sf))
    assert not [f for f in FORBIDDEN if f in plan]
    lines = plan.split("\n")
    gathered = [lines[i - 1] for i, line in enumerate(lines) if "Exchange SinglePartition" in line and "Sort [" in lines[i - 1]]
    assert not gathered


def test_scan_reads_needed_columns(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    spec = summary.TableSpec("orders", ["o_orderkey"], "o_orderdate", "o_orderstatus")
    plan = text(summary.summarize(orders, spec, "1997-01-01", "1998-01-01", "2024-01-01"))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>" in plan
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_filters_reach_the_scan(spark, sf):
    plan = text(ENTRIES["slow_ops"].run(spark, sf))
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,100.0)]" in plan


def test_row_diff_shuffles_narrow_rows(spark, sf):
    df = ENTRIES["row_diff"].run(spark, sf)
    plan = text(df)
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan and "SortAggregate" not in plan


def test_latest_row_is_limited_before_the_shuffle(spark, sf):
    for name in ("job_latest", "top_statements_stacked", "cdc_net", "cdc_apply"):
        assert "WindowGroupLimit" in text(ENTRIES[name].run(spark, sf))


def test_summary_segments_use_partial_aggregates(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    plan = text(summary.summarize_by(orders, SPEC, "1997-01-01", "1998-01-01", F.floor(F.col("o_orderkey") / 1000)))
    assert "partial_sum" in plan and plan.count("Exchange") == 1


def test_registry_covers_the_inventory():
    covered = {i for e in ENTRIES.values() for i in e.ids}
    groups = {"S": 17, "P": 11, "J": 16, "A": 14, "W": 7, "K": 5, "U": 4, "F": 17, "M": 15, "R": 27, "T": 57, "X": 12, "Q": 14}
    assert covered == {f"{g}{i}" for g, n in groups.items() for i in range(1, n + 1)}
