"""Chunked scans of hot keys against plain windows and against loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators.ordered import Running, exact_percentiles, following, previous, running, runs, split_hot_keys


def frame(spark, seed: int, size: int = 300):
    """Random rows; key 0 holds more than half of them, one key is null."""
    rng = random.Random(seed)
    data = []
    for i in range(size):
        key = rng.choice([0, 0, 0, 1, 2, None])
        value = rng.choice([None, rng.randint(-5, 5)])
        data.append((key, rng.randint(0, 60), i, value))
    return spark.createDataFrame(data, "k int, t bigint, i bigint, v int")


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("limit", [7, 40, 10_000])
def test_running_equals_window(spark, seed, limit):
    df = frame(spark, seed)
    spec = {
        "s": ("sum", True), "c": ("count", False), "lo": ("min", False), "hi": ("max", True), "la": ("last", False), "li": ("last", True),
    }
    got = running(df, ["k"], ["t", "i"], {n: Running(kind, F.col("v"), inc) for n, (kind, inc) in spec.items()}, rows_per_chunk=limit)
    window = Window.partitionBy("k").orderBy("t", "i")
    upto, before = window.rowsBetween(Window.unboundedPreceding, 0), window.rowsBetween(Window.unboundedPreceding, -1)
    fns = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    want = df.select("*", *[fns[k]("v").over(upto if inc else before).alias(n) for n, (k, inc) in spec.items()])
    assert rows(got) == rows(want)


@pytest.mark.parametrize("limit", [7, 10_000])
def test_previous_and_following(spark, limit):
    df = frame(spark, 4)
    window = Window.partitionBy("k").orderBy("t", "i")
    want = df.withColumn("p", F.lag("v").over(window)).withColumn("f", F.lead("v").over(window))
    got = previous(df, ["k"], ["t", "i"], {"p": "v"}, rows_per_chunk=limit)
    got = following(got, ["k"], ["t", "i"], {"f": "v"}, rows_per_chunk=limit)
    assert rows(got) == rows(want)


def test_explicit_chunk(spark):
    df = frame(spark, 5)
    window = Window.partitionBy("k").orderBy("t", "i")
    want = df.withColumn("p", F.lag("v").over(window))
    assert rows(previous(df, ["k"], ["t", "i"], {"p": "v"}, chunk=F.floor(F.col("t") / 10))) == rows(want)


def test_hot_key_is_split(spark):
    df = frame(spark, 6, 2000)
    assert split_hot_keys(df, ["k"], "t", 10_000) is None
    sizes = split_hot_keys(df, ["k"], "t", 100).groupBy("k", "_chunk").count()
    hot = sizes.where("k = 0").collect()
    assert len(hot) > 5
    assert max(r["count"] for r in hot) < 250


def test_ties_and_many_chunks(spark):
    """One value of the first order column, and more than a thousand chunks: both are cut to size."""
    tied = spark.range(20_000).select(F.lit(0).alias("k"), F.lit(7).alias("t"), F.col("id").alias("i"), (F.col("id") % 5).alias("v"))
    sizes = [r["count"] for r in split_hot_keys(tied, ["k"], ["t", "i"], 10).groupBy("_chunk").count().collect()]
    assert len(sizes) > 1200 and max(sizes) < 100
    got = running(tied, ["k"], ["t", "i"], {"s": Running("sum", F.col("v"))}, rows_per_chunk=200)
    assert got.where("s <> (i DIV 5) * 10 + (i % 5) * (i % 5 + 1) / 2").count() == 0


def test_chunks_by_a_rule_are_stitched_in_groups(spark, monkeypatch):
    from tidemark.operators import ordered

    monkeypatch.setattr(ordered, "STITCHED_AT_ONCE", 7)
    df = frame(spark, 5)
    window = Window.partitionBy("k").orderBy("t", "i")
    want = df.withColumn("p", F.lag("v").over(window))
    assert rows(previous(df, ["k"], ["t", "i"], {"p": "v"}, chunk=F.floor(F.col("t") / 2))) == rows(want)


@pytest.mark.parametrize("limit", [5, 10_000])
def test_runs(spark, limit):
    df = frame(spark, 7).where("k IS NOT NULL")
    got = runs(df, ["k"], ["t", "i"], F.col("v") > 0, rows_per_chunk=limit)
    want = []
    for key in (0, 1, 2):
        seq = sorted((r.t, r.i, r.v) for r in df.where(F.col("k") == key).collect())
        start, length = None, 0
        for t, i, v in [*seq, (None, None, None)]:
            if v is not None and v > 0:
                start, length, end = (t, 1, t) if length == 0 else (start, length + 1, t)
            elif length:
                want.append((key, start, end, length))
                length = 0
    assert sorted(want) == sorted((r.k, r.run_start, r.run_end, r.run_length) for r in got.collect())


@pytest.mark.parametrize("limit", [3, 10_000])
def test_exact_percentiles(spark, limit):
    df = frame(spark, 8).withColumn("d", F.col("v") * 1.5)
    got = exact_percentiles(df, ["k"], "d", {"a": 0.0, "b": 0.5, "c": 0.95, "e": 1.0}, rows_per_chunk=limit)
    want = df.where("d IS NOT NULL").groupBy("k").agg(
        F.percentile("d", 0.0).alias("a"), F.percentile("d", 0.5).alias("b"), F.percentile("d", 0.95).alias("c"), F.percentile("d", 1.0).alias("e"),
    )
    for g, w in zip(rows(got), rows(want)):
        assert g == pytest.approx(w)
    assert got.count() == want.count()


def test_results_survive_repartition(spark):
    df = frame(spark, 9)
    spec = {"s": Running("sum", F.col("v"))}
    assert rows(running(df.repartition(1), ["k"], ["t", "i"], spec, rows_per_chunk=9)) == rows(
        running(df.repartition(7), ["k"], ["t", "i"], spec, rows_per_chunk=9)
    )
