"""Interval and as-of joins, difference sketches and exact distinct counts against plain forms."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import diff, intervals, sketch
from tidemark.operators.telemetry import storage

T0 = datetime(2024, 1, 1)


def made_up(seed: int, n: int, first: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = T0 + timedelta(seconds=rng.randrange(-90_000, 90_000))
        length = rng.choice([0, 1, 59, 60, 61, 480, 500, 4_000, 90_000, 40_000_000])
        out.append((first + i, rng.choice(["a", "a", "a", "b", None]), start, start + timedelta(seconds=length)))
    return out + [(first + n, "a", None, T0), (first + n + 1, "a", T0, None), (first + n + 2, "b", T0, T0 - timedelta(1))]


@pytest.mark.parametrize("tile", [3, 2000])
def test_overlaps(spark, tile):
    x, y = made_up(1, 120, 0), made_up(2, 80, 1000)
    x.append(x[0])
    left = spark.createDataFrame(x, "i int, k string, a timestamp_ntz, b timestamp_ntz")
    right = spark.createDataFrame(y, "j int, k string, c timestamp_ntz, d timestamp_ntz")
    got = intervals.overlaps(left, right, ["k"], ["a", "b"], ["c", "d"], tile).select("i", "j").collect()

    def real(row):
        return row[1] is not None and row[2] is not None and row[3] is not None and row[2] < row[3]

    want = [(p[0], q[0]) for p in x for q in y if real(p) and real(q) and p[1] == q[1] and p[2] < q[3] and q[2] < p[3]]
    assert sorted(map(tuple, got)) == sorted(want)
    assert intervals.overlaps(left, right.limit(0), ["k"], ["a", "b"], ["c", "d"]).collect() == []
    with pytest.raises(ValueError, match="both sides"):
        intervals.overlaps(left, left, ["k"], ["a", "b"], ["a", "b"])


def test_buckets_are_narrow_against_the_interval(spark):
    """A bucket as wide as the longer interval or wider holds many short ones that do not meet it."""
    lengths = [1, 59_000_000, *(60_000_000 * n for n in (1, 2, 7, 8, 9, 60, 500, 1999, 10**6, 10**9))]
    at = spark.createDataFrame([(n,) for n in lengths], "n bigint").withColumn("level", intervals._level(F.col("n"))).withColumn("wide", intervals._width("level"))
    for r in at.collect():
        assert r.wide <= max(60_000_000, r.n / 2)
        assert r.n <= intervals.SPAN * r.wide


def test_tasks_follow_the_pairs(spark):
    """So few bytes would be one task, however many pairs they make."""
    left = spark.createDataFrame(made_up(1, 300, 0), "i int, k string, a timestamp_ntz, b timestamp_ntz")
    right = spark.createDataFrame(made_up(2, 300, 0), "j int, k string, c timestamp_ntz, d timestamp_ntz")
    few = intervals.overlaps(left, right, ["k"], ["a", "b"], ["c", "d"])
    many = intervals.overlaps(left, right, ["k"], ["a", "b"], ["c", "d"], 20, 500)
    assert many.rdd.getNumPartitions() > 8 >= few.rdd.getNumPartitions()
    assert rows(many.select("i", "j")) == rows(few.select("i", "j"))


def test_overlap_plan_has_no_nested_loop(spark):
    left = spark.createDataFrame(made_up(1, 20, 0), "i int, k string, a timestamp_ntz, b timestamp_ntz")
    right = spark.createDataFrame(made_up(2, 20, 0), "j int, k string, c timestamp_ntz, d timestamp_ntz")
    plan = intervals.overlaps(left, right, ["k"], ["a", "b"], ["c", "d"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("limit", [5, 10_000])
def test_as_of(spark, limit):
    rng = random.Random(3)

    def when():
        return rng.choice([None, *(T0 + timedelta(minutes=m) for m in range(40))])

    asked = [(i, rng.choice([1, 1, 1, 2, None, 9]), when()) for i in range(120)]
    known = [(rng.choice([1, 1, 2, None]), when(), rng.randrange(100)) for _ in range(60)]
    left = spark.createDataFrame(asked, "i int, k int, at timestamp_ntz")
    right = spark.createDataFrame(known, "k int, since timestamp_ntz, v int")
    got = intervals.as_of(left, right, ["k"], "at", "since", ["since", "v"], rows_per_chunk=limit).collect()
    want = []
    for i, k, at in asked:
        states = [(s, v) for q, s, v in known if q == k and s is not None and at is not None and s <= at]
        want.append((i, k, at, *(max(states) if states else (None, None))))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def drifted(spark, n: int, wrong: int):
    rng = random.Random(n + wrong)
    base = [(i % 50, i, f"v{i % 7}", i / 4) for i in range(n)]
    other = base[:]
    for _ in range(wrong):
        j = rng.randrange(len(other))
        what = rng.randrange(3)
        if what == 0:
            other[j] = (*other[j][:2], "changed", None)
        elif what == 1:
            other.pop(j)
        else:
            other.append((-1, n + j, None, 0.5))
    other += base[:1] * 2 if wrong else []
    ddl = "a int, b int, t string, x double"
    return spark.createDataFrame([*base, (None, 1, "n", None)], ddl), spark.createDataFrame([*other, (None, 1, "n", None)], ddl)


@pytest.mark.parametrize(("wrong", "cells", "attempts"), [(0, 30, 1), (9, 300, 1), (40, 6, 3), (200, 3, 1)])
def test_sketch_diff_equals_row_diff(spark, wrong, cells, attempts):
    source, target = drifted(spark, 600, wrong)
    full = diff.key_status(source, target, ["a", "b"], ["t", "x"]).where("status <> 'SAME'")
    got = sketch.sketch_diff(source, target, ["a", "b"], ["t", "x"], cells, attempts)
    assert rows(got) == rows(full)


def test_sketch_resolves_its_cells(spark):
    source, target = drifted(spark, 600, 30)
    sides = sketch.elements(source, ["a", "b"], ["t", "x"]), sketch.elements(target, ["a", "b"], ["t", "x"])
    cells = sketch.difference(*sides, 300)
    assert cells.count() <= 300
    found, complete = sketch.peel(cells, 300)
    plain = sides[0].withColumn("n", F.lit(1)).union(sides[1].withColumn("n", F.lit(-1))).groupBy("key", "row").agg(F.sum("n").alias("n")).where("n <> 0")
    assert complete and rows(found) == rows(plain)
    assert not sketch.peel(sketch.difference(*sides, 3), 3)[1]
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "partial_sum" in plan


def test_exact_distinct_counts_without_expand(spark):
    data = [(i % 300 - 20, [None, "a", "b"][i % 3], i / 8, i * 100_000_007) for i in range(2000)]
    df = spark.createDataFrame(data, "small int, word string, real double, wide bigint").repartition(3)
    columns = df.columns
    got = {r.column_name: (r.unique_count, r.total_rows) for r in storage.low_cardinality(df, columns, 1000.0, exact=True).collect()}
    assert got == {c: (len({r[i] for r in data} - {None}), 2000) for i, c in enumerate(columns)}
    plan = storage.low_cardinality(df, columns, 1000.0, exact=True)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Join" not in plan
    none = storage.low_cardinality(df.limit(0), ["small", "word"], exact=True)
    assert none.collect() == []
