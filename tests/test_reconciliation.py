"""Golden reconciliation case, signatures, diffs and repairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.functions.scalars import exact_sum, money_sum
from tidemark.functions.signature import hash_sum, row_number60, segment_digest, signature
from tidemark.operators import compare, diff, integrity, repair

# The published example of two summaries, whose classification must come out the same.
SUMMARY = "schema_name string, table_name string, row_count string, hash_sum string, updated_count string, deleted_count string"
SOURCE = [
    ("public", "orders", "1250000", "9876543210", "8421", "120"),
    ("public", "order_items", "5125000", "1234509876", "14425", "85"),
    ("public", "payments", "850000", "777777777", "2201", "15"),
    ("public", "shipments", "610000", "555550001", "1104", "9"),
    ("public", "audit_log", "25200000", "333330999", "50440", "0"),
]
TARGET = [
    ("public", "orders", "1249985", "9876541111", "8410", "118"),
    ("public", "order_items", "5125000", "1234509876", "14425", "85"),
    ("public", "payments", "850000", "777777700", "2199", "15"),
    ("public", "shipments", "610002", "555550001", "1104", "11"),
    ("public", "audit_log", "25200000", "333330999", "50440", "0"),
]


def test_golden_summaries(spark):
    compared = compare.compare_summaries(spark.createDataFrame(SOURCE, SUMMARY), spark.createDataFrame(TARGET, SUMMARY))
    out = compare.classify(compared).withColumn("literal", compare.gap_class("literal"))
    got = {r.table_name: (r.severity, r.gap_class, r.literal, dict(r.deltas)) for r in out.collect()}
    assert got == {
        "orders": ("SEV1", "CLASS-A", "CLASS-A", {"row_count_delta": -15, "update_delta": -11, "delete_delta": -2}),
        "payments": ("SEV2", "CLASS-B", "CLASS-B", {"update_delta": -2}),
        "shipments": ("SEV2", "CLASS-A", "CLASS-C", {"row_count_delta": 2, "delete_delta": 2}),
        "order_items": ("OK", "OK", "OK", {}),
        "audit_log": ("OK", "OK", "OK", {}),
    }


def test_missing_side_and_lenient_numbers(spark):
    s = spark.createDataFrame([("p", "a", "10.0", "7", "", None)], SUMMARY)
    t = spark.createDataFrame([("p", "b", "3", "7", "0", "0")], SUMMARY)
    got = {r.table_name: (r.severity, dict(r.deltas)) for r in compare.compare_summaries(s, t).collect()}
    assert got == {"a": ("SEV1", {"row_count_delta": -10}), "b": ("SEV1", {"row_count_delta": 3})}


def test_signature_separates_and_normalises(spark):
    df = spark.createDataFrame(
        [("a", None, "b"), ("a", "b", None), ("a|b", "c", "d"), ("a", "b|c", "d"), ("~", "x", "y"), (None, "x", "y"), (" a ", None, "b ")],
        "x string, y string, z string",
    )
    marks = [r[0] for r in df.select(signature(df, ["x", "y", "z"])).collect()]
    assert len(set(marks[:6])) == 6
    assert marks[6] == marks[0]
    one = spark.sql("SELECT CAST(1.50 AS DOUBLE) AS v, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS t, X'0AFF' AS b, true AS f")
    assert one.select(signature(one, ["v", "t", "b", "f"])).first()[0] == "1500000|1704164645000000|0aff|1"


def test_numbers_agree_across_types(spark):
    texts = ["0", "-0.5", "12.345678", "0.0000005", "-123456789.123456", "99999999999999.5", "1E+20", "0.1234565"]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select(
        F.col("x").cast("double").alias("d"), F.col("x").cast("decimal(38,10)").alias("m")
    )
    got = df.select(signature(df, ["d"]).alias("d"), signature(df, ["m"]).alias("m")).collect()
    assert [r.d for r in got] == [r.m for r in got]
    assert [r.d for r in got][:3] == ["0", "-500000", "12345678"]
    odd = spark.sql("SELECT CAST('NaN' AS DOUBLE) AS d UNION ALL SELECT CAST('1E300' AS DOUBLE) UNION ALL SELECT CAST(NULL AS DOUBLE)")
    assert [r[0] for r in odd.select(signature(odd, ["d"])).collect()] == ["NaN", "1.0E300", "~"]


def test_timestamps_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00.000001' AS t UNION ALL SELECT TIMESTAMP_NTZ '2024-03-10 03:30:00.000001'")
    want = [r[0] for r in df.select(signature(df, ["t"])).collect()]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [r[0] for r in df.select(signature(df, ["t"])).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(set(want)) == 2


def test_exact_sums(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (-5.55,), (None,), (90071992547409.93,)], "x double")
    plain = df.agg(F.sum(F.col("x").cast("decimal(18,2)"))).first()[0]
    assert df.agg(money_sum(F.col("x"))).first()[0] == plain
    assert df.where("x > 1e300").agg(money_sum(F.col("x"))).first()[0] is None
    third = spark.createDataFrame([(1 / 3,), (2.5e-7,), (-1.0000005,)], "x double")
    assert third.agg(exact_sum(F.col("x"), 6)).first()[0] == third.agg(F.sum(F.col("x").cast("decimal(18,6)"))).first()[0]


def test_hash_sum_is_exact_and_order_free(spark):
    df = spark.range(5000).select(row_number60(F.col("id").cast("string")).alias("h"))
    plain = df.agg(F.sum(F.col("h").cast("decimal(38,0)"))).first()[0]
    assert df.agg(hash_sum(F.col("h"))).first()[0] == plain
    assert df.repartition(13).agg(hash_sum(F.col("h"))).first()[0] == plain
    assert df.where("h < 0").agg(hash_sum(F.col("h"))).first()[0] == 0


def test_segment_digests_fold_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (105, "d")], "k bigint, v string")
    base = {r.segment: (r.row_count, r.digest) for r in segment_digest(df, "k", ["k", "v"], 100).collect()}
    again = {r.segment: (r.row_count, r.digest) for r in segment_digest(df.repartition(3), "k", ["k", "v"], 100).collect()}
    changed = df.withColumn("v", F.when(F.col("v") == "b", "z").otherwise(F.col("v")))
    other = {r.segment: (r.row_count, r.digest) for r in segment_digest(changed, "k", ["k", "v"], 100).collect()}
    assert base == again and base[0] != other[0] and base[1] == other[1] and base[0][0] == 3


def sides(spark, seed: int):
    rng = random.Random(seed)
    s = [(k, rng.choice([None, rng.randint(0, 3)]), rng.choice([None, "x", "y"])) for k in range(200)]
    t = [(k, v if rng.random() < 0.9 else 9, w if rng.random() < 0.9 else None) for k, v, w in s if rng.random() < 0.9]
    t += [(1000 + i, 1, "e") for i in range(10)]
    return s, t


@pytest.mark.parametrize("seed", [1, 2])
def test_diff_and_repair(spark, seed):
    s, t = sides(spark, seed)
    ddl = "k bigint, v bigint, w string"
    a, b = spark.createDataFrame(s, ddl), spark.createDataFrame(t, ddl)
    sm, tm = {r[0]: r[1:] for r in s}, {r[0]: r[1:] for r in t}
    want = {
        k: "MISSING" if k not in tm else "EXTRA" if k not in sm else "SAME" if sm[k] == tm[k] else "CHANGED" for k in sm.keys() | tm.keys()
    }
    got = {r.k: r.status for r in diff.key_status(a, b, ["k"], ["v", "w"]).collect()}
    assert got == want
    joined = diff.key_status(a, b, ["k"], ["v", "w"], unique_keys=True)
    assert rows(joined) == rows(diff.key_status(a, b, ["k"], ["v", "w"]))
    columns = {r.k: r.changed_columns for r in diff.changed_columns(a, b, ["k"], ["v", "w"]).collect()}
    assert columns == {
        k: ",".join(c for c, x, y in zip("vw", sm[k], tm[k]) if x != y) for k, st in want.items() if st == "CHANGED"
    }
    drilled = diff.drill_down(a, b, ["k"], ["v", "w"], F.floor(F.col("k") / 10))
    assert {r.k: r.status for r in drilled.collect()} == {k: st for k, st in want.items() if st != "SAME"}
    scope = diff.drifted_keys(a, b, ["k"], ["v", "w"])
    assert rows(repair.repair(a, b, scope, ["k"])) == rows(a)
    step = repair.insert_missing(a, repair.delete_extra(a, b, scope, ["k"]), scope, ["k"])
    assert rows(repair.update_changed(a, step, scope, ["k"])) == rows(a)
    assert rows(repair.update_changed(a, repair.delete_extra(a, b, scope, ["k"]), scope, ["k"], insert=True)) == rows(a)
    only = scope.where("k < 20")
    partly = repair.repair(a, b, only, ["k"])
    assert diff.key_status(a, partly, ["k"], ["v", "w"]).where("status <> 'SAME' AND k < 20").isEmpty()
    assert diff.key_status(a, partly, ["k"], ["v", "w"]).where("status <> 'SAME'").count() == sum(
        1 for k, st in want.items() if st != "SAME" and k >= 20
    )


def test_diff_of_repeated_and_hot_keys(spark):
    hot = [(1, "a")] * 500 + [(1, "b")] * 500
    a = spark.createDataFrame([*hot, (2, "x"), (3, "x"), (3, "y")], "k bigint, v string")
    b = spark.createDataFrame([*hot[:-1], (1, "a"), (2, "x"), (3, "y"), (3, "x")], "k bigint, v string")
    got = {r.k: r.status for r in diff.key_status(a, b, ["k"], ["v"]).collect()}
    assert got == {1: "DUPLICATE", 2: "SAME", 3: "SAME"}


def test_id_gaps_match_a_loop(spark):
    rng = random.Random(5)
    ids = sorted(rng.sample(range(500), 300))
    got = integrity.id_gaps(spark.createDataFrame([(i,) for i in ids], "k bigint"), "k", width=16)
    want = [(a + 1, b - 1, b - a - 1) for a, b in zip(ids, ids[1:]) if b - a > 1]
    assert sorted((r.gap_start, r.gap_end, r.missing_ids) for r in got.collect()) == want


def test_rule_violations_ignore_nulls(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "v int")
    got = integrity.violations(df, {"positive": F.col("v") > 0}).first()
    assert (got.rule, got.violations) == ("positive", 1)
