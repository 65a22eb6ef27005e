"""Engine detectors, daily pack, replicas, space, panels and two-sided parity on small tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import compare, integrity
from tidemark.operators.telemetry import health

NOW = "2024-01-31 00:00:00"
T = datetime(2024, 1, 31)


def test_engine_detectors(spark):
    minutes = lambda m: T - timedelta(minutes=m)
    sessions = spark.createDataFrame(
        [
            ("oracle", "o1", minutes(1), "ACTIVE", 601, "USER", None, 0, None),
            ("oracle", "o1", minutes(5), "ACTIVE", 600, "USER", 7, 0, None),
            ("oracle", "o1", minutes(6), "ACTIVE", 900, "BACKGROUND", None, 0, None),
            ("sqlserver", "s1", None, "ACTIVE", 900, "USER", 0, 30_001, None),
            ("postgres", "p1", None, "idle", 0, "USER", 5, 0, minutes(11)),
            ("postgres", "p1", None, "idle", 0, "USER", None, 0, minutes(10)),
            ("mysql", "m1", minutes(1), "ACTIVE", 999, "USER", 3, 99_999, minutes(99)),
            ("oracle", "o2", minutes(1), "IDLE", 0, "USER", None, 0, None),
        ],
        "engine string, host string, sampled_at timestamp_ntz, status string, last_call_s int, kind string, blocker_id int, elapsed_ms int, xact_start timestamp_ntz",
    )
    schedulers = spark.createDataFrame([("sqlserver", "s1", "VISIBLE ONLINE", 1), ("sqlserver", "s1", "HIDDEN", 9), ("oracle", "o1", "VISIBLE ONLINE", 1)], "engine string, host string, status string, runnable_tasks int")
    statements = spark.createDataFrame([("postgres", "p1", 251.0, 0), ("mysql", "m1", 201.0, 1), ("mysql", "m1", None, 2), ("oracle", "o1", 999.0, 9)], "engine string, host string, mean_ms double, no_index_used int")
    settings = spark.createDataFrame([("o1", "cpu_count", 1), ("o1", "other", 99)], "host string, setting string, value int")
    got = health.detect_engines({"sessions": sessions, "samples": sessions, "schedulers": schedulers, "statements": statements}, settings, NOW)
    assert rows(got.select("host", "issue", "observed", "threshold")) == sorted(
        [
            ("o1", "AAS_CPU_PRESSURE", 2.0, 1.0),
            ("o1", "BLOCKING_SESSIONS", 1.0, 0.0),
            ("o1", "LONG_ACTIVE_SESSIONS_OVER_10M", 1.0, 0.0),
            ("s1", "CPU_RUNNABLE_TASKS", 1.0, 0.0),
            ("s1", "LONG_REQUESTS_OVER_30S", 1.0, 0.0),
            ("p1", "BLOCKED_SESSIONS", 1.0, 0.0),
            ("p1", "LONG_XACTS_OVER_10M", 1.0, 0.0),
            ("p1", "MEAN_QUERY_TIME_OVER_250MS", 1.0, 0.0),
            ("m1", "DIGESTS_AVG_OVER_200MS", 1.0, 0.0),
            ("m1", "STATEMENTS_WITH_NO_INDEX", 2.0, 0.0),
        ],
        key=repr,
    )


def test_daily_pack(spark):
    values = spark.createDataFrame([("a", 5.0), ("b", 11.0), ("c", 21.0), ("d", None)], "host string, value double")
    got = health.daily_pack([health.Check("up", values, 10, 20), health.Check("down", values, 20, 10, True)])
    want = {("up", "a", "OK"), ("up", "b", "WARN"), ("up", "c", "FAIL"), ("up", "d", "UNKNOWN"), ("down", "a", "FAIL"), ("down", "b", "WARN"), ("down", "c", "OK"), ("down", "d", "UNKNOWN")}
    assert {(r.check_name, r.host, r.status) for r in got.collect()} == want


def test_replica_health(spark):
    data = [
        (1, None, True, False, 1, 0, 0, "DISCONNECTED"),
        (2, True, True, True, 99, 0, 0, "READ_ONLY"),
        (3, True, True, False, None, 0, 0, "LAG_UNKNOWN"),
        (4, True, False, False, 61, 500, None, "LAG"),
        (5, True, True, None, 60, 60, 41, "QUEUE"),
        (6, True, None, False, 0, None, None, "NOT_SYNCHRONIZED"),
        (7, True, True, None, 0, 100, None, "NONE"),
    ]
    df = spark.createDataFrame(data, "id int, connected boolean, synchronized boolean, is_readonly boolean, lag_s int, send_queue int, redo_queue int, want string")
    out = health.replica_health(df).collect()
    assert all(r.reason == r.want for r in out)
    assert [r.status for r in sorted(out)] == ["CRITICAL", "CRITICAL", "DEGRADED", "DEGRADED", "DEGRADED", "DEGRADED", "HEALTHY"]


def test_largest_objects_and_space(spark):
    data = [("a", "x", 5), ("a", "y", 5), ("a", "z", 90), ("b", "x", 0), (None, "x", 7), ("b", "w", None)]
    df = spark.createDataFrame(data, "owner string, name string, bytes bigint")
    out = health.largest_objects(df, ["owner"], "bytes", 2)
    assert rows(out.select("owner", "name", "rank", "share_pct")) == sorted(
        [("z", "a", 1, 90.0), ("x", "a", 2, 5.0), ("x", None, 1, 100.0), ("x", "b", 1, None), ("w", "b", 2, None)], key=repr
    )
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    used = health.space_used(spark.createDataFrame([("t", 96, 100), ("u", 90, 100), ("v", 0, 0), ("w", 1, 100)], "t string, u int, s int"), ["t"], F.col("u"), F.col("s"))
    assert {r.t: r.status for r in used.collect()} == {"t": "FAIL", "u": "WARN", "v": "UNKNOWN", "w": "OK"}


def test_panels_sort_nulls_last_and_ties_by_item(spark):
    df = spark.createDataFrame([("b", 1, 9), ("a", 1, 9), ("c", None, 99), ("d", 3, None)], "k string, x int, y int")
    got = health.panels([health.Panel("p", df, "k", {"x": "x", "twice": "y * 2"}, ("x", "y"), 3)])
    assert [(r.rank, r.item, r.measure, r.value) for r in sorted(got.collect(), key=lambda r: (r["rank"], r.measure))] == [
        (1, "d", "twice", None), (1, "d", "x", 3.0), (2, "a", "twice", 18.0), (2, "a", "x", 1.0), (3, "b", "twice", 18.0), (3, "b", "x", 1.0)
    ]


def test_two_sided_parity(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 5), (None, 3)], "k string, v int")
    b = spark.createDataFrame([("x", 4), ("z", 7), (None, 3)], "k string, v int")
    got = integrity.parity_by(a, b, ["k"], {"n": F.count("*"), "s": F.sum("v")})
    names = ["k", "source_n", "target_n", "n_delta", "source_s", "target_s", "s_delta"]
    assert {tuple(r[n] for n in names) for r in got.collect()} == {("x", 2, 1, -1, 3, 4, 1), ("y", 1, 0, -1, 5, 0, -5), ("z", 0, 1, 1, 0, 7, 7), (None, 1, 1, 0, 3, 3, 0)}
    top = integrity.top_parity(a, b, "k", F.sum("v"), 2)
    assert {(r.k, r.value_delta, r.source_rank, r.target_rank) for r in top.collect()} == {("y", -5, 1, None), (None, 0, 2, None), ("z", 7, None, 1), ("x", 1, None, 2)}


@pytest.mark.parametrize(("pct", "low", "want"), [(99.99, True, "PASS"), (99.98, True, "FAIL"), (99.99, False, "FAIL"), (100.0, False, "PASS"), (None, True, "FAIL")])
def test_low_risk_tier(spark, pct, low, want):
    rates = spark.createDataFrame([("t", pct)], "table_name string, match_pct double")
    assert compare.tier_gate(rates, F.lit(low)).first().status == want
