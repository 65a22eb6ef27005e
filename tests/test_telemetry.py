"""Telemetry operators against small hand-made cases and loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import alerts, quality
from tidemark.operators.telemetry import blocking, report_text, storage, trends, waits


def test_head_blockers_chains_cycles_and_strangers(spark):
    links = [(i, i - 1 if i % 50 else None) for i in range(200)]
    links += [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000), (2000, 9999), (2001, 2000)]
    out = blocking.head_blockers(spark.createDataFrame(links, "session_id bigint, blocker_id bigint"))
    got = {r.session_id: (r.head_blocker, r.depth, r.in_cycle) for r in out.collect()}
    want = {i: (i - i % 50, i % 50, False) for i in range(200)}
    want |= {i: (None, None, True) for i in (1000, 1001, 1002, 1003)}
    want |= {2000: (9999, 1, False), 2001: (9999, 2, False)}
    assert got == want
    assert out.count() == len(links)


def test_blocking_stays_within_host_and_snapshot(spark):
    """Three hosts with the same chain 3 -> 2 -> 1, and one row delivered twice."""
    data = [(h, s, b) for h in "abc" for s, b in ((1, None), (2, 1), (3, 2))] + [("a", 2, 1)]
    sessions = spark.createDataFrame(data, "host string, session_id bigint, blocker_id bigint")
    heads = blocking.head_blockers(sessions, scope=["host"])
    assert sorted((r.host, r.session_id, r.head_blocker, r.depth) for r in heads.collect()) == [(h, s, 1, s - 1) for h in "abc" for s in (1, 2, 3)]
    assert {(r.host, r.blocked_sessions) for r in blocking.chains_by_head(heads, ["host"]).collect()} == {(h, 2) for h in "abc"}
    assert blocking.blocking_pairs(sessions, scope=["host"]).count() == 6
    listed = sessions.select("host", "session_id", F.array_compact(F.array("blocker_id")).alias("blockers"))
    assert blocking.blocking_pairs_of_arrays(listed, "session_id", "blockers", ["host"]).count() == 6


def test_head_blockers_without_links(spark):
    out = blocking.head_blockers(spark.createDataFrame([(1, None), (2, None)], "session_id bigint, blocker_id bigint"))
    assert sorted((r.session_id, r.head_blocker, r.depth) for r in out.collect()) == [(1, 1, 0), (2, 2, 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_lock_conflicts_equal_pairs(spark, seed):
    rng = random.Random(seed)
    data = [(i, rng.randrange(8), rng.choice(["r", "s", None]), rng.random() < 0.4, rng.randrange(100)) for i in range(80)]
    locks = spark.createDataFrame(data, "n int, pid int, res string, granted boolean, ts int")
    held: dict = {}
    for _, pid, res, granted, ts in data:
        if granted:
            key = (res, pid)
            held[key] = min(held.get(key, ts), ts)
    want = {}
    for n, pid, res, granted, _ in data:
        others = sorted((since, p) for (r, p), since in held.items() if r == res and p != pid)
        if not granted and others:
            want[n] = (len(others), others[0][1])
    out = blocking.lock_conflicts(locks, ["res"], "pid", "granted", "ts")
    assert {r.n: (r.blocking_holders, r.oldest_holder) for r in out.collect()} == want
    want_pairs = {(w[1], p, w[2]) for w in data if not w[3] for (r, p) in held if r == w[2] and p != w[1]}
    for tile, limit in ((1, 3), (2, 1000), (1000, 1000)):
        pairs = blocking.conflict_pairs(locks, ["res"], "pid", "granted", tile=tile, rows_per_chunk=limit).collect()
        assert len(pairs) == len(want_pairs) and {(r.blocked_pid, r.holder_pid, r.res) for r in pairs} == want_pairs
    some = blocking.conflict_pairs(locks, ["res"], "pid", "granted", "pid IN (1, 2)").collect()
    assert {(r.blocked_pid, r.holder_pid, r.res) for r in some} == {p for p in want_pairs if p[0] in (1, 2)}
    counts = {r.pid: (r.pairs_waiting, r.pairs_holding) for r in blocking.conflict_counts(locks, ["res"], "pid", "granted").collect()}
    assert counts == {d[1]: (sum(p[0] == d[1] for p in want_pairs), sum(p[1] == d[1] for p in want_pairs)) for d in data}
    contended = {d[2] for d in data if d[3]} & {d[2] for d in data if not d[3]}
    assert {r.pid for r in blocking.in_contention(locks, ["res"], "pid", "granted").collect()} == {d[1] for d in data if d[2] in contended}


def test_wait_categories(spark):
    names = ["LCK_M_X", "LCKXM", "PAGEIOLATCH_SH", "WRITELOG", "CXPACKET", "RESOURCE_SEMAPHORE_QUERY", "THREADPOOL", "HADR_SYNC", "PAGELATCH_EX", "ASYNC"]
    df = spark.createDataFrame([(n,) for n in names], "w string").select("w", waits.wait_category(F.col("w")).alias("c"))
    assert [r.c for r in df.collect()] == ["Lock", "Other", "IO/Log", "IO/Log", "Parallelism", "Memory", "CPU/Scheduler", "HADR", "Latch", "Other"]


def test_ratios_of_zero(spark):
    stats = spark.createDataFrame([(0, 5, 0, 9), (2, 50, 0, 0)], "reads int, read_stall_ms int, writes int, write_stall_ms int")
    out = storage.io_latency(stats, 20).collect()
    assert [(r.avg_read_stall_ms, r.avg_write_stall_ms) for r in out] == [(25.0, 0.0)]
    assert spark.range(0).agg(F.lit(1)).count() == 1
    empty = storage.cache_hit(spark.createDataFrame([(0, 0)], "h int, m int"), F.col("h"), F.col("m")).first()
    assert empty.hit_ratio is None


def test_redundant_indexes(spark):
    df = spark.createDataFrame(
        [("t", "a", ["x"]), ("t", "b", ["x", "y"]), ("t", "c", ["x", "y", "z"]), ("t", "d", ["y"]), ("u", "e", ["x"])],
        "t string, i string, c array<string>",
    )
    out = storage.redundant_indexes(df, "t", "i", "c")
    assert sorted((r.i, r.covered_by, r.covering_indexes) for r in out.collect()) == [("a", "b", 2), ("b", "c", 1)]


def test_counter_reset(spark):
    df = spark.createDataFrame([("h", i, i, v) for i, v in enumerate([5, 9, 9, 2, 6])], "h string, t int, n int, v int")
    for limit in (2, 100):
        out = trends.counter_deltas(df, ["h"], "t", "n", "v", rows_per_chunk=limit).orderBy("t").collect()
        assert [(r.delta, r.was_reset) for r in out] == [(None, False), (4, False), (0, False), (2, True), (4, False)]


@pytest.mark.parametrize("limit", [3, 1000])
def test_alerts_must_hold(spark, limit):
    start = datetime(2024, 1, 1)
    p95 = [50, 110, 120, 130, 90, 110, None, 110, 80, 80, 80]
    data = [("h", start + timedelta(minutes=i), float(v) if v else None, 90.0) for i, v in enumerate(p95)]
    df = spark.createDataFrame(data, "host string, ts timestamp_ntz, p95_ms double, cpu_pct double")
    wanted = {"DatabaseLatencyBreach", "DatabaseLatencyWarning", "CpuWithSlowQueries", "DatabaseCPUSaturation"}
    rules = tuple(r for r in alerts.STANDARD_RULES if r.name in wanted)
    out = alerts.fire(df, ["host"], "ts", rules, rows_per_chunk=limit)
    got = sorted((r.alert, r.run_start.minute, r.run_end.minute, r.severity, r.page_after_minutes) for r in out.collect())
    assert got == [
        ("DatabaseCPUSaturation", 0, 10, "Sev-2", 5),
        ("DatabaseLatencyBreach", 1, 3, "Sev-1", 0),
        ("DatabaseLatencyWarning", 1, 5, "Sev-2", 5),
        ("DatabaseLatencyWarning", 7, 10, "Sev-2", 5),
    ]


def test_null_placement(spark, sf):
    from tidemark.plans.registry import load_all

    out = [r.segment for r in load_all()["null_placement"].run(spark, sf).collect()]
    filled = [s for s in out if s is not None]
    assert filled == sorted(filled) and out == filled + [None] * (len(out) - len(filled)) and None in out


def test_promotion_rank_with_a_hot_cluster(spark):
    df = spark.createDataFrame([("c", (i * 7) % 50, f"r{i}") for i in range(50)], "cluster string, lag int, name string")
    out = trends.promotion_rank(df, ["cluster"], F.col("lag") < 40, F.lit(True), "lag", "name", rows_per_chunk=6)
    assert [(r.lag, r.promotion_rank) for r in out.orderBy("lag").collect()] == [(i, i + 1) for i in range(40)]


def test_config_changes(spark):
    ddl = "p string, v string"
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4")], ddl)
    after = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None), ("e", "5")], ddl)
    out = trends.config_changes(before, after, "p", "v")
    assert {r.p: r.change for r in out.collect()} == {"b": "CHANGED", "d": "REMOVED", "e": "ADDED"}


def test_heartbeat_threshold(spark):
    states = [True, False, False, True, False, False, False, False]
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, start + timedelta(minutes=i), i, s) for i, s in enumerate(states)], "k int, ts timestamp_ntz, n int, ok boolean")
    for limit in (2, 100):
        out = trends.failure_runs(df, ["k"], "ts", "n", ~F.col("ok"), 3, rows_per_chunk=limit).collect()
        assert [(r.run_start.minute, r.run_end.minute, r.run_length) for r in out] == [(4, 7, 4)]


def test_forecast_of_a_line(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([("h", start + timedelta(days=i), 10.0 + 0.5 * i) for i in range(20)], "h string, ts timestamp_ntz, v double")
    out = trends.capacity_forecast(df, ["h"], "ts", "v", 30, 60).orderBy("horizon_days").collect()
    assert [r.projected for r in out] == pytest.approx([10 + 0.5 * (19 + h) for h in (30, 90, 180)])
    assert [r.high - r.low for r in out] == pytest.approx([0, 0, 0], abs=1e-6)
    assert [r.trigger for r in out] == ["ALERT", "SCALE", "SCALE"]


def test_sliding_rates_match_direct_windows(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    data = [(start + timedelta(seconds=rng.randrange(3600)), rng.random() < 0.3) for _ in range(200)]
    df = spark.createDataFrame(data, "ts timestamp_ntz, is_error boolean")
    got = trends.sliding_rates(df, "ts", [], "10 minutes", "2 minutes").select("bucket", "events", "errors")
    want = df.groupBy(F.window("ts", "10 minutes", "2 minutes").alias("w")).agg(
        F.count("*").alias("events"), F.count_if("is_error").alias("errors")
    ).select(F.col("w.start").alias("bucket"), "events", "errors")
    assert rows(got) == rows(want)


REPORT = """host: db1
version: 8.0

## Statement Wait Events
Section unavailable: privilege
## Empty
## Table IO

name | reads | writes
---- | ----- | ------
t1 | 5 | 6
broken | 1
t2 | 7 | 8

note: done
## Lock Wait Detail
row_lock seen
"""


def test_report_sections_and_tables(spark):
    df = spark.createDataFrame([(1, REPORT), (2, "## Only\nx"), (3, "")], "id int, text string")
    out = report_text.sections(df, "id", "text").cache()
    assert [(r.id, r.title) for r in out.orderBy("id", "section_no").collect()] == [
        (1, "Overview"), (1, "Statement Wait Events"), (1, "Table IO"), (1, "Lock Wait Detail"), (2, "Only"),
    ]
    classes = out.where("id = 1").orderBy("section_no").select(
        report_text.classify_section(F.col("title"), F.col("content")).alias("s"),
        report_text.classify_section(F.col("title"), F.col("content"), "literal").alias("l"),
    ).collect()
    assert [(r.s, r.l) for r in classes] == [
        ("telemetry", "telemetry"), ("wait events", "waits"), ("table io", "storage latency"), ("lock waits", "waits"),
    ]
    cells = report_text.pipe_tables(out, ["id", "title"], "content")
    assert [[c.cell for c in r.cells] for r in cells.orderBy("row_no").collect()] == [["t1", "5", "6"], ["t2", "7", "8"]]
    pairs = report_text.key_values(out.where("title = 'Overview'"), ["id"], "content")
    assert sorted((r.key, r.value) for r in pairs.collect()) == [("host", "db1"), ("version", "8.0")]
    found = report_text.findings(df, "id", "text")
    assert sorted(r.rule_no for r in found.where("id = 1").collect()) == [0, 2]
    assert [r.rule_no for r in found.where("id = 2").collect()] == [len(report_text.FINDING_RULES)]
    assert len(report_text.FINDING_RULES) == 18
    assert df.select(report_text.unavailable_count(F.col("text"))).first()[0] == 1


def test_regression_gate_is_decimal(spark):
    ddl = "query string, seconds decimal(10,3)"
    base = spark.createDataFrame([("query_0", Decimal("1.0")), ("query_1", Decimal("0.8"))], ddl)
    cur = spark.createDataFrame([("query_0", Decimal("1.1")), ("query_1", Decimal("0.9"))], ddl)
    assert [(r.query, r.status) for r in quality.regression_gate(base, cur).orderBy("query").collect()] == [("query_0", "PASS"), ("query_1", "FAIL")]


def test_contract_and_kpi(spark):
    df = spark.createDataFrame([(1, "5", "1.5"), (2, "x", None)], "k int, order_id string, price string")
    out = quality.contract_violations(df, "k", {"order_id": "int", "price": "double"})
    assert sorted((r.k, r.field, r.reason) for r in out.collect()) == [(2, "order_id", "NOT INT"), (2, "price", "MISSING")]
    kpis = spark.createDataFrame([("cdc_lag_minutes", 7.0), ("row_parity_pct", 99.0), ("query_delta_pct", 5.0)], "kpi string, value double")
    assert {r.kpi: r.status for r in quality.kpi_check(kpis).collect()} == {
        "cdc_lag_minutes": "WARN", "row_parity_pct": "ALERT", "query_delta_pct": "OK",
    }
