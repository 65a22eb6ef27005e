"""Streams: resume, late data, replayed batches, order across batches, dead letters."""

from __future__ import annotations

import json
import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import cdc
from tidemark.operators.ordered import runs
from tidemark.sources.readers import parse_lines
from tidemark.streaming import flows, heartbeat
from tidemark.streaming.store import ChangeStore

STATE = "id bigint, v bigint"
LOG = "id bigint, op string, v bigint, seq struct<n: bigint>"


def land(path, lines: list[str], name: str) -> None:
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def change(n: int, key: int, op: str, v) -> str:
    return json.dumps({"id": key, "op": op, "v": v, "seq": {"n": n}})


def test_change_stream(spark, tmp_path):
    landing, root = str(tmp_path / "in"), str(tmp_path / "store")
    store = ChangeStore(spark, root, ("id",), STATE, LOG)
    store.seed(spark.createDataFrame([(1, 0), (2, 0), (3, 0)], STATE))
    step = flows.apply_changes(store, ["id", "op"])

    def run():
        flows.run_available(flows.line_stream(spark, landing, max_files=1), step, str(tmp_path / "cp"))

    # a late change for key 1 (n=1) arrives after a newer one; key 2 is deleted before an older update arrives
    land(landing, [change(5, 1, "U", 50), "", change(6, 2, "D", None), "{broken"], "a.json")
    run()
    land(landing, [change(1, 1, "U", 10), change(2, 2, "U", 20)], "b.json")
    land(landing, [change(7, 4, "I", 70), change(8, 5, "Q", 1), json.dumps({"op": "I", "v": 1})], "c.json")
    run()
    want = [(1, 50), (3, 0), (4, 70)]
    assert rows(store.current()) == want
    assert sorted(r.reason for r in store.dead().collect()) == ["MALFORMED", "MISSING FIELD", "UNKNOWN OPERATION"]
    mark = store.checkpoint().first()
    assert (mark.last_seq.n, mark.rows_applied) == (7, 5)
    # the same batch delivered again overwrites itself
    step(spark.createDataFrame([(change(5, 1, "U", 50),), (change(6, 2, "D", None),)], "value string"), 0)
    assert rows(store.current()) == want
    store.compact(2)
    assert store.base_batch() == 2 and rows(store.current()) == want
    assert sorted((r.id, r.op) for r in store.base().collect()) == [(1, "U"), (2, "D"), (3, "I"), (4, "I")]
    # changes older than what the base has seen arrive after the compaction
    land(landing, [change(2, 1, "U", 11), change(3, 2, "I", 21)], "d.json")
    run()
    assert rows(store.current()) == want
    store.compact(3, forget="seq.n < 7")
    assert rows(store.current()) == want and [r.id for r in store.base().where("op = 'D'").collect()] == []
    # nothing new: a restart on the same checkpoint applies nothing
    run()
    assert rows(store.current()) == want


def test_restart_from_position(spark, tmp_path):
    landing = str(tmp_path / "in")
    land(landing, [change(n, n, "I", n) for n in range(10)], "a.json")
    store = ChangeStore(spark, str(tmp_path / "store"), ("id",), STATE, LOG)
    step = flows.apply_changes(store, ["id", "op"], start="seq.n > 6")
    flows.run_available(flows.line_stream(spark, landing), step, str(tmp_path / "cp"))
    assert [r[0] for r in rows(store.current())] == [7, 8, 9]


def test_polling(spark, tmp_path):
    landing, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    land(landing, ["one"], "a.txt")
    query = flows.start_batches(
        flows.line_stream(spark, landing), flows.upsert_sink(sink), str(tmp_path / "cp"), every="1 second"
    )
    try:
        query.processAllAvailable()
        land(landing, ["two", "three"], "b.txt")
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.value for r in spark.read.parquet(sink).collect()) == ["one", "three", "two"]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    log = [(rng.randrange(20), rng.choice("IUUD"), rng.randrange(9), n) for n in range(200)]
    shuffled = log[:]
    rng.shuffle(shuffled)
    landing = str(tmp_path / "in")
    store = ChangeStore(spark, str(tmp_path / "store"), ("id",), STATE, LOG)
    step = flows.apply_changes(store, ["id", "op"], dedupe_on=["id", "seq"])
    for i in range(4):
        part = shuffled[i * 50 : (i + 1) * 50]
        land(landing, [change(n, k, op, v) for k, op, v, n in part + part[:5]], f"{i}.json")
    flows.run_available(flows.line_stream(spark, landing, max_files=1), step, str(tmp_path / "cp"))
    assert store.changes().select("batch_id").distinct().count() == 4
    frame = spark.createDataFrame([(k, op, v, (n,)) for k, op, v, n in log], LOG)
    assert rows(store.current()) == rows(cdc.apply_full(spark.createDataFrame([], STATE), frame, ["id"]))


def test_late_rows_are_dropped(spark, tmp_path):
    landing, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    t0 = datetime(2024, 1, 1)

    def line(minutes: int, bad: bool = False) -> str:
        return json.dumps({"ts": (t0 + timedelta(minutes=minutes)).isoformat() + ".000000", "is_error": bad})

    def run():
        parsed = parse_lines(flows.line_stream(spark, landing), "ts timestamp_ntz, is_error boolean")
        rates = flows.windowed_rates(parsed, "ts", [], "10 minutes")
        flows.run_available(rates, flows.upsert_sink(sink), str(tmp_path / "cp"), "update")

    land(landing, [line(0), line(1, True), line(60)], "a.json")
    run()
    # 55 is within ten minutes of 60, 2 is not
    land(landing, [line(55), line(2)], "b.json")
    run()
    got = {r.bucket: (r.events, r.errors) for r in flows.latest_rows(spark, sink, ["bucket"]).collect()}
    assert got == {t0: (2, 1), t0 + timedelta(minutes=55): (1, 0), t0 + timedelta(minutes=60): (1, 0)}


def test_heartbeat_across_batches(spark, tmp_path):
    rng = random.Random(4)
    t0 = datetime(2024, 1, 1)
    data = [(rng.choice([1, 1, 1, 2, 3]), t0 + timedelta(minutes=i), i, rng.random() < 0.7) for i in range(150)]
    ddl = "k bigint, ts timestamp_ntz, n bigint, failed boolean"
    root = str(tmp_path / "hb")
    step = flows.heartbeat_step(spark, root, "k", "ts", "n", "failed", rows_per_chunk=10)
    for batch_id, start in enumerate(range(0, 150, 30)):
        part = data[start : start + 30]
        if batch_id == 2:
            part = [r for r in part if r[0] != 3]
        step(spark.createDataFrame(part, ddl), batch_id)
    kept = [r for i, r in enumerate(data) if not (60 <= i < 90 and r[0] == 3)]
    whole = runs(spark.createDataFrame(kept, ddl), ["k"], ["ts", "n"], F.col("failed")).where("run_length >= 3")
    got = flows.latest_rows(spark, f"{root}/runs", ["k", "run_start"])
    assert rows(got) == rows(whole.select("k", "run_start", "run_end", "run_length"))


def test_heartbeat_in_event_time(spark, tmp_path):
    """Events in any order give the runs of the ordered table; what comes after the watermark is a dead letter."""
    rng = random.Random(9)
    t0 = datetime(2024, 1, 1)
    data = [(rng.choice([1, 1, 1, 2, 3]), t0 + timedelta(seconds=37 * (i // 2)), i, rng.random() < 0.75) for i in range(400)]
    data += [(4, t0 + timedelta(minutes=i), 500 + i, True) for i in range(0, 180, 7)]
    landing, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    ddl = "k bigint, ts timestamp_ntz, n bigint, failed boolean"

    def line(k, ts, n, failed):
        return json.dumps({"k": k, "ts": ts and ts.isoformat() + ".000000", "n": n, "failed": failed})

    def run():
        parsed = parse_lines(flows.line_stream(spark, landing, max_files=1), ddl).drop("_corrupt")
        pieces = heartbeat.event_time_pieces(parsed, "k", "ts", "n", "failed", "5 hours", bucket_seconds=600)
        flows.run_available(pieces, flows.upsert_sink(sink), str(tmp_path / "cp"))

    shuffled = data[:]
    rng.shuffle(shuffled)
    for i in range(3):
        land(landing, [line(*r) for r in shuffled[i::3]], f"{i}.json")
    land(landing, [line(1, None, 900, True)], "3.json")
    run()
    land(landing, [line(None, t0 + timedelta(days=1), 0, None)], "4.json")
    run()
    late = [(1, t0 + timedelta(minutes=1), 901, False), (7, t0 + timedelta(minutes=2), 902, True)]
    land(landing, [line(*r) for r in late], "5.json")
    run()
    pieces = spark.read.parquet(sink)
    whole = runs(spark.createDataFrame(data, ddl), ["k"], ["ts", "n"], F.col("failed")).where("run_length >= 3")
    want = rows(whole.select(F.col("k").alias("target"), "run_start", "run_end", "run_length"))
    assert rows(heartbeat.failure_runs(pieces)) == want
    assert rows(heartbeat.failure_runs(pieces, rows_per_chunk=5)) == want
    dead = sorted((tuple(r) for r in heartbeat.dead_letters(pieces).collect()), key=repr)
    assert dead == sorted([*((k, ts, n, "LATE") for k, ts, n, _ in late), (1, None, 900, "NO TIME")], key=repr)


def _many_targets(tmp_path) -> tuple[list[tuple], list[tuple], str]:
    """3,000 targets over two buckets, with ids and ties that only 64 bits hold, landed as one file; then a tick and late events."""
    rng = random.Random(12)
    t0 = datetime(2024, 1, 1)
    data = [((1 << 60) + rng.randrange(3000), t0 + timedelta(seconds=rng.randrange(1200)), (1 << 61) + i, rng.random() < 0.7) for i in range(24_000)]
    data += [((1 << 60) + 5, t0 + timedelta(seconds=3), None, True)]
    landing = str(tmp_path / "in")

    def line(k, ts, n, failed):
        return json.dumps({"k": k, "ts": ts and ts.isoformat() + ".000000", "n": n, "failed": failed})

    land(landing, [line(*r) for r in data], "0.json")
    land(landing, [line(None, t0 + timedelta(days=1), 0, None)], "1.json")
    late = [(k, ts, n, f) for k, ts, n, f in data[:500]] + [(7, t0, None, True), (8, None, (1 << 61) + 1, True), (8, None, None, True)]
    land(landing, [line(*r) for r in late], "2.json")
    return data, late, landing


DDL = "k bigint, ts timestamp_ntz, n bigint, failed boolean"


def _pieces_of_many(spark, tmp_path, landing: str):
    parsed = parse_lines(flows.line_stream(spark, landing, max_files=1), DDL).drop("_corrupt")
    pieces = heartbeat.event_time_pieces(parsed, "k", "ts", "n", "failed", "1 hour", bucket_seconds=600)
    query = flows.start_batches(pieces, flows.upsert_sink(str(tmp_path / "sink")), str(tmp_path / "cp"))
    query.awaitTermination()
    held = max(p["stateOperators"][0]["numRowsTotal"] for p in map(json.loads, (p.json for p in query.recentProgress)) if p["stateOperators"])
    return spark.read.parquet(str(tmp_path / "sink")), held


def test_dead_letters_of_many_targets(spark, tmp_path):
    """The state has a row per shard and bucket, not per target and bucket; each late event is a dead letter as it came."""
    data, late, landing = _many_targets(tmp_path)
    pieces, held = _pieces_of_many(spark, tmp_path, landing)
    assert 0 < held <= 2 * heartbeat.SHARDS
    got = sorted((tuple(r) for r in heartbeat.dead_letters(pieces).collect()), key=repr)
    assert got == sorted([(k, ts, n, "LATE" if ts else "NO TIME") for k, ts, n, _ in late], key=repr)


def test_runs_of_many_targets(spark, tmp_path):
    """Runs of targets that share a shard's call are those of the ordered table."""
    data, _, landing = _many_targets(tmp_path)
    pieces, held = _pieces_of_many(spark, tmp_path, landing)
    assert 0 < held <= 2 * heartbeat.SHARDS
    whole = runs(spark.createDataFrame(data, DDL), ["k"], ["ts", "n"], F.col("failed")).where("run_length >= 3")
    assert rows(heartbeat.failure_runs(pieces)) == rows(whole.select(F.col("k").alias("target"), "run_start", "run_end", "run_length"))
    few = pieces.where("kind = 'RUN'").agg(F.min("length")).first()[0]
    assert few is None or few >= 3
