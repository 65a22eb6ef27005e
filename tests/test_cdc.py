"""Change application against a row-at-a-time loop."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import cdc


def make_log(rng: random.Random, size: int, keys: int) -> list[tuple]:
    return [
        (rng.randrange(keys) if rng.random() < 0.7 else 0, rng.choice("IUUD"), rng.choice([None, rng.randint(0, 9)]), rng.choice("abc"), (i // 3, i))
        for i in range(size)
    ]


LOG = "id bigint, op string, a bigint, b string, seq struct<scn: bigint, n: bigint>"
TARGET = "id bigint, a bigint, b string"


@pytest.mark.parametrize("seed", range(4))
def test_full_apply_equals_loop(spark, seed):
    rng = random.Random(seed)
    target = [(k, k * 10, "t") for k in range(0, 12, 2)]
    log = make_log(rng, 120, 12)
    state = {k: (a, b) for k, a, b in target}
    for key, op, a, b, _ in log:
        if op == "D":
            state.pop(key, None)
        else:
            state[key] = (a, b)
    shuffled = log[:]
    rng.shuffle(shuffled)
    t, l = spark.createDataFrame(target, TARGET), spark.createDataFrame(shuffled, LOG)
    once = cdc.apply_full(t, l, ["id"])
    assert rows(once) == rows(spark.createDataFrame([(k, *v) for k, v in state.items()], TARGET))
    assert rows(cdc.apply_full(once, l, ["id"])) == rows(once)
    assert rows(cdc.apply_full(t, l.unionByName(l), ["id"])) == rows(once)


def partial_loop(target: list[tuple], log: list[tuple], create: bool) -> dict:
    state = {k: {"a": a, "b": b} for k, a, b in target}
    for key, op, data, _ in log:
        if op == "D":
            state.pop(key, None)
        elif op == "I":
            state[key] = {"a": None, "b": None, **data}
        elif key in state or create:
            state.setdefault(key, {"a": None, "b": None}).update(data)
    return state


@pytest.mark.parametrize("seed", range(4))
def test_partial_apply_equals_loop(spark, seed):
    rng = random.Random(seed)
    target = [(k, k * 10, "t") for k in range(0, 10, 2)]
    log = []
    for i in range(100):
        data = {}
        if rng.random() < 0.6:
            data["a"] = rng.choice([None, str(rng.randint(0, 9))])
        if rng.random() < 0.6:
            data["b"] = rng.choice([None, rng.choice("xyz")])
        log.append((rng.randrange(10), rng.choice("IUUUD"), data, (i,)))
    typed = [(k, op, {c: (int(v) if c == "a" and v is not None else v) for c, v in d.items()}, s) for k, op, d, s in log]
    shuffled = log[:]
    rng.shuffle(shuffled)
    l = spark.createDataFrame(shuffled, "id bigint, op string, data map<string,string>, seq struct<n: bigint>")
    t = spark.createDataFrame(target, TARGET)
    want = [(k, v["a"], v["b"]) for k, v in partial_loop(target, typed, True).items()]
    assert rows(cdc.apply_partial(t, l, ["id"])) == rows(spark.createDataFrame(want, TARGET))


def test_partial_without_create(spark):
    log = [(1, "U", {"a": "5"}, (1,)), (2, "U", {"a": "6"}, (2,)), (3, "I", {"b": "n"}, (3,)), (3, "U", {"a": None}, (4,))]
    l = spark.createDataFrame(log, "id bigint, op string, data map<string,string>, seq struct<n: bigint>")
    t = spark.createDataFrame([(1, 10, "t")], TARGET)
    assert [tuple(r) for r in cdc.apply_partial(t, l, ["id"], create=False).orderBy("id").collect()] == [(1, 5, "t"), (3, None, "n")]


@pytest.mark.parametrize("limit", [6, 10_000])
def test_conflicts_equal_loop(spark, limit):
    rng = random.Random(11)
    target = [(k, 0, "t") for k in range(0, 8, 2)]
    log = make_log(rng, 100, 8)
    held = {k for k, _, _ in target}
    want = {}
    for key, op, _, _, seq in log:
        exists = key in held
        want[seq[1]] = (
            "DUPLICATE_INSERT" if op == "I" and exists else "MISSING_ON_UPDATE" if op == "U" and not exists
            else "MISSING_ON_DELETE" if op == "D" and not exists else "NONE"
        )
        if op == "I":
            held.add(key)
        elif op == "D":
            held.discard(key)
    l = spark.createDataFrame(log, LOG).withColumn("n", F.col("seq.n")).withColumn("scn", F.col("seq.scn"))
    marked = cdc.conflicts(spark.createDataFrame(target, TARGET), l, ["id"], ["scn", "n"], rows_per_chunk=limit)
    assert {r.n: r.conflict for r in marked.collect()} == want
    with pytest.raises(ValueError):
        cdc.resolve_conflicts(marked, "ABORT")
    kept = cdc.resolve_conflicts(marked, "UPSERT", "SKIP")
    assert kept.where("conflict LIKE 'MISSING%'").isEmpty() and not kept.where("conflict = 'DUPLICATE_INSERT'").isEmpty()


def test_flat_rows(spark):
    captured = spark.createDataFrame(
        [(2, "01", "a", 1, "x"), (3, "02", "a", 1, "x"), (4, "03", "a", 1, "y"), (1, "04", "a", 2, None), (4, "05", "a", None, "z"), (9, "06", "a", 5, "q")],
        "`__$operation` int, `__$start_lsn` string, `__$seqval` string, id int, v string",
    )
    out = cdc.flat_changes(captured, ["id"])
    assert out.columns == ["id", "v", "op", "seq"]
    assert [(r.id, r.op, r.v) for r in out.orderBy("seq").collect()] == [(1, "I", "x"), (1, "U", "y"), (2, "D", None)]


def test_checkpoint_is_per_table(spark):
    stored = spark.createDataFrame([("a", 5, None, 2)], "table_name string, last_scn bigint, last_timestamp timestamp_ntz, rows_applied bigint")
    log = spark.createDataFrame([("a", 4), ("a", 9), ("b", 3)], "table_name string, scn bigint").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    fresh = cdc.after_checkpoint(log, stored)
    assert sorted((r.table_name, r.scn) for r in fresh.collect()) == [("a", 9), ("b", 3)]
    moved = cdc.advance_checkpoint(stored, fresh, "2024-01-01")
    assert sorted((r.table_name, r.last_scn, r.rows_applied) for r in moved.collect()) == [("a", 9, 3), ("b", 3, 1)]


def test_replay_follows_the_dependency_order(spark):
    ddl = "table_name string, id bigint, op string, a bigint, b string, seq struct<n: bigint>"
    log = spark.createDataFrame([("kid", 1, "I", 1, "k", (2,)), ("mum", 1, "I", 2, "m", (1,)), ("kid", 1, "U", 3, "k", (3,))], ddl)
    empty = spark.createDataFrame([], TARGET)
    out = cdc.replay_tables({"kid": empty, "mum": empty}, log, {"kid": ["id"], "mum": ["id"]}, ["mum", "kid"])
    assert list(out) == ["mum", "kid"]
    assert rows(out["kid"]) == [(3, "k", 1)] and rows(out["mum"]) == [(2, "m", 1)]


def test_history_and_sanity_with_hot_table(spark):
    log = spark.createDataFrame([("t", i, (i * 7) % 11, "U") for i in range(50)], "table_name string, n bigint, pos bigint, op string")
    small, big = (cdc.replay_sanity(log, "n", "pos", ["table_name"], rows_per_chunk=r).first() for r in (4, 10_000))
    assert small == big
    h = cdc.history(log.withColumn("k", F.lit(1)), ["k"], ["n"], "n", rows_per_chunk=4)
    assert [r.valid_to for r in h.orderBy("n").collect()] == [*range(1, 50), None]
