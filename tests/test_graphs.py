"""Reachability, cycles and layers against plain searches over made-up graphs."""

from __future__ import annotations

import random

import pytest

from tidemark.operators import cdc, graphs
from tidemark.operators.telemetry import blocking


def reach(edges: set) -> dict:
    """Node → nodes that one or more edges lead to."""
    out = {a: set() for e in edges for a in e}
    for a in out:
        todo = [a]
        while todo:
            for x, y in edges:
                if x == todo[0] and y not in out[a]:
                    out[a].add(y)
                    todo.append(y)
            todo.pop(0)
    return out


def made_up(seed: int) -> set:
    rng = random.Random(seed)
    n = 30
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([20, 35, 60]))}
    chain = [(100 + i, 101 + i) for i in range(5)]
    ring = [(200 + i, 200 + (i + 1) % 4) for i in range(4)]
    return edges | set(chain) | set(ring) | {(202, 300), (5, 200), (300, 301), (301, 300), (400, 400)}


def frame(spark, edges):
    return spark.createDataFrame([(a, b) for a, b in edges] + [(None, 1), (1, None)], "src bigint, dst bigint")


@pytest.mark.parametrize("seed", [1, 3])
def test_cycles_and_spread(spark, seed):
    edges = made_up(seed)
    far = reach(edges)
    got = {r.node: r.component for r in graphs.components_of_cycles(frame(spark, edges)).collect()}
    assert got == {a: min(b for b in far[a] if a in far[b]) for a in far if a in far[a]}
    seeds = {(300, "x"), (3, "y"), (999, "z")}
    known = graphs.spread(frame(spark, edges), spark.createDataFrame(sorted(seeds), "node bigint, label string")).collect()
    want = seeds | {(a, label) for a in far for b, label in seeds if b in far[a]}
    assert len(known) == len(want) and {tuple(r) for r in known} == want


def test_layers(spark):
    edges = {("b", "a"), ("c", "b"), ("c", "a"), ("d", "x"), ("p", "q"), ("q", "p"), ("r", "p"), ("s", "s")}
    nodes = spark.createDataFrame([(n,) for n in "abcdpqrsa"] + [(None,)], "node string")
    got = graphs.layers(nodes, spark.createDataFrame(sorted(edges), "src string, dst string")).collect()
    ready = {("a", 0), ("b", 1), ("c", 2), ("d", 0)}
    assert {tuple(r) for r in got} == {(n, i, "READY") for n, i in ready} | {(n, None, "CYCLE") for n in "pqs"} | {("r", None, "BLOCKED")}
    none = spark.createDataFrame([], "node string")
    assert graphs.layers(none, spark.createDataFrame([], "src string, dst string")).collect() == []


def test_replay_layers_follow_links(spark):
    rng = random.Random(7)
    links = {(f"t{a}", f"t{b}") for a, b in ((rng.randrange(1, 40), rng.randrange(40)) for _ in range(60)) if a > b}
    tables = spark.createDataFrame([(f"t{i}",) for i in range(40)], "table_name string")
    got = {r.table_name: r.layer for r in cdc.replay_layers(tables, spark.createDataFrame(sorted(links), "child string, parent string")).collect()}
    assert len(got) == 40
    for i in range(40):
        above = [got[p] for c, p in links if c == f"t{i}"]
        assert got[f"t{i}"] == max(above, default=-1) + 1


@pytest.mark.parametrize("seed", [1, 2])
def test_head_sets(spark, seed):
    rng = random.Random(seed)
    listed = [(h, i, rng.choice([None, [], [rng.randrange(25)], [rng.randrange(25)], [rng.randrange(25), rng.randrange(25), None]])) for h in (1, None) for i in range(20)]
    listed += [(1, 50 + i, [51 + i]) for i in range(9)] + [(1, 80, [80]), (1, 81, [80]), (1, 82, [80, 3]), (1, 3, [50]), (1, None, [3])]
    sessions = spark.createDataFrame(listed, "host int, session_id bigint, blockers array<bigint>")
    got = {tuple(r) for r in blocking.head_sets(sessions, scope=["host"]).collect()}
    rings = {tuple(r) for r in blocking.blocking_cycles(sessions, scope=["host"]).collect()}
    want, cycles = set(), set()
    for host in (1, None):
        edges = {(i, b) for h, i, own in listed if h == host and i is not None for b in own or [] if b is not None}
        far = reach(edges)
        waits = {a for a, _ in edges}
        want |= {(host, a, b) for a in waits for b in far[a] if b not in waits}
        cycles |= {(host, min(b for b in far[a] if a in far[b]), a) for a in far if a in far[a]}
    assert got == want and rings == cycles


def test_head_sets_without_waiters(spark):
    sessions = spark.createDataFrame([(1, []), (2, None)], "session_id bigint, blockers array<bigint>")
    assert blocking.head_sets(sessions).collect() == [] and blocking.blocking_cycles(sessions).collect() == []


def test_no_table_of_the_graph_is_broadcast(spark, monkeypatch):
    """As files, regular ids are so small that joins by size would send them to the driver."""
    plans, write = [], graphs.materialize

    def recorded(df, name="step"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(graphs, "materialize", recorded)
    ring = spark.createDataFrame([(1, i, [(i + 1) % 9, i + 20]) for i in range(9)] + [(1, 30, [31]), (1, 31, [])], "host int, session_id bigint, blockers array<bigint>")
    found = blocking.blocking_cycles(sessions=ring, scope=["host"])
    assert {tuple(r) for r in found.collect()} == {(1, 0, i) for i in range(9)}
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)
