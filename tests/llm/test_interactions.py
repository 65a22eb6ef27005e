"""Filter interaction audit against all orders run one by one."""

from __future__ import annotations

import random
from fractions import Fraction
from itertools import permutations
from math import factorial

import duckdb
import pytest

from tests.llm.helpers import BLANK_WORD, empty, odd_rows
from tidemark.llm import interactions
from tidemark.llm.queries import INTERACTIONS_SQL, op13


@pytest.mark.parametrize("n", [2, 3, 5])
def test_least_squares_equal_mean_marginal_gains(n):
    values = [random.Random(n).randrange(1000) for _ in range(1 << n)]
    want = [Fraction(0)] * n
    for order in permutations(range(n)):
        done = 0
        for i in order:
            want[i] += Fraction(values[done | 1 << i] - values[done], factorial(n))
            done |= 1 << i
    got = [sum(c * v for c, v in zip(row, values)) for row in interactions.shapley_map(n)]
    assert got == want


def plain(docs: list[tuple], labels: list[tuple]) -> set[tuple]:
    """Rows of the audit, one document, order and step at a time. ``docs``: (id, text, source)."""
    known = {}
    for i, quality, toxic in labels:
        old = known.get(i, (0, 0))
        known[i] = (max(old[0], quality or 0), max(old[1], toxic or 0))
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = BLANK_WORD.findall(text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        rows.append((source or "", fails, *known.get(i, (0, 0))))
    out, share = [], {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if r[1][letter]]
                left = [r for r in left if not r[1][letter]]
                share[part, letter] = share.get((part, letter), 0) + len(gone)
                every = sum(r[1][letter] for r in own)
                alone = sum(r[1][letter] and sum(r[1].values()) == 1 for r in own)
                lost = [sum(r[k] == 1 for r in gone) for k in (2, 3)]
                out.append((part, "".join(order), step, len(left), len(gone), every - len(gone), alone, *lost, letter))
    return {(*r[:-1], share[r[0], r[-1]]) for r in out}


def test_odd_rows_clashing_names_and_repeated_labels(spark):
    names = ["id", "part", "mask", "digest", "first", "good", "toxic", "total", "of_n", "share", "at", "before", "bit", "step"]
    docs = odd_rows(spark).union(spark.createDataFrame([(20, "A " * 60, "en", "s1", 1), (21, "A " * 60, "en", None, 1), (20, "A " * 60, "en", "s1", 1)], "a long, b string, c string, d string, e long"))
    labels = spark.createDataFrame([(20, 1, 0), (20, 0, 1), (21, 1, None), (3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = interactions.filter_audit(docs.selectExpr("*", *[f"7 AS `{n}`" for n in names]), labels).collect()
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = plain(rows, [tuple(r) for r in labels.where("doc_id IS NOT NULL").collect()])
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.filter_audit(empty(spark), labels).collect() == []


def test_query_equals_oracle_without_python(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = op13(spark, sf)
    want = con.execute(INTERACTIONS_SQL)
    names = [c[0] for c in want.description]
    assert {tuple(r) for r in got.select(*names).collect()} == set(want.fetchall())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
