from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
import pytest

from tests.llm.helpers import BLANK_WORD, empty, odd_rows
from tidemark.llm import mixing
from tidemark.llm.queries import op2


def plain_targets(rows):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(BLANK_WORD.findall(t or ""))
    names = sorted(x for x in size if x is not None) + [None] * (None in size)
    weight = {n: 1 + k % 3 for k, n in enumerate(names)}
    total, cut = sum(size.values()), set()
    while True:
        free = [n for n in names if n not in cut]
        level = (total - sum(3 * size[n] for n in cut)) / max(1, sum(weight[n] for n in free))
        above = {n for n in free if level * weight[n] > 3 * size[n]}
        if not above:
            return size, {n: 3 * size[n] if n in cut else level * weight[n] for n in names}
        cut |= above


def check(got, rows, near):
    size, target = plain_targets(rows)
    source = {i: s for i, _, s in rows}
    words = {i: len(BLANK_WORD.findall(t or "")) for i, t, _ in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert (r["size"], r["source_size"]) == (words[r["doc_id"]], size[s])
        assert r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    for s, t in target.items():
        longest = max(words[i] for i in source if source[i] == s)
        assert abs(taken[s] - t) <= max(near * t, min(longest / 2, near * size[s]), 1)


def test_query(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{sf}/documents.parquet'").fetchall()
    got = op2(spark, sf).collect()
    assert len(got) == len(rows)
    check(got, rows, 0.2)  # sources of the smallest tables hold about ten documents, some as long as all others
    assert sorted(got) == sorted(op2(spark, sf).collect())


def test_cut_sources_and_null_source(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "z " * 50, None), (5, "a", "y"), (6, "b " * 7, "y"), (7, " ", "zz")]
    rows += [(k, "w " * (k % 13), "é") for k in range(10, 300)]
    check(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect(), rows, 0.01)


def test_odd_rows(spark):
    rows = odd_rows(spark, "lang string, source string, size long")
    got = mixing.mix(rows).collect()
    assert len(got) == rows.count() and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix(empty(spark)).collect() == []


def test_repeat_follows_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter(copies)


def test_small_bins_give_a_sample_of_the_same_size(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{sf}/documents.parquet'").fetchall()
    for bins in (1, 7):
        check(mixing.mix(docs, bins=bins).collect(), rows, 0.2)


def test_long_documents_are_likelier_and_rates_are_the_odds(spark):
    """Copies per size are on average what the sizes' probabilities say, and those differ."""
    sizes = [5, 40, 256, 900]
    rows = [(i, "w " * sizes[i % 4], "a" if i % 8 < 4 else "b") for i in range(24_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(df).collect()
    source = {i: s for i, _, s in rows}
    copies, n = defaultdict(float), Counter()
    for r in got:
        copies[source[r["doc_id"]], r["size"]] += r["copies"]
        n[source[r["doc_id"]], r["size"]] += 1
    one = {source[r["doc_id"]]: r for r in got}
    for s, r in one.items():
        ratio = r["target"] / r["source_size"]
        lift = {k: 1000 * k // (k + mixing.HALF) for k in sizes}
        mean = sum(lift[k] * k * n[s, k] for k in sizes) / (1000 * r["source_size"])
        rates = []
        for k in sizes:
            want = ratio + min(ratio, 3 - ratio) * (lift[k] / 1000 - mean)
            p = want - int(want)
            rates.append(copies[s, k] / n[s, k])
            assert abs(rates[-1] - want) < 5 * (p * (1 - p) / n[s, k]) ** 0.5 + 2 / n[s, k], (s, k)
        assert rates == sorted(rates) and rates[-1] > rates[0] + 0.3


def test_repeat_keeps_columns_of_any_name(spark):
    names = ["_source", "_copy", "_plan", "_plan_source", "_size", "_u", "size", "u", "source_size", "p_source", "cut", "_COPY2"]
    docs = odd_rows(spark).selectExpr("*", *[f"7 AS `{c}`" for c in names])
    out = mixing.repeat(docs)
    assert out.columns == docs.columns and all(r[c] == 7 for r in out.collect() for c in names)
    plain_copies = {r["doc_id"]: r["copies"] for r in mixing.mix(odd_rows(spark)).collect() if r["doc_id"] == 6}
    assert sum(r["doc_id"] == 6 for r in out.collect()) == plain_copies[6]
