"""Source divergence audit against shares computed term by term."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import LOWER, empty, odd_rows
from tidemark.llm import divergence
from tidemark.llm.queries import DIVERGENCE_SQL, op12
from tidemark.llm.textbits import cut

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows: list[tuple], least: int = 3, top: int = 200) -> set[tuple]:
    """The audit of rows (lang, source, text) by dictionaries."""
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(words)
        held[lang or ""].update(set(words))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in held.items()}
    whole = defaultdict(Counter)
    for (lang, _), c in counts.items():
        whole[lang].update(c)

    def shares(c, lang):
        total = sum(c[t] for t in kept[lang]) + len(kept[lang])
        return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept[lang]}

    out = set()
    for (lang, source), c in counts.items():
        p, q = shares(c, lang), shares(whole[lang], lang)
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept[lang] if c[t] and p[t] > q[t]]
        out |= {(lang, source, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms), 1) if i <= top}
        pairs = []
        for (other, name), d in counts.items():
            if other == lang and name != source:
                r = shares(d, lang)
                pairs.append((-sum((p[t] - r[t]) ** 2 // r[t] for t in kept[lang]), name.encode(), name))
        out |= {(lang, source, "pair", n, -v, i) for i, (v, _, n) in enumerate(sorted(pairs), 1)}
    return out


def made_up() -> list[tuple]:
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        lang, source = ("en", "fr", None, "solo")[i % 4], f"s{(i // 4) % 7}" if i % 4 != 3 else None
        words = [f"{'ABé東'[k % 4]}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in rng.zipf(1.3, 60) % 400]
        rows.append((lang, source, ("-" if i % 3 else "\x00").join(words)))
    return rows + [("en", "bare", "12 34"), ("en", "bare", None), ("xx", "a", "one two"), ("xx", "b", "one two"), (None, None, "")]


@pytest.mark.parametrize(("frequent", "narrow", "wide", "tile"), [(256, 64, 4096, 512), (8, 3, 70, 5), (10**9, 64, 200, 1)])
def test_equals_plain_shares_whatever_the_blocks(spark, monkeypatch, frequent, narrow, wide, tile):
    for name, value in (("FREQUENT", frequent), ("NARROW", narrow), ("WIDE", wide), ("TILE", tile)):
        monkeypatch.setattr(divergence, name, value)
    rows = made_up()
    got = divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"), top=20).collect()
    want = plain(rows, top=20)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_odd_rows_and_clashing_names(spark):
    docs = odd_rows(spark)
    names = ["term", "n", "docs", "p", "q", "zero", "total", "terms", "value", "rank", "item", "part", "used", "lang_n", "lead"]
    got = divergence.audit(docs.selectExpr("*", *[f"7 AS `{n}`" for n in names]), least_docs=1).collect()
    assert {tuple(r) for r in got} == plain([(r.lang, r.source, r.text) for r in docs.collect()], least=1)


def test_empty_table(spark):
    assert divergence.audit(empty(spark)).collect() == []


def test_large_counts_are_exact(spark):
    rows = [(10**15 + i, 3 * 10**15 + i, 1000) for i in range(50)]
    got = spark.createDataFrame(rows, "n long, total long, terms long").select("n", "total", "terms", divergence.share("n", "total", "terms").alias("p"))
    assert all(r.p == 1 + 10**9 * (r.n + 1) // (r.total + r.terms) for r in got.collect())


def test_joint_cells():
    rng = np.random.default_rng(1)
    held = rng.random((30, 130)) < 0.3
    packed = np.packbits(held, axis=1, bitorder="little")
    bits = np.zeros((30, 24), dtype=np.uint8)
    bits[:, : packed.shape[1]] = packed
    got = divergence.joint(bits.view(np.uint64), 4, 9)
    assert (got == held[4:9].astype(int) @ held.T.astype(int)).all()


def test_query_equals_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(DIVERGENCE_SQL)
    names = [c[0] for c in want.description]
    got = op12(spark, sf).select(*names).collect()
    want = want.fetchall()
    assert len(got) == len(want) and {tuple(r) for r in got} == set(want)


def test_counts_are_added_up_however_little_a_task_holds(spark, monkeypatch):
    rows = [(lang, source, f"alpha beta {'gamma ' * i}") for i in range(40) for lang in ("en", "de") for source in ("a", "b", None)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    want = Counter()
    for lang, source, text in rows:
        for term, n in Counter(text.split()).items():
            want[lang, source, term] += n
    for held, emit in ((1, 1), (7, 3), (divergence.HELD, divergence.EMIT)):
        monkeypatch.setattr(divergence, "HELD", held)
        monkeypatch.setattr(divergence, "EMIT", emit)
        monkeypatch.setattr(divergence, "_CHUNK", 200)
        got = divergence.term_counts(docs).collect()
        assert {(r["lang"], r["source"], r["term"]): r["n"] for r in got} == want
        assert all(r["docs"] == (39 if r["term"] == "gamma" else 40) for r in got)


def test_a_task_emits_few_rows_of_counts_at_once():
    batch = pa.RecordBatch.from_pylist([{"text": "x" * 1000}] * 50)
    pieces = list(cut([batch], 10_000))
    assert sum(p.num_rows for p in pieces) == 50 and max(p.nbytes for p in pieces) < 11_000
    assert [p.num_rows for p in cut([batch], 10)] == [1] * 50


def test_terms_are_exchanged_once(spark):
    docs = spark.createDataFrame(made_up(), "lang string, source string, text string").na.fill("")
    counts = divergence.term_counts(docs)
    kept = divergence.kept_terms(counts)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r["lang"], r["term"], r["source"]): (r["n"], r["lang_n"]) for r in kept.collect()}
    totals = Counter()
    for (lang, term, _), (n, _) in got.items():
        totals[lang, term] += n
    assert got and all(lang_n == totals[lang, term] for (lang, term, _), (_, lang_n) in got.items())
    assert len({(r["lang"], r["term"]) for r in kept.where("lead").collect()}) == kept.where("lead").count() == len(totals)
