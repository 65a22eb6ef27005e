from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import BLANK_WORD, empty, odd_rows, sha
from tidemark.llm import syncmers as m
from tidemark.llm.queries import op10


@pytest.mark.parametrize("part_bytes", [20_000, 16_000_000])
def test_query(spark, sf, texts, monkeypatch, part_bytes):
    monkeypatch.setattr(m, "PART_BYTES", part_bytes)
    got = {r["doc_id"]: r for r in op10(spark, sf).collect()}
    prints: dict[str, set] = {}
    near: list[float] = []
    assert len(got) == len(texts)
    for k, (i, t) in enumerate(texts):
        after, half = texts[(k + 1) % len(texts)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited))
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        prints.setdefault(t, set()).add(r["fingerprint"])
        prints.setdefault(edited, set()).add(r["edited_fingerprint"])
        if len(BLANK_WORD.findall(t)) > 60:
            near.append(r["near_edited"])
    assert all(len(x) == 1 for x in prints.values())
    assert min(near) > 0 and 0.25 < statistics.median(near) < 0.45  # a half is shared, so about a third of all anchors


def chosen(hashes: list[int], k: int, s: int, spark) -> set:
    """Which k-mers are closed syncmers, from their inner hashes alone."""
    df = spark.createDataFrame([(hashes,)], "h array<long>")
    inner = F.transform(F.sequence(F.lit(0), F.size("h") - s), lambda i: F.xxhash64(*[F.col("h")[i + j] for j in range(s)]))
    values = df.select(inner.alias("x")).first()["x"]
    out = set()
    for i in range(len(hashes) - k + 1):
        own = values[i : i + k - s + 1]
        if min(own) in (own[0], own[-1]):
            out.add(i)
    return out


def test_closed_syncmers_are_context_free(spark):
    words = [f"w{i * i % 97}" for i in range(300)]
    sets = {}
    for name, text in {"all": words, "part": words[100:200], "moved": ["x"] * 7 + words[100:200] + ["y"] * 9}.items():
        sets[name] = set(spark.createDataFrame([(" ".join(text),)], "t string").select(m.fingerprint(F.col("t")).alias("f")).first()["f"])
    assert sets["part"] <= sets["all"] and sets["part"] <= sets["moved"]
    hashes = spark.createDataFrame([(" ".join(words),)], "t string").select(m.word_hashes(F.col("t")).alias("h")).first()["h"]
    starts = chosen(hashes, m.K, m.S, spark)
    assert len({tuple(words[i : i + m.K]) for i in starts}) == len(sets["all"])


def likenesses(spark, pairs) -> list[float]:
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    both = df.select("i", m.anchors(F.col("a")).alias("a"), m.anchors(F.col("b")).alias("b"))
    return [r["x"] for r in both.select("i", m.likeness(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]


def test_fingerprints_hold_all_anchors_with_their_places(spark):
    words = [f"w{i * i % 9973}" for i in range(600)]
    text, other = " ".join(words), " ".join([*words[:-30], *(f"x{i}" for i in range(30))])
    rows = spark.createDataFrame([(0, text), (1, other)], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in m.compare_with_edits(rows).collect()}
    hashes = rows.where("doc_id = 0").select(m.word_hashes(F.col("text")).alias("h")).first()["h"]
    count, _, rest = got[0].partition(":")
    listed = [x.split(".") for x in rest.split(",")]
    assert int(count) == len(listed) > 200 and {int(p) for p, _ in listed} == chosen(hashes, m.K, m.S, spark)
    assert [int(p) for p, _ in listed] == sorted(int(p) for p, _ in listed)
    shared = set(rest.split(",")) & set(got[1].partition(":")[2].split(","))
    assert got[0] != got[1] and len(shared) > 200  # the shared passage is found at its place


def test_likeness_counts_anchors_in_order(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passages = [words[i : i + 50] for i in range(0, 400, 50)]
    mixed = rng.sample(passages, len(passages))
    pairs = [(" ".join(words), " ".join(words)), (" ".join(words), " ".join(sum(reversed(passages), []))), ("", " "), ("", "a"), ("a a b", "b a a")]
    pairs += [(" ".join(words), " ".join(sum(mixed, [])))]
    pairs += [(" ".join(rng.choices("ab", k=n)), " ".join(rng.choices("ab", k=60))) for n in (3, 40, 90)]
    got = likenesses(spark, pairs)
    assert got[0] == 1 and got[1] < 0.12 and got[2:4] == [1, 0] and got[4] == 0.5
    df = spark.createDataFrame(pairs, "a string, b string").select(m.anchors(F.col("a")).alias("a"), m.anchors(F.col("b")).alias("b"))
    for (a, b), value in zip([(r["a"]["hash"], r["b"]["hash"]) for r in df.collect()], got):
        number = lambda hs: [(h, hs[:i].count(h)) for i, h in enumerate(hs)]
        at = {x: i for i, x in enumerate(number(b))}
        order = [at[x] for x in number(a) if x in at]
        best: list[int] = []
        for i, x in enumerate(order):
            best.append(1 + max((best[j] for j in range(i) if order[j] < x), default=0))
        n = max(best, default=0)
        assert value == (n / (len(a) + len(b) - n) if a or b else 1)


def test_no_python_in_the_plan(spark, sf):
    plan = op10(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "SinglePartition"))


def test_odd_rows(spark):
    rows = odd_rows(spark, "part string, id string, next long")
    got = m.compare_with_edits(rows).collect()
    ordered = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in rows.collect()))
    want = []
    for k, (i, t) in enumerate(ordered):
        after, half = ordered[(k + 1) % len(ordered)][1], len(t) // 2
        want.append((i, len(t), sha(t[: len(t) - half] + after[:half])))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    assert m.compare_with_edits(empty(spark)).collect() == []
    one = m.compare_with_edits(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == sha("abab") and one["near_next"] == 1.0
