from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tests.llm.helpers import empty, jaccard_components, odd_rows
from tidemark.llm import jaccard_join as j
from tidemark.llm.queries import op1


def test_query_equals_brute_force(spark, sf, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op1(spark, sf).collect()}
    assert got == jaccard_components(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_near_copies(spark, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 5, 8, 12, 20, 35, 60, 150, 300]))] for _ in range(25)]
    shared = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(400):
        words = list(rng.choice(base))
        if rng.random() < 0.3:  # unlike texts around one long passage
            words = [f"q{rng.randrange(4000)}" for _ in range(rng.choice([6, 15, 40, 90]))] + shared
        else:
            for _ in range(int(rng.random() * max(1, len(words) * 0.06) + rng.random())):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.jaccard_components(df).collect()}
    assert got == jaccard_components(rows)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 13, 29, 40, 77, 150, 400])
def test_every_linked_pair_shares_a_signature(size):
    rng = np.random.default_rng(size)
    for _ in range(30):
        pool = rng.integers(0, 2**63, 2 * size + 8, dtype=np.uint64)
        a = pool[:size]
        gone = rng.integers(0, size // 4 + 1)
        new = int(rng.integers(0, size // 3 + 1))
        b = np.concatenate([a[gone:], pool[size : size + new]])
        both = a.size - gone
        if 100 * both < 75 * (a.size + b.size - both):
            continue
        value = np.concatenate([np.sort(a), np.sort(b)])
        sig, own = j.signatures(value, np.array([a.size, b.size]))
        assert set(sig[own == 0].tolist()) & set(sig[own == 1].tolist())


def test_odd_rows(spark):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.jaccard_components(odd_rows(spark)).collect()]
    assert len(got) == 12
    by_id = {}
    for i, n, c in got:
        by_id.setdefault(i, []).append((n, c))
    assert by_id[0] == by_id[1] == [(0, 0)] or by_id[0] == [(0, 0)] and by_id[1] == [(0, 1)]
    assert by_id[2] == [(0, 2)]
    assert by_id[3] == [(1, 3), (1, 3)] and by_id[4] == [(1, 3)]
    assert by_id[7][0][1] == by_id[8][0][1] == 7
    assert j.jaccard_components(empty(spark)).collect() == []


def test_representatives(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = jaccard_components(texts)
    kept = j.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (n, c) in want.items() if n == 0 or c == i)


def test_representatives_of_odd_rows(spark):
    rows = odd_rows(spark)
    kept = j.representatives(rows).collect()
    # repeated rows leave one, texts without words all stay
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept) == [-1, 0, 1, 2, 3, 5, 6, 7, 9]
    assert j.representatives(empty(spark)).collect() == []


def test_long_sketches_never_exceed_the_distance(spark):
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 2**63, 30_000, dtype=np.uint64))
    picks = [pool[:1500], pool[200:1900], pool[:2100], pool[5000:9100], pool[5000:9090], pool[:1000], pool[9000:26_000], pool[9001:20_000], pool[:1024], pool[3:1030]]
    sizes = np.array([p.size for p in picks])
    value = np.concatenate(picks)
    short = j.sketches(value, np.repeat(np.arange(sizes.size), sizes), sizes.size)
    wide = j.long_sketches(value, sizes)
    assert [w is not None for w in wide] == [bool(n > 1024) for n in sizes] and all(w.size * 64 >= n for w, n in zip(wide, sizes) if w is not None)
    for w, s in zip(wide, short):
        if w is not None:
            assert (np.bitwise_xor.reduce(w.reshape(-1, j.SKETCH_LONGS), axis=0) == s).all()
    rows = [(i, int(n), s.tolist(), None if w is None else w.tolist()) for i, (n, s, w) in enumerate(zip(sizes, short, wide))]
    df = spark.createDataFrame(rows, "class long, n_shingles long, sketch array<long>, long_sketch array<long>")
    both = df.alias("x").crossJoin(df.alias("y")).select("x.class", "y.class", j._long_apart("x", "y"), j._near("x", "y", 75, 100) & j._long_near("x", "y", 75, 100)).collect()
    for a, b, apart, near in both:
        differ = np.setxor1d(picks[a], picks[b]).size
        assert apart is None or apart <= differ
        assert near or 175 * differ > 25 * (sizes[a] + sizes[b]) or 100 * min(sizes[a], sizes[b]) < 75 * max(sizes[a], sizes[b])
    assert not {(a, b) for a, b, _, near in both if near} & {(0, 3), (6, 3), (2, 5)}


def test_long_texts_around_one_passage(spark):
    """Long texts that share a passage but are not alike, and near copies of some of them."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(700)]
    rows = []
    for i in range(24):
        words = passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([900, 1500, 2500]))]
        rows.append((2 * i, " ".join(words)))
        for _ in range(rng.choice([1, 20, 200])):
            words[rng.randrange(len(words))] = "new"
        rows.append((2 * i + 1, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.jaccard_components(df).collect()}
    assert got == jaccard_components(rows)


def test_representatives_keep_columns_of_any_name(spark):
    names = ["_h", "_class", "_id", "_of", "_stays", "_row", "class", "comp", "id", "__h"]
    docs = odd_rows(spark).selectExpr("*", *[f"7 AS `{c}`" for c in names], "map('k', text) AS m")
    out = j.representatives(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert all(r[c] == 7 for r in got for c in names) and all(r["m"] == {"k": r["text"]} for r in got)
    assert sorted(r["doc_id"] or -1 for r in got) == sorted(r["doc_id"] or -1 for r in j.representatives(odd_rows(spark)).collect())


def test_one_of_repeated_rows_stays_whatever_the_order(spark):
    rows = [(1, "a b c d e f", f"s{i}") for i in range(30)] + [(2, "a b c d e f", "s0"), (None, "x y", "p"), (None, "x y", "q")]
    kept = set()
    for n in (1, 3, 7):
        df = spark.createDataFrame(rows[::-1] if n == 3 else rows, "doc_id long, text string, source string").repartition(n)
        kept.add(tuple(sorted(map(repr, map(tuple, j.representatives(df).collect())))))
    assert len(kept) == 1 and len(kept.pop()) == 2


def test_a_bucket_sorted_in_shares_has_the_same_families(monkeypatch):
    rng = np.random.default_rng(5)
    sig, names = rng.integers(0, 400, 3000).astype(np.uint64), rng.integers(-9, 9, 12)
    blocks = [(sig[i::3], rng.integers(0, 12, sig[i::3].size).astype(np.uint32), names + 100 * i) for i in range(3)]

    def families(shares):
        monkeypatch.setattr(j, "MEETING_SHARES", shares)
        found = [(f, c) for family, cls in j._met(*zip(*blocks)) for f, c in zip(family.tolist(), cls.tolist())]
        assert len(found) == len(set(found))
        return sorted(found)

    assert families(1) == families(8) == families(64) and families(8)


def test_pairs_of_many_families_meet_once(spark):
    """Every near pair of a family across components is listed once; what is known is not, and hardly leaves the join twice."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = [np.unique(np.r_[base[rng.random(200) > 0.06], rng.integers(0, 2**63, 4, dtype=np.uint64)]) for _ in range(12)]
    sets += [np.unique(rng.integers(0, 2**63, 190, dtype=np.uint64)) for _ in range(4)]
    sizes = np.array([s.size for s in sets])
    sketch = j.sketches(np.concatenate(sets), np.repeat(np.arange(sizes.size), sizes), sizes.size)
    one = [(i, int(n), s.tolist(), None, False) for i, (n, s) in enumerate(zip(sizes, sketch))]
    one = spark.createDataFrame(one, "class long, n_shingles long, sketch array<long>, long_sketch array<long>, wide boolean")
    families = [sorted(rng.choice(16, rng.integers(2, 9), replace=False).tolist()) for _ in range(300)]
    rest = spark.createDataFrame([(f, c, c // 2) for f, m in enumerate(families) for c in m], "family long, class long, comp long")
    none = spark.createDataFrame([], "a long, b long")
    both = one.alias("x").crossJoin(one.alias("y")).where(j._near("x", "y", 75, 100)).select("x.class", "y.class").collect()
    near = {(a, b) for a, b in both if a < b and a // 2 != b // 2 and any(a in m and b in m for m in families)}
    listed = [tuple(r) for r in j.across_components(rest, one, none, 75, 100).collect()]
    assert len(listed) == len(set(listed)) and set(listed) == near and len(near) > 40
    known = sorted(near)[::3] + [(12, 13)]
    left = j.across_components(rest, one, spark.createDataFrame(known, "a long, b long"), 75, 100).collect()
    assert sorted(map(tuple, left)) == sorted(near - set(known))


def test_known_pairs_lie_at_the_end_with_fewer(spark):
    pairs = [(0, i) for i in range(1, 40)] + [(3, 4), (5, 3)]
    got = {r["class"]: sorted(r["known"]) for r in j._partners(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {tuple(sorted((c, o))) for c, known in got.items() for o in known} == {tuple(sorted(p)) for p in pairs}
    assert sum(map(len, got.values())) == len(pairs) and max(map(len, got.values())) <= 2 and 0 not in got


@pytest.mark.parametrize("small, rows", [(64, 8192), (3, 1), (3, 8192)])
def test_families_compared_in_arrays_list_every_near_pair(monkeypatch, small, rows):
    """Units of all sizes, cut anywhere into batches, list the cross-component pairs that a loop over all pairs lists."""
    monkeypatch.setattr(j, "SMALL_UNIT", small)
    monkeypatch.setattr(j, "UNIT_ROWS", rows)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    sets = [np.unique(np.r_[base[rng.random(120) > 0.07], rng.integers(0, 2**63, 3, dtype=np.uint64)]) for _ in range(40)]
    sizes = np.array([s.size for s in sets])
    sketch = j.sketches(np.concatenate(sets), np.repeat(np.arange(40), sizes), 40)
    known = {c: [int(x) for x in rng.choice(40, 4)] if c % 5 else None for c in range(40)}
    told = {frozenset((c, o)) for c, others in known.items() for o in others or ()}
    table, want = [], set()
    for family, (lo, hi) in enumerate([(0, 0)] * 30 + [(0, 1)] * 10):
        members = [(c, c % 2 if hi else 0) for c in sorted(rng.choice(40, rng.integers(2, 12), replace=False).tolist())]
        table += [(family, lo, hi, block, c, c // 3, int(sizes[c]), sketch[c].tolist(), c % 7 == 0, known[c]) for c, block in members]
        for a, x in members:
            for b, y in members:
                apart = sum(int(p & (2**64 - 1)).bit_count() for p in (sketch[a] ^ sketch[b]).tolist())
                near = 100 * min(sizes[a], sizes[b]) >= 75 * max(sizes[a], sizes[b]) and 175 * apart <= 25 * (sizes[a] + sizes[b])
                if a < b and a // 3 != b // 3 and near and (x != y or not hi) and not (a % 7 == 0 and b % 7 == 0) and frozenset((a, b)) not in told:
                    want.add((family, a, b))
    names = ["family", "lo", "hi", "block", "class", "comp", "n_shingles", "sketch", "wide", "known"]
    whole = pa.Table.from_pylist([dict(zip(names, r)) for r in table], pa.schema([*((c, pa.int64()) for c in names[:7]), ("sketch", pa.list_(pa.int64())), ("wide", pa.bool_()), ("known", pa.list_(pa.int64()))]))
    units = list(j._whole_units(iter(whole.to_batches(max_chunksize=7))))
    assert sum(u.num_rows for u in units) == len(table) and all(len(set(u.column("family").to_pylist()) & set(v.column("family").to_pylist())) == 0 for u in units for v in units if u is not v)
    got = {p for u in units for p in zip(*(x.tolist() for x in j._crossing(u, 75, 100)))}
    assert got == {(a, b) for _, a, b in want} and len(got) > 20
    one = [(f, *p) for f in range(40) for p in zip(*(x.tolist() for x in j._crossing(whole.filter(pc.equal(whole["family"], f)), 75, 100)))]
    assert set(one) == want and len(one) == len(want)


def test_large_families_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(j, "FAMILY_BLOCK", 5)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    sets = [np.unique(base[rng.random(150) > 0.06]) for _ in range(30)]
    sizes = np.array([s.size for s in sets])
    sketch = j.sketches(np.concatenate(sets), np.repeat(np.arange(30), sizes), 30)
    one = spark.createDataFrame([(i, int(n), s.tolist(), None, False) for i, (n, s) in enumerate(zip(sizes, sketch))], "class long, n_shingles long, sketch array<long>, long_sketch array<long>, wide boolean")
    rest = spark.createDataFrame([(7, c, c // 2) for c in range(30)] + [(8, c, c // 2) for c in range(4)], "family long, class long, comp long")
    both = one.alias("x").crossJoin(one.alias("y")).where(j._near("x", "y", 75, 100)).select("x.class", "y.class").collect()
    want = {(a, b) for a, b in both if a < b and a // 2 != b // 2}
    listed = [tuple(r) for r in j.across_components(rest, one, spark.createDataFrame([], "a long, b long"), 75, 100).collect()]
    assert len(listed) == len(set(listed)) and set(listed) == want and len(want) > 100


def test_components_end_with_stars(spark):
    rng = random.Random(2)
    for edges in ([(i + 1, i) for i in range(40)], [(rng.randrange(90), rng.randrange(90)) for _ in range(60)], [(9, 1), (9, 2), (5, 5)]):
        parent = list(range(100))

        def root(x):
            return x if parent[x] == x else root(parent[x])

        for a, b in edges:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        found = {r["class"]: r["comp"] for r in j.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert found == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    pairs = "a long, b long"
    assert j._are_stars(spark.createDataFrame([(3, 1), (4, 1), (5, 2)], pairs)) and j._are_stars(spark.createDataFrame([], pairs))
    assert not j._are_stars(spark.createDataFrame([(3, 1), (3, 2)], pairs)) and not j._are_stars(spark.createDataFrame([(3, 2), (2, 1)], pairs))
