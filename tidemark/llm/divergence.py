"""Divergence of term use between the sources of a language, from count-level bitmaps.

1. *Counts.* Tasks count terms per (language, source) in small chunks of text, add
   up what they hold whenever it has grown to ``HELD`` rows, and emit what is
   left of it; Spark adds them up. A language keeps the terms that
   enough of its documents hold.
2. *Shares.* Every kept term has in every group the smoothed share
   ``p = 1 + floor(SCALE * (count + 1) / (N + V))``. Of a group's shares only those of
   its occurring counts ("levels") differ, and the one of count zero.
3. *Bitsets.* The kept terms of a language are dealt into blocks by hash, frequent
   terms into narrow blocks and rare ones, which have few levels, into wide ones. A
   block is one row: for every (source, level) in it the set of its terms as bits.
4. *Pairs.* AND and popcount of two levels' bitsets give a pair's joint cell. A
   cell counts with ``f`` of its two shares. Cells in which one count is zero are
   complements: they follow from the number of terms of each level, so blocks
   hold no zeros and a source without terms in a block costs nothing there. For
   terms that both have, a block adds what its cells differ from that:
   ``f(pa, pb) - f(pa, zero b) - f(zero a, pb) + f(zero a, zero b)``.

All numbers are whole. ``f`` sums stay below ``SCALE * (SCALE + V)``, so they fit
64 bits; shares are computed in decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.textbits import LOWER, binary, chunks, map_batches, owners, word_spans
from tidemark.session import materialize

SCALE = 1_000_000_000
LEAST_DOCS, TOP = 3, 200
#: Terms of at least so many occurrences in the language stand in narrow blocks.
FREQUENT = 256
#: Terms of a narrow and of a wide block, on average.
NARROW, WIDE = 64, 4096
#: Levels of a block that one unit of work compares with all others.
TILE = 512
#: Rows of counts that a task holds before it adds them up, and rows that it emits at once.
HELD, EMIT = 400_000, 20_000
_CHUNK = 2 << 20

#: Bytes of the terms [^\x00-\x40\x5B-\x60\x7B-\x7F]+, after lower-casing A-Z.
TERMS = np.zeros(256, dtype=bool)
TERMS[0x61:0x7B] = True
TERMS[0x80:] = True


def _counted(chunk, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of a chunk's terms; ``group`` numbers its texts' groups."""
    low = LOWER[chunk.buf]
    starts, ends = word_spans(low, TERMS)
    offsets = np.zeros(starts.size + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = low[TERMS[low]]
    words = pa.LargeStringArray.from_buffers(starts.size, pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    code, terms = words.indices.to_numpy().astype(np.int64), words.dictionary
    width = max(len(terms), 1)
    own, times = np.unique(owners(chunk.at, starts) * width + code, return_counts=True)
    key = group[own // width] * width + own % width
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: key.size])
    n = np.add.reduceat(times, first) if first.size else times
    return key[first] // width, terms.take(pa.array(key[first] % width)), n, np.diff(np.r_[first, key.size])


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs) of a table (lang, source, text)."""

    def emit(groups: dict, table: pa.Table) -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
        for lo in range(0, table.num_rows, EMIT):
            part = table.slice(lo, EMIT).combine_chunks()
            g, term, n, has = (part.column(c).combine_chunks() for c in ("g", "term", "n", "docs"))
            yield pa.RecordBatch.from_arrays([langs.take(g), sources.take(g), term.cast(pa.string()), n, has], ["lang", "source", "term", "n", "docs"])

    def added(tables: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(tables).group_by(["g", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return pa.table({"g": sums["g"], "term": sums["term"], "n": sums["n_sum"], "docs": sums["docs_sum"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, rows = {}, [], 0
        for batch in batches:
            pairs = zip(*(batch.column(i).to_pylist() for i in (0, 1)))
            group = np.array([groups.setdefault(x, len(groups)) for x in pairs], dtype=np.int64)
            for c in chunks(binary(batch.column(2)), _CHUNK):
                g, term, n, has = _counted(c, group[c.lo : c.hi])
                held.append(pa.table({"g": g, "term": term, "n": n, "docs": has}))
                rows += g.size
                if rows >= HELD:
                    held = [added(held)]
                    rows = held[0].num_rows
                    if 2 * rows >= HELD:  # little is left to add up: begin anew
                        yield from emit(groups, held[0])
                        held, rows = [], 0
            if not held:
                groups = {}
        if held:
            yield from emit(groups, added(held))

    found = map_batches(docs.select("lang", "source", "text"), run, "lang string, source string, term string, n long, docs long")
    # tasks have added up what they hold, so nothing is gained by adding before the exchange; all sources of a term meet in it
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)) of three columns; null where there are neither occurrences nor terms."""
    top = f"cast({SCALE} AS decimal(10,0)) * (cast({n} AS decimal(20,0)) + 1)"
    both = f"cast({total} AS decimal(20,0)) + cast({terms} AS decimal(20,0))"
    return F.expr(f"CASE WHEN {total} + {terms} > 0 THEN 1 + ({top}) div ({both}) END")


def cost(p: str, q: str) -> Column:
    """floor((p-q) * (p-q) / q) of two columns."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``counts`` of the terms that at least ``least_docs`` documents of the language hold.

    With ``lang_n``, the term's occurrences in the language, and ``lead``, true in one row of each term.
    """
    same = Window.partitionBy("lang", "term")
    found = counts.withColumn("lead", F.row_number().over(same.orderBy("source")) == 1)
    found = found.withColumn("lang_n", F.sum("n").over(same)).withColumn("held", F.sum("docs").over(same))
    return found.where(F.col("held") >= least_docs).select("lang", "source", "term", "n", "lang_n", "lead")


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows (lang, source, total, used, terms, lang_total, zero): every occurring group, also one without terms.

    ``total`` occurrences of kept terms, ``used`` kept terms that occur, ``terms`` kept
    terms of the language, ``zero`` the share of a term that does not occur.
    """
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("used"))
    all_of = kept.where("lead").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(all_of, "lang", "left")
    return groups.na.fill(0, ["total", "used", "terms", "lang_total"]).withColumn("none", F.lit(0)).withColumn("zero", share("none", "total", "terms")).drop("none")


def bitsets(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per block of terms: its sources, their zero shares, its levels and their bitsets.

    Level i belongs to source ``owner[i]``, has count ``counts[i]`` and share ``shares[i]``; its
    terms are bits ``i * words * 64`` onwards of ``bits``. Levels are sorted by source.
    """
    wide = (F.col("lang_n") < FREQUENT).alias("wide")
    sizes = kept.where("lead").groupBy("lang", wide).agg(F.count("*").alias("n_terms"))
    blocks = F.ceil(F.col("n_terms") / F.when(F.col("wide"), WIDE).otherwise(NARROW))
    shares = groups.select("lang", "source", "total", "terms", "zero")
    rows = kept.select("lang", "source", "term", "n", wide).join(sizes, ["lang", "wide"]).join(shares, ["lang", "source"])
    rows = rows.select("lang", "wide", F.pmod(F.xxhash64("term"), blocks).alias("block"), "term", "source", "n", share("n", "total", "terms").alias("p"), "zero")

    def pack(names: list[str], lang: str, rows: pa.Table) -> pa.RecordBatch:
        sources, owner = np.unique(np.array(rows["source"].to_pylist(), dtype=object), return_inverse=True)
        _, term = np.unique(np.array(rows["term"].to_pylist(), dtype=object), return_inverse=True)
        n, p, zero = (rows[c].to_numpy() for c in ("n", "p", "zero"))
        order = np.lexsort((n, owner))
        owner, term, n, p, zero = owner[order], term[order], n[order], p[order], zero[order]
        fresh = np.r_[True, (owner[1:] != owner[:-1]) | (n[1:] != n[:-1])]
        first, level = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        words = int(term.max()) // 64 + 1
        bits = np.zeros((first.size, words), dtype=np.uint64)
        np.bitwise_or.at(bits, (level, term >> 6), np.uint64(1) << (term & 63).astype(np.uint64))
        begin = np.searchsorted(owner, np.arange(sources.size))
        columns = [[lang], [sources.tolist()], [zero[begin].tolist()], [owner[first].tolist()], [n[first].tolist()], [p[first].tolist()], [words], [bits.tobytes()]]
        kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["lang", "sources", "zeros", "owner", "counts", "shares", "words", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, parts = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if keys[lo] != open_key and parts:
                    yield pack(names, open_key[0], pa.Table.from_batches(parts))
                    parts = []
                open_key = keys[lo]
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield pack(names, open_key[0], pa.Table.from_batches(parts))

    dealt = rows.repartition("lang", "wide", "block").sortWithinPartitions("lang", "wide", "block")
    return map_batches(dealt, run, "lang string, sources array<string>, zeros array<long>, owner array<int>, counts array<long>, shares array<long>, words int, bits binary")


def joint(bits: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Number of terms that level i of lo..hi and level j share, for all j: AND and popcount, word by word."""
    out = np.zeros((hi - lo, bits.shape[0]), dtype=np.int64)
    for w in range(bits.shape[1]):
        out += np.bitwise_count(bits[lo:hi, w, None] & bits[None, :, w])
    return out


def _cost(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def joint_values(blocks: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value): what a block's terms that both sources have add to their complements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, sources, zeros, owner, shares, words, bits, lo in zip(*(batch.column(i).to_pylist() for i in range(8))):
                owner, p = np.array(owner), np.array(shares, dtype=np.int64)
                zero = np.array(zeros, dtype=np.int64)[owner]
                cells = np.frombuffer(bits, dtype=np.uint64).reshape(-1, words)
                hi = min(lo + TILE, p.size)
                many = joint(cells, lo, hi)
                pa_, za, pb, zb = p[lo:hi, None], zero[lo:hi, None], p[None], zero[None]
                value = many * (_cost(pa_, pb) - _cost(pa_, zb) - _cost(za, pb) + _cost(za, zb))
                begin = np.searchsorted(owner, np.arange(len(sources)))
                own = owner[lo:hi]
                rows = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                total = np.add.reduceat(np.add.reduceat(value, begin, axis=1), rows, axis=0)
                here = own[rows]
                a, b = np.nonzero(here[:, None] != np.arange(len(sources))[None])
                if a.size:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * a.size), pa.array([sources[here[i]] for i in a.tolist()]), pa.array([sources[i] for i in b.tolist()]), pa.array(total[a, b])],
                        ["lang", "source", "item", "value"],
                    )

    tiles = F.explode(F.sequence(F.lit(0), F.size("shares") - 1, F.lit(TILE))).alias("tile")
    units = blocks.select("lang", "sources", "zeros", "owner", "shares", "words", "bits", tiles)
    return map_batches(units, run, "lang string, source string, item string, value long")


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value): f of the two sources' shares, summed over the kept terms; each ordered pair."""
    side = groups.select("lang", "source", "used", "zero")
    other = side.select("lang", F.col("source").alias("item"), F.col("used").alias("item_used"), F.col("zero").alias("item_zero"))
    pairs = groups.select("lang", "source", "used", "zero", "terms").join(other, "lang").where("source <> item")
    neither = F.when(F.col("terms") > 0, F.expr("terms - used - item_used") * cost("zero", "item_zero")).otherwise(F.lit(0))
    neither = pairs.select("lang", "source", "item", neither.alias("value"))
    levels = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("many"))
    levels = levels.join(groups.select("lang", "source", "total", "terms", "zero"), ["lang", "source"])
    levels = levels.select("lang", "source", "many", "zero", share("n", "total", "terms").alias("p")).join(other, "lang").where("source <> item")
    one = levels.groupBy("lang", "source", "item").agg(F.sum(F.col("many") * cost("p", "item_zero")).alias("value"))
    mirrored = levels.groupBy("lang", "source", "item").agg(F.sum(F.col("many") * cost("item_zero", "p")).alias("value"))
    mirrored = mirrored.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    both = joint_values(materialize(bitsets(kept, groups), "bitsets"))
    return neither.unionByName(one).unionByName(mirrored).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value) of the terms that a source uses more than its language does."""
    sizes = groups.select("lang", "source", "total", "terms", "lang_total")
    rows = kept.join(sizes, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q")
    )
    return rows.where("p > q").select("lang", "source", "item", cost("p", "q").alias("value"))


def ranked(values: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = values.withColumn("rank", F.row_number().over(order).cast("int"))
    out = out if top is None else out.where(F.col("rank") <= top)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every (lang, source) group of ``docs``.

    Part ``pair`` ranks the other sources of the language by divergence from them,
    part ``term`` the source's ``top`` most typical terms. Null language, source
    and text are empty. Repeated rows count as documents of their own. A group without
    terms stands in the pairs; a language without kept terms has pairs of value 0; a
    language of one source has no pairs. Ties are ordered by item. Other columns play
    no part, an empty table gives no rows.
    """
    named = {"lang": lang_col, "source": source_col, "text": text_col}
    docs = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in named.items()])
    kept = materialize(kept_terms(term_counts(docs), least_docs), "kept_terms")
    groups = materialize(group_table(docs, kept), "groups")
    return ranked(pair_values(kept, groups), "pair").unionByName(ranked(term_values(kept, groups), "term", top))
