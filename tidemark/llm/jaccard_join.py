"""N-gram Jaccard self-join by PartEnum signatures, without pairs within groups.

A document's set holds the hashes of its distinct word n-grams. Two sets link
when their Jaccard similarity reaches the threshold. The steps:

1. Equal sets form one class. Everything below concerns classes.
2. *Signatures.* Set sizes are cut into bands so that partners lie in the same
   or the next band. For each of its two bands a set gets PartEnum signatures:
   the feature domain is cut into ``n1`` parts by hash and each part into ``n2``
   cells; a signature is the hash of a set's features in ``n2 - k2`` cells of a
   part, for every such choice of cells. A linked pair differs in at most ``k``
   features, and ``n1 * (k2 + 1) > k``, so in some part at most ``k2`` cells
   differ and some choice of cells agrees. An agreeing choice may be empty in
   both sets and empty choices are shared by very many sets; ``n1`` is therefore
   larger than needed, and a set for which not enough parts have a feature in
   every choice ("unsafe", known from the set alone) adds its empty choices.
   Each pair has a non-empty choice in common unless both sets are unsafe.
3. *Meeting.* Signatures travel in packed blocks, one per batch and bucket. Before
   that, a signature that several classes of one batch share is reduced to one
   of them, its pivot, so a signature shared by a third of all rows is one entry
   per batch; the others are kept as neighbours of the pivot. Classes that share
   many signatures are one family, listed once per bucket.
4. *Stars.* Each neighbour is compared with its pivot and each pivot of a family
   with the family's first: by sketch, and what passes by the whole sets. A sketch
   is 1024 parities, and for larger sets as many as they have features; its distance never
   exceeds the true one. Links found give components.
5. *Rest.* Families that, with their pivots' neighbours, still span several
   components are dealt out by family, large ones in blocks, and their rows compared across
   components by sketch, in arrays; what passes is verified too. Near copies meet in
   hundreds of families, so one family in ``PILOT`` is joined first and the others
   list only pairs that are not known by then.
   So no link between different components is lost, and pairs within one
   component are not listed.
6. Verification reads the texts of the candidates again and compares whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbits import (
    BLANK_WORDS,
    LOWER,
    binary,
    chunks,
    fresh,
    gram_hashes,
    map_batches,
    mix,
    owners,
    word_hashes,
    word_spans,
)
from tidemark.session import materialize

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
SKETCH_LONGS = 16
#: Bits of the fixed-size filter of documents that verification needs (it only saves reading, never decides).
FILTER_BITS = 22
SHINGLES_PER_BUCKET = 2_000_000
#: One family in so many is joined before the others; it lists nearly all pairs that very many families have.
PILOT = 32
#: Rows of a family that are compared at once; a larger one is cut into blocks. Rows of small families that are compared together.
FAMILY_BLOCK, UNIT_ROWS, SMALL_UNIT = 4096, 8192, 64


def shingles(buf: np.ndarray, at: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted within the text, and the index of their text.

    A text of fewer than ``k`` words has one n-gram, all its words; one without words has none.
    """
    low = LOWER[buf]
    starts, ends = word_spans(low, BLANK_WORDS)
    text = owners(at, starts)
    words = word_hashes(low, starts, ends)
    grams = gram_hashes(words, k)
    inside = text[: grams.size] == text[k - 1 :] if grams.size else np.empty(0, dtype=bool)
    values, owner = [grams[inside]], [text[: grams.size][inside]]
    count = np.bincount(text, minlength=at.size - 1)
    first = np.searchsorted(text, np.arange(at.size - 1))
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        value = np.full(short.size, n, dtype=np.uint64)
        for j in range(n):
            value = mix(value * np.uint64(0x2545F4914F6CDD1D) + words[first[short] + j]) if short.size else value
        values.append(value)
        owner.append(short)
    value, text = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])][: value.size]
    return value[new], text[new]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.zeros(values.size + 1, dtype=values.dtype)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def class_ids(value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, the same for equal sets (order-free)."""
    a = _sums(mix(value ^ np.uint64(0x5851F42D4C957F2D)), sizes)
    return mix(a + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def sketches(value: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Parity sketch of each set: bit h of 1024 is the parity of the features that fall on it."""
    bit = (mix(value + np.uint64(0x1234567)) & np.uint64(64 * SKETCH_LONGS - 1)).astype(np.int64)
    out = np.zeros(n * SKETCH_LONGS, dtype=np.uint64)
    np.bitwise_xor.at(out, text * SKETCH_LONGS + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out.reshape(n, SKETCH_LONGS).view(np.int64)


def long_sketches(value: np.ndarray, sizes: np.ndarray) -> list[np.ndarray | None]:
    """A parity sketch of at least one bit per feature for each set that ``sketches`` has fewer for; None for the others.

    Its length is a power of two. The sketch of half its length is the exclusive or
    of its halves, so sketches of two lengths can be compared.
    """
    out: list[np.ndarray | None] = [None] * sizes.size
    ends = np.cumsum(sizes)
    for i in np.flatnonzero(sizes > 64 * SKETCH_LONGS).tolist():
        bits = 1 << int(sizes[i] - 1).bit_length()
        own = value[ends[i] - sizes[i] : ends[i]]
        odd = np.bincount((mix(own + np.uint64(0x1234567)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    return out


def size_bands(numerator: int, denominator: int, most: int) -> np.ndarray:
    """Upper ends of the size bands: a set's partners lie in its own band or one beside it."""
    ends = [1]
    while ends[-1] < most:
        ends.append(((ends[-1] + 1) * denominator) // numerator)
    return np.array(ends, dtype=np.int64)


def scheme(upper: int, numerator: int, denominator: int) -> tuple[int, int, int, int]:
    """(k, n1, n2, k2) of the band ending at ``upper``: pairs across it and the band below, or within the band below.

    The size of the symmetric difference of a linked pair is at most (1-t)/(1+t)
    of both sizes together, t being the threshold.
    """
    below = (upper * numerator) // denominator
    share = (denominator - numerator) / (denominator + numerator)
    k = int(max(share * (below + upper), share * 2 * below) + 1e-9)
    if upper < 40:
        return k, 64 * upper, 1, 0
    return k, int(1.15 * (k + 1) / 2) + 4, 3, 1


def signatures(value: np.ndarray, sizes: np.ndarray, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of all sets and the index of their set."""
    bands = size_bands(numerator, denominator, int(sizes.max(initial=1)) * 2)
    band = np.searchsorted(bands, sizes)
    begin = np.cumsum(sizes) - sizes
    out, own = [], []
    for instance in np.unique(np.r_[band[sizes > 0], band[sizes > 0] + 1]).tolist():
        members = np.flatnonzero((sizes > 0) & ((band == instance) | (band + 1 == instance)))
        upper = int(bands[instance])
        k, n1, n2, k2 = scheme(upper, numerator, denominator)
        n = sizes[members]
        take = np.repeat(begin[members] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        features, owner = value[take], np.repeat(np.arange(members.size), n)
        spread = mix(features ^ np.uint64(0x9E6C63D0676A9A99 + instance))
        cell = ((spread >> np.uint64(32)) * np.uint64(n1 * n2) >> np.uint64(32)).astype(np.int64)
        part, cell = cell // n2, cell % n2
        # sums of scrambled features per (set, part, cell)
        slot = (owner * n1 + part) * n2 + cell
        order = np.argsort(slot, kind="stable")
        slot, spread = slot[order], mix(spread[order])
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        filled, content = slot[first], np.add.reduceat(spread, first)
        pair = filled // n2  # (set, part)
        head = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        row = np.repeat(np.arange(head.size), np.diff(np.r_[head, pair.size]))
        cells = np.zeros((head.size, n2), dtype=np.uint64)
        cells[row, filled % n2] = content
        cell_filled = np.zeros((head.size, n2), dtype=bool)
        cell_filled[row, filled % n2] = True
        own_set, own_part = pair[head] // n1, pair[head] % n1
        full = np.ones(head.size, dtype=bool)
        for c, chosen in enumerate(combinations(range(n2), n2 - k2)):
            some = cell_filled[:, chosen].any(axis=1)
            full &= some
            total = np.zeros(head.size, dtype=np.uint64)
            for j in chosen:
                total = mix(total + cells[:, j])
            key = mix(total + ((own_part * 8 + c) * 4096 + instance).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            out.append(key[some])
            own.append(members[own_set[some]])
        # parts with a feature in every choice; the rest can agree on an empty one
        good = np.bincount(own_set[full], minlength=members.size)
        s = sizes[members]
        share = (denominator - numerator) / (denominator + numerator)
        below = (upper * numerator) // denominator
        partner = np.where(s > below, below, np.minimum((s * denominator) // numerator, upper))
        worst = np.minimum(k, (share * (s + partner) + 1e-9).astype(np.int64))
        unsafe = np.flatnonzero(good <= worst // (k2 + 1))
        if unsafe.size:
            there = np.zeros((unsafe.size, n1, n2), dtype=bool)
            rank = np.full(members.size, -1)
            rank[unsafe] = np.arange(unsafe.size)
            hit = rank[filled // n2 // n1] >= 0
            there[rank[filled[hit] // n2 // n1], filled[hit] // n2 % n1, filled[hit] % n2] = True
            for c, chosen in enumerate(combinations(range(n2), n2 - k2)):
                i, p = np.nonzero(~there[:, :, chosen].any(axis=2))
                out.append(mix(((p * 8 + c) * 4096 + instance).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(1)))
                own.append(members[unsafe[i]])
    if not out:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.concatenate(out), np.concatenate(own)


def _sets(text: list[bytes | None], k: int) -> Iterator[tuple]:
    for c in chunks(text):
        value, owner = shingles(c.buf, c.at, k)
        sizes = np.bincount(owner, minlength=c.hi - c.lo)
        yield c, value, owner, sizes


def classes(docs: DataFrame, id_col: str, text_col: str, k: int = WORDS) -> DataFrame:
    """Rows (doc_id, n_shingles, class, sketch, long_sketch) for every document, from one pass over the texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, sketch, wide = [], [], [], []
            for c, value, owner, n in _sets(binary(batch.column(1)), k):
                ids.append(class_ids(value, n))
                sizes.append(n)
                sketch.append(sketches(value, owner, n.size))
                wide += long_sketches(value, n)
            if not sizes:
                continue
            flat = np.concatenate(sketch)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(flat.shape[0] + 1) * SKETCH_LONGS, pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(np.concatenate(ids)), lists, pa.array(wide, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "class", "sketch", "long_sketch"],
            )

    schema = f"doc_id {kind}, n_shingles long, class long, sketch array<long>, long_sketch array<long>"
    return map_batches(docs.select(f"`{id_col}`", f"`{text_col}`"), run, schema)


SIG_BYTES = 6
#: Shares (a power of two) in which a bucket's signatures are sorted, so that a task sorts few at once.
MEETING_SHARES = 8


def _packed(sig: np.ndarray, cls: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Signatures in SIG_BYTES bytes each, sorted by class; the distinct classes; how many signatures each has."""
    order = np.argsort(cls, kind="stable")
    sig, cls = sig[order], cls[order]
    first = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
    short = sig.view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES]
    return short.tobytes(), cls[first].tobytes(), np.diff(np.r_[first, cls.size]).astype(np.uint32).tobytes()


def _unpacked(sigs: pa.Buffer, classes: pa.Buffer, counts: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, for each the place of its class among the classes, and the classes."""
    wide = np.zeros((len(sigs) // SIG_BYTES, 8), dtype=np.uint8)
    wide[:, :SIG_BYTES] = np.frombuffer(sigs, dtype=np.uint8).reshape(-1, SIG_BYTES)
    classes = np.frombuffer(classes, dtype=np.int64).copy()
    return wide.view(np.uint64).ravel(), np.repeat(np.arange(classes.size, dtype=np.uint32), np.frombuffer(counts, dtype=np.uint32)), classes


def _met(sigs: list[np.ndarray], places: list[np.ndarray], names: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The families of a bucket, each once, from blocks as ``_unpacked`` gives them; the signatures are sorted a share at a time."""
    seen = np.empty(0, dtype=np.int64)
    for share in range(MEETING_SHARES):
        sig, cls = [], []
        for s, p, n in zip(sigs, places, names):
            here = np.flatnonzero(s & np.uint64(MEETING_SHARES - 1) == share)
            sig.append(s[here])
            cls.append(n[p[here]])
        sig, c = np.concatenate(sig), np.concatenate(cls)
        order = np.argsort(sig, kind="stable")
        sig, c = sig[order], c[order]
        same = sig[1:] == sig[:-1]
        shared = np.r_[False, same] | np.r_[same, False]
        if not shared.any():
            continue
        sig, c = sig[shared], c[shared]
        order = np.lexsort((c, sig))
        sig, c = sig[order], c[order]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (c[1:] != c[:-1])]
        family, c = _families(sig[new], c[new])
        more = ~np.isin(family, seen)
        family, c = family[more], c[more]
        seen = np.union1d(seen, family)
        yield family, c


def _families(sig: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(family, class) of the signatures that several classes share, classes sharing the same set of them once.

    The input is sorted by signature and class. A family's number is a hash of its set of classes.
    """
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    sizes = np.diff(np.r_[first, sig.size])
    family = mix(np.add.reduceat(mix(cls.view(np.uint64)), first) + sizes.astype(np.uint64))
    _, one = np.unique(family, return_index=True)
    one = one[sizes[one] > 1]
    take = np.repeat(first[one] - np.cumsum(sizes[one]) + sizes[one], sizes[one]) + np.arange(int(sizes[one].sum()))
    return np.repeat(family[one], sizes[one]).view(np.int64), cls[take]


def groups(docs: DataFrame, text_col: str, buckets: int, k: int, numerator: int, denominator: int) -> DataFrame:
    """Rows (family, class, near): who shares signatures with whom.

    ``near`` rows come from one batch: ``family`` is the pivot (a class) and
    ``class`` one of those that share a signature with it there. Other rows list
    the pivots of several batches that share a signature; such a set of pivots is a
    family, listed once per bucket however many signatures it shares.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            for _, value, _, n in _sets(binary(batch.column(0)), k):
                ids = class_ids(value, n)
                _, first = np.unique(ids, return_index=True)  # copies within the chunk once
                keep = np.zeros(n.size, dtype=bool)
                keep[first] = True
                keep &= n > 0
                sig, own = signatures(value[np.repeat(keep, n)], n[keep], numerator, denominator)
                if not sig.size:
                    continue
                cls = ids[keep][own]
                order = np.lexsort((cls, sig))
                sig, cls = sig[order], cls[order]
                new = np.r_[True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])]
                sig, cls = sig[new], cls[new]
                pivot = np.r_[True, sig[1:] != sig[:-1]]
                rows = []
                if not pivot.all():
                    lead = cls[np.maximum.accumulate(np.where(pivot, np.arange(cls.size), 0))][~pivot]
                    near = np.unique(np.stack([lead, cls[~pivot]], axis=1), axis=0)
                    rows.append((turn % buckets, 1, near.tobytes(), b"", b""))
                    turn += 1
                sig, cls = sig[pivot], cls[pivot]
                home = ((sig >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                sig, cls = sig[order], cls[order]
                cut = np.searchsorted(home[order], np.arange(buckets + 1))
                rows += [(b, 0, *_packed(sig[x:y], cls[x:y])) for b, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "sigs", "classes", "counts"])

    def out(family: np.ndarray, cls: np.ndarray, near: bool) -> Iterator[pa.RecordBatch]:
        for i in range(0, cls.size, 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(family[part]), pa.array(cls[part]), pa.array(np.full(cls[part].size, near))], ["family", "class", "near"]
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for batch in batches:
            for i, kind in enumerate(batch.column(1).to_pylist()):
                s, c, n = (batch.column(j)[i].as_buffer() for j in (2, 3, 4))
                if kind:
                    near = np.frombuffer(s, dtype=np.int64).reshape(-1, 2)
                    yield from out(near[:, 0], near[:, 1], True)
                else:
                    blocks.append(_unpacked(s, c, n))
        if blocks:
            for family, cls in _met(*zip(*blocks)):
                yield from out(family, cls, False)

    packed = map_batches(docs.select(f"`{text_col}`"), emit, "bucket int, kind int, sigs binary, classes binary, counts binary")
    return map_batches(packed.repartition(buckets, "bucket"), meet, "family long, class long, near boolean")


def _distinct_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def with_class(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, out: str, k: int = WORDS) -> DataFrame:
    """``docs`` with ``out``, the class of the row's text, at least where the id is among those in ``wanted``; else null.

    A bit table of fixed size, filled from hashes of the ids, tells the rows that
    can matter, so that only their texts are hashed and joined. It lets some
    others through, more of them the more ids there are, and never leaves out one.
    """
    mask = F.lit((1 << FILTER_BITS) - 1)
    words = wanted.select(F.xxhash64("doc_id").bitwiseAND(mask).alias("h")).select(
        F.shiftrightunsigned("h", 5).cast("int").alias("w"), F.expr("shiftleft(1L, cast(h & 31 AS int))").alias("m")
    )
    table = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()  # at most 2**FILTER_BITS / 32 rows
    bits = np.zeros(1 << FILTER_BITS - 5, dtype=np.int64)
    bits[table.column("w").to_numpy()] = table.column("m").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    (name,) = fresh(docs, "_h")
    base = docs.select(*[f"`{c}`" for c in docs.columns], F.xxhash64(F.col(f"`{id_col}`")).bitwiseAND(mask).alias(name))
    names = base.columns
    at, hashed = names.index(text_col), names.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(hashed).to_numpy()
            hit = np.flatnonzero((shared.value[h >> 5] >> (h & 31)) & 1)
            some = binary(batch.column(at).take(pa.array(hit)))
            found = np.zeros(h.size, dtype=np.int64)
            found[hit] = np.concatenate([np.empty(0, np.int64), *[class_ids(value, n) for _, value, _, n in _sets(some, k)]])
            none = np.ones(h.size, dtype=bool)
            none[hit] = False
            columns = [c for i, c in enumerate(batch.columns) if i != hashed]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, mask=none)], [*(c for c in names if c != name), out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{out}` long"])
    return map_batches(base, run, schema)


def texts_of(pairs: DataFrame, members: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Rows (class, text): a whole text of every class in the pairs (a, b)."""
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    heads = members.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    heads = materialize(heads.join(wanted, "class"), "heads")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    some = with_class(slim, heads, "id", "text", "class", k).where("class IS NOT NULL").select("class", "text")
    texts = some.join(heads, "class").select("class", "text")
    return materialize(texts.dropDuplicates(["class"]), "texts")


def verify(pairs: DataFrame, texts: DataFrame, k: int, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the threshold.

    Each row of a pair carries b's text to a's; a hot ``a`` is split into groups of about 1000 partners, each with a
    copy of a's text.
    """
    split = 1000
    counts = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / split).cast("int").alias("parts"))
    counts = materialize(counts, "parts")
    sides = (
        pairs.join(counts, "a")
        .join(texts.withColumnRenamed("class", "b"), "b")
        .select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("class"), "text", F.lit(1).alias("side"))
    )
    pivots = counts.join(texts.withColumnRenamed("class", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("class"), "text", F.lit(0).alias("side")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, base = None, None
        for batch in batches:
            a, side, cls = (batch.column(i).to_pylist() for i in (0, 4, 2))
            links = []
            at = 0
            for c, value, owner, n in _sets(binary(batch.column(3)), k):
                begin = np.cumsum(n) - n
                for i in range(n.size):
                    own = value[begin[i] : begin[i] + n[i]]
                    if side[at] == 0:
                        pivot, base = a[at], own
                    elif pivot == a[at] and own.size and base.size:
                        small, large = (own, base) if own.size < base.size else (base, own)
                        if denominator * small.size >= numerator * large.size:
                            where = np.minimum(np.searchsorted(large, small), large.size - 1)
                            both = int((large[where] == small).sum())
                            if denominator * both >= numerator * (own.size + base.size - both):
                                links.append((a[at], cls[at]))
                    at += 1
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    dealt = pivots.unionByName(sides).repartition("a", "part").sortWithinPartitions("a", "part", "side")
    return map_batches(dealt, compare, "a long, b long")


def settle(pairs: DataFrame, links: DataFrame | None, texts: DataFrame, k: int, numerator: int, denominator: int) -> tuple[DataFrame, DataFrame]:
    """Links and components after the pairs have been compared, as far as they join components.

    First every ``b`` meets its smallest ``a`` only. Then all pairs are compared
    that still lie in different components. In a group of near copies the first
    step joins nearly all, so their other pairs move no text. Where the pairs are at most
    twice as many as that, all are compared at once.
    """
    first = materialize(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    at_once = pairs.count() <= 2 * first.count()
    first = pairs if at_once else first
    found = verify(first, texts, k, numerator, denominator)
    links = materialize(found if links is None else links.unionByName(found), "links")
    comps = materialize(components(links), "components")
    if at_once:
        return links, comps
    left = pairs.join(first, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        named = comps.select(F.col("class").alias(side), F.col("comp").alias(f"comp_{side}"))
        left = left.join(named, side, "left").withColumn(f"comp_{side}", F.coalesce(f"comp_{side}", side))
    left = materialize(left.where("comp_a <> comp_b").select("a", "b"), "second")
    if not left.isEmpty():
        links = materialize(links.unionByName(verify(left, texts, k, numerator, denominator)), "links")
        comps = materialize(components(links), "components")
    return links, comps


def likely(pairs: DataFrame, members: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link; no linked pair is left out."""
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    one = materialize(members.select("class", "n_shingles", "sketch", "long_sketch").join(wanted, "class", "left_semi").dropDuplicates(["class"]), "sketches")
    slim, large = one.drop("long_sketch"), one.where("long_sketch IS NOT NULL")
    left = pairs.join(slim.alias("x"), F.col("a") == F.col("x.class"))
    near = materialize(left.join(slim.alias("y"), F.col("b") == F.col("y.class")).where(_near("x", "y", numerator, denominator)).select("a", "b"), "near")
    left = near.join(large.alias("x"), F.col("a") == F.col("x.class"))
    apart = left.join(large.alias("y"), F.col("b") == F.col("y.class")).where(~_long_near("x", "y", numerator, denominator)).select("a", "b")
    return near.join(apart, ["a", "b"], "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """Rows (class, comp) for every class in an edge: the smallest class reachable. Alternating stars, log rounds.

    Each round is written to the shared folder; a star around one class is one
    row per neighbour, never gathered.
    """
    current = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "stars")
    while not _are_stars(current):
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        top = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(top, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        current = materialize(small.union(top).distinct(), "stars")
    roots = current.select(F.col("b").alias("class")).distinct().select("class", F.col("class").alias("comp"))
    return current.select(F.col("a").alias("class"), F.col("b").alias("comp")).union(roots)


def _are_stars(edges: DataFrame) -> bool:
    """Every class of the edges (a > b) either has one edge, to its b, or is the b of others only: each b is its component's smallest."""
    ends = edges.select(F.col("a").alias("class"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    return ends.groupBy("class").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 OR ups = 1 AND least = 0").isEmpty()


def _near(x: str, y: str, numerator: int, denominator: int) -> Column:
    """Sizes and sketches of two classes allow a link; a quarter of the sketch is looked at before all of it.

    The sketches of two large sets differ in half of their bits whatever the sets hold; see ``_long_near``.
    """
    n, m = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")

    def apart(longs: int) -> Column:
        return sum((F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(longs)), F.lit(0))

    fits = denominator * F.least(n, m) >= numerator * F.greatest(n, m)
    most = (denominator - numerator) * (n + m)
    return fits & (apart(SKETCH_LONGS // 4) * (numerator + denominator) <= most) & (apart(SKETCH_LONGS) * (numerator + denominator) <= most)


def _long_near(x: str, y: str, numerator: int, denominator: int) -> Column:
    """The long sketches of two classes, where both have one, allow a link."""
    most = (denominator - numerator) * (F.col(f"{x}.n_shingles") + F.col(f"{y}.n_shingles"))
    return F.coalesce(_long_apart(x, y) * (numerator + denominator) <= most, F.lit(True))


def _long_apart(x: str, y: str) -> Column:
    """Bits in which two long sketches differ, the longer one folded to the shorter; null where one is missing."""
    p, q = F.col(f"{x}.long_sketch"), F.col(f"{y}.long_sketch")
    least = F.least(F.size(p), F.size(q))

    def fold(v: Column) -> Column:
        more = F.sequence(F.lit(1), (F.size(v) / least).cast("int") - 1)
        parts = F.aggregate(
            more, F.slice(v, F.lit(1), least), lambda done, i: F.zip_with(done, F.slice(v, i * least + 1, least), lambda a, b: a.bitwiseXOR(b))
        )
        return F.when(F.size(v) > least, parts).otherwise(v)

    differ = F.zip_with(fold(p), fold(q), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.when(p.isNotNull() & q.isNotNull(), F.aggregate(differ, F.lit(0), lambda total, n: total + n))


def _partners(pairs: DataFrame) -> DataFrame:
    """Rows (class, known): each pair (a, b) listed once, at the end that is in fewer pairs, so lists stay short."""
    many = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    ends = pairs.select("a", "b").distinct()
    for side in ("a", "b"):
        ends = ends.join(many.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}")), side)
    at_a = F.col("n_a") <= F.col("n_b")
    at = ends.select(F.when(at_a, F.col("a")).otherwise(F.col("b")).alias("class"), F.when(at_a, F.col("b")).otherwise(F.col("a")).alias("other"))
    return at.groupBy("class").agg(F.collect_list("other").alias("known"))


def across_components(rest: DataFrame, one: DataFrame, known: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The distinct pairs (a, b) of classes of one family that lie in different components and may link by size and sketch.

    Pairs in ``known`` are not listed again: near copies have hundreds of families in common. A family of more than
    ``FAMILY_BLOCK`` rows is cut into blocks by hash, and each two of its blocks are compared on their own, so no task needs
    a whole one.
    """
    told = materialize(one.join(_partners(known), "class", "left"), "told")
    rows = materialize(rest.join(told, "class"), "rest")
    blocks = F.ceil(F.col("n") / FAMILY_BLOCK).cast("int").alias("blocks")
    cut = rest.groupBy("family").agg(F.count("*").alias("n")).where(F.col("n") > FAMILY_BLOCK).select("family", blocks)
    cut = materialize(cut, "cut")
    # two large sets have long sketches to compare, which Spark joins; all other pairs are compared in arrays
    slim = rows.select("family", "class", "comp", "n_shingles", "sketch", "wide", "known").join(cut, "family", "left")
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).otherwise(F.lit(0))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    slim = slim.withColumn("block", own).select("*", every.alias("other")).drop("blocks")
    slim = slim.select("*", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).drop("other")
    dealt = slim.repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _whole_units(batches):
            a, b = _crossing(unit, numerator, denominator)
            if a.size:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    met = map_batches(dealt, compare, "a long, b long")
    across = (F.col("x.family") == F.col("y.family")) & (F.col("x.comp") < F.col("y.comp"))

    def listed(x: str, y: str) -> Column:
        return F.coalesce(F.array_contains(F.col(f"{x}.known"), F.col(f"{y}.class")), F.lit(False))

    new = ~listed("x", "y") & ~listed("y", "x")
    both = across & _near("x", "y", numerator, denominator) & new & _long_near("x", "y", numerator, denominator)
    large = rows.where("wide")
    wide = large.alias("x").join(large.alias("y"), both).select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))
    return materialize(_distinct_pairs(met.unionByName(wide)), "crossing")


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, sorted by (family, lo, hi), in tables of whole units and of about ``UNIT_ROWS`` rows or one unit."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < UNIT_ROWS:
            continue
        table = pa.Table.from_batches(held)
        key = _unit_keys(table)
        last = int(np.flatnonzero((key[1:] != key[:-1]).any(axis=1))[-1]) + 1 if (key[0] != key[-1]).any() else 0
        if last:
            yield table.slice(0, last)
        held, rows = table.slice(last).to_batches(), table.num_rows - last
    if rows:
        yield pa.Table.from_batches(held)


def _unit_keys(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("family", "lo", "hi")], axis=1)


def _crossing(table: pa.Table, numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes (smaller first, each once) of one unit and different components whose sizes and sketches allow a link."""
    table = table.combine_chunks()
    key = _unit_keys(table)
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[first, len(key)])
    cls, comp, n, block = (table.column(c).to_numpy() for c in ("class", "comp", "n_shingles", "block"))
    wide = table.column("wide").to_numpy(zero_copy_only=False)
    sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_LONGS)
    split = np.repeat(key[first, 1] != key[first, 2], sizes)

    def near(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs of rows (i, j) that may link; a quarter of the sketch is looked at before all of it."""
        fits = (comp[i] != comp[j]) & ~(wide[i] & wide[j]) & ~(split[i] & (block[i] == block[j]))
        fits &= denominator * np.minimum(n[i], n[j]) >= numerator * np.maximum(n[i], n[j])
        i, j = i[fits], j[fits]
        for longs in (SKETCH_LONGS // 4, SKETCH_LONGS):
            apart = np.bitwise_count(sketch[i, :longs] ^ sketch[j, :longs]).sum(axis=1, dtype=np.int64)
            close = apart * (numerator + denominator) <= (denominator - numerator) * (n[i] + n[j])
            i, j = i[close], j[close]
        return i, j

    left, right = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    # small units together: each row with the next one of its unit, the one after that and so on
    end = np.repeat(first + sizes, sizes)
    alive = np.flatnonzero(np.repeat(sizes <= SMALL_UNIT, sizes))
    for step in range(1, int(sizes[sizes <= SMALL_UNIT].max(initial=0))):
        alive = alive[alive + step < end[alive]]
        i, j = near(alive, alive + step)
        left.append(i)
        right.append(j)
    # a large unit by itself: a quarter of its sketches in columns, each row against all later ones
    quarter = SKETCH_LONGS // 4
    for at, size in zip(first[sizes > SMALL_UNIT].tolist(), sizes[sizes > SMALL_UNIT].tolist()):
        columns = np.ascontiguousarray(sketch[at : at + size, :quarter].T)
        own = n[at : at + size]
        for row in range(size - 1):
            apart = np.bitwise_count(columns[0, row + 1 :] ^ columns[0, row]).astype(np.int16)
            for c in range(1, quarter):
                apart += np.bitwise_count(columns[c, row + 1 :] ^ columns[c, row])
            j = np.flatnonzero(apart.astype(np.int64) * (numerator + denominator) <= (denominator - numerator) * (own[row] + own[row + 1 :]))
            if j.size:
                i, j = near(np.full(j.size, at + row), j + at + row + 1)
                left.append(i)
                right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    met = np.unique(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])], axis=1), axis=0)
    if met.size:
        ends = np.unique(np.r_[i, j])
        told = {(a, b) for a, own in zip(cls[ends].tolist(), table.column("known").take(pa.array(ends)).to_pylist()) for b in own or ()}
        met = met[[(a, b) not in told and (b, a) not in told for a, b in met.tolist()]]
    return met[:, 0], met[:, 1]


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = WORDS,
    numerator: int = NUMERATOR,
    denominator: int = DENOMINATOR,
) -> DataFrame:
    """Rows (doc_id, n_shingles, class, comp, component_id) for every row of ``docs``.

    Documents link when ``denominator * intersection >= numerator * union`` of
    their sets; ``component_id`` is the smallest id reachable by links. Texts
    that are null, empty or blank have no n-grams and are components of their own
    (repeated ids give repeated rows). A null id is kept; its component is the
    smallest id of its class. Other columns of ``docs`` play no part. An empty
    table gives an empty table.
    """
    members = materialize(classes(docs, id_col, text_col, k), "classes")
    total = members.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(4, int(total // SHINGLES_PER_BUCKET) + 1)
    shared = materialize(groups(docs, text_col, buckets, k, numerator, denominator), "groups")
    near = materialize(shared.where("near").select(F.col("family").alias("pivot"), "class").distinct(), "near")
    far = materialize(shared.where("NOT near").select("family", F.col("class").alias("pivot")).distinct(), "far")
    first = far.groupBy("family").agg(F.min("pivot").alias("a"))
    crossing = far.join(first, "family").where("pivot != a").select("a", F.col("pivot").alias("b"))
    stars = materialize(_distinct_pairs(crossing.union(near.toDF("a", "b"))), "pairs")
    close = materialize(likely(stars, members, numerator, denominator), "close")
    links, comps = settle(close, None, texts_of(close, members, docs, id_col, text_col, k), k, numerator, denominator)
    # families that still span several components, with their pivots' neighbours
    around = near.union(near.select("pivot", F.col("pivot").alias("class"))).union(far.select("pivot", F.col("pivot").alias("class"))).distinct()
    around = materialize(around.join(comps, "class", "left").select("pivot", "class", F.coalesce("comp", "class").alias("comp")), "around")
    span = around.groupBy("pivot").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    all_families = far.union(near.select(F.col("pivot").alias("family"), "pivot").distinct())
    open_ones = all_families.join(span, "pivot").groupBy("family").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("family")
    rest = materialize(all_families.join(open_ones, "family").join(around, "pivot").select("family", "class", "comp").distinct(), "rest")
    one = members.join(rest.select("class").distinct(), "class").dropDuplicates(["class"]).select("class", "n_shingles", "sketch", "long_sketch")
    one = materialize(one.withColumn("wide", F.col("long_sketch").isNotNull()), "sketches")
    pilot = F.pmod(F.xxhash64("family"), F.lit(PILOT)) == 0
    often = across_components(rest.where(pilot), one, close, numerator, denominator)
    seldom = across_components(rest.where(~pilot), one, close.unionByName(often), numerator, denominator)
    more = materialize(often.unionByName(seldom), "more")
    if not more.isEmpty():
        links, comps = settle(more, links, texts_of(more, members, docs, id_col, text_col, k), k, numerator, denominator)
    named = members.select("doc_id", "n_shingles", "class").join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    smallest = named.where("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("_least"))
    return named.join(smallest, "comp", "left").select(
        "doc_id", "n_shingles", "class", "comp", F.when(F.col("n_shingles") > 0, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without near copies: of each component the row with the smallest id stays, columns unchanged.

    Rows without n-grams are no copies of anything and stay. Of several rows with
    the component's smallest id those with the smallest class stay, and of these
    the one whose columns have the smallest hash.
    """
    found = jaccard_components(docs, id_col, text_col, **options).where("n_shingles > 0")
    rows = materialize(found.groupBy("doc_id", "class", "comp").agg(F.count("*").alias("n")), "members")
    heads = rows.groupBy("comp").agg(F.min(F.struct("doc_id", "class")).alias("head"))
    stays = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("class") == F.col("head.class"))
    moved = rows.join(heads, "comp").select("doc_id", "class", stays.alias("stays"), "n").where("NOT stays OR n > 1")
    moved = materialize(moved, "moved")
    names = [F.col(f"`{c}`") for c in docs.columns]
    cls, key, of, kept, row = fresh(docs, "_class", "_id", "_of", "_stays", "_row")
    read = with_class(docs, moved, id_col, text_col, cls, options.get("k", WORDS))
    others = read.where(F.col(cls).isNull()).select(*names)
    fates = moved.select(F.col("doc_id").alias(key), F.col("class").alias(of), F.col("stays").alias(kept))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & (F.col(cls) == F.col(of))
    looked = read.where(F.col(cls).isNotNull()).join(fates, same, "left")
    single = looked.where(F.col(kept).isNull()).select(*names)
    whole = F.struct(*names)
    several = looked.where(F.col(kept)).groupBy(key, of).agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias(row))
    several = several.select(*[F.col(row)[c].alias(c) for c in docs.columns])
    return others.unionByName(single).unionByName(several)
