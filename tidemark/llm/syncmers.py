"""Document fingerprints from closed syncmers, with DataFrame functions only.

Units are words. A k-mer of words is a closed syncmer if the smallest hash among
its inner s-mers stands at its first or last place. Whether a k-mer is chosen
depends on nothing outside it, so texts that share a passage choose the same
k-mers in it: they are anchors for comparing texts piece by piece. A text's
fingerprint lists all its anchors, each with the place of its first word and its
hash; two texts are as like as the share of anchors that match in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

K, S = 5, 2
PART_BYTES = 4_000_000
COARSE = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hashes(text: Column) -> Column:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ in order (null text: none)."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _struct(place: Column, found: Column) -> Column:
    return F.struct(place.cast("array<int>").alias("place"), found.cast("array<bigint>").alias("hash"))


def closed_syncmers(hashes: Column, k: int = K, s: int = S) -> Column:
    """All closed syncmers of a sequence of unit hashes, in order: struct of arrays ``place`` (from 0) and ``hash``.

    A sequence without any (shorter than k, or too short to have one) gives its units' own hashes, an empty one nothing.
    """
    last = k - s

    def units(h: Column) -> Column:
        return F.when(F.size(h) == 0, _struct(F.array(), F.array())).otherwise(_struct(F.sequence(F.lit(0), F.size(h) - 1), h))

    def of_inner(h: Column, inner: Column) -> Column:
        def chosen(i: Column) -> Column:
            least = F.least(*[inner[i + j] for j in range(last + 1)])
            return (least == inner[i]) | (least == inner[i + last])

        steps = [*range(0, last, s), last]
        starts = F.filter(F.sequence(F.lit(0), F.size(h) - k), chosen)
        found = let(starts, lambda x: _struct(x, F.transform(x, lambda i: F.xxhash64(*[inner[i + j] for j in steps]))))
        return let(found, lambda x: F.when(F.size(x["place"]) > 0, x).otherwise(units(h)))

    def of_units(h: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*[h[i + j] for j in range(s)]))
        return F.when(F.size(h) < k, units(h)).otherwise(let(inner, lambda x: of_inner(h, x)))

    return let(hashes, of_units)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """All closed syncmers of a text's words, in order: struct of arrays ``place`` (of the first word, from 0) and ``hash``."""
    return closed_syncmers(word_hashes(text), k, s)


def fingerprint(text: Column, k: int = K, s: int = S) -> Column:
    """The set of closed syncmers of a text, as a sorted array of hashes."""
    return F.sort_array(F.array_distinct(anchors(text, k, s)["hash"]))


def printed(found: Column) -> Column:
    """The number of anchors and all of them in order: place and hash in hexadecimal."""
    one = F.zip_with(found["place"], found["hash"], lambda p, h: F.concat(p.cast("string"), F.lit("."), F.lower(F.lpad(F.hex(h), 16, "0"))))
    return F.concat(F.size(found["place"]).cast("string"), F.lit(":"), F.array_join(one, ","))


def _numbered(found: Column, side: int) -> Column:
    """Sorted structs (hash, n, side, at) of anchors: ``n`` numbers those of equal hash, ``at`` is the index in the text's order."""

    def of_sorted(x: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (x[i]["hash"] != F.get(x, i - 1)["hash"]))

        def numbers(f: Column) -> Column:
            return F.flatten(F.transform(f, lambda a, j: F.sequence(F.lit(0), F.coalesce(F.get(f, j + 1), F.size(x)) - a - 1)))

        return F.zip_with(x, let(first, numbers), lambda y, n: F.struct(y["hash"].alias("hash"), n.alias("n"), F.lit(side).alias("side"), y["at"].alias("at")))

    own = F.sort_array(F.transform(found["hash"], lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
    none = F.array().cast("array<struct<hash:bigint,n:int,side:int,at:int>>")
    return let(own, lambda x: F.when(F.size(x) == 0, none).otherwise(of_sorted(x)))


def matched(a: Column, b: Column) -> Column:
    """Structs (a, b): indices of anchors of equal hash in both texts, in the first one's order.

    Repeated hashes pair by number: the first with the first and so on.
    """

    def pairs(x: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(x)), lambda i: (F.get(x, i)["side"] == 0) & (F.get(x, i + 1)["side"] == 1) & (F.get(x, i)["hash"] == F.get(x, i + 1)["hash"]) & (F.get(x, i)["n"] == F.get(x, i + 1)["n"]))
        return F.sort_array(F.transform(at, lambda i: F.struct(x[i]["at"].alias("a"), x[i + 1]["at"].alias("b"))))

    return let(F.sort_array(F.concat(_numbered(a, 0), _numbered(b, 1))), pairs)


def in_order(pairs: Column) -> Column:
    """The most of these pairs (in the first text's order) that stand in the same order in both texts.

    Pairs that are neighbours in both orders form a block; each is taken whole or not at all, so the heaviest
    increasing chain of blocks is exact.
    """
    by_b = F.sort_array(F.transform(pairs, lambda p: F.struct(p["b"].alias("b"), p["a"].alias("a"))))
    ranked = F.transform(F.sort_array(F.transform(by_b, lambda p, i: F.struct(p["a"].alias("a"), i.alias("rank")))), lambda p: p["rank"])

    def blocks(r: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (i == 0) | (r[i] != F.get(r, i - 1) + 1))
        return let(
            first, lambda f: F.transform(f, lambda i, j: F.struct(r[i].alias("lo"), (F.coalesce(F.get(f, j + 1), F.size(r)) - i).alias("n")))
        )

    def step(chains: Column, x: Column) -> Column:
        before = F.array_max(F.transform(F.filter(chains, lambda c: c["end"] < x["lo"]), lambda c: c["n"]))
        return F.concat(chains, F.array(F.struct((x["lo"] + x["n"] - 1).alias("end"), (F.coalesce(before, F.lit(0)) + x["n"]).alias("n"))))

    none = F.array().cast("array<struct<end:int,n:int>>")
    chained = let(ranked, lambda r: F.aggregate(blocks(r), none, step, lambda c: F.array_max(F.transform(c, lambda x: x["n"]))))
    return F.when(F.size(pairs) == 0, 0).otherwise(chained)


def likeness(a: Column, b: Column) -> Column:
    """Anchors matched in order, as a share of all anchors of both texts (a match counts once); 1 for two texts without any."""
    both = let(matched(a, b), in_order)
    total = F.size(a["hash"]) + F.size(b["hash"])
    return let(both, lambda n: F.when(total == 0, 1.0).otherwise(n / (total - n)))


def id_parts(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A number of the row's part, ascending with an integer id: quantiles of the ids, each cut into equal ranges.

    One pass gives the bytes and at most ``COARSE`` quantiles; the number of parts follows the bytes. Null ids come first.
    """
    size = docs.agg(F.sum(F.octet_length(f"`{text_col}`")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // PART_BYTES))
    coarse = min(COARSE, parts)
    fine = -(-parts // coarse)
    shares = [i / coarse for i in range(1, coarse)]
    row = docs.agg(
        F.min(f"`{id_col}`").alias("lo"), F.max(f"`{id_col}`").alias("hi"), F.percentile_approx(f"`{id_col}`", shares or [0.5], 10_000).alias("q")
    ).first()
    if row["lo"] is None:
        return F.lit(0).cast("long")
    cuts = sorted({row["lo"], *(row["q"] if shares else []), row["hi"] + 1})
    ends = F.array(*[F.lit(c).cast("long") for c in cuts])
    id_ = F.coalesce(F.col(f"`{id_col}`"), F.lit(row["lo"])).cast("long")
    at = F.size(F.filter(ends, lambda c: c <= id_))
    low, high = F.element_at(ends, at), F.element_at(ends, at + 1)
    inside = F.floor((id_ - low) / (high - low).cast("double") * fine)
    return (at.cast("long") * fine + F.least(inside, F.lit(fine - 1))).cast("long")


def with_next(docs: DataFrame, id_col: str, text_col: str, made: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Rows (id, text, *made, next_text, next_*made): each document with the one after it in the order of ids.

    After the last comes the first; equal ids are ordered by text. Rows are dealt by ranges of ids and ordered within a
    range; the last row of a range takes the first row of the next one from a table with one row per range. ``made``
    are expressions of the text, computed once per document.
    """
    part = id_parts(docs, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), part.alias("part"))
    first = rows.groupBy("part").agg(F.min(F.struct("id", "text")).alias("first"))
    first = materialize(first.select("part", F.col("first.text").alias("first_text")), "first")
    numbers = first.select("part")
    after = numbers.select("part", F.lead("part").over(Window.orderBy("part")).alias("next"), F.min("part").over(Window.partitionBy()).alias("least"))
    following = after.select("part", F.coalesce("next", "least").alias("next")).join(first.withColumnRenamed("part", "next"), "next").drop("next")
    following = following.select("part", "first_text", *[f(F.col("first_text")).alias(f"first_{n}") for n, f in made.items()])
    following = materialize(following, "following")
    order = Window.partitionBy("part").orderBy("id", "text")
    dealt = rows.repartition("part").select("*", *[f(F.col("text")).alias(n) for n, f in made.items()])
    led = dealt.select("*", F.lead(F.struct("text", *made)).over(order).alias("next"))
    joined = led.join(following, "part")
    return joined.select(
        "id",
        "text",
        *made,
        *[F.when(F.col("next").isNull(), F.col(f"first_{n}")).otherwise(F.col(f"next.{n}")).alias(f"next_{n}") for n in ("text", *made)],
    )


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, both fingerprints, near_edited and near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document. Fingerprints hold every anchor. A null text counts as empty;
    texts without words have the empty fingerprint. Repeated rows are rows of
    their own; ids must be integers, null ids come first; other columns play no
    part; an empty table gives an empty table.
    """
    rows = with_next(docs, id_col, text_col, {"found": anchors})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half))
    rows = rows.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "found", "next_found")
    rows = rows.select("*", anchors(F.col("edited")).alias("edited_found"))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("found")).alias("fingerprint"),
        printed(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("edited_found")).cast("double").alias("near_edited"),
        likeness(F.col("found"), F.col("next_found")).cast("double").alias("near_next"),
    )
