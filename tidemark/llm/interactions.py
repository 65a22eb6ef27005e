"""How filters of a corpus interact: what each removes in every order, and its Shapley share.

1. Every row gets a bit mask of the filters that it fails. Counts per (part,
   mask) are all that later steps need: at most ``2**n`` rows a part.
2. From them the removals of all coalitions of filters are tabulated: a coalition
   removes the rows whose mask meets it.
3. Shapley values solve a constrained least-squares problem: the additive values
   that fit the removals of all coalitions best under the Shapley kernel's weights,
   given that they sum to the removals of all filters. The normal equations are
   solved in rationals, once, for unit removals; the solution is a linear map of the
   tabulated removals with whole coefficients once multiplied by ``n!``.
4. A step of an order is a difference of two coalitions: with its filter, and before it.

One filter is not a matter of one row: copies. A row is a copy when a row with a
smaller id has the same text. Texts are told apart by SHA-256; a row is *not* a
copy when its id is the smallest of its digest, which is found by an equi-join on
(id, digest), so many copies of one text are many keys.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

WORD = r"[^\x20\x09-\x0D]+"


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X with ``matrix @ X = right``, exactly."""
    rows = [[*a, *b] for a, b in zip(matrix, right)]
    n = len(rows)
    for i in range(n):
        pivot = next(j for j in range(i, n) if rows[j][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(n):
            if j != i and rows[j][i]:
                rows[j] = [x - rows[j][i] * y for x, y in zip(rows[j], rows[i])]
    return [r[n:] for r in rows]


def shapley_map(n: int) -> list[list[Fraction]]:
    """Row i holds the coefficients by which the values of all ``2**n`` coalitions make player i's Shapley value.

    Minimises the kernel-weighted squares of v(S) - v(0) - sum of S's values over all
    proper coalitions, subject to the sum of all values being v(all) - v(0).
    """
    full = (1 << n) - 1
    matrix = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    right = [[Fraction(0)] * (full + 1) for _ in range(n + 1)]
    for s in range(1, full):
        size = s.bit_count()
        weight = Fraction(n - 1, comb(n, size) * size * (n - size))
        inside = [i for i in range(n) if s >> i & 1]
        for i in inside:
            for j in inside:
                matrix[i][j] += weight
            right[i][s] += weight
            right[i][0] -= weight
    for i in range(n):
        matrix[i][n] = matrix[n][i] = Fraction(1)
    right[n][full], right[n][0] = Fraction(1), Fraction(-1)
    return solve(matrix, right)[:n]


def text_checks(text: Column) -> dict[str, Column]:
    """Filter letter → failure condition of a text."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, part, mask): per row of ``docs`` the filters A to E that it fails, A being bit 0 and E (copies) the last.

    Null texts and parts are empty. A row without id is never a copy, and none is a
    copy of it; of rows with equal text and equal smallest id none is a copy.
    Other columns play no part.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    checks = text_checks(F.col("text"))
    flags = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(checks.values())]
    base = docs.select(F.col(f"`{id_col}`").alias("id"), part.alias("part"), text.alias("text"))
    base = base.select("id", "part", sum(flags[1:], flags[0]).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    base = materialize(base, "checked")
    heads = base.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << len(checks)).otherwise(0)
    return base.join(heads, ["id", "digest"], "left").select("id", "part", (F.col("mask") + copy).alias("mask"))


def audit(masks: DataFrame, names: str, sums: list[str] | None = None) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, ``<name>_lost`` …, shapley).

    ``masks`` has part, mask and the 0/1 columns named in ``sums``; bit i of a mask
    stands for filter ``names[i]``. Every part gets all orders and steps. No row gives no row.
    """
    n, sums = len(names), sums or []
    full = (1 << n) - 1
    counted = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.sum(F.col(s).cast("long")).alias(s) for s in sums])

    def removals(name: str) -> Column:
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(name)).otherwise(F.lit(0))) for s in range(full + 1)])

    table = counted.groupBy("part").agg(F.sum("n").alias("total"), *[removals(c).alias(f"of_{c}") for c in ["n", *sums]])
    share = []
    for row in shapley_map(n):
        whole = [c * factorial(n) for c in row]
        assert all(c.denominator == 1 for c in whole)
        share.append(sum((F.col("of_n")[s] * F.lit(int(c)) for s, c in enumerate(whole) if c), F.lit(0)).cast("long"))
    table = table.withColumn("share", F.array(*share))
    orders = F.explode(F.split(F.lit(" ".join("".join(o) for o in permutations(names))), " "))
    steps = table.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    at = F.instr(F.lit(names), F.expr("substring(filter_order, step, 1)")) - 1
    before = [F.when(F.instr("filter_order", c) < F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(names)]
    steps = steps.withColumn("at", at).withColumn("before", sum(before[1:], before[0])).withColumn("bit", F.expr("shiftleft(1, at)"))

    def gain(name: str) -> Column:
        of = F.col(f"of_{name}")
        return of[F.col("before") + F.col("bit")] - of[F.col("before")]

    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.col("of_n")[F.col("before") + F.col("bit")]).alias("kept"),
        gain("n").alias("removed"),
        (F.col("of_n")[F.col("bit")] - gain("n")).alias("redundant"),
        (F.col("of_n")[full] - F.col("of_n")[full - F.col("bit")]).alias("unique_fails"),
        *[gain(s).alias(f"{s}_lost") for s in sums],
        F.col("share")[F.col("at")].alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``audit`` of the filters A to E over ``docs``, with labelled good and toxic rows lost.

    ``labels`` has the id, quality and toxic; of repeated label rows the greatest
    values count, rows without a label are neither good nor toxic.
    """
    name = F.col(f"`{id_col}`")
    known = labels.groupBy(name.alias("id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    rows = failures(docs, part_col, id_col, text_col).join(known, "id", "left")
    flags = [F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c) for c in ("good", "toxic")]
    return audit(rows.select("part", "mask", *flags), "ABCDE", ["good", "toxic"])
