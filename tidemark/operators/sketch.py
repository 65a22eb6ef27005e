"""Reconciliation by difference sketch: what two tables exchange follows their drift, not their size.

Each side is summed into a table of cells. A row is one element, (hash of its key, hash
of its values), and falls into three cells, one of each third of the table; a cell holds the
number of its elements and the sums of their hashes and of a check hash. The sides are subtracted
cell by cell, so equal rows vanish wherever they lie. A cell that holds one element only, perhaps
several times, shows it: its sums are whole multiples of an element with a right check hash. Such
elements are taken out of their other cells, which shows more, round by round.

Where peeling stops early the cells were too few for the drift. They are made
more, and in the end the rows are compared in full; the result is the same in every case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.signature import signature
from tidemark.operators.diff import SAME, key_status
from tidemark.session import materialize

CELLS, GROWTH, ATTEMPTS = 3 * 4096, 32, 3
#: Sums of 32-bit halves of the key's, the values' and the check hash.
SUMS = ("key_hi", "key_lo", "row_hi", "row_lo", "check_hi", "check_lo")
_LOW = 0xFFFFFFFF


def _check(key: str, row: str) -> Column:
    return F.xxhash64(F.lit("check"), F.col(key), F.col(row))


def _halves(n: Column) -> list[Column]:
    """``n`` times the halves of the hashes (key, row, check)."""
    out = []
    for value in (F.col("key"), F.col("row"), _check("key", "row")):
        out += [F.shiftright(value, 32) * n, value.bitwiseAND(F.lit(_LOW)) * n]
    return out


def _cells(elements: DataFrame, cells: int, n: Column) -> DataFrame:
    """Cell rows of elements (key, row), each counted ``n`` times."""
    third = cells // 3
    homes = F.array(*[F.pmod(F.xxhash64(F.lit(i), F.col("key"), F.col("row")), F.lit(third)) + i * third for i in range(3)])
    return elements.select(F.explode(homes).alias("cell"), n.alias("n"), *[h.alias(s) for s, h in zip(SUMS, _halves(n))])


def _summed(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in SUMS])
    return sums.where(" OR ".join(f"{c} <> 0" for c in ("n", *SUMS)))


def elements(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One (key, row) pair of hashes per row; equal values give equal hashes whatever their column types."""
    return df.select(F.xxhash64(signature(df, keys)).alias("key"), F.xxhash64(F.lit("row"), signature(df, [*keys, *columns])).alias("row"))


def difference(source: DataFrame, target: DataFrame, cells: int) -> DataFrame:
    """The non-zero cells of source minus target, both tables of elements; at most ``cells`` rows leave a task."""
    both = _cells(source, cells, F.lit(1).cast("bigint")).unionByName(_cells(target, cells, F.lit(-1).cast("bigint")))
    return _summed(both)


def peel(sketch: DataFrame, cells: int) -> tuple[DataFrame, bool]:
    """(elements (key, row, n), whether all cells could be resolved); ``n`` is by how many more the source has it."""
    left = materialize(sketch, "sketch")
    found = None
    while not left.isEmpty():
        whole = F.lit(True)
        for s in SUMS:
            whole = whole & F.expr(f"{s} % nullif(n, 0) = 0")

        def value(name: str) -> Column:
            return F.expr(f"shiftleft({name}_hi div nullif(n, 0), 32) | ({name}_lo div nullif(n, 0))")

        single = left.where(whole).select("cell", "n", value("key").alias("key"), value("row").alias("row"), value("check").alias("seen"))
        single = single.where(F.col("seen") == _check("key", "row"))
        shown = materialize(single.groupBy("key", "row").agg(F.max("n").alias("n")), "shown")
        if shown.isEmpty():
            return found if found is not None else shown, False
        found = shown if found is None else found.unionByName(shown)
        left = materialize(_summed(left.unionByName(_cells(shown, cells, -F.col("n")))), "sketch")
    if found is None:
        found = left.select(F.col("key_hi").alias("key"), F.col("row_hi").alias("row"), "n")
    return found, True


def sketch_diff(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], cells: int = CELLS, attempts: int = ATTEMPTS
) -> DataFrame:
    """``diff.key_status`` of the keys that are not SAME, found through the sketch.

    The sketch gives the hashes of drifting keys; only their rows are read again and
    compared exactly, so a hash that two keys share costs a comparison and no error. Each further attempt
    has ``GROWTH`` times the cells; after ``attempts`` all rows are compared.
    """
    sides = elements(source, keys, columns), elements(target, keys, columns)
    for _ in range(attempts):
        cells = max(3, cells // 3 * 3)
        found, complete = peel(difference(*sides, cells), cells)
        if complete:
            drift = materialize(found.select(F.col("key").alias("_key")).distinct(), "drift")
            kept = [df.withColumn("_key", F.xxhash64(signature(df, keys))).join(drift, "_key", "left_semi") for df in (source, target)]
            return key_status(*[df.select(*keys, *columns) for df in kept], keys, columns).where(F.col("status") != SAME)
        cells *= GROWTH
    return key_status(source, target, keys, columns).where(F.col("status") != SAME)
