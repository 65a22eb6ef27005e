"""Ordered per-key operators that hold when one key owns a third of the rows.

A plain ``Window.partitionBy(key)`` puts all rows of a key into one task. The
functions here first count rows per key. When no key is above the limit the
plain window is used. Otherwise the rows of hot keys are range-partitioned by
key and full order into chunks; each chunk is scanned on its own, a table of one
row per chunk carries the state from chunk to chunk, and a join hands every
chunk the state it starts with. Results equal the plain window's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

ROWS_PER_CHUNK = 4_000_000
STITCHED_AT_ONCE = 10_000

_CHUNK = "_chunk"


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is sum, count, min, max or last (non-null)."""

    kind: str
    value: Column
    inclusive: bool = True


def _aggregate(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](value)


def split_hot_keys(
    df: DataFrame,
    keys: list[str],
    order: str | list[str],
    rows_per_chunk: int = ROWS_PER_CHUNK,
    probe: DataFrame | None = None,
) -> DataFrame | None:
    """Add a chunk number, ascending along ``order``, to the rows of hot keys; other rows get null.

    Returns None when no key is hot. The rows of hot keys are sorted into ranges
    of (keys, order), about one range per ``rows_per_chunk`` rows; rows that tie
    in the first order column are cut by the others. The cut rows are written,
    so that every later read sees the same chunks. ``probe`` may give a cheaper table,
    with the same keys and about as many rows per key, to find hot keys on.
    """
    counted = df if probe is None else probe
    sizes = counted.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_chunk)
    hot = materialize(_renamed(sizes, keys, "_h_", ["_n"]))
    total = hot.agg(F.sum("_n")).first()[0]
    if not total:
        return None
    chunks = -(-total // rows_per_chunk) + 1
    order = [order] if isinstance(order, str) else order
    rows = df.join(hot.drop("_n"), _same(keys, "_h_"), "left_semi")
    cut = materialize(rows.repartitionByRange(chunks, *keys, *order).withColumn(_CHUNK, F.spark_partition_id().cast("bigint")))
    others = df.join(hot.drop("_n"), _same(keys, "_h_"), "left_anti").withColumn(_CHUNK, F.lit(None).cast("bigint"))
    return cut.unionByName(others)


def _renamed(df: DataFrame, keys: list[str], prefix: str, extra: list[str] | None = None) -> DataFrame:
    return df.select(*[F.col(k).alias(prefix + k) for k in keys], *(extra or []))


def _same(keys: list[str], prefix: str) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(prefix + key))
    return condition


def _plain(df: DataFrame, parts: list[str], order: list[str], values: dict[str, Running], reverse: bool) -> DataFrame:
    """Running values by a plain window over ``parts``."""
    window = Window.partitionBy(*parts).orderBy(*[F.desc(c) if reverse else F.asc(c) for c in order])
    frames = {
        True: window.rowsBetween(Window.unboundedPreceding, 0),
        False: window.rowsBetween(Window.unboundedPreceding, -1),
    }
    return df.select("*", *[_aggregate(v.kind, v.value).over(frames[v.inclusive]).alias(n) for n, v in values.items()])


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, Running],
    chunk: Column | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    probe: DataFrame | None = None,
    reverse: bool = False,
) -> DataFrame:
    """Add running values per key in the order of ``order``, or against it with ``reverse``.

    Later columns of ``order`` break ties. ``chunk`` may give a whole number,
    monotone in ``order``, that cuts the rows by a rule; chunks are then stitched
    in groups of ``STITCHED_AT_ONCE``, and those groups among each other.
    """
    if chunk is not None:
        chunked = df.withColumn(_CHUNK, chunk)
    else:
        chunked = split_hot_keys(df, keys, order, rows_per_chunk, probe)
    parts = list(keys) if chunked is None else [*keys, _CHUNK]
    source = df if chunked is None else chunked
    local = _plain(source, parts, order, values, reverse)
    if chunked is None:
        return _fill_counts(local, values)

    ordering = F.struct(*order)
    newest = F.min_by if reverse else F.max_by
    totals = chunked.where(F.col(_CHUNK).isNotNull()).groupBy(*parts).agg(*[
        (
            newest(v.value, F.when(v.value.isNotNull(), ordering)) if v.kind == "last" else _aggregate(v.kind, v.value)
        ).alias(f"_t_{n}")
        for n, v in values.items()
    ])
    carries = {f"_c_{n}": Running("sum" if v.kind == "count" else v.kind, F.col(f"_t_{n}"), inclusive=False) for n, v in values.items()}
    if chunk is not None:
        groups = F.floor(F.col("_at") / STITCHED_AT_ONCE)
        level = totals.withColumnRenamed(_CHUNK, "_at")
        few = level.select(F.min("_at"), F.max("_at")).first()
        if few[0] is None or few[1] - few[0] < STITCHED_AT_ONCE:
            stitched = _plain(level, keys, ["_at"], carries, reverse)
        else:
            stitched = running(level, keys, ["_at"], carries, groups, reverse=reverse)
    else:
        stitched = _plain(totals.withColumnRenamed(_CHUNK, "_at"), keys, ["_at"], carries, reverse)
    carried = stitched.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_at").alias(f"_k_{_CHUNK}"), *carries)
    # One row per chunk of a hot key: written out, so the join sees how small it is.
    carried = materialize(carried)
    joined = local.join(carried, _same(parts, "_k_"), "left")
    combined = joined.select(
        *[F.col(c) for c in df.columns],
        *[_combine(v.kind, F.col(n), F.col(f"_c_{n}")).alias(n) for n, v in values.items()],
    )
    return _fill_counts(combined, values)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(local.isNull() & carry.isNull(), None).otherwise(
            F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
        )
    if kind == "min":
        return F.least(local, carry)
    if kind == "max":
        return F.greatest(local, carry)
    return F.coalesce(local, carry)


def _fill_counts(df: DataFrame, values: dict[str, Running]) -> DataFrame:
    counts = {n: F.coalesce(F.col(n), F.lit(0)) for n, v in values.items() if v.kind == "count"}
    return df.withColumns(counts) if counts else df


def previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, str],
    chunk: Column | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    reverse: bool = False,
) -> DataFrame:
    """``lag(column, 1)`` per key; ``columns`` maps new name to source column."""
    boxed = {"_prev": Running("last", F.struct(*[F.col(c) for c in dict.fromkeys(columns.values())]), inclusive=False)}
    out = running(df, keys, order, boxed, chunk, rows_per_chunk, reverse=reverse)
    return out.withColumns({new: F.col("_prev")[old] for new, old in columns.items()}).drop("_prev")


def following(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, str],
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """``lead(column, 1)`` per key: ``previous`` against the order."""
    return previous(df, keys, order, columns, rows_per_chunk=rows_per_chunk, reverse=True)


def exact_percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    points: dict[str, float],
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Exact interpolated percentiles per key without gathering a group.

    Equal values are counted map-side first; a running sum of those counts
    gives each value its rank interval, and an aggregate picks the two values
    around every requested rank.
    """
    df = df.where(F.col(value).isNotNull())
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running(counts, keys, [value], {"_upto": Running("sum", F.col("_n"))}, rows_per_chunk=rows_per_chunk, probe=df)
    sizes = _renamed(counts.groupBy(*keys).agg(F.sum("_n").alias("_size")), keys, "_s_", ["_size"])
    joined = ranked.join(sizes, _same(keys, "_s_"))
    aggregates = [F.max("_size").alias("_size")]
    for name, p in points.items():
        position = F.lit(p) * (F.col("_size") - 1)
        aggregates += [
            F.min(F.when(F.col("_upto") > F.floor(position), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_upto") > F.ceil(position), F.col(value))).alias(f"_hi_{name}"),
        ]
    picked = joined.groupBy(*keys).agg(*aggregates)
    out = []
    for name, p in points.items():
        position = F.lit(p) * (F.col("_size") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return picked.select(*keys, *out)


def runs(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    condition: Column,
    chunk: Column | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    bounds: bool = False,
) -> DataFrame:
    """Maximal runs of consecutive rows where ``condition`` holds, per key.

    A run is named by the number of rows before it that broke the condition, so
    runs form by a partial hash aggregation. Returns keys, run_start, run_end
    (values of ``order[0]``) and run_length; ``bounds`` adds first_row and
    last_row (structs of ``order``).
    """
    holds = F.coalesce(condition, F.lit(False))
    marked = running(
        df.withColumn("_holds", holds),
        keys,
        order,
        {"_island": Running("count", F.when(~F.col("_holds"), 1))},
        chunk,
        rows_per_chunk,
    )
    extra = [F.min(F.struct(*order)).alias("first_row"), F.max(F.struct(*order)).alias("last_row")] if bounds else []
    return (
        marked.where("_holds")
        .groupBy(*keys, "_island")
        .agg(
            F.min(order[0]).alias("run_start"),
            F.max(order[0]).alias("run_end"),
            F.count("*").alias("run_length"),
            *extra,
        )
        .drop("_island")
    )
