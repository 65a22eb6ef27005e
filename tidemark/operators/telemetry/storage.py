"""IO, cache, bloat, index and storage reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import label, percent, ratio_or_null, ratio_or_zero
from tidemark.operators.rules import Rule, evaluate

# Healthy ranges of an index.
INDEX_RULES = [
    Rule("SCAN_FREQUENCY", "scans_per_month", "<", 50, "REVIEW"),
    Rule("WRITE_PENALTY", "write_penalty_pct", ">", 5, "REVIEW"),
    Rule("CACHE_HIT", "cache_hit_pct", "<", 95, "REVIEW"),
    Rule("BLOAT", "dead_pct", ">", 10, "REINDEX"),
]


def io_latency(stats: DataFrame, hot_ms: float | None = None) -> DataFrame:
    """Mean stall per read and write; ``hot_ms`` keeps files above it on either side."""
    out = stats.withColumns({
        "avg_read_stall_ms": ratio_or_zero(F.col("read_stall_ms"), F.col("reads")),
        "avg_write_stall_ms": ratio_or_zero(F.col("write_stall_ms"), F.col("writes")),
    })
    if hot_ms is None:
        return out
    return out.where((F.col("avg_read_stall_ms") > hot_ms) | (F.col("avg_write_stall_ms") > hot_ms))


def read_heavy(stats: DataFrame, factor: int = 10, excluded: list[str] | None = None, owner: str = "owner") -> DataFrame:
    """Objects read more than ``factor`` times as often as written."""
    out = stats.where(F.col("reads") > F.col("writes") * factor)
    return out.where(~F.col(owner).isin(*excluded)) if excluded else out


def dead_rows(stats: DataFrame, min_dead: int = 10_000, min_pct: float = 10.0) -> DataFrame:
    out = stats.withColumn("dead_pct", percent(F.col("dead"), F.col("live") + F.col("dead")))
    return out.where((F.col("dead") > min_dead) | (F.col("dead_pct") > min_pct))


def hit_ratio(stats: DataFrame, min_reads: int = 0, below_pct: float | None = None) -> DataFrame:
    out = stats.withColumn("hit_pct", percent(F.col("hits"), F.col("hits") + F.col("misses")))
    return out.where((F.col("misses") > min_reads) & (F.col("hit_pct") < below_pct)) if below_pct is not None else out


def cache_hit(df: DataFrame, hits: Column, misses: Column) -> DataFrame:
    """Global hit ratio of sums, null when nothing was read."""
    return df.agg(F.sum(hits).alias("hits"), F.sum(misses).alias("misses")).select(
        "hits", "misses", ratio_or_null(F.col("hits"), F.col("hits") + F.col("misses")).alias("hit_ratio")
    )


def index_usage(indexes: DataFrame, usage: DataFrame, key: str) -> DataFrame:
    """Every index with its usage, seek and read share and a usage label."""
    zero = F.lit(0).cast("bigint")
    joined = indexes.join(usage, key, "left").select(
        *indexes.columns, *[F.coalesce(c, zero).alias(c) for c in ("seeks", "scans", "lookups", "updates")]
    )
    reads = F.col("seeks") + F.col("scans") + F.col("lookups")
    total = reads + F.col("updates")
    return joined.select(
        "*",
        F.round(F.lit(100.0) * ratio_or_null(F.col("seeks"), total), 1).alias("seek_pct"),
        F.round(F.lit(100.0) * ratio_or_null(reads, total), 1).alias("read_pct"),
        label(reads, [(reads == 0, "UNUSED"), (reads < 10, "VERY_LOW")], "USED").alias("usage"),
    )


def redundant_indexes(indexes: DataFrame, table: str, name: str, columns: str) -> DataFrame:
    """Indexes whose columns lead another index of the same table.

    Each index offers its proper prefixes; one aggregate per (table, prefix)
    names the shortest covering index, so no index is paired with all others.
    """
    prefixes = indexes.where(F.size(columns) > 1).select(
        table,
        F.col(name).alias("_cover"),
        F.size(columns).alias("_len"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size(columns) - 1), lambda n: F.slice(columns, 1, n))).alias("_prefix"),
    )
    covers = prefixes.groupBy(F.col(table).alias("_t"), "_prefix").agg(
        F.count("*").alias("covering_indexes"), F.min(F.struct("_len", "_cover")).alias("_best")
    )
    joined = indexes.join(covers, (F.col(table) == F.col("_t")) & (F.col(columns) == F.col("_prefix")))
    return joined.select(table, name, F.col("_best._cover").alias("covered_by"), "covering_indexes")


#: Values of a bitmap of Spark's bitmap aggregates.
BITMAP_VALUES = 32_768
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """One row (column_name, unique_count, total_rows): exact distinct non-null values of one column, and all rows.

    Whole numbers are set in bitmaps of ``BITMAP_VALUES`` values each, so a task sends a
    bitmap per range it has seen however often the values repeat. Other types are reduced to
    their distinct values per task, then per key range. Only this column is read.
    """
    values = df.select(F.col(column).alias("v"))
    if df.schema[column].dataType.simpleString() in _WHOLE:
        wide = F.col("v").cast("bigint")
        bits = F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(wide)))
        parts = values.groupBy(F.bitmap_bucket_number(wide).alias("b")).agg(F.count("*").alias("rows"), bits.alias("n"))
    else:
        parts = values.groupBy("v").agg(F.count("*").alias("rows")).select("rows", F.col("v").isNotNull().cast("bigint").alias("n"))
    zero = F.lit(0).cast("bigint")
    return parts.agg(F.coalesce(F.sum("n"), zero).alias("unique_count"), F.coalesce(F.sum("rows"), zero).alias("total_rows")).select(
        F.lit(column).alias("column_name"), "unique_count", "total_rows"
    )


def low_cardinality(df: DataFrame, columns: list[str], below_pct: float = 5.0, exact: bool = False) -> DataFrame:
    """Columns with few distinct values.

    Sketched counts come from one pass. Exact ones are counted column by column, each
    reading its own column only, so no row is copied once per column.
    """
    if exact:
        rows = reduce(DataFrame.unionByName, [distinct_count(df, c) for c in columns])
    else:
        one = df.agg(F.count("*").alias("total_rows"), *[F.approx_count_distinct(c).alias(c) for c in columns])
        rows = one.unpivot(["total_rows"], columns, "column_name", "unique_count")
    pct = F.round(F.lit(100.0) * ratio_or_null(F.col("unique_count"), F.col("total_rows")), 4)
    return rows.select("column_name", "unique_count", "total_rows", pct.alias("cardinality_pct")).where(F.col("cardinality_pct") < below_pct)


def index_score(stats: DataFrame) -> DataFrame:
    """cost * impact / 100 * (seeks + scans), in decimals so that half cents round alike everywhere."""
    gain = F.col("avg_cost").cast("decimal(12,2)") * F.col("avg_impact").cast("decimal(6,2)")
    score = gain * (F.col("seeks") + F.col("scans")).cast("decimal(12,0)") * F.lit("0.01").cast("decimal(2,2)")
    return stats.withColumn("improvement", score.cast("decimal(18,2)"))


def index_health(stats: DataFrame, ids: list[str]) -> DataFrame:
    return evaluate(stats, INDEX_RULES, ids)


def storage_by(df: DataFrame, owner: list[str], data_bytes: Column, index_bytes: Column) -> DataFrame:
    """Objects, data, index and total size in MB per owner."""
    mb = 1024.0 * 1024.0
    sums = df.groupBy(*owner).agg(
        F.count("*").alias("objects"), F.sum(data_bytes).alias("_data"), F.sum(index_bytes).alias("_index")
    )
    return sums.select(
        *owner,
        "objects",
        F.round(F.col("_data").cast("double") / mb, 4).alias("data_mb"),
        F.round(F.col("_index").cast("double") / mb, 4).alias("index_mb"),
        F.round((F.col("_data") + F.col("_index")).cast("double") / mb, 4).alias("total_mb"),
    )


def hot_partitions(df: DataFrame, key: str, factor: float = 2.0) -> DataFrame:
    """Rows per key with the ratio to the mean; HOT above ``factor`` times the mean."""
    counts = df.groupBy(key).agg(F.count("*").alias("items"))
    mean = counts.agg(F.avg("items")).scalar()
    ratio = F.round(F.col("items").cast("double") / mean, 4)
    return counts.withColumn("ratio_to_mean", ratio).withColumn(
        "status", F.when(F.col("ratio_to_mean") > factor, "HOT").otherwise("OK")
    )


def progress(df: DataFrame, done: str, total: str) -> DataFrame:
    """Unfinished operations with percent done."""
    return df.where(F.col(done) < F.col(total)).withColumn("pct_done", percent(F.col(done), F.col(total)))


def stale(df: DataFrame, last: str, as_of: str, max_days: int) -> DataFrame:
    """Objects never maintained or not for more than ``max_days``."""
    age = F.date_diff(F.lit(as_of).cast("date"), F.col(last).cast("date"))
    return df.withColumn("age_days", age).where(F.col("age_days").isNull() | (F.col("age_days") > max_days))
