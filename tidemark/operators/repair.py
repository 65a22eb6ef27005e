"""Key-scoped repair of a target from its source. Each function returns the new target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.diff import key_status
from tidemark.operators.summary import TableSpec, compare_segments, summarize_by


def insert_missing(source: DataFrame, target: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """Add scoped source rows whose key is not in the target."""
    wanted = source.join(scope.select(*keys), keys, "left_semi")
    return target.unionByName(wanted.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def delete_extra(source: DataFrame, target: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """Drop scoped target rows whose key is not in the source."""
    doomed = scope.select(*keys).join(source.select(*keys), keys, "left_anti")
    return target.join(doomed, keys, "left_anti")


def update_changed(
    source: DataFrame, target: DataFrame, scope: DataFrame, keys: list[str], insert: bool = False
) -> DataFrame:
    """Overwrite scoped target rows by their source rows; ``insert`` also adds missing ones."""
    values = [c for c in target.columns if c not in keys]
    fresh = source.join(scope.select(*keys), keys, "left_semi").select(*keys, F.struct(*values).alias("_new"))
    joined = target.select(*keys, F.struct(*values).alias("_old")).join(fresh, keys, "full" if insert else "left")
    row = F.coalesce("_new", "_old")
    return joined.select(*keys, row.alias("_row")).select(*keys, "_row.*").select(*target.columns)


def repair(source: DataFrame, target: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """All three branches at once: extra rows go, changed and missing rows come from the source.

    Rows outside the scope are kept as they are and scoped rows are taken from
    the source, so both tables are only filtered by the scope. When the scope is
    small against the tables no wide row is shuffled.
    """
    wanted = scope.select(*keys)
    kept = target.join(wanted, keys, "left_anti")
    return kept.unionByName(source.join(wanted, keys, "left_semi").select(*target.columns))


def verify(
    source: DataFrame,
    repaired: DataFrame,
    scope: DataFrame,
    spec: TableSpec,
    key: str,
    width: int,
    start: str,
    end: str,
) -> DataFrame:
    """Segment comparison of the repaired ranges and their neighbours."""
    touched = scope.select(F.floor(F.col(key) / width).alias("segment")).distinct()
    around = touched.select(
        F.explode(F.array(F.col("segment") - 1, F.col("segment"), F.col("segment") + 1)).alias("segment")
    ).distinct()
    segment = F.floor(F.col(key) / width)
    s = summarize_by(source, spec, start, end, segment).join(around, "segment", "left_semi")
    t = summarize_by(repaired, spec, start, end, segment).join(around, "segment", "left_semi")
    return compare_segments(s, t, only_drift=False)


def residual(source: DataFrame, repaired: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys per status after a repair; a full repair leaves SAME only."""
    return key_status(source, repaired, keys, columns).groupBy("status").agg(F.count("*").alias("keys"))
