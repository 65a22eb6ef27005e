"""One-pass table summaries and segment summaries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import DELETED_VALUES, half_open, is_deleted
from tidemark.functions.signature import hash_sum, row_number60, signature


@dataclass(frozen=True)
class TableSpec:
    """How one table takes part in a reconciliation."""

    table_name: str
    key: list[str]
    updated_col: str
    deleted_col: str
    hash_cols: list[str] = field(default_factory=list)
    schema_name: str = "public"
    deleted_values: tuple[str, ...] = DELETED_VALUES
    scale: int = 6
    digest: str = "md5"

    def hashed(self) -> list[str]:
        """Agreed columns, or key + update time + delete flag when none are given."""
        return self.hash_cols or [*self.key, self.updated_col, self.deleted_col]


def _measures(df: DataFrame, spec: TableSpec, start: str, end: str) -> list[Column]:
    number = row_number60(signature(df, spec.hashed(), spec.scale), spec.digest)
    return [
        F.count("*").alias("row_count"),
        hash_sum(number).alias("hash_sum"),
        F.count_if(half_open(F.col(spec.updated_col), start, end)).alias("updated_count"),
        F.count_if(is_deleted(F.col(spec.deleted_col), spec.deleted_values)).alias("deleted_count"),
    ]


def summarize(df: DataFrame, spec: TableSpec, start: str, end: str, run_ts: str) -> DataFrame:
    """Row count, hash sum, updates in ``[start, end)`` and soft deletes in one scan."""
    return df.agg(*_measures(df, spec, start, end)).select(
        F.lit(spec.schema_name).alias("schema_name"),
        F.lit(spec.table_name).alias("table_name"),
        "*",
        F.lit(run_ts).cast("timestamp_ntz").alias("run_ts"),
    )


def summarize_by(df: DataFrame, spec: TableSpec, start: str, end: str, segment: Column) -> DataFrame:
    """The same measures per segment: key range, time window, partition or operation."""
    return df.groupBy(segment.alias("segment")).agg(*_measures(df, spec, start, end))


def compare_segments(source: DataFrame, target: DataFrame, only_drift: bool = True) -> DataFrame:
    """Full outer join of two segment summaries on ``segment``."""
    s = source.select("segment", F.col("row_count").alias("s_n"), F.col("hash_sum").alias("s_h"))
    t = target.select("segment", F.col("row_count").alias("t_n"), F.col("hash_sum").alias("t_h"))
    joined = s.join(t, "segment", "full")
    zero = F.lit(0).cast("bigint")
    out = joined.select(
        "segment",
        F.coalesce("s_n", zero).alias("source_count"),
        F.coalesce("t_n", zero).alias("target_count"),
        (F.coalesce("t_n", zero) - F.coalesce("s_n", zero)).alias("count_delta"),
        F.col("s_h").eqNullSafe(F.col("t_h")).alias("hash_match"),
    )
    return out.where((F.col("count_delta") != 0) | ~F.col("hash_match")) if only_drift else out


def counts_by_state(source: DataFrame, target: DataFrame, state: str) -> DataFrame:
    """Row counts per business state on both sides."""
    s = source.groupBy(state).agg(F.count("*").alias("_s"))
    t = target.groupBy(state).agg(F.count("*").alias("_t"))
    zero = F.lit(0).cast("bigint")
    return s.join(t, state, "full").select(
        state,
        F.coalesce("_s", zero).alias("source_count"),
        F.coalesce("_t", zero).alias("target_count"),
        (F.coalesce("_t", zero) - F.coalesce("_s", zero)).alias("delta"),
    )


def metric_rows(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """All metrics in one aggregate, then one (metric, value) row each."""
    one = df.agg(*[c.cast("double").alias(n) for n, c in metrics.items()])
    return one.unpivot([], list(metrics), "metric", "value")
