"""Row-level differences, hash first.

The wide rows of both sides never meet in a shuffle. Each row is reduced to its
key and a signed fingerprint (source plus, target minus); per key the counts and
fingerprint sums decide the status. Only keys whose sums differ are read again
for the list of changed columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.signature import fingerprint, row_number60, signature
from tidemark.session import materialize

LIMBS = ("_l0", "_l1", "_l2")
MISSING, EXTRA, CHANGED, SAME, DUPLICATE = "MISSING", "EXTRA", "CHANGED", "SAME", "DUPLICATE"


def key_status(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], unique_keys: bool = False
) -> DataFrame:
    """Per key: source_rows, target_rows and status. Map-side combined, so a hot key is small.

    With ``unique_keys``, for keys already found unique and not null on both
    sides, a join of the fingerprints does the same at about half the cost.
    """
    if unique_keys:
        return _status_by_join(source, target, keys, columns)

    def side(df: DataFrame, sign: int) -> DataFrame:
        limbs = fingerprint(df, columns)
        return df.select(
            *keys,
            *[(limb * sign).alias(name) for name, limb in zip(LIMBS, limbs)],
            F.lit(int(sign > 0)).alias("_s"),
            F.lit(int(sign < 0)).alias("_t"),
        )

    per_key = (
        side(source, 1)
        .unionByName(side(target, -1))
        .groupBy(*keys)
        .agg(F.sum("_s").alias("source_rows"), F.sum("_t").alias("target_rows"), *[F.sum(c).alias(c) for c in LIMBS])
    )
    same = (F.col("source_rows") == F.col("target_rows")) & _all_zero(LIMBS)
    status = (
        F.when(F.col("target_rows") == 0, MISSING)
        .when(F.col("source_rows") == 0, EXTRA)
        .when(same, SAME)
        .when((F.col("source_rows") > 1) | (F.col("target_rows") > 1), DUPLICATE)
        .otherwise(CHANGED)
    )
    return per_key.select(*keys, "source_rows", "target_rows", status.alias("status"))


def _status_by_join(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(*fingerprint(df, columns)).alias(name))

    joined = side(source, "_s").join(side(target, "_t"), keys, "full")
    held_s, held_t = F.col("_s").isNotNull(), F.col("_t").isNotNull()
    status = (
        F.when(~held_t, MISSING).when(~held_s, EXTRA).when(F.col("_s") == F.col("_t"), SAME).otherwise(CHANGED)
    )
    return joined.select(
        *keys, held_s.cast("bigint").alias("source_rows"), held_t.cast("bigint").alias("target_rows"), status.alias("status")
    )


def _all_zero(names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c) == 0 for c in names])


def drifted_keys(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The key scope for a repair: every key that is not SAME, written once for its many readers."""
    return materialize(key_status(source, target, keys, columns).where(F.col("status") != SAME).select(*keys, "status"))


def changed_columns(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Changed column names per CHANGED key, as a comma-separated text in column order."""
    changed = materialize(key_status(source, target, keys, columns).where(F.col("status") == CHANGED).select(*keys))
    s = source.join(changed, keys, "left_semi").select(*keys, F.struct(*columns).alias("_s"))
    t = target.join(changed, keys, "left_semi").select(*keys, F.struct(*columns).alias("_t"))
    named = F.array_compact(
        F.array(*[F.when(~F.col("_s")[c].eqNullSafe(F.col("_t")[c]), F.lit(c)) for c in columns])
    )
    return s.join(t, keys).select(*keys, F.array_join(named, ",").alias("changed_columns"))


def segment_drift(source: DataFrame, target: DataFrame, columns: list[str], segment: Column) -> DataFrame:
    """Segments whose row count or fingerprint sum differs; one row per segment is shuffled."""

    def side(df: DataFrame, sign: int) -> DataFrame:
        limbs = fingerprint(df, columns)
        return df.select(
            segment.alias("segment"),
            F.lit(sign).alias("_n"),
            *[(limb * sign).alias(name) for name, limb in zip(LIMBS, limbs)],
        )

    sums = side(source, 1).unionByName(side(target, -1)).groupBy("segment").agg(
        *[F.sum(c).alias(c) for c in ("_n", *LIMBS)]
    )
    return sums.where(~_all_zero(("_n", *LIMBS))).select("segment")


def drill_down(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], segment: Column
) -> DataFrame:
    """Segment hashes first, then ``key_status`` on drifting segments only."""
    drift = materialize(segment_drift(source, target, [*keys, *columns], segment))
    s = source.withColumn("segment", segment).join(drift, "segment", "left_semi")
    t = target.withColumn("segment", segment).join(drift, "segment", "left_semi")
    return key_status(s, t, ["segment", *keys], columns).where(F.col("status") != SAME)


def sampled_checksum(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], percent: int = 10, threshold: float = 99.9
) -> DataFrame:
    """Match rate of row checksums over a sample of keys chosen by their hash."""

    def side(df: DataFrame, name: str) -> DataFrame:
        bucket = F.pmod(row_number60(signature(df, keys)), F.lit(100))
        return df.where(bucket < percent).select(*keys, row_number60(signature(df, columns)).alias(name))

    joined = side(source, "_s").join(side(target, "_t"), keys, "left")
    matched = F.count_if(F.col("_s").eqNullSafe(F.col("_t")))
    rate = F.round(F.lit(100.0) * matched.cast("double") / F.nullif(F.count("*").cast("double"), F.lit(0.0)), 4)
    return joined.agg(
        F.count("*").alias("sampled"),
        matched.alias("matched"),
        rate.alias("match_pct"),
        F.when(rate >= threshold, "PASS").otherwise("FAIL").alias("status"),
    )


def presence(sides: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Which of N sides hold a key: one aggregate over the union of keys."""
    tagged = [df.select(*keys, F.lit(name).alias("_side")) for name, df in sides.items()]
    union = reduce(DataFrame.unionByName, tagged)
    held = [F.max(F.col("_side") == name).alias(f"_has_{i}") for i, name in enumerate(sides)]
    names = F.array_compact(F.array(*[F.when(F.col(f"_has_{i}"), F.lit(n)) for i, n in enumerate(sides)]))
    first = F.col("_has_0")
    rest = F.greatest(*[F.col(f"_has_{i}") for i in range(1, len(sides))]) if len(sides) > 2 else F.col("_has_1")
    every = F.size(names) == len(sides)
    return (
        union.groupBy(*keys)
        .agg(*held)
        .select(
            *keys,
            F.array_join(names, ",").alias("present_on"),
            F.when(every, "EVERYWHERE").when(first & ~rest, "PRIMARY_ONLY").when(~first, "MISSING_ON_PRIMARY")
            .otherwise("PARTIAL").alias("presence"),
        )
    )
