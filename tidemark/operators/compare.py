"""Comparison, severity, gap classes and gates over summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import lenient_int

# Gap classes and the action recommended for each.
GAP_ACTIONS = {
    "CLASS-A": "Re-extract and replay missing/extra key ranges; then hash validate",
    "CLASS-B": "Run row-level diff and targeted UPDATE remediation",
    "CLASS-C": "Replay CDC from safe checkpoint and validate operation parity",
    "CLASS-D": "Reapply DDL and validate",
    "CLASS-E": "Canonicalize data and recalc hashes",
    "OK": "No remediation required",
}

# go/no-go thresholds.
GATE_COUNT_PCT = 100.0
GATE_HASH_PCT = 100.0
GATE_LOW_RISK_PCT = 99.99
GATE_OPS_PCT = 100.0
GATE_LAG_MINUTES = 5.0


def compare_summaries(source: DataFrame, target: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Full outer join of summaries; flags, sparse delta map and severity.

    A side without the table counts as zero rows and an empty hash.
    """
    keys = keys or ["schema_name", "table_name"]

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(
            *keys,
            lenient_int(F.col("row_count").cast("string")).alias(f"{p}_n"),
            F.col("hash_sum").cast("string").alias(f"{p}_h"),
            lenient_int(F.col("updated_count").cast("string")).alias(f"{p}_u"),
            lenient_int(F.col("deleted_count").cast("string")).alias(f"{p}_d"),
        )

    zero = F.lit(0).cast("bigint")

    def delta(m: str) -> Column:
        return F.coalesce(f"t_{m}", zero) - F.coalesce(f"s_{m}", zero)

    joined = side(source, "s").join(side(target, "t"), keys, "full")
    flags = joined.select(
        *keys,
        (delta("n") == 0).alias("count_match"),
        (F.coalesce("s_h", F.lit("")) == F.coalesce("t_h", F.lit(""))).alias("hash_match"),
        (delta("u") == 0).alias("update_match"),
        (delta("d") == 0).alias("delete_match"),
        F.map_filter(
            F.create_map(
                F.lit("row_count_delta"), delta("n"), F.lit("update_delta"), delta("u"), F.lit("delete_delta"), delta("d")
            ),
            lambda _, v: v != 0,
        ).alias("deltas"),
    )
    return flags.withColumn("severity", severity())


def severity() -> Column:
    count, digest = F.col("count_match"), F.col("hash_match")
    every = count & digest & F.col("update_match") & F.col("delete_match")
    return F.when(~count & ~digest, "SEV1").when(~every, "SEV2").otherwise("OK")


def gap_class(mode: str = "documented") -> Column:
    """``documented``: any count mismatch is CLASS-A. ``literal``: only with a hash mismatch."""
    count, digest = F.col("count_match"), F.col("hash_match")
    first = ~count if mode == "documented" else ~count & ~digest
    return (
        F.when(first, "CLASS-A")
        .when(count & ~digest, "CLASS-B")
        .when(~F.col("update_match") | ~F.col("delete_match"), "CLASS-C")
        .otherwise("OK")
    )


def action_of(column: Column) -> Column:
    pairs = [F.lit(x) for pair in GAP_ACTIONS.items() for x in pair]
    return F.element_at(F.create_map(*pairs), column)


def classify(df: DataFrame, mode: str = "documented") -> DataFrame:
    return df.withColumn("gap_class", gap_class(mode)).withColumn("recommended_action", action_of(F.col("gap_class")))


def extended_class(raw_match: Column, canonical_match: Column, objects_match: Column, base: Column) -> Column:
    """D when objects differ, E when only the raw form of equal values differs, else the base class."""
    return F.when(~objects_match, "CLASS-D").when(~raw_match & canonical_match, "CLASS-E").otherwise(base)


def tally(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("tables"))


def within_tolerance(source: Column, target: Column, tolerance: float = 0.0) -> Column:
    """MATCH when the counts differ by at most ``tolerance`` of the source."""
    ok = F.abs(source - target).cast("double") <= F.lit(tolerance) * source.cast("double")
    return F.when(ok, "MATCH").otherwise("MISMATCH")


def gate(checks: DataFrame) -> DataFrame:
    """PASS / FAIL per row of (check_name, observed, op, threshold)."""
    observed, bound = F.col("observed"), F.col("threshold")
    ok = F.when(F.col("op") == ">=", observed >= bound).when(F.col("op") == "<", observed < bound).otherwise(observed <= bound)
    return checks.withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL"))


def tier_gate(rates: DataFrame, low_risk: Column) -> DataFrame:
    """Gate of match rates (table_name, match_pct): low-risk tables may miss by ``100 - GATE_LOW_RISK_PCT`` %, others by nothing."""
    tier = F.when(F.coalesce(low_risk, F.lit(False)), "LOW").otherwise("HIGH")
    bound = F.when(F.col("tier") == "LOW", GATE_LOW_RISK_PCT).otherwise(GATE_HASH_PCT)
    passed = F.coalesce(F.col("match_pct") >= F.col("threshold"), F.lit(False))
    return rates.withColumn("tier", tier).withColumn("threshold", bound).withColumn("status", F.when(passed, "PASS").otherwise("FAIL"))


def verdict(gated: DataFrame) -> DataFrame:
    """GO only when every check passed."""
    return gated.agg(
        F.count("*").alias("checks"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.when(F.min("status") == "FAIL", "NO-GO").otherwise("GO").alias("decision"),
    )


def policy_severity(compared: DataFrame, critical: list[str], exceptions: DataFrame, as_of: str) -> DataFrame:
    """Severity by table scope; a live approved exception lowers it to Sev-3.

    ``exceptions`` has (table_name, expiry_date).
    """
    live = (
        exceptions.where(F.col("expiry_date") >= F.lit(as_of).cast("date"))
        .groupBy("table_name")
        .agg(F.max("expiry_date").alias("exception_until"))
    )
    joined = compared.join(live, "table_name", "left")
    level = (
        F.when(F.col("severity") == "OK", "OK")
        .when(F.col("exception_until").isNotNull(), "Sev-3")
        .when(F.col("table_name").isin(*critical), "Sev-1")
        .otherwise("Sev-2")
    )
    return joined.withColumn("policy_severity", level)
