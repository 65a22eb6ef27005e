"""Contracts, regression gates, guardrails, SLOs and ageing checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import exact_mean, label, ratio_or_null
from tidemark.operators.ordered import exact_percentiles
from tidemark.operators.rules import band

# SLO per tier: (availability percent, p95 limit in ms).
SLO = {"Tier 0": (99.99, 50.0), "Tier 1": (99.95, 120.0), "Tier 2": (99.9, 2000.0)}

# Patch limits in days by CVE severity.
PATCH_DAYS = {"Critical": 7, "High": 30}

# KPI -> (target, alert, higher is worse).
KPI = {
    "full_load_hours": (96.0, 120.0, True),
    "cdc_lag_minutes": (5.0, 15.0, True),
    "replay_failure_pct": (0.1, 1.0, True),
    "row_parity_pct": (100.0, 100.0, False),
    "query_delta_pct": (20.0, 30.0, True),
}

# Weights of the change-risk dimensions; each dimension is scored 1 to 5.
RISK_WEIGHTS = {"blast_radius": 3, "data_risk": 3, "rollback": 2, "load": 1, "coupling": 1}


def contract_violations(df: DataFrame, row_key: str, fields: dict[str, str]) -> DataFrame:
    """Rows whose required fields are missing or not of the agreed type: (key, field, reason)."""
    checks = [
        F.when(F.col(name).isNull(), F.struct(F.lit(name).alias("field"), F.lit("MISSING").alias("reason"))).when(
            F.col(name).cast("string").try_cast(kind).isNull(),
            F.struct(F.lit(name).alias("field"), F.lit(f"NOT {kind.upper()}").alias("reason")),
        )
        for name, kind in fields.items()
    ]
    return df.select(F.col(row_key), F.inline(F.array_compact(F.array(*checks))))


def keys_present(df: DataFrame, map_col: str, key: str) -> DataFrame:
    """Whether every map holds the key, and whether every value is set."""
    return df.agg(
        F.bool_and(F.map_contains_key(map_col, F.lit(key))).alias("key_present"),
        (F.count_if(F.try_element_at(map_col, F.lit(key)).isNull()) == 0).alias("value_present"),
    )


def regression_gate(baseline: DataFrame, current: DataFrame, budget: str = "0.10") -> DataFrame:
    """Relative slowdown per query in decimals; FAIL when it is strictly above the budget."""
    joined = baseline.select("query", F.col("seconds").alias("base")).join(
        current.select("query", F.col("seconds").alias("cur")), "query"
    )
    limit = F.lit(budget).cast("decimal(5,2)")
    grown = F.col("cur") - F.col("base")
    return joined.select(
        "query",
        "base",
        "cur",
        F.round(grown.cast("double") / F.nullif(F.col("base").cast("double"), F.lit(0.0)), 4).alias("change"),
        F.when(grown > F.col("base") * limit, "FAIL").otherwise("PASS").alias("status"),
    )


def timing_delta(df: DataFrame, source: str, target: str, flag_pct: float = 20.0) -> DataFrame:
    """Percent change of target over source time, 0 where the source is 0."""
    pct = F.when(F.col(source) == 0, F.lit(0.0)).otherwise(
        F.round((F.col(target) - F.col(source)) * 100.0 / F.nullif(F.col(source), F.lit(0.0)), 2)
    )
    return df.withColumn("delta_pct", pct).withColumn("flagged", F.col("delta_pct") > flag_pct)


def precheck(df: DataFrame, by: list[str], threshold: int = 100) -> DataFrame:
    """Reject new load on hosts with more sessions than the threshold."""
    counted = df.groupBy(*by).agg(F.count("*").alias("active_sessions"))
    return counted.withColumn(
        "decision", F.when(F.col("active_sessions") > threshold, "REJECT").otherwise("ALLOW")
    )


def change_risk(df: DataFrame) -> DataFrame:
    """Weighted score, tier and the approvals the tier needs."""
    score = F.lit(0)
    for name, weight in RISK_WEIGHTS.items():
        score = score + F.col(name) * weight
    tier = label(score, [(F.col("risk_score") >= 35, "Tier-1 High"), (F.col("risk_score") >= 25, "Tier-2 Medium")], "Tier-3 Low")
    approval = (
        F.when(F.col("tier") == "Tier-1 High", "DBRE + Service owner + Platform lead")
        .when(F.col("tier") == "Tier-2 Medium", "DBRE + Service owner")
        .otherwise("DBRE")
    )
    return df.withColumn("risk_score", score).withColumn("tier", tier).withColumn("approval", approval)


def slo_attainment(df: DataFrame, tier: str, ok: Column, latency: str) -> DataFrame:
    """Availability, p95 and error-budget burn per tier against the SLO table."""
    rates = df.groupBy(F.col(tier).alias("_tier")).agg(F.count("*").alias("requests"), F.count_if(ok).alias("_ok"))
    p95 = exact_percentiles(df, [tier], latency, {"p95": 0.95})
    pairs = [F.lit(x) for t, (a, _) in SLO.items() for x in (t, a)]
    limits = [F.lit(x) for t, (_, l) in SLO.items() for x in (t, l)]
    availability = F.round(F.lit(100.0) * ratio_or_null(F.col("_ok"), F.col("requests")), 4)
    goal, limit = F.element_at(F.create_map(*pairs), F.col(tier)), F.element_at(F.create_map(*limits), F.col(tier))
    return (
        rates.join(p95, F.col("_tier").eqNullSafe(F.col(tier)))
        .withColumn("availability_pct", availability)
        .select(
            tier,
            "requests",
            "availability_pct",
            F.round("p95", 6).alias("p95"),
            F.round((F.lit(100.0) - F.col("availability_pct")) / (F.lit(100.0) - goal), 2).alias("budget_burn"),
            ((F.col("availability_pct") >= goal) & (F.col("p95") < limit)).alias("attained"),
        )
    )


def rollback_trigger(df: DataFrame, by: list[str], after: Column, latency: Column, error: Column) -> DataFrame:
    """ROLLBACK when latency grew by more than half or errors exceed 0.1 % after a change."""
    grouped = df.groupBy(*by).agg(
        exact_mean(F.when(~after, latency)).alias("before_ms"),
        exact_mean(F.when(after, latency)).alias("after_ms"),
        F.round(F.lit(100.0) * ratio_or_null(F.count_if(after & error), F.count_if(after)), 4).alias("error_pct"),
    )
    slow = F.col("after_ms") > F.col("before_ms") * 1.5
    return grouped.select(
        *by,
        "before_ms",
        "after_ms",
        "error_pct",
        F.when(F.coalesce(slow, F.lit(False)) | (F.col("error_pct") > 0.1), "ROLLBACK").otherwise("KEEP").alias("decision"),
    )


def kpi_check(observed: DataFrame) -> DataFrame:
    """Observed (kpi, value) rows against target and alert limits."""
    status = F.lit(None).cast("string")
    for name, (target, alert, worse) in KPI.items():
        status = F.when(F.col("kpi") == name, band(F.col("value"), target, alert, worse)).otherwise(status)
    return observed.withColumn("status", status)


def alert_quality(alerts: DataFrame, ts: str) -> DataFrame:
    """Per alert and week: fired, false-alarm and incident share, mean minutes to resolve, versus targets."""
    grouped = alerts.groupBy("alert", F.trunc(F.col(ts).cast("date"), "week").alias("week")).agg(
        F.count("*").alias("fired"),
        F.round(F.lit(100.0) * ratio_or_null(F.count_if("false_alarm"), F.count("*")), 2).alias("false_pct"),
        F.round(F.lit(100.0) * ratio_or_null(F.count_if("incident"), F.count("*")), 2).alias("incident_pct"),
        F.round(ratio_or_null(F.sum("minutes"), F.count("*")), 2).alias("mttr_minutes"),
    )
    # Fewer than 10 fired, under 20 % false, over 70 % incidents, under 10 minutes.
    good = (F.col("fired") < 10) & (F.col("false_pct") < 20) & (F.col("incident_pct") > 70) & (F.col("mttr_minutes") < 10)
    return grouped.withColumn("on_target", good)


def alert_outcomes(alerts: DataFrame, met: DataFrame, alert: str, by: list[str], fired_at: str) -> DataFrame:
    """Per group and week: alerts fired, those that an incident of ``met`` overlaps, their share versus the target.

    Both sides hold unique alert ids; ``met`` may have many rows per alert.
    """
    led = met.select(alert).distinct().withColumn("_led", F.lit(True))
    marked = alerts.join(led, alert, "left").withColumn("week", F.trunc(F.col(fired_at).cast("date"), "week"))
    counted = marked.groupBy(*by, "week").agg(F.count("*").alias("fired"), F.count_if(F.coalesce("_led", F.lit(False))).alias("led"))
    share = F.round(F.lit(100.0) * ratio_or_null(F.col("led"), F.col("fired")), 2)
    return counted.withColumn("incident_pct", share).withColumn("on_target", F.col("incident_pct") > 70)


def patch_sla(df: DataFrame, found: str, patched: str, severity: str, as_of: str) -> DataFrame:
    """Age of a finding against the limit of its severity; open findings age until ``as_of``."""
    until = F.coalesce(F.col(patched).cast("date"), F.lit(as_of).cast("date"))
    age = F.date_diff(until, F.col(found).cast("date"))
    pairs = [F.lit(x) for pair in PATCH_DAYS.items() for x in pair]
    limit = F.try_element_at(F.create_map(*pairs), F.col(severity))
    return df.withColumn("age_days", age).withColumn("limit_days", limit).withColumn(
        "status",
        F.when(F.col("limit_days").isNull(), "MONTHLY_CYCLE").when(F.col("age_days") > F.col("limit_days"), "OVERDUE")
        .otherwise("WITHIN_SLA"),
    )


def unsupported_versions(fleet: DataFrame, minimum: dict[str, int], engine: str, version: str) -> DataFrame:
    pairs = [F.lit(x) for pair in minimum.items() for x in pair]
    floor = F.try_element_at(F.create_map(*pairs), F.col(engine))
    return fleet.withColumn("minimum_version", floor).where(F.col(version) < F.col("minimum_version"))


def drill_result(df: DataFrame, started: str, restored: str, last_commit: str, rto_minutes: str, rpo_minutes: str) -> DataFrame:
    """Actual RTO and RPO of a restore drill with Met / Exceeded."""
    rto = F.timestamp_diff("MINUTE", F.col(started), F.col(restored))
    rpo = F.timestamp_diff("MINUTE", F.col(last_commit), F.col(started))
    return df.withColumn("actual_rto", rto).withColumn("actual_rpo", rpo).withColumns({
        "rto_status": F.when(F.col("actual_rto") <= F.col(rto_minutes), "Met").otherwise("Exceeded"),
        "rpo_status": F.when(F.col("actual_rpo") <= F.col(rpo_minutes), "Met").otherwise("Exceeded"),
    })


# Event type -> action, and action -> outcome; anything else gives the default.
ROUTES = {"health_threshold_reached": "prepare_action"}
OUTCOMES = {"prepare_action": "execution_triggered"}


def route_events(df: DataFrame, event_type: str) -> DataFrame:
    action = label(F.col(event_type), [(F.col(event_type) == k, v) for k, v in ROUTES.items()], "no_action")
    outcome = label(F.col("action"), [(F.col("action") == k, v) for k, v in OUTCOMES.items()], "no_execution")
    return df.withColumn("action", action).withColumn("outcome", outcome)
