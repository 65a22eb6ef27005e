"""Alert rules that must hold for a while, with severity and page delay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import ROWS_PER_CHUNK, Running, running

# Minutes until someone is paged, by severity.
PAGE_MINUTES = {"Sev-1": 0, "Sev-2": 5, "Sev-3": 30}


@dataclass(frozen=True)
class AlertRule:
    """Fires when the SQL ``condition`` over metric columns holds for ``for_seconds``."""

    name: str
    condition: str
    for_seconds: int
    severity: str


# The standard rules over these metric columns: p95_ms, qps, error_ratio, cpu_pct, connection_ratio,
# iops_ratio, replication_lag_s, blocked_sessions, deadlocks_5m, backup_age_s, backup_size_ratio, drill_ok.
STANDARD_RULES = (
    AlertRule("DatabaseLatencyBreach", "p95_ms > 100", 120, "Sev-1"),
    AlertRule("DatabaseLatencyWarning", "p95_ms > 75", 60, "Sev-2"),
    AlertRule("DatabaseThroughputDrop", "qps < 1000", 60, "Sev-1"),
    AlertRule("DatabaseThroughputSpike", "qps > 20000", 30, "Sev-2"),
    AlertRule("ErrorRateBreach", "error_ratio > 0.001", 120, "Sev-1"),
    AlertRule("ErrorRateWarning", "error_ratio > 0.0005", 60, "Sev-2"),
    AlertRule("DatabaseCPUSaturation", "cpu_pct > 85", 120, "Sev-2"),
    AlertRule("DatabaseConnectionExhaustion", "connection_ratio > 0.9", 60, "Sev-1"),
    AlertRule("DatabaseIOPSSaturation", "iops_ratio > 0.8", 120, "Sev-2"),
    AlertRule("ReplicationLagHigh", "replication_lag_s > 10", 120, "Sev-3"),
    AlertRule("ReplicationLagCritical", "replication_lag_s > 60", 30, "Sev-3"),
    AlertRule("LongBlockingChain", "blocked_sessions > 10", 60, "Sev-2"),
    AlertRule("DeadlockRateHigh", "deadlocks_5m > 1", 30, "Sev-2"),
    AlertRule("BackupMissing", "backup_age_s > 90000", 600, "Sev-3"),
    AlertRule("BackupSizeDrop", "backup_size_ratio < 0.5", 300, "Sev-3"),
    AlertRule("RestoreDrillFailed", "NOT drill_ok", 60, "Sev-3"),
    AlertRule("CpuWithSlowQueries", "cpu_pct > 80 AND p95_ms > 150", 120, "Sev-1"),
)


def _lookup(pairs: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def fire(
    metrics: DataFrame, ids: list[str], ts: str, rules: tuple[AlertRule, ...], rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Periods in which a rule held long enough.

    ``metrics`` has one row per target and time. One scan per target numbers the
    islands of all rules side by side; only rows on which a rule holds are then
    given one record per such rule. A missing metric breaks a run.
    """
    holds = {f"_holds{i}": F.coalesce(F.expr(r.condition), F.lit(False)) for i, r in enumerate(rules)}
    islands = {f"_island{i}": Running("count", F.when(~F.col(f"_holds{i}"), 1)) for i in range(len(rules))}
    marked = running(
        metrics.select(*ids, ts, *[c.alias(n) for n, c in holds.items()]), ids, [ts], islands, rows_per_chunk=rows_per_chunk
    )
    entries = F.array_compact(F.array(*[
        F.when(F.col(f"_holds{i}"), F.struct(F.lit(r.name).alias("alert"), F.col(f"_island{i}").alias("_island")))
        for i, r in enumerate(rules)
    ]))
    found = (
        marked.select(*ids, ts, F.inline(entries))
        .groupBy(*ids, "alert", "_island")
        .agg(F.min(ts).alias("run_start"), F.max(ts).alias("run_end"), F.count("*").alias("run_length"))
        .drop("_island")
    )
    held = F.timestamp_diff("SECOND", F.col("run_start"), F.col("run_end"))
    named = found.withColumn("held_seconds", held).where(
        F.col("held_seconds") >= _lookup({r.name: r.for_seconds for r in rules}, F.col("alert"))
    )
    return named.withColumn("severity", _lookup({r.name: r.severity for r in rules}, F.col("alert"))).withColumn(
        "page_after_minutes", _lookup(PAGE_MINUTES, F.col("severity"))
    )
