"""Health detectors of four engines, the daily pack of small checks, replica health, and space in use."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import label, ratio_or_null


@dataclass(frozen=True)
class Signal:
    """Rows of a telemetry ``table`` that meet ``condition``, counted per host of ``engine``; too many are an issue.

    ``condition`` is SQL over the table's columns and ``as_of``. ``limit`` is a number, or the name of
    a per-host setting that holds it.
    """

    engine: str
    issue: str
    table: str
    condition: str
    limit: float | str = 0.0


# What the engines' detectors count and the limits that they ship with.
SIGNALS = (
    Signal("oracle", "AAS_CPU_PRESSURE", "samples", "sampled_at >= as_of - INTERVAL 5 MINUTES", "cpu_count"),
    Signal("oracle", "BLOCKING_SESSIONS", "sessions", "blocker_id IS NOT NULL"),
    Signal("oracle", "LONG_ACTIVE_SESSIONS_OVER_10M", "sessions", "status = 'ACTIVE' AND last_call_s > 600 AND kind = 'USER'"),
    Signal("sqlserver", "CPU_RUNNABLE_TASKS", "schedulers", "status = 'VISIBLE ONLINE' AND runnable_tasks > 0"),
    Signal("sqlserver", "BLOCKED_REQUESTS", "sessions", "blocker_id <> 0"),
    Signal("sqlserver", "LONG_REQUESTS_OVER_30S", "sessions", "elapsed_ms > 30000"),
    Signal("postgres", "BLOCKED_SESSIONS", "sessions", "blocker_id IS NOT NULL"),
    Signal("postgres", "LONG_XACTS_OVER_10M", "sessions", "xact_start IS NOT NULL AND as_of - xact_start > INTERVAL 10 MINUTES"),
    Signal("postgres", "MEAN_QUERY_TIME_OVER_250MS", "statements", "mean_ms > 250"),
    Signal("mysql", "LOCK_WAITS", "lock_waits", "true"),
    Signal("mysql", "DIGESTS_AVG_OVER_200MS", "statements", "mean_ms > 200"),
    Signal("mysql", "STATEMENTS_WITH_NO_INDEX", "statements", "no_index_used > 0"),
)


def detect_engines(
    tables: dict[str, DataFrame], settings: DataFrame, as_of: str, signals: tuple[Signal, ...] = SIGNALS
) -> DataFrame:
    """Rows (engine, host, issue, observed, threshold) of the signals that are above their limit.

    Every table has engine and host; a table that is not given has no signals. ``settings`` has host,
    setting and value. All signals of a table are counted in one pass over it, with partial counts per
    task, so a host with most of the rows is one row per task.
    """
    counted = []
    for name, df in tables.items():
        own = [s for s in signals if s.table == name]
        if not own:
            continue
        stamped = df.withColumn("as_of", F.lit(as_of).cast("timestamp_ntz"))
        hits = [F.count_if((F.col("engine") == s.engine) & F.expr(s.condition)).alias(s.issue) for s in own]
        per_host = stamped.groupBy("engine", "host").agg(*hits)
        counted.append(per_host.unpivot(["engine", "host"], [s.issue for s in own], "issue", "observed"))
    rows = reduce(DataFrame.unionByName, counted)
    limits = [F.struct(F.lit(s.engine).alias("engine"), F.lit(s.issue).alias("issue"), F.lit(s.limit if isinstance(s.limit, str) else None).cast("string").alias("setting"), F.lit(None if isinstance(s.limit, str) else float(s.limit)).cast("double").alias("fixed")) for s in signals]
    named = F.filter(F.array(*limits), lambda e: (e["engine"] == F.col("engine")) & (e["issue"] == F.col("issue")))
    ruled = rows.where("observed > 0").withColumn("_rule", F.get(named, F.lit(0))).where("_rule IS NOT NULL")
    values = settings.select(F.col("host").alias("_host"), F.col("setting").alias("_setting"), F.col("value").cast("double").alias("_value"))
    joined = ruled.join(values, F.col("host").eqNullSafe(F.col("_host")) & (F.col("_rule.setting") == F.col("_setting")), "left")
    limit = F.coalesce(F.col("_rule.fixed"), F.col("_value"))
    observed = F.col("observed").cast("double")
    return joined.where(observed > limit).select("engine", "host", "issue", observed.alias("observed"), limit.alias("threshold"))


@dataclass(frozen=True)
class Check:
    """One check of the daily pack: a table of (host, value) and the limits of WARN and FAIL, low values being worse if so said."""

    name: str
    values: DataFrame
    warn: float
    fail: float
    low_is_worse: bool = False


def daily_pack(checks: list[Check]) -> DataFrame:
    """Rows (check_name, host, value, status) of all checks; a host without a value is UNKNOWN."""
    parts = []
    for check in checks:
        value = F.col("value").cast("double")
        warn, fail = (value < check.warn, value < check.fail) if check.low_is_worse else (value > check.warn, value > check.fail)
        status = F.when(value.isNull(), "UNKNOWN").when(fail, "FAIL").when(warn, "WARN").otherwise("OK")
        parts.append(check.values.select(F.lit(check.name).alias("check_name"), "host", value.alias("value"), status.alias("status")))
    return reduce(DataFrame.unionByName, parts)


def replica_health(replicas: DataFrame, lag_s: int = 60, queue: int = 100) -> DataFrame:
    """``replicas`` with status and the reason for it.

    Needs connected, synchronized, is_readonly (booleans), lag_s, send_queue and redo_queue. The first
    reason that holds counts; an unknown lag of a connected replica is one.
    """
    waiting = F.coalesce("send_queue", F.lit(0)) + F.coalesce("redo_queue", F.lit(0))
    reason = label(
        F.lit(""),
        [
            (~F.coalesce("connected", F.lit(False)), "DISCONNECTED"),
            (F.coalesce("is_readonly", F.lit(False)), "READ_ONLY"),
            (F.col("lag_s").isNull(), "LAG_UNKNOWN"),
            (F.col("lag_s") > lag_s, "LAG"),
            (waiting > queue, "QUEUE"),
            (~F.coalesce("synchronized", F.lit(False)), "NOT_SYNCHRONIZED"),
        ],
        "NONE",
    )
    status = F.when(F.col("reason").isin("DISCONNECTED", "READ_ONLY"), "CRITICAL").when(F.col("reason") == "NONE", "HEALTHY").otherwise("DEGRADED")
    return replicas.withColumn("queue", waiting).withColumn("reason", reason).withColumn("status", status)


def largest_objects(objects: DataFrame, by: list[str], size: str, top: int = 10) -> DataFrame:
    """The ``top`` largest objects of every group with their rank and share of the group's bytes.

    Objects have unique names (column ``name``) in their group; equal sizes go by name. Spark cuts
    each task's rows to ``top`` a group before they are exchanged, so a huge group is small.
    """
    listed = ", ".join(f"`{c}`" for c in by)
    ranked = objects.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY {listed} ORDER BY `{size}` DESC, name)")).where(F.col("rank") <= top)
    totals = objects.groupBy(*[F.col(c).alias(f"_t_{c}") for c in by]).agg(F.sum(size).alias("_all"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in by])
    share = F.round(F.lit(100.0) * ratio_or_null(F.col(size), F.col("_all")), 4)
    return ranked.join(totals, same).select(*by, "name", size, F.col("rank").cast("int").alias("rank"), share.alias("share_pct"))


def space_used(files: DataFrame, by: list[str], used: Column, size: Column, warn: float = 85.0, fail: float = 95.0) -> DataFrame:
    """Used and total bytes, used % and status per group (tablespace, file group, log)."""
    sums = files.groupBy(*by).agg(F.sum(used).alias("used"), F.sum(size).alias("size"))
    pct = F.round(F.lit(100.0) * ratio_or_null(F.col("used"), F.col("size")), 2)
    status = F.when(F.col("used_pct") > fail, "FAIL").when(F.col("used_pct") > warn, "WARN").otherwise("OK")
    return sums.withColumn("used_pct", pct).withColumn("status", F.when(F.col("used_pct").isNull(), "UNKNOWN").otherwise(status))


@dataclass(frozen=True)
class Panel:
    """A panel of one resource: its rows sorted by SQL expressions, the largest first, at most ``top`` of them."""

    name: str
    table: DataFrame
    item: str
    measures: dict[str, str]
    order: tuple[str, ...]
    top: int = 20


def panels(wanted: list[Panel]) -> DataFrame:
    """Rows (panel, rank, item, measure, value) of several resource panels, one measure a row.

    Ties go by item. Each panel is a top-k of its own table, cut within tasks first.
    """
    parts = []
    for p in wanted:
        numbers = [F.expr(e).cast("double").alias(m) for m, e in p.measures.items()]
        rows = p.table.select(F.expr(p.item).cast("string").alias("item"), *numbers, *[F.expr(e).cast("double").alias(f"_o{i}") for i, e in enumerate(p.order)])
        keys = [F.desc_nulls_last(f"_o{i}") for i in range(len(p.order))] + [F.asc("item")]
        first = rows.orderBy(*keys).limit(p.top)
        listed = ", ".join([*(f"_o{i} DESC NULLS LAST" for i in range(len(p.order))), "item"])
        ranked = first.withColumn("rank", F.expr(f"cast(row_number() OVER (ORDER BY {listed}) AS int)"))
        parts.append(ranked.unpivot(["item", "rank"], list(p.measures), "measure", "value").select(F.lit(p.name).alias("panel"), "rank", "item", "measure", "value"))
    return reduce(DataFrame.unionByName, parts)
