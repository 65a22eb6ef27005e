"""Engine detectors, the daily pack, replicas, space and resource panels over telemetry derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import percent
from tidemark.operators.telemetry import health, storage, trends
from tidemark.operators.telemetry import waits as w
from tidemark.plans.fixtures import AS_OF, table
from tidemark.plans.registry import plan

ENGINE = "CASE user_id % 4 WHEN 0 THEN 'oracle' WHEN 1 THEN 'sqlserver' WHEN 2 THEN 'postgres' ELSE 'mysql' END AS engine"

# Every event is a session of its user's host. {now} and {seconds} are written in either engine's way.
SESSION_EXPRS = [
    ENGINE,
    "user_id AS host",
    "event_id",
    "{now} - {seconds}(event_id * 7 % 1800) AS sampled_at",
    "CASE WHEN event_type IN ('click', 'view') THEN 'ACTIVE' ELSE 'INACTIVE' END AS status",
    "event_id * 13 % 700 AS last_call_s",
    "CASE WHEN event_id % 3 = 0 THEN 'BACKGROUND' ELSE 'USER' END AS kind",
    "CASE WHEN event_id % 41 = 0 THEN event_id - 1 WHEN event_id % 43 = 0 THEN 0 END AS blocker_id",
    "event_id * 7919 % 31000 AS elapsed_ms",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE {now} - {seconds}(event_id * 11 % 620) END AS xact_start",
]
SCHEDULER_EXPRS = [
    ENGINE,
    "user_id AS host",
    "CASE event_type WHEN 'error' THEN 'HIDDEN ONLINE' ELSE 'VISIBLE ONLINE' END AS status",
    "CASE WHEN event_id % 97 = 0 THEN 2 ELSE 0 END AS runnable_tasks",
]
NOW = AS_OF


def _in(expressions: list[str], spark_sql: bool) -> list[str]:
    now, seconds = (f"TIMESTAMP_NTZ '{NOW}'", "make_dt_interval(0, 0, 0, ") if spark_sql else (f"TIMESTAMP '{NOW}'", "to_seconds(")
    return [e.replace("{now}", now).replace("{seconds}(", seconds) for e in expressions]


TELEMETRY_SQL = f"""
    s AS (SELECT {", ".join(_in(SESSION_EXPRS, False))} FROM events),
    sch AS (SELECT {", ".join(SCHEDULER_EXPRS)} FROM events),
    st AS (SELECT {ENGINE}, user_id AS host, event_type, max(value) * 3 AS mean_ms, count(*) FILTER (WHERE event_id % 29 = 0) AS no_index_used FROM events GROUP BY ALL),
    lw AS (SELECT {ENGINE}, user_id AS host FROM events WHERE event_id % 53 = 0),
    cfg AS (SELECT DISTINCT user_id AS host, 'cpu_count' AS setting, 4 + user_id % 8 AS value FROM events)"""


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(*_in(SESSION_EXPRS, True))


def _count_sql(engine: str, issue: str, source: str, condition: str, limit: str = "0") -> str:
    return f"SELECT engine, host, '{issue}' AS issue, count(*) AS n, {limit} AS threshold FROM {source} WHERE engine = '{engine}' AND {condition} GROUP BY 1, 2"


DETECT_SQL = " UNION ALL ".join([
    _count_sql("oracle", "AAS_CPU_PRESSURE", "s", f"sampled_at >= TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE", "(SELECT value FROM cfg WHERE cfg.host = s.host)"),
    _count_sql("oracle", "BLOCKING_SESSIONS", "s", "blocker_id IS NOT NULL"),
    _count_sql("oracle", "LONG_ACTIVE_SESSIONS_OVER_10M", "s", "status = 'ACTIVE' AND last_call_s > 600 AND kind = 'USER'"),
    _count_sql("sqlserver", "CPU_RUNNABLE_TASKS", "sch", "status = 'VISIBLE ONLINE' AND runnable_tasks > 0"),
    _count_sql("sqlserver", "BLOCKED_REQUESTS", "s", "blocker_id <> 0"),
    _count_sql("sqlserver", "LONG_REQUESTS_OVER_30S", "s", "elapsed_ms > 30000"),
    _count_sql("postgres", "BLOCKED_SESSIONS", "s", "blocker_id IS NOT NULL"),
    _count_sql("postgres", "LONG_XACTS_OVER_10M", "s", f"TIMESTAMP '{NOW}' - xact_start > INTERVAL 10 MINUTE"),
    _count_sql("postgres", "MEAN_QUERY_TIME_OVER_250MS", "st", "mean_ms > 250"),
    _count_sql("mysql", "LOCK_WAITS", "lw", "true"),
    _count_sql("mysql", "DIGESTS_AVG_OVER_200MS", "st", "mean_ms > 200"),
    _count_sql("mysql", "STATEMENTS_WITH_NO_INDEX", "st", "no_index_used > 0"),
])


@plan(
    "engine_detectors",
    "T1 U1 P7 J8",
    "",
    TELEMETRY_SQL
    + f""", u AS ({DETECT_SQL})
       SELECT engine, host, issue, CAST(n AS DOUBLE) AS observed, CAST(threshold AS DOUBLE) AS threshold FROM u WHERE n > threshold""",
)
def engine_detectors(spark: SparkSession, d: str) -> DataFrame:
    events, own = table(spark, d, "events"), sessions(spark, d)
    statements = (
        events.groupBy(F.expr(ENGINE), F.col("user_id").alias("host"), "event_type")
        .agg((F.max("value") * 3).alias("mean_ms"), F.count_if(F.expr("event_id % 29 = 0")).alias("no_index_used"))
    )
    tables = {
        "samples": own,
        "sessions": own,
        "schedulers": events.selectExpr(*SCHEDULER_EXPRS),
        "statements": statements,
        "lock_waits": events.where("event_id % 53 = 0").selectExpr(ENGINE, "user_id AS host"),
    }
    settings = events.selectExpr("user_id AS host", "'cpu_count' AS setting", "4 + user_id % 8 AS value").distinct()
    return health.detect_engines(tables, settings, NOW)


PACK_SQL = f"""
    c AS (SELECT 'longest_wait_ms' AS check_name, user_id AS host, CAST(max(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value, 60.0 AS warn, 100.0 AS fail, false AS low FROM events WHERE event_type <> 'view' GROUP BY 2
          UNION ALL SELECT 'oldest_active_s', host, max(last_call_s), 690, 697, false FROM s WHERE status = 'ACTIVE' GROUP BY 2
          UNION ALL SELECT 'connections_used_pct', host, round(100.0 * CAST(count(*) FILTER (WHERE status = 'ACTIVE') AS DOUBLE) / count(*), 2), 60, 75, false FROM s GROUP BY 2
          UNION ALL SELECT 'dead_rows_pct', user_id, round(100.0 * CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*), 2), 20, 30, false FROM events GROUP BY 2
          UNION ALL SELECT 'cache_hit_pct', user_id, round(100.0 * CAST(count(*) FILTER (WHERE value >= 2) AS DOUBLE) / count(*), 2), 95, 85, true FROM events GROUP BY 2
          UNION ALL SELECT 'stored_bytes', user_id, CAST(sum(length(props)) AS DOUBLE), 1500, 2500, false FROM events GROUP BY 2
          UNION ALL SELECT 'replica_lag_s', user_id, date_sub('second', max(ts), TIMESTAMP '{NOW}'), 20000, 80000, false FROM events GROUP BY 2)"""


@plan(
    "daily_health_pack",
    "T55 U1 T2 T8 T9 T16 T17 T25 T28",
    "",
    TELEMETRY_SQL
    + ","
    + PACK_SQL
    + """ SELECT check_name, host, CAST(value AS DOUBLE) AS value, CASE WHEN value IS NULL THEN 'UNKNOWN' WHEN CASE WHEN low THEN value < fail ELSE value > fail END THEN 'FAIL'
              WHEN CASE WHEN low THEN value < warn ELSE value > warn END THEN 'WARN' ELSE 'OK' END AS status FROM c""",
)
def daily_health_pack(spark: SparkSession, d: str) -> DataFrame:
    events, own = table(spark, d, "events"), sessions(spark, d)
    host = F.col("user_id").alias("host")
    waits = events.where("event_type <> 'view'").groupBy(host).agg(F.max(F.col("value").cast("decimal(18,2)")).alias("value"))
    oldest = own.where("status = 'ACTIVE'").groupBy("host").agg(F.max("last_call_s").alias("value"))
    used = w.saturation(own, ["host"], F.col("status") == "ACTIVE", F.count("*")).withColumnRenamed("used_pct", "value")
    dead = events.groupBy(host).agg(percent(F.count_if(F.col("event_type") == "error"), F.count("*")).alias("value"))
    hits = events.groupBy(host).agg(F.count_if(F.col("value") >= 2).alias("hits"), F.count_if(~(F.col("value") >= 2)).alias("misses"))
    stored = events.groupBy(host).agg(F.sum(F.length("props")).alias("value"))
    lag = trends.replica_lag(events, ["user_id"], "ts", NOW).select(host, F.col("lag_seconds").alias("value"))
    return health.daily_pack([
        health.Check("longest_wait_ms", waits, 60, 100),
        health.Check("oldest_active_s", oldest, 690, 697),
        health.Check("connections_used_pct", used, 60, 75),
        health.Check("dead_rows_pct", dead, 20, 30),
        health.Check("cache_hit_pct", storage.hit_ratio(hits).withColumnRenamed("hit_pct", "value"), 95, 85, True),
        health.Check("stored_bytes", stored, 1500, 2500),
        health.Check("replica_lag_s", lag, 20_000, 80_000),
    ])


REPLICA_EXPRS = [
    "user_id AS replica",
    "event_id",
    "CASE WHEN event_id % 31 = 0 THEN false WHEN event_id % 61 = 0 THEN NULL ELSE true END AS connected",
    "event_id % 7 <> 0 AS synchronized",
    "event_id % 53 = 0 AS is_readonly",
    "CASE WHEN event_id % 47 = 0 THEN NULL ELSE event_id * 3 % 70 END AS lag_s",
    "event_id * 17 % 90 AS send_queue",
    "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id * 19 % 60 END AS redo_queue",
]


@plan(
    "replica_health",
    "T28 F13",
    "",
    f"""r AS (SELECT {", ".join(REPLICA_EXPRS)} FROM events), q AS (SELECT *, coalesce(send_queue, 0) + coalesce(redo_queue, 0) AS queue FROM r),
        x AS (SELECT *, CASE WHEN connected IS NOT TRUE THEN 'DISCONNECTED' WHEN is_readonly THEN 'READ_ONLY' WHEN lag_s IS NULL THEN 'LAG_UNKNOWN' WHEN lag_s > 60 THEN 'LAG'
                             WHEN queue > 100 THEN 'QUEUE' WHEN NOT synchronized THEN 'NOT_SYNCHRONIZED' ELSE 'NONE' END AS reason FROM q)
        SELECT event_id, replica, lag_s, queue, reason, CASE WHEN reason IN ('DISCONNECTED', 'READ_ONLY') THEN 'CRITICAL' WHEN reason = 'NONE' THEN 'HEALTHY' ELSE 'DEGRADED' END AS status FROM x""",
)
def replica_health(spark: SparkSession, d: str) -> DataFrame:
    out = health.replica_health(table(spark, d, "events").selectExpr(*REPLICA_EXPRS))
    return out.select("event_id", "replica", "lag_s", "queue", "reason", "status")


@plan(
    "largest_objects",
    "T25 K1 W2",
    "",
    """t AS (SELECT p_brand, p_partkey AS name, coalesce(sum(CAST(l_quantity AS BIGINT)), 0)::BIGINT * 8192 AS bytes FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY bytes DESC, name) AS rank, sum(bytes) OVER (PARTITION BY p_brand) AS total FROM t)
       SELECT p_brand, name, bytes, CAST(rank AS INTEGER) AS rank, round(100.0 * CAST(bytes AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0), 4) AS share_pct FROM r WHERE rank <= 10""",
)
def largest_objects(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("blocks"))
    parts = table(spark, d, "part").join(sizes, F.col("p_partkey") == F.col("l_partkey"), "left")
    objects = parts.select("p_brand", F.col("p_partkey").alias("name"), (F.coalesce("blocks", F.lit(0)) * 8192).cast("bigint").alias("bytes"))
    return health.largest_objects(objects, ["p_brand"], "bytes")


@plan(
    "space_used",
    "T25 F6 F7",
    "",
    """t AS (SELECT l_suppkey AS tablespace, CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS used, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size FROM lineitem GROUP BY 1),
       p AS (SELECT *, round(100.0 * (CAST(used AS DOUBLE) / nullif(CAST(size AS DOUBLE), 0)), 2) AS used_pct FROM t)
       SELECT *, CASE WHEN used_pct IS NULL THEN 'UNKNOWN' WHEN used_pct > 55 THEN 'FAIL' WHEN used_pct > 50 THEN 'WARN' ELSE 'OK' END AS status FROM p""",
)
def space_used(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("l_quantity").cast("bigint")
    files = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "tablespace")
    return health.space_used(files, ["tablespace"], F.when(F.col("l_linestatus") == "O", size).otherwise(0), size, 50.0, 55.0)


def _panel_sql(name: str, source: str, item: str, measures: dict[str, str], order: list[str]) -> str:
    rank = f"row_number() OVER (ORDER BY {', '.join(f'{o} DESC NULLS LAST' for o in order)}, CAST({item} AS VARCHAR))"
    return " UNION ALL ".join(
        f"SELECT '{name}' AS panel, CAST(rank AS INTEGER) AS rank, item, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM "
        f"(SELECT {rank} AS rank, CAST({item} AS VARCHAR) AS item, {', '.join(f'{e} AS {k}' for k, e in measures.items())} FROM {source}) WHERE rank <= 20"
        for m in measures
    )


# What the panels of an engine show and how they are sorted.
PANELS = [
    ("schedulers", "sch", "host", {"runnable": "runnable", "tasks": "tasks"}, ["runnable", "tasks"]),
    ("memory_grants", "grants", "session_id", {"requested_kb": "requested_kb", "granted_kb": "granted_kb"}, ["requested_kb"]),
    ("temp_space", "temp", "host", {"temp_bytes": "temp_bytes", "temp_files": "temp_files"}, ["temp_bytes"]),
    ("log_space", "log", "host", {"active_mb": "active_mb", "total_mb": "total_mb"}, ["active_mb"]),
    ("undo", "undo", "day", {"retention_s": "retention_s", "old_errors": "old_errors"}, ["old_errors", "retention_s"]),
    ("recent_cpu", "cpu", "minute", {"cpu_pct": "cpu_pct", "io_pct": "io_pct"}, ["cpu_pct", "io_pct"]),
]
PANEL_TABLES = {
    "sch": "SELECT user_id AS host, count(*) FILTER (WHERE event_type = 'error') AS runnable, count(*) AS tasks FROM events GROUP BY 1",
    "grants": "SELECT event_id AS session_id, event_id * 7919 % 100003 AS requested_kb, event_id * 7919 % 100003 - event_id % 5 AS granted_kb FROM events",
    "temp": "SELECT user_id AS host, sum(length(props)) AS temp_bytes, count(*) FILTER (WHERE event_id % 3 = 0) AS temp_files FROM events GROUP BY 1",
    "log": "SELECT user_id AS host, max(event_id) % 512 AS active_mb, max(event_id) % 512 + count(*) AS total_mb FROM events GROUP BY 1",
    "undo": "SELECT CAST(ts AS DATE) AS day, max(event_id % 900) AS retention_s, count(*) FILTER (WHERE event_type = 'error') AS old_errors FROM events GROUP BY 1",
    "cpu": "SELECT event_id % 1440 AS minute, max(event_id * 31 % 101) AS cpu_pct, max(event_id * 37 % 103) AS io_pct FROM events GROUP BY 1",
}


@plan(
    "resource_panel_set",
    "T52 K1 A6",
    "",
    ", ".join(f"{n} AS ({q})" for n, q in PANEL_TABLES.items()) + " " + " UNION ALL ".join(_panel_sql(*p) for p in PANELS),
)
def resource_panel_set(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    host, failed = F.col("user_id").alias("host"), F.count_if(F.col("event_type") == "error")
    requested = F.expr("event_id * 7919 % 100003")
    newest = F.max("event_id") % 512
    tables = {
        "sch": events.groupBy(host).agg(failed.alias("runnable"), F.count("*").alias("tasks")),
        "grants": events.select(F.col("event_id").alias("session_id"), requested.alias("requested_kb"), (requested - F.col("event_id") % 5).alias("granted_kb")),
        "temp": events.groupBy(host).agg(F.sum(F.length("props")).alias("temp_bytes"), F.count_if(F.expr("event_id % 3 = 0")).alias("temp_files")),
        "log": events.groupBy(host).agg(newest.alias("active_mb"), (newest + F.count("*")).alias("total_mb")),
        "undo": events.groupBy(F.to_date("ts").alias("day")).agg(F.max(F.expr("event_id % 900")).alias("retention_s"), failed.alias("old_errors")),
        "cpu": events.groupBy(F.expr("event_id % 1440").alias("minute")).agg(F.max(F.expr("event_id * 31 % 101")).alias("cpu_pct"), F.max(F.expr("event_id * 37 % 103")).alias("io_pct")),
    }
    return health.panels([health.Panel(name, tables[source], item, measures, tuple(order)) for name, source, item, measures, order in PANELS])
