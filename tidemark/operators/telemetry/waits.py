"""Waits, sessions and statement statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import label, like_literal, ratio_or_null, recent

# Wait types that are idle and left out of wait reports.
IDLE_WAITS = (
    "BROKER_EVENTHANDLER",
    "BROKER_TASK_STOP",
    "BROKER_TO_FLUSH",
    "CHECKPOINT_QUEUE",
    "CLR_AUTO_EVENT",
    "CLR_MANUAL_EVENT",
    "CLR_SEMAPHORE",
    "DIRTY_PAGE_POLL",
    "DISPATCHER_QUEUE_SEMAPHORE",
    "FT_IFTS_SCHEDULER_IDLE_WAIT",
    "HADR_FILESTREAM_IOMGR_IOCOMPLETION",
    "LAZYWRITER_SLEEP",
    "LOGMGR_QUEUE",
    "ONDEMAND_TASK_QUEUE",
    "QDS_ASYNC_QUEUE",
    "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP",
    "REQUEST_FOR_DEADLOCK_SEARCH",
    "RESOURCE_QUEUE",
    "SLEEP_SYSTEMTASK",
    "SLEEP_TASK",
    "SOS_WORK_DISPATCHER",
    "SP_SERVER_DIAGNOSTICS_SLEEP",
    "SQLTRACE_BUFFER_FLUSH",
    "TRACEWRITE",
    "WAITFOR",
    "XE_DISPATCHER_JOIN",
    "XE_DISPATCHER_WAIT",
    "XE_TIMER_EVENT",
)

# Wait categories, first match wins: (category, prefixes, exact names).
WAIT_CATEGORIES = (
    ("Lock", ("LCK_",), ()),
    ("IO/Log", ("PAGEIOLATCH_", "IO_"), ("WRITELOG", "LOGBUFFER")),
    ("Parallelism", ("CX",), ()),
    ("Memory", ("RESOURCE_SEMAPHORE", "MEMORY_"), ()),
    ("CPU/Scheduler", (), ("SOS_SCHEDULER_YIELD", "THREADPOOL")),
    ("HADR", ("HADR_",), ()),
    ("Latch", ("PAGELATCH_",), ()),
)


def not_idle(df: DataFrame, wait: str = "wait_type") -> DataFrame:
    return df.where(~F.col(wait).isin(*IDLE_WAITS))


def wait_category(wait: Column) -> Column:
    pairs = []
    for category, prefixes, names in WAIT_CATEGORIES:
        condition = wait.isin(*names) if names else F.lit(False)
        for prefix in prefixes:
            condition = condition | like_literal(wait, prefix + "%")
        pairs.append((condition, category))
    return label(wait, pairs, "Other")


def wait_totals(df: DataFrame, by: list[str], wait_ms: str = "wait_ms") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("total_waits"), F.sum(wait_ms).alias("wait_ms"))


def top_waits(df: DataFrame, k: int = 25) -> DataFrame:
    """Non-idle wait types by total time, with seconds and mean."""
    totals = wait_totals(not_idle(df), ["wait_type"]).select(
        "wait_type",
        "total_waits",
        "wait_ms",
        F.round(F.col("wait_ms").cast("double") / 1000.0, 2).alias("wait_s"),
        F.round(ratio_or_null(F.col("wait_ms"), F.col("total_waits")), 2).alias("avg_wait_ms"),
    )
    return totals.orderBy(F.desc("wait_ms"), "wait_type").limit(k).drop("wait_ms")


def share_of_total(totals: DataFrame, value: str, out: str, k: int | None = None, tie: str | None = None) -> DataFrame:
    """Percent of the grand total; the total is a scalar subquery over the small aggregate."""
    total = totals.agg(F.sum(F.col(value).cast("double"))).scalar()
    shared = totals.withColumn(
        out, F.round(F.lit(100.0) * F.col(value).cast("double") / F.nullif(total, F.lit(0.0)), 2)
    )
    return shared.orderBy(F.desc(value), *([tie] if tie else [])).limit(k) if k else shared


def active_over_time(df: DataFrame, ts: str, by: list[str], width: str, as_of: str | None = None, span: str | None = None) -> DataFrame:
    """Sessions per time bucket and state, optionally for the last ``span`` before ``as_of``."""
    rows = df.where(recent(F.col(ts), as_of, span)) if as_of and span else df
    return rows.groupBy(F.window(ts, width).alias("_w"), *by).agg(F.count("*").alias("sessions")).select(
        F.col("_w.start").alias("bucket"), *by, "sessions"
    )


def group_counts(df: DataFrame, by: list[str], out: str = "sessions") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(out))


def statement_totals(df: DataFrame, statement: str, measures: dict[str, Column]) -> DataFrame:
    return df.groupBy(statement).agg(F.count("*").alias("calls"), *[c.alias(n) for n, c in measures.items()])


def top_statements(stats: DataFrame, statement: str, dimension: str | Column, k: int = 25) -> DataFrame:
    """Top-k by a column or expression; the statement id breaks ties."""
    order = F.col(dimension) if isinstance(dimension, str) else dimension
    return stats.orderBy(order.desc(), statement).limit(k)


def top_per_dimension(stats: DataFrame, statement: str, dimensions: list[str], k: int = 10) -> DataFrame:
    """Top-k per dimension stacked as (metric, value); ranks are limited before the shuffle."""
    stacked = stats.select(statement, *[F.col(c).cast("double").alias(c) for c in dimensions]).unpivot(
        [statement], dimensions, "metric", "value"
    )
    window = Window.partitionBy("metric").orderBy(F.desc("value"), statement)
    return stacked.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def slow_operations(df: DataFrame, duration: str, threshold: float) -> DataFrame:
    return df.where(F.col(duration) > threshold)


def sessions_by_age(df: DataFrame, started: str, as_of: str, min_seconds: int = 0) -> DataFrame:
    """Sessions older than a number of seconds at ``as_of``."""
    age = F.timestamp_diff("SECOND", F.col(started), F.lit(as_of).cast("timestamp_ntz"))
    return df.withColumn("age_seconds", age).where(F.col("age_seconds") > min_seconds)


def saturation(df: DataFrame, by: list[str], active: Column, capacity: Column) -> DataFrame:
    """Current use against capacity; WARN above 85 %, ALERT above 90 %."""
    used = df.groupBy(*by).agg(F.count_if(active).alias("current"), capacity.alias("capacity"))
    pct = F.round(F.lit(100.0) * ratio_or_null(F.col("current"), F.col("capacity")), 2)
    return used.withColumn("used_pct", pct).withColumn(
        "status", F.when(pct > 90, "ALERT").when(pct > 85, "WARN").otherwise("OK")
    )
