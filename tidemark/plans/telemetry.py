"""Telemetry queries; samples are derived from ``events``, ``lineitem`` and ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import epoch_micros, money_sum, ratio_or_null
from tidemark.operators import history
from tidemark.operators.rules import Rule, detect
from tidemark.operators.telemetry import blocking, storage, trends, waits as w
from tidemark.plans.fixtures import AS_OF, FLEET_SCOPE, fleet, locks, sessions, table, wait_graph, waits
from tidemark.plans.registry import plan
from tidemark.session import materialize, scratch_path

NOT_IDLE = "wait_type NOT IN ('SLEEP_TASK', 'WAITFOR')"
CATEGORY_SQL = (
    "CASE WHEN wait_type LIKE 'LCK\\_%' ESCAPE '\\' THEN 'Lock' WHEN wait_type LIKE 'PAGEIOLATCH\\_%' ESCAPE '\\' OR wait_type = 'WRITELOG' THEN 'IO/Log' "
    "WHEN wait_type LIKE 'CX%' THEN 'Parallelism' ELSE 'Other' END"
)


@plan(
    "top_waits",
    "T2 K1 P5 F7",
    "waits",
    f"""SELECT wait_type, count(*) AS total_waits, round(CAST(sum(wait_ms) AS DOUBLE) / 1000.0, 2) AS wait_s,
              round(CAST(sum(wait_ms) AS DOUBLE) / count(*), 2) AS avg_wait_ms
        FROM waits WHERE {NOT_IDLE} GROUP BY 1 ORDER BY sum(wait_ms) DESC, 1 LIMIT 25""",
)
def top_waits(spark: SparkSession, d: str) -> DataFrame:
    return w.top_waits(waits(spark, d))


@plan(
    "wait_share",
    "T3 W2 J8",
    "waits",
    f"""t AS (SELECT host, wait_type, count(*) AS total_waits, CAST(sum(wait_ms) AS DECIMAL(28,2)) AS wait_ms FROM waits WHERE {NOT_IDLE} GROUP BY 1, 2)
        SELECT *, round(100.0 * CAST(wait_ms AS DOUBLE) / (SELECT CAST(sum(wait_ms) AS DOUBLE) FROM t), 2) AS pct FROM t""",
)
def wait_share(spark: SparkSession, d: str) -> DataFrame:
    return w.share_of_total(w.wait_totals(w.not_idle(waits(spark, d)), ["host", "wait_type"]), "wait_ms", "pct")


@plan(
    "wait_categories",
    "T4 F13 P6",
    "waits",
    f"""SELECT {CATEGORY_SQL} AS category, count(*) AS total_waits, CAST(sum(wait_ms) AS DECIMAL(28,2)) AS wait_ms FROM waits WHERE {NOT_IDLE} GROUP BY 1""",
)
def wait_categories(spark: SparkSession, d: str) -> DataFrame:
    labelled = w.not_idle(waits(spark, d)).withColumn("category", w.wait_category(F.col("wait_type")))
    return w.wait_totals(labelled, ["category"])


@plan(
    "wait_profile",
    "T5 A12",
    "waits",
    "SELECT host, wait_type, count(*) AS sessions FROM waits GROUP BY 1, 2",
)
def wait_profile(spark: SparkSession, d: str) -> DataFrame:
    return w.group_counts(waits(spark, d), ["host", "wait_type"])


@plan(
    "ash_timeline",
    "T31",
    "waits",
    "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, wait_type, count(*) AS sessions FROM waits GROUP BY 1, 2",
)
def ash_timeline(spark: SparkSession, d: str) -> DataFrame:
    return w.active_over_time(waits(spark, d), "ts", ["wait_type"], "15 minutes")


@plan(
    "ash_recent",
    "T31 P4",
    "waits",
    f"""SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, wait_type, count(*) AS sessions FROM waits
        WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2""",
)
def ash_recent(spark: SparkSession, d: str) -> DataFrame:
    return w.active_over_time(waits(spark, d), "ts", ["wait_type"], "15 minutes", AS_OF, "7 DAYS")


STATEMENTS_SQL = """
    st AS (SELECT p_partkey AS statement_id, substr(p_name, 1, 8) AS statement_text, calls, total_time, rows_read, max_time
           FROM part JOIN (SELECT l_partkey, count(*) AS calls, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total_time,
                                  CAST(sum(l_quantity) AS BIGINT) AS rows_read, max(l_extendedprice) AS max_time FROM lineitem GROUP BY 1) ON p_partkey = l_partkey)"""


def statements(spark: SparkSession, d: str) -> DataFrame:
    """Parts as statements: aggregated to one row per statement before the text is joined."""
    stats = w.statement_totals(
        table(spark, d, "lineitem"),
        "l_partkey",
        {
            "total_time": money_sum(F.col("l_extendedprice")),
            "rows_read": F.sum("l_quantity").cast("bigint"),
            "max_time": F.max("l_extendedprice"),
        },
    )
    texts = table(spark, d, "part").select("p_partkey", F.substring("p_name", 1, 8).alias("statement_text"))
    return stats.join(texts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_partkey").alias("statement_id"), "statement_text", "calls", "total_time", "rows_read", "max_time"
    )


@plan(
    "top_statements_total",
    "T6 K1 J1 F2 F5 F6",
    "",
    STATEMENTS_SQL
    + """ SELECT *, CAST(total_time AS DOUBLE) / calls AS avg_time FROM st ORDER BY total_time DESC, statement_id LIMIT 25""",
)
def top_statements_total(spark: SparkSession, d: str) -> DataFrame:
    stats = statements(spark, d).withColumn("avg_time", ratio_or_null(F.col("total_time"), F.col("calls")))
    return w.top_statements(stats, "statement_id", "total_time")


@plan(
    "top_statements_calls",
    "T6 K1",
    "",
    STATEMENTS_SQL + " SELECT * FROM st ORDER BY calls DESC, statement_id LIMIT 25",
)
def top_statements_calls(spark: SparkSession, d: str) -> DataFrame:
    return w.top_statements(statements(spark, d), "statement_id", "calls")


@plan(
    "top_statements_expression",
    "T6 K2",
    "",
    STATEMENTS_SQL + " SELECT * FROM st ORDER BY calls + rows_read DESC, statement_id LIMIT 25",
)
def top_statements_expression(spark: SparkSession, d: str) -> DataFrame:
    return w.top_statements(statements(spark, d), "statement_id", F.col("calls") + F.col("rows_read"))


@plan(
    "top_statements_stacked",
    "K5 T6",
    "",
    STATEMENTS_SQL
    + """, u AS (SELECT statement_id, 'calls' AS metric, CAST(calls AS DOUBLE) AS value FROM st UNION ALL SELECT statement_id, 'total_time', CAST(total_time AS DOUBLE) FROM st
                 UNION ALL SELECT statement_id, 'rows_read', CAST(rows_read AS DOUBLE) FROM st),
          k AS (SELECT *, CAST(row_number() OVER (PARTITION BY metric ORDER BY value DESC, statement_id) AS INTEGER) AS rank FROM u)
          SELECT * FROM k WHERE rank <= 10""",
)
def top_statements_stacked(spark: SparkSession, d: str) -> DataFrame:
    return w.top_per_dimension(statements(spark, d), "statement_id", ["calls", "total_time", "rows_read"])


@plan(
    "slow_ops",
    "T7",
    "",
    "SELECT event_id, user_id, event_type, value FROM events WHERE value > 100.0",
)
def slow_ops(spark: SparkSession, d: str) -> DataFrame:
    return w.slow_operations(table(spark, d, "events"), "value", 100.0).select("event_id", "user_id", "event_type", "value")


@plan(
    "active_sessions",
    "T8 P4 F8",
    "sessions",
    f"""SELECT session_id, user_id, event_type, date_sub('second', ts, TIMESTAMP '{AS_OF}') AS age_seconds FROM sessions
        WHERE date_sub('second', ts, TIMESTAMP '{AS_OF}') > 600""",
)
def active_sessions(spark: SparkSession, d: str) -> DataFrame:
    aged = w.sessions_by_age(sessions(spark, d), "ts", AS_OF, 600)
    return aged.select("session_id", "user_id", "event_type", "age_seconds")


@plan(
    "session_mix",
    "T9 A12",
    "sessions",
    "SELECT user_id, event_type, count(*) AS sessions FROM sessions GROUP BY 1, 2",
)
def session_mix(spark: SparkSession, d: str) -> DataFrame:
    return w.group_counts(sessions(spark, d), ["user_id", "event_type"])


@plan(
    "saturation",
    "T9 A3 F6",
    "sessions",
    """u AS (SELECT user_id, count(*) FILTER (WHERE event_type <> 'view') AS current, count(*) AS capacity FROM sessions GROUP BY 1),
       p AS (SELECT *, round(100.0 * (CAST(current AS DOUBLE) / CAST(capacity AS DOUBLE)), 2) AS used_pct FROM u)
       SELECT *, CASE WHEN used_pct > 90 THEN 'ALERT' WHEN used_pct > 85 THEN 'WARN' ELSE 'OK' END AS status FROM p""",
)
def saturation(spark: SparkSession, d: str) -> DataFrame:
    return w.saturation(sessions(spark, d), ["user_id"], F.col("event_type") != "view", F.count("*"))


@plan(
    "blocking_pairs",
    "T10 J10 J11 F2",
    "fleet",
    """SELECT host, captured_at, a.session_id AS blocked_session_id, a.wait_ms AS blocked_wait_ms, substr(a.event_type, 1, 4) AS blocked_text,
              b.session_id AS blocker_session_id, substr(b.event_type, 1, 4) AS blocker_text
       FROM fleet a JOIN fleet b USING (host, captured_at) WHERE a.blocker_id = b.session_id""",
)
def blocking_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = blocking.blocking_pairs(fleet(spark, d), scope=FLEET_SCOPE)
    return pairs.select(
        *FLEET_SCOPE,
        "blocked_session_id",
        "blocked_wait_ms",
        F.left("blocked_event_type", F.lit(4)).alias("blocked_text"),
        "blocker_session_id",
        F.left("blocker_event_type", F.lit(4)).alias("blocker_text"),
    )


@plan(
    "blocking_pairs_arrays",
    "J12 F14",
    "fleet",
    """a AS (SELECT host, captured_at, session_id, unnest(CASE WHEN blocker_id IS NULL THEN [] WHEN blocker_id % 5 = 0 THEN [blocker_id] ELSE [blocker_id, blocker_id - 1] END) AS blocker_id FROM fleet)
       SELECT host, captured_at, a.session_id AS blocked_id, a.blocker_id, b.event_type FROM a JOIN fleet b USING (host, captured_at) WHERE a.blocker_id = b.session_id""",
)
def blocking_pairs_arrays(spark: SparkSession, d: str) -> DataFrame:
    listed = fleet(spark, d).selectExpr(
        *FLEET_SCOPE,
        "session_id",
        "CASE WHEN blocker_id IS NULL THEN CAST(array() AS ARRAY<BIGINT>) WHEN blocker_id % 5 = 0 THEN array(blocker_id) "
        "ELSE array(blocker_id, blocker_id - 1) END AS blockers",
        "event_type",
    )
    return blocking.blocking_pairs_of_arrays(listed, "session_id", "blockers", scope=FLEET_SCOPE)


@plan(
    "head_blockers",
    "T11",
    "fleet",
    """c AS (SELECT host, captured_at, session_id, session_id AS head_blocker, CAST(0 AS BIGINT) AS depth FROM fleet WHERE blocker_id IS NULL
             UNION ALL SELECT host, captured_at, s.session_id, c.head_blocker, c.depth + 1 FROM fleet s JOIN c USING (host, captured_at) WHERE s.blocker_id = c.session_id)
       SELECT *, false AS in_cycle FROM c""",
)
def head_blockers(spark: SparkSession, d: str) -> DataFrame:
    return blocking.head_blockers(fleet(spark, d), scope=FLEET_SCOPE)


@plan(
    "head_blocker_chains",
    "T11 T13",
    "fleet",
    """c AS (SELECT host, captured_at, session_id, session_id AS head_blocker, CAST(0 AS BIGINT) AS depth FROM fleet WHERE blocker_id IS NULL
             UNION ALL SELECT host, captured_at, s.session_id, c.head_blocker, c.depth + 1 FROM fleet s JOIN c USING (host, captured_at) WHERE s.blocker_id = c.session_id)
       SELECT host, captured_at, head_blocker, count(*) AS blocked_sessions, max(depth) AS chain_depth FROM c WHERE depth > 0 GROUP BY 1, 2, 3""",
)
def head_blocker_chains(spark: SparkSession, d: str) -> DataFrame:
    return blocking.chains_by_head(blocking.head_blockers(fleet(spark, d), scope=FLEET_SCOPE), FLEET_SCOPE)


REACH_SQL = """
    e AS (SELECT DISTINCT host, captured_at, session_id AS src, unnest(blockers) AS dst FROM wait_graph),
    r AS (SELECT host, captured_at, src, dst FROM e UNION SELECT r.host, r.captured_at, r.src, e.dst FROM r JOIN e ON e.host = r.host AND e.captured_at = r.captured_at AND e.src = r.dst)"""


@plan(
    "head_sets",
    "T11 J12",
    "fleet wait_graph",
    REACH_SQL
    + """ SELECT DISTINCT r.host, r.captured_at, r.src AS waiter, r.dst AS head FROM r
          WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.host = r.host AND e.captured_at = r.captured_at AND e.src = r.dst)""",
)
def head_sets(spark: SparkSession, d: str) -> DataFrame:
    return blocking.head_sets(wait_graph(spark, d), scope=FLEET_SCOPE)


@plan(
    "blocking_cycles",
    "T11 J12",
    "fleet wait_graph",
    REACH_SQL
    + """ SELECT a.host, a.captured_at, min(a.dst) AS cycle, a.src AS session_id FROM r a
          JOIN r b ON b.host = a.host AND b.captured_at = a.captured_at AND b.src = a.dst AND b.dst = a.src GROUP BY 1, 2, 4""",
)
def blocking_cycles(spark: SparkSession, d: str) -> DataFrame:
    return blocking.blocking_cycles(wait_graph(spark, d), scope=FLEET_SCOPE)


@plan(
    "lock_conflicts",
    "J9 P9",
    "locks",
    """h AS (SELECT lock_day, pid, min(ts) AS since FROM locks WHERE granted GROUP BY 1, 2),
       p AS (SELECT q.event_id, count(*) AS blocking_holders, min_by(h.pid, (h.since, h.pid)) AS oldest_holder
             FROM locks q JOIN h ON q.lock_day = h.lock_day AND q.pid <> h.pid WHERE NOT q.granted GROUP BY 1)
       SELECT q.event_id, q.pid, q.lock_day, p.blocking_holders, p.oldest_holder FROM locks q JOIN p USING (event_id)""",
)
def lock_conflicts(spark: SparkSession, d: str) -> DataFrame:
    out = blocking.lock_conflicts(locks(spark, d), ["lock_day"], "pid", "granted", "ts")
    return out.select("event_id", "pid", "lock_day", "blocking_holders", "oldest_holder")


@plan(
    "lock_conflict_counts",
    "J9 P9",
    "locks",
    """w AS (SELECT DISTINCT pid, lock_day FROM locks WHERE NOT granted),
       h AS (SELECT DISTINCT pid, lock_day FROM locks WHERE granted),
       y AS (SELECT w.pid AS a, h.pid AS b FROM w JOIN h USING (lock_day) WHERE w.pid <> h.pid)
       SELECT pid, (SELECT count(*) FROM y WHERE a = pid) AS pairs_waiting, (SELECT count(*) FROM y WHERE b = pid) AS pairs_holding
       FROM (SELECT DISTINCT pid FROM locks)""",
)
def lock_conflict_counts(spark: SparkSession, d: str) -> DataFrame:
    return blocking.conflict_counts(locks(spark, d), ["lock_day"], "pid", "granted")


@plan(
    "lock_conflict_pairs",
    "J9",
    "locks",
    """w AS (SELECT DISTINCT pid, lock_day FROM locks WHERE NOT granted AND pid % 100 = 0),
       h AS (SELECT DISTINCT pid, lock_day FROM locks WHERE granted)
       SELECT w.pid AS blocked_pid, h.pid AS holder_pid, lock_day FROM w JOIN h USING (lock_day) WHERE w.pid <> h.pid""",
)
def lock_conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    return blocking.conflict_pairs(locks(spark, d), ["lock_day"], "pid", "granted", "pid % 100 = 0")


@plan(
    "lock_contention",
    "J15",
    "locks",
    """r AS (SELECT lock_day, event_id // 100 AS slot FROM locks GROUP BY ALL),
       l AS (SELECT *, event_id // 100 AS slot FROM locks),
       c AS (SELECT lock_day, slot FROM l GROUP BY 1, 2 HAVING bool_or(granted) AND bool_or(NOT granted))
       SELECT DISTINCT pid FROM l JOIN c USING (lock_day, slot)""",
)
def lock_contention(spark: SparkSession, d: str) -> DataFrame:
    slotted = locks(spark, d).withColumn("slot", F.floor(F.col("event_id") / 100))
    return blocking.in_contention(slotted, ["lock_day", "slot"], "pid", "granted")


@plan(
    "lock_inventory",
    "T12 A4 A12",
    "locks",
    """SELECT lock_mode, lock_day, count(*) FILTER (WHERE granted) AS granted, count(*) FILTER (WHERE NOT granted) AS waiting FROM locks GROUP BY 1, 2""",
)
def lock_inventory(spark: SparkSession, d: str) -> DataFrame:
    return blocking.lock_inventory(locks(spark, d), ["lock_mode", "lock_day"], "granted")


@plan(
    "blocked_scope",
    "T13 F13",
    "sessions",
    """n AS (SELECT user_id, count(*) AS blocked_sessions FROM sessions WHERE blocker_id IS NOT NULL GROUP BY 1)
       SELECT *, CASE WHEN blocked_sessions >= 10 THEN 'KILL_BLOCKER_AND_RETRY' WHEN blocked_sessions > 2 THEN 'ESCALATE'
                      WHEN blocked_sessions >= 1 THEN 'INVESTIGATE_BLOCKER' ELSE 'NONE' END AS decision FROM n""",
)
def blocked_scope(spark: SparkSession, d: str) -> DataFrame:
    blocked = sessions(spark, d).where("blocker_id IS NOT NULL")
    return blocking.blocked_scope(blocked, ["user_id"])


IO_SQL = """
    io AS (SELECT l_suppkey AS file_id, count(*) FILTER (WHERE l_returnflag <> 'R') AS reads, count(*) FILTER (WHERE l_returnflag = 'R') AS writes,
                  CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS read_stall_ms,
                  CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS write_stall_ms
           FROM lineitem GROUP BY 1)"""


def io_stats(spark: SparkSession, d: str) -> DataFrame:
    written = F.col("l_returnflag") == "R"
    stall = F.col("l_quantity").cast("bigint")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("file_id")).agg(
        F.count_if(~written).alias("reads"),
        F.count_if(written).alias("writes"),
        F.sum(F.when(~written, stall).otherwise(0)).alias("read_stall_ms"),
        F.sum(F.when(written, stall).otherwise(0)).alias("write_stall_ms"),
    )


@plan(
    "io_latency",
    "T14 F6 P7",
    "",
    IO_SQL
    + """, a AS (SELECT *, CASE WHEN reads = 0 THEN 0.0 ELSE CAST(read_stall_ms AS DOUBLE) / reads END AS avg_read_stall_ms,
                        CASE WHEN writes = 0 THEN 0.0 ELSE CAST(write_stall_ms AS DOUBLE) / writes END AS avg_write_stall_ms FROM io)
          SELECT s_name, reads, writes, CAST(avg_read_stall_ms AS DOUBLE) AS avg_read_stall_ms, CAST(avg_write_stall_ms AS DOUBLE) AS avg_write_stall_ms
          FROM a JOIN supplier ON file_id = s_suppkey WHERE avg_read_stall_ms > 25 OR avg_write_stall_ms > 25""",
)
def io_latency(spark: SparkSession, d: str) -> DataFrame:
    hot = storage.io_latency(io_stats(spark, d), 25.0)
    named = hot.join(table(spark, d, "supplier"), F.col("file_id") == F.col("s_suppkey"))
    return named.select("s_name", "reads", "writes", "avg_read_stall_ms", "avg_write_stall_ms")


@plan(
    "read_heavy",
    "T15 K1 P5",
    "",
    """t AS (SELECT l_partkey AS object_id, l_linestatus AS owner, count(*) FILTER (WHERE l_returnflag <> 'R') AS reads, count(*) FILTER (WHERE l_returnflag = 'R') AS writes
             FROM lineitem GROUP BY 1, 2)
       SELECT * FROM t WHERE reads > writes * 10 AND owner NOT IN ('X') ORDER BY reads DESC, object_id, owner LIMIT 25""",
)
def read_heavy(spark: SparkSession, d: str) -> DataFrame:
    written = F.col("l_returnflag") == "R"
    stats = table(spark, d, "lineitem").groupBy(
        F.col("l_partkey").alias("object_id"), F.col("l_linestatus").alias("owner")
    ).agg(F.count_if(~written).alias("reads"), F.count_if(written).alias("writes"))
    return storage.read_heavy(stats, excluded=["X"]).orderBy(F.desc("reads"), "object_id", "owner").limit(25)


@plan(
    "dead_rows",
    "T16 F6 P7",
    "",
    """t AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS live, count(*) FILTER (WHERE l_returnflag = 'R') AS dead FROM lineitem GROUP BY 1),
       p AS (SELECT *, round(100.0 * CAST(dead AS DOUBLE) / nullif(live + dead, 0), 2) AS dead_pct FROM t)
       SELECT * FROM p WHERE dead > 250 OR dead_pct > 34""",
)
def dead_rows(spark: SparkSession, d: str) -> DataFrame:
    dead = F.col("l_returnflag") == "R"
    stats = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(~dead).alias("live"), F.count_if(dead).alias("dead")
    )
    return storage.dead_rows(stats, 250, 34.0)


HIT_SQL = """t AS (SELECT p_brand, CAST(sum(l_quantity) AS BIGINT) AS hits, count(*) FILTER (WHERE l_returnflag = 'A') AS misses
             FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Counters are summed per part before they meet the part's brand."""
    per_part = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("_h"), F.count_if(F.col("l_returnflag") == "A").alias("_m")
    )
    joined = per_part.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand").agg(
        F.sum("_h").cast("bigint").alias("hits"), F.sum("_m").alias("misses")
    )


@plan(
    "hit_ratio",
    "T17 K3",
    "",
    HIT_SQL
    + """, p AS (SELECT *, round(100.0 * CAST(hits AS DOUBLE) / nullif(hits + misses, 0), 2) AS hit_pct FROM t)
          SELECT * FROM p WHERE misses > 10 AND hit_pct < 98.7 ORDER BY hit_pct ASC NULLS LAST, p_brand LIMIT 25""",
)
def hit_ratio(spark: SparkSession, d: str) -> DataFrame:
    out = storage.hit_ratio(hits(spark, d), 10, 98.7)
    return out.orderBy(F.col("hit_pct").asc_nulls_last(), "p_brand").limit(25)


@plan(
    "cache_hit",
    "A6 T17",
    "",
    HIT_SQL
    + """ SELECT CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(misses) AS BIGINT) AS misses,
                 CAST(sum(hits) AS DOUBLE) / nullif(CAST(sum(hits) + sum(misses) AS DOUBLE), 0) AS hit_ratio FROM t""",
)
def cache_hit(spark: SparkSession, d: str) -> DataFrame:
    return storage.cache_hit(hits(spark, d), F.col("hits"), F.col("misses"))


USAGE_SQL = """
    u AS (SELECT l_partkey AS p_partkey, count(*) FILTER (WHERE l_linenumber = 1) AS seeks, count(*) FILTER (WHERE l_linenumber = 2) AS scans,
                 count(*) FILTER (WHERE l_linenumber = 3) AS lookups, count(*) FILTER (WHERE l_linenumber > 3) AS updates FROM lineitem GROUP BY 1),
    x AS (SELECT p_partkey, p_brand, coalesce(seeks, 0) AS seeks, coalesce(scans, 0) AS scans, coalesce(lookups, 0) AS lookups, coalesce(updates, 0) AS updates
          FROM part LEFT JOIN u USING (p_partkey))"""


def usage(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("l_linenumber")
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count_if(line == 1).alias("seeks"),
        F.count_if(line == 2).alias("scans"),
        F.count_if(line == 3).alias("lookups"),
        F.count_if(line > 3).alias("updates"),
    )


@plan(
    "index_usage",
    "T18 J2 F5",
    "",
    USAGE_SQL
    + """ SELECT *, round(100.0 * (CAST(seeks AS DOUBLE) / nullif(CAST(seeks + scans + lookups + updates AS DOUBLE), 0)), 1) AS seek_pct,
                 round(100.0 * (CAST(seeks + scans + lookups AS DOUBLE) / nullif(CAST(seeks + scans + lookups + updates AS DOUBLE), 0)), 1) AS read_pct,
                 CASE WHEN seeks + scans + lookups = 0 THEN 'UNUSED' WHEN seeks + scans + lookups < 10 THEN 'VERY_LOW' ELSE 'USED' END AS usage FROM x""",
)
def index_usage(spark: SparkSession, d: str) -> DataFrame:
    return storage.index_usage(table(spark, d, "part").select("p_partkey", "p_brand"), usage(spark, d), "p_partkey")


INDEX_SQL = """i AS (SELECT DISTINCT p_brand AS table_name, p_type || '-' || p_size || '-' || p_name AS index_name,
                     CASE WHEN p_size < 15 THEN [p_type] WHEN p_size < 35 THEN [p_type, p_name] ELSE [p_type, p_name, CAST(p_size AS VARCHAR)] END AS cols FROM part)"""


@plan(
    "redundant_index",
    "T19",
    "",
    INDEX_SQL
    + """, p AS (SELECT a.table_name, a.index_name, count(*) AS covering_indexes, min_by(b.index_name, (len(b.cols), b.index_name)) AS covered_by
                 FROM i a JOIN i b ON a.table_name = b.table_name AND len(b.cols) > len(a.cols) AND b.cols[1:len(a.cols)] = a.cols GROUP BY 1, 2)
          SELECT table_name, index_name, covered_by, covering_indexes FROM p""",
)
def redundant_index(spark: SparkSession, d: str) -> DataFrame:
    indexes = table(spark, d, "part").selectExpr(
        "p_brand AS table_name",
        "concat_ws('-', p_type, CAST(p_size AS STRING), p_name) AS index_name",
        "CASE WHEN p_size < 15 THEN array(p_type) WHEN p_size < 35 THEN array(p_type, p_name) "
        "ELSE array(p_type, p_name, CAST(p_size AS STRING)) END AS cols",
    ).distinct()
    return storage.redundant_indexes(indexes, "table_name", "index_name", "cols")


@plan(
    "low_cardinality",
    "T20 A5",
    "",
    """n AS (SELECT count(*) AS t, count(DISTINCT l_returnflag) AS a, count(DISTINCT l_quantity) AS b, count(DISTINCT l_orderkey) AS c FROM lineitem),
       u AS (SELECT 'l_returnflag' AS column_name, a AS unique_count, t AS total_rows FROM n UNION ALL SELECT 'l_quantity', b, t FROM n UNION ALL SELECT 'l_orderkey', c, t FROM n)
       SELECT *, round(100.0 * (CAST(unique_count AS DOUBLE) / total_rows), 4) AS cardinality_pct FROM u WHERE round(100.0 * (CAST(unique_count AS DOUBLE) / total_rows), 4) < 5""",
)
def low_cardinality(spark: SparkSession, d: str) -> DataFrame:
    columns = ["l_returnflag", "l_quantity", "l_orderkey"]
    return storage.low_cardinality(table(spark, d, "lineitem"), columns, exact=True)


@plan(
    "low_cardinality_approx",
    "T20",
    "",
    """n AS (SELECT count(*) AS t, count(DISTINCT l_returnflag) AS a, count(DISTINCT l_quantity) AS b, count(DISTINCT l_orderkey) AS c FROM lineitem)
       SELECT 'l_returnflag' AS column_name, t AS total_rows, a AS distinct_values, true AS within_error FROM n
       UNION ALL SELECT 'l_quantity', t, b, true FROM n UNION ALL SELECT 'l_orderkey', t, c, true FROM n""",
)
def low_cardinality_approx(spark: SparkSession, d: str) -> DataFrame:
    """The sketch beside the exact count: within four standard errors of 5 %."""
    columns = ["l_returnflag", "l_quantity", "l_orderkey"]
    lines = table(spark, d, "lineitem")
    sketched = storage.low_cardinality(lines, columns, below_pct=1000.0).select("column_name", "total_rows", F.col("unique_count").alias("sketch"))
    exact = storage.low_cardinality(lines, columns, below_pct=1000.0, exact=True).select("column_name", F.col("unique_count").alias("distinct_values"))
    near = F.abs(F.col("sketch") - F.col("distinct_values")) <= 0.2 * F.col("distinct_values")
    return sketched.join(exact, "column_name").select("column_name", "total_rows", "distinct_values", near.alias("within_error"))


@plan(
    "index_score",
    "T21 J1 K1",
    "",
    USAGE_SQL
    + """ SELECT x.p_partkey, p_brand, seeks, scans, CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(p_size AS DECIMAL(6,2)) * CAST(seeks + scans AS DECIMAL(12,0)) * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(18,2)) AS improvement
          FROM x JOIN (SELECT p_partkey, p_retailprice, p_size FROM part) USING (p_partkey) ORDER BY improvement DESC, p_partkey LIMIT 25""",
)
def index_score(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(
        "p_partkey", "p_brand", F.col("p_retailprice").alias("avg_cost"), F.col("p_size").cast("double").alias("avg_impact")
    )
    stats = storage.index_usage(part, usage(spark, d), "p_partkey")
    scored = storage.index_score(stats).select("p_partkey", "p_brand", "seeks", "scans", "improvement")
    return scored.orderBy(F.desc("improvement"), "p_partkey").limit(25)


@plan(
    "index_health",
    "T22 Q10",
    "",
    USAGE_SQL
    + """, m AS (SELECT p_partkey, CAST(seeks + scans + lookups AS DOUBLE) AS a, round(100.0 * CAST(updates AS DOUBLE) / nullif(seeks + scans + lookups + updates, 0), 2) AS b,
                        round(100.0 * CAST(seeks AS DOUBLE) / nullif(seeks + scans, 0), 2) AS c, round(100.0 * CAST(lookups AS DOUBLE) / nullif(seeks + scans + lookups, 0), 2) AS dd FROM x)
          SELECT p_partkey, 'SCAN_FREQUENCY' AS issue, a AS observed, CAST(50 AS DOUBLE) AS threshold, 'REVIEW' AS severity FROM m WHERE a < 50
          UNION ALL SELECT p_partkey, 'WRITE_PENALTY', b, 5, 'REVIEW' FROM m WHERE b > 5
          UNION ALL SELECT p_partkey, 'CACHE_HIT', c, 95, 'REVIEW' FROM m WHERE c < 95
          UNION ALL SELECT p_partkey, 'BLOAT', dd, 10, 'REINDEX' FROM m WHERE dd > 10""",
)
def index_health(spark: SparkSession, d: str) -> DataFrame:
    stats = storage.index_usage(table(spark, d, "part").select("p_partkey"), usage(spark, d), "p_partkey").selectExpr(
        "p_partkey",
        "CAST(seeks + scans + lookups AS DOUBLE) AS scans_per_month",
        "round(100.0D * CAST(updates AS DOUBLE) / CAST(nullif(seeks + scans + lookups + updates, 0) AS DOUBLE), 2) AS write_penalty_pct",
        "round(100.0D * CAST(seeks AS DOUBLE) / CAST(nullif(seeks + scans, 0) AS DOUBLE), 2) AS cache_hit_pct",
        "round(100.0D * CAST(lookups AS DOUBLE) / CAST(nullif(seeks + scans + lookups, 0) AS DOUBLE), 2) AS dead_pct",
    )
    return storage.index_health(stats, ["p_partkey"])


@plan(
    "plan_cache",
    "T23 A2",
    "",
    """SELECT p_type, count(*) AS plans, CAST(sum(p_size) AS BIGINT) AS total_size, max(p_size) AS max_size,
              count(*) FILTER (WHERE p_size = 1) AS single_use FROM part GROUP BY 1""",
)
def plan_cache(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_type").agg(
        F.count("*").alias("plans"),
        F.sum("p_size").alias("total_size"),
        F.max("p_size").alias("max_size"),
        F.count_if(F.col("p_size") == 1).alias("single_use"),
    )


@plan(
    "plan_regression",
    "T24 J1",
    "",
    """s AS (SELECT l_partkey, l_returnflag AS plan_id, count(*) AS executions, max(l_extendedprice) AS max_ms,
                    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_ms FROM lineitem GROUP BY 1, 2),
       q AS (SELECT l_partkey, count(*) AS plans, min(avg_ms) AS best_ms, max(avg_ms) AS worst_ms, max(max_ms / avg_ms) AS outlier_ratio FROM s GROUP BY 1)
       SELECT p_brand, l_partkey, plans, round(worst_ms / best_ms, 4) AS regression, round(outlier_ratio, 4) AS outlier
       FROM q JOIN part ON l_partkey = p_partkey WHERE plans > 1 AND worst_ms / best_ms > 1.5""",
)
def plan_regression(spark: SparkSession, d: str) -> DataFrame:
    stats = table(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(
        F.max("l_extendedprice").alias("max_ms"),
        ratio_or_null(money_sum(F.col("l_extendedprice")), F.count("*")).alias("avg_ms"),
    )
    per_query = stats.groupBy("l_partkey").agg(
        F.count("*").alias("plans"),
        (F.max("avg_ms") / F.min("avg_ms")).alias("_r"),
        F.max(F.col("max_ms") / F.col("avg_ms")).alias("_o"),
    )
    worse = per_query.where("plans > 1 AND _r > 1.5")
    named = worse.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return named.select(
        "p_brand", "l_partkey", "plans", F.round("_r", 4).alias("regression"), F.round("_o", 4).alias("outlier")
    )


@plan(
    "wow_p99",
    "W6 A14 T24",
    "",
    """k AS (SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, round(quantile_cont(value, 0.99), 6) AS p_value FROM events GROUP BY 1, 2),
       l AS (SELECT *, lag(p_value) OVER (PARTITION BY event_type ORDER BY week) AS b FROM k)
       SELECT event_type, week, p_value, round(100.0 * (p_value - b) / nullif(b, 0), 4) AS change_pct,
              coalesce(round(100.0 * (p_value - b) / nullif(b, 0), 4) > 20, false) AS degraded FROM l""",
)
def wow_p99(spark: SparkSession, d: str) -> DataFrame:
    return trends.week_over_week(table(spark, d, "events"), ["event_type"], "ts", "value")


@plan(
    "wow_p99_history",
    "W6 A14",
    "",
    """SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS samples, true AS within_bound FROM events
       WHERE ts < TIMESTAMP '2024-01-29' GROUP BY 1, 2""",
)
def wow_p99_history(spark: SparkSession, d: str) -> DataFrame:
    """p99 per week from day sketches made in two refreshes: its rank among the week's values is within 1 % of 0.99."""
    events = table(spark, d, "events").select("event_type", "value", F.to_date("ts").alias("day"))
    path = scratch_path(spark, "day_sketches")
    for upto in ("2024-01-16", "2024-01-29"):
        history.refresh(events, "day", ["event_type"], "value", path, upto)
    weekly = materialize(history.quantiles(spark, path, ["event_type"], F.trunc("day", "week"), {"p99": 0.99}), "weekly")
    ranked = events.withColumn("period", F.trunc("day", "week")).join(weekly, ["event_type", "period"])
    ranked = ranked.where("day < DATE '2024-01-29'").groupBy("event_type", "period").agg(
        F.first("samples").alias("samples"), F.avg((F.col("value") < F.col("p99")).cast("int")).alias("_lo"), F.avg((F.col("value") <= F.col("p99")).cast("int")).alias("_hi")
    )
    # a week of few rows can't come nearer than one of them
    room = F.greatest(F.lit(0.01), 1 / F.col("samples"))
    near = (F.col("_lo") <= 0.99 + room) & (F.col("_hi") >= 0.99 - room)
    return ranked.select("event_type", F.col("period").alias("week"), "samples", near.alias("within_bound"))


@plan(
    "storage_by_owner",
    "T25 A2 F7",
    "",
    """b AS (SELECT n_name, length(s_name) * 1000 + s_suppkey AS data_bytes, length(s_name) * 10 AS index_bytes FROM supplier JOIN nation ON s_nationkey = n_nationkey)
       SELECT n_name, count(*) AS objects, round(CAST(sum(data_bytes) AS DOUBLE) / 1048576.0, 4) AS data_mb,
              round(CAST(sum(index_bytes) AS DOUBLE) / 1048576.0, 4) AS index_mb, round(CAST(sum(data_bytes) + sum(index_bytes) AS DOUBLE) / 1048576.0, 4) AS total_mb
       FROM b GROUP BY 1""",
)
def storage_by_owner(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return storage.storage_by(
        joined, ["n_name"], F.length("s_name") * 1000 + F.col("s_suppkey"), F.length("s_name") * 10
    )


@plan(
    "row_estimates",
    "T26 U2",
    "",
    """SELECT 'orders' AS table_name, count(*) AS row_estimate FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem
       UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events""",
)
def row_estimates(spark: SparkSession, d: str) -> DataFrame:
    def count(name: str) -> DataFrame:
        return table(spark, d, name).agg(F.count("*").alias("row_estimate")).select(
            F.lit(name).alias("table_name"), "row_estimate"
        )

    out = count("orders")
    for name in ("lineitem", "customer", "events"):
        out = out.unionByName(count(name))
    return out


@plan(
    "hot_partition",
    "T41",
    "",
    """c AS (SELECT l_suppkey, count(*) AS items FROM lineitem GROUP BY 1)
       SELECT *, round(CAST(items AS DOUBLE) / (SELECT avg(items) FROM c), 4) AS ratio_to_mean,
              CASE WHEN round(CAST(items AS DOUBLE) / (SELECT avg(items) FROM c), 4) > 1.15 THEN 'HOT' ELSE 'OK' END AS status FROM c""",
)
def hot_partition(spark: SparkSession, d: str) -> DataFrame:
    return storage.hot_partitions(table(spark, d, "lineitem"), "l_suppkey", 1.15)


@plan(
    "deadlock_xml",
    "T27 F16",
    "",
    """SELECT event_id, ts, user_id AS victim_spid, CAST(1 + event_id % 3 AS INTEGER) AS process_count, CAST(event_id % 2 AS INTEGER) AS resource_count
       FROM events WHERE event_type = 'error'""",
)
def deadlock_xml(spark: SparkSession, d: str) -> DataFrame:
    process = F.concat(F.lit('<process spid="'), F.col("user_id").cast("string"), F.lit('"/>'))
    document = F.concat(
        F.lit("<event><deadlock><process-list>"),
        process,
        F.expr("repeat('<process spid=\"0\"/>', CAST(event_id % 3 AS INT))"),
        F.lit("</process-list><resource-list>"),
        F.expr("repeat('<keylock/>', CAST(event_id % 2 AS INT))"),
        F.lit("</resource-list></deadlock></event>"),
    )
    reports = table(spark, d, "events").where("event_type = 'error'").select("event_id", "ts", document.alias("xml"))
    base = "/event/deadlock"
    return reports.select(
        "event_id",
        "ts",
        F.xpath_long("xml", F.lit(f"{base}/process-list/process[1]/@spid")).alias("victim_spid"),
        F.size(F.xpath("xml", F.lit(f"{base}/process-list/process/@spid"))).alias("process_count"),
        F.xpath_int("xml", F.lit(f"count({base}/resource-list/*)")).alias("resource_count"),
    )


@plan(
    "deadlock_log_lines",
    "T27 K1 P6",
    "",
    """SELECT doc_id, source, n_chars FROM documents WHERE contains(lower(text), 'error') OR contains(lower(text), 'lock')
       ORDER BY doc_id DESC LIMIT 50""",
)
def deadlock_log_lines(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower("text")
    found = table(spark, d, "documents").where(F.contains(text, F.lit("error")) | F.contains(text, F.lit("lock")))
    return found.select("doc_id", "source", "n_chars").orderBy(F.desc("doc_id")).limit(50)


@plan(
    "replica_lag",
    "T28 F8",
    "",
    f"""n AS (SELECT user_id, max(ts) AS last_applied FROM events GROUP BY 1),
        l AS (SELECT *, date_sub('second', last_applied, TIMESTAMP '{AS_OF}') AS lag_seconds FROM n)
        SELECT *, CASE WHEN lag_seconds > 60 THEN 'CRITICAL' WHEN lag_seconds > 10 THEN 'HIGH' ELSE 'OK' END AS status FROM l""",
)
def replica_lag(spark: SparkSession, d: str) -> DataFrame:
    return trends.replica_lag(table(spark, d, "events"), ["user_id"], "ts", AS_OF)


@plan(
    "standby_gap",
    "T29 A9",
    "",
    """m AS (SELECT l_suppkey, max(l_linenumber) AS last_l_linenumber FROM lineitem GROUP BY 1)
       SELECT l_suppkey, last_l_linenumber, max(l_returnflag) AS last_state FROM lineitem JOIN m USING (l_suppkey) WHERE l_linenumber = last_l_linenumber GROUP BY 1, 2""",
)
def standby_gap(spark: SparkSession, d: str) -> DataFrame:
    return trends.last_by(table(spark, d, "lineitem"), ["l_suppkey"], "l_linenumber", "l_returnflag", "last_state")


@plan(
    "promotion_rank",
    "T56 W1",
    "",
    """SELECT s_nationkey, s_name, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_name) AS promotion_rank
       FROM supplier WHERE s_acctbal > 0 AND s_name NOT LIKE '%3'""",
)
def promotion_rank(spark: SparkSession, d: str) -> DataFrame:
    ranked = trends.promotion_rank(
        table(spark, d, "supplier"),
        ["s_nationkey"],
        F.col("s_acctbal") > 0,
        ~F.col("s_name").like("%3"),
        "s_acctbal",
        "s_name",
    )
    return ranked.select("s_nationkey", "s_name", "s_acctbal", "promotion_rank")


COUNTER_SQL = "c AS (SELECT user_id, event_type, event_id, ts, CAST(value * 100 AS BIGINT) AS counter FROM events)"


def counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "user_id", "event_type", "event_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("counter")
    )


DELTA_SQL = (
    COUNTER_SQL
    + """, p AS (SELECT *, lag(counter) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous_value FROM c),
          x AS (SELECT *, coalesce(counter - previous_value < 0, false) AS was_reset,
                       CASE WHEN counter - previous_value < 0 THEN counter ELSE counter - previous_value END AS delta FROM p)"""
)


@plan("snapshot_delta", "T40 W4", "", DELTA_SQL + " SELECT event_id, counter, previous_value, was_reset, delta FROM x")
def snapshot_delta(spark: SparkSession, d: str) -> DataFrame:
    out = trends.counter_deltas(counters(spark, d), ["user_id", "event_type"], "ts", "event_id", "counter")
    return out.select("event_id", "counter", "previous_value", "was_reset", "delta")


@plan(
    "snapshot_findings",
    "T40",
    "",
    DELTA_SQL
    + """ SELECT event_id, delta, CASE WHEN delta > 20000 THEN 'CRITICAL' ELSE 'WARN' END AS severity,
                 CASE WHEN delta > 20000 THEN 'Investigate now' ELSE 'Watch next window' END AS recommendation FROM x WHERE delta > 10000""",
)
def snapshot_findings(spark: SparkSession, d: str) -> DataFrame:
    deltas = trends.counter_deltas(counters(spark, d), ["user_id", "event_type"], "ts", "event_id", "counter")
    return trends.delta_findings(deltas, 10_000, 20_000).select("event_id", "delta", "severity", "recommendation")


@plan(
    "health_detector",
    "T1 U1 J14 P7",
    "sessions",
    """m AS (SELECT user_id, CAST(count(*) FILTER (WHERE blocker_id IS NOT NULL) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE wait_ms > 250) AS DOUBLE) AS b,
                    CAST(count(*) AS DOUBLE) AS c FROM sessions GROUP BY 1)
       SELECT user_id, 'BLOCKED_SESSIONS' AS issue, a AS observed, CAST(50 AS DOUBLE) AS threshold, 'SEV2' AS severity FROM m WHERE a > 50
       UNION ALL SELECT user_id, 'WAITS_OVER_250MS', b, 0, 'SEV1' FROM m WHERE b > 0
       UNION ALL SELECT user_id, 'SESSION_PRESSURE', c, 80, 'SEV3' FROM m WHERE c >= 80""",
)
def health_detector(spark: SparkSession, d: str) -> DataFrame:
    metrics = {
        "blocked": F.count_if(F.col("blocker_id").isNotNull()),
        "slow": F.count_if(F.col("wait_ms") > 250),
        "total": F.count("*"),
    }
    rules = [
        Rule("BLOCKED_SESSIONS", "blocked", ">", 50, "SEV2"),
        Rule("WAITS_OVER_250MS", "slow", ">", 0, "SEV1"),
        Rule("SESSION_PRESSURE", "total", ">=", 80, "SEV3"),
    ]
    return detect(sessions(spark, d), metrics, rules, ["user_id"])


@plan(
    "health_pack",
    "T55 U1",
    "sessions",
    f"""SELECT 'idle_wait_sessions' AS check_name, user_id AS host, CAST(count(*) AS DOUBLE) AS value, CASE WHEN count(*) > 20 THEN 'WARN' ELSE 'OK' END AS status FROM sessions WHERE event_type = 'view' GROUP BY 2
        UNION ALL SELECT 'blocked_sessions', user_id, CAST(count(*) AS DOUBLE), CASE WHEN count(*) > 10 THEN 'WARN' ELSE 'OK' END FROM sessions WHERE blocker_id IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'lag_seconds', user_id, CAST(date_sub('second', max(ts), TIMESTAMP '{AS_OF}') AS DOUBLE), CASE WHEN date_sub('second', max(ts), TIMESTAMP '{AS_OF}') > 60 THEN 'WARN' ELSE 'OK' END FROM sessions GROUP BY 2""",
)
def health_pack(spark: SparkSession, d: str) -> DataFrame:
    all_sessions = sessions(spark, d)

    def check(name: str, df: DataFrame, limit: float) -> DataFrame:
        value = F.col("value").cast("double")
        return df.select(
            F.lit(name).alias("check_name"), F.col("user_id").alias("host"), value.alias("value"),
            F.when(value > limit, "WARN").otherwise("OK").alias("status"),
        )

    idle = w.group_counts(all_sessions.where("event_type = 'view'"), ["user_id"], "value")
    blocked = w.group_counts(all_sessions.where("blocker_id IS NOT NULL"), ["user_id"], "value")
    lag = trends.replica_lag(all_sessions, ["user_id"], "ts", AS_OF).withColumnRenamed("lag_seconds", "value")
    return (
        check("idle_wait_sessions", idle, 20)
        .unionByName(check("blocked_sessions", blocked, 10))
        .unionByName(check("lag_seconds", lag, 60))
    )


@plan(
    "counter_panel",
    "T50 A3",
    "",
    """SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18,2)) END) AS DECIMAL(28,2)) AS click,
              CAST(sum(CASE WHEN event_type = 'error' THEN CAST(value AS DECIMAL(18,2)) END) AS DECIMAL(28,2)) AS error
       FROM events WHERE event_type IN ('click', 'error') GROUP BY 1, 2""",
)
def counter_panel(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "events").select(
        "user_id", F.to_date("ts").alias("day"), "event_type", F.col("value").cast("decimal(18,2)").alias("value")
    )
    return trends.counter_panel(samples, ["user_id", "day"], "event_type", "value", ["click", "error"])


@plan(
    "config_drift",
    "T51",
    "",
    """SELECT p_name, count(DISTINCT p_type) AS distinct_values, min(p_type) AS lowest, max(p_type) AS highest FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1""",
)
def config_drift(spark: SparkSession, d: str) -> DataFrame:
    return trends.config_drift(table(spark, d, "part"), "p_name", "p_type")


@plan(
    "config_changes",
    "T51",
    "",
    """b AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS v FROM events WHERE ts < TIMESTAMP '2024-01-03' GROUP BY 1),
       a AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1)
       SELECT user_id, b.v AS old_value, a.v AS new_value, CASE WHEN b.v IS NULL THEN 'ADDED' WHEN a.v IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change
       FROM b FULL JOIN a USING (user_id) WHERE a.v IS DISTINCT FROM b.v""",
)
def config_changes(spark: SparkSession, d: str) -> DataFrame:
    """The last setting per parameter in two snapshots, at the start and the end of the month."""
    newest = F.max_by("event_type", F.struct("ts", "event_id")).alias("value")
    events = table(spark, d, "events")
    before = events.where("ts < TIMESTAMP_NTZ '2024-01-03'").groupBy("user_id").agg(newest)
    after = events.where("ts >= TIMESTAMP_NTZ '2024-01-29'").groupBy("user_id").agg(newest)
    return trends.config_changes(before, after, "user_id", "value")


@plan(
    "resource_panels",
    "T52 A6 K2",
    "",
    """SELECT user_id, count(*) AS samples, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total, max(value) AS peak, min(value) AS low
       FROM events GROUP BY 1 ORDER BY sum(CAST(value AS DECIMAL(18,2))) + count(*) DESC, user_id LIMIT 25""",
)
def resource_panels(spark: SparkSession, d: str) -> DataFrame:
    grouped = table(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("samples"),
        money_sum(F.col("value")).alias("total"),
        F.max("value").alias("peak"),
        F.min("value").alias("low"),
    )
    return grouped.orderBy((F.col("total") + F.col("samples")).desc(), "user_id").limit(25)


@plan(
    "op_progress",
    "T53",
    "",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(100.0 * CAST(CAST(l_linenumber AS BIGINT) AS DOUBLE) / CAST(l_quantity AS DOUBLE), 2) AS pct_done
       FROM lineitem WHERE l_linenumber < l_quantity""",
)
def op_progress(spark: SparkSession, d: str) -> DataFrame:
    return storage.progress(table(spark, d, "lineitem"), "l_linenumber", "l_quantity").select(
        "l_orderkey", "l_linenumber", "l_partkey", "pct_done"
    )


@plan(
    "resample_5m",
    "T54 W7",
    "",
    """SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, count(*) AS samples, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total, max(CAST(value AS DECIMAL(18,2))) AS maximum,
              CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS average FROM events GROUP BY 1, 2""",
)
def resample_5m(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "events").select("event_type", "ts", F.col("value").cast("decimal(18,2)").alias("value"))
    return trends.resample(samples, "ts", ["event_type"], "value")


@plan(
    "sliding_rates",
    "W7 X5",
    "",
    """s AS (SELECT e.*, unnest(range(0, 30)) AS k FROM events e),
       b AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - k * INTERVAL 1 MINUTE AS bucket, event_type FROM s)
       SELECT bucket, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors,
              CAST(count(*) AS DOUBLE) / 1800.0 AS per_second, CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*) AS error_ratio
       FROM b GROUP BY 1""",
)
def sliding_rates(spark: SparkSession, d: str) -> DataFrame:
    marked = table(spark, d, "events").withColumn("is_error", F.col("event_type") == "error")
    return trends.sliding_rates(marked, "ts", [], "30 minutes", "1 minute")


FORECAST_SQL = """
    p AS (SELECT user_id, CAST(CAST(ts AS DATE) - DATE '2000-01-01' AS HUGEINT) AS x, CAST(round(max(value) * 100) AS HUGEINT) AS y FROM events GROUP BY user_id, CAST(ts AS DATE)),
    s AS (SELECT user_id, CAST(count(*) AS HUGEINT) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy, CAST(max(x) AS DOUBLE) AS last
          FROM p GROUP BY 1 HAVING count(*) > 2),
    f AS (SELECT user_id, CAST(n AS DOUBLE) AS n, CAST(sx AS DOUBLE) AS sx, CAST(sy AS DOUBLE) AS sy, last, CAST(n * sxx - sx * sx AS DOUBLE) AS dx,
                 CAST(n * sxy - sx * sy AS DOUBLE) AS dxy, CAST(n * syy - sy * sy AS DOUBLE) AS dy FROM s),
    g AS (SELECT *, dxy / dx AS slope FROM f),
    h AS (SELECT user_id, unnest([30, 90, 180]) AS horizon_days, last, slope, (sy - slope * sx) / n AS b,
                 sqrt(greatest((dy - slope * dxy) / n, 0.0) / (n - 2)) AS sd FROM g),
    r AS (SELECT user_id, horizon_days, (b + slope * (last + horizon_days)) / 100.0 AS y, 2.0 * sd / 100.0 AS w FROM h)"""


@plan(
    "capacity_forecast",
    "T47",
    "",
    FORECAST_SQL
    + """ SELECT user_id, horizon_days, y AS projected, y - w AS low, y + w AS high,
                 CASE WHEN y > 75 THEN 'SCALE' WHEN y > 70 THEN 'ALERT' ELSE 'OK' END AS trigger FROM r""",
)
def capacity_forecast(spark: SparkSession, d: str) -> DataFrame:
    return trends.capacity_forecast(table(spark, d, "events"), ["user_id"], "ts", "value", 70, 75)


@plan(
    "unit_cost",
    "T48",
    "",
    """s AS (SELECT s_suppkey, s_acctbal AS spend FROM supplier), u AS (SELECT l_suppkey AS s_suppkey, count(*) AS queries FROM lineitem GROUP BY 1)
       SELECT s_suppkey, spend, queries, round(spend * 1000000.0 / CAST(queries AS DOUBLE), 4) AS unit_cost FROM s LEFT JOIN u USING (s_suppkey)""",
)
def unit_cost(spark: SparkSession, d: str) -> DataFrame:
    spend = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("spend"))
    used = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("queries"))
    return trends.unit_cost(spend, used, ["s_suppkey"], "spend", "queries", 1e6)


@plan(
    "peak_profile",
    "T49",
    "",
    """SELECT CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS samples, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM events GROUP BY 1, 2""",
)
def peak_profile(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "events").select("ts", F.col("value").cast("decimal(18,2)").alias("value"))
    return trends.peak_profile(samples, "ts", "value")


@plan(
    "principal_roles",
    "T42 J1",
    "",
    """SELECT c_custkey, c_mktsegment AS role_name, n_name AS principal_group, c_acctbal > 9000 AS high_privilege
       FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 OR c_mktsegment = 'MACHINERY'""",
)
def principal_roles(spark: SparkSession, d: str) -> DataFrame:
    high = F.col("c_acctbal") > 9000
    members = table(spark, d, "customer").where(high | (F.col("c_mktsegment") == "MACHINERY"))
    joined = members.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        "c_custkey", F.col("c_mktsegment").alias("role_name"), F.col("n_name").alias("principal_group"),
        high.alias("high_privilege"),
    )


@plan(
    "stale_statistics",
    "T43 K3",
    "",
    f"""n AS (SELECT p_partkey, max(l_shipdate) AS last FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1)
        SELECT p_partkey, last, CAST(DATE '2001-12-31' - CAST(last AS DATE) AS INTEGER) AS age_days FROM n
        WHERE last IS NULL OR DATE '2001-12-31' - CAST(last AS DATE) > 200""",
)
def stale_statistics(spark: SparkSession, d: str) -> DataFrame:
    newest = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.max("l_shipdate").alias("last")
    )
    parts = table(spark, d, "part").select("p_partkey")
    joined = parts.join(newest, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "last")
    return storage.stale(joined, "last", "2001-12-31", 200)


@plan(
    "backup_rules",
    "X12 A9",
    "",
    f"""g AS (SELECT user_id, max(ts) AS last_backup, max_by(value, ts) AS s, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS m FROM events GROUP BY 1)
        SELECT user_id, last_backup, date_sub('second', last_backup, TIMESTAMP '{AS_OF}') / 3600.0 > 25 AS backup_missing, s < m * 0.5 AS size_drop FROM g""",
)
def backup_rules(spark: SparkSession, d: str) -> DataFrame:
    return trends.backup_rules(table(spark, d, "events"), ["user_id"], "ts", "value", AS_OF)


@plan(
    "freshness",
    "X11",
    "",
    f"""n AS (SELECT event_type, max(ts) AS newest FROM events GROUP BY 1), a AS (SELECT *, date_sub('minute', newest, TIMESTAMP '{AS_OF}') AS age_minutes FROM n)
        SELECT *, CASE WHEN age_minutes > 15 THEN 'STALE' ELSE 'FRESH' END AS status FROM a""",
)
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return trends.freshness(table(spark, d, "events"), "event_type", "ts", AS_OF, 15)


@plan(
    "heartbeat_runs",
    "W3 X6",
    "",
    """m AS (SELECT *, count(*) FILTER (WHERE event_type NOT IN ('error', 'signup')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
       r AS (SELECT user_id, min(ts) AS run_start, max(ts) AS run_end, count(*) AS run_length FROM m WHERE event_type IN ('error', 'signup') GROUP BY user_id, island)
       SELECT * FROM r WHERE run_length >= 3""",
)
def heartbeat_runs(spark: SparkSession, d: str) -> DataFrame:
    return trends.failure_runs(
        table(spark, d, "events"), ["user_id"], "ts", "event_id", F.col("event_type").isin("error", "signup")
    )


@plan(
    "sustained_alert",
    "W5 X7",
    "",
    """m AS (SELECT *, count(*) FILTER (WHERE NOT value > 30) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
       r AS (SELECT user_id, min(ts) AS run_start, max(ts) AS run_end, count(*) AS run_length FROM m WHERE value > 30 GROUP BY user_id, island)
       SELECT *, date_sub('second', run_start, run_end) AS held_seconds FROM r WHERE date_sub('second', run_start, run_end) >= 7200""",
)
def sustained_alert(spark: SparkSession, d: str) -> DataFrame:
    return trends.sustained(table(spark, d, "events"), ["user_id"], "ts", "event_id", F.col("value") > 30, 7200)
