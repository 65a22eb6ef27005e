"""Inputs derived from the given tables, by the same expressions in Spark and in the oracle.

The drifted copy of ``orders`` has faults injected by key arithmetic; every
derivation covers its whole input table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize

AS_OF = "2024-01-31 00:00:00"
WINDOW_START = "1997-01-01 00:00:00"
WINDOW_END = "1998-01-01 00:00:00"
RUN_TS = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Expressions valid in both engines.
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
COMPARED = ORDER_COLUMNS[1:]

CHANGE_EXPRS = [
    "user_id AS id",
    "ts",
    "event_id",
    "CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op",
    "CAST(value AS DECIMAL(18,2)) AS amount",
    "event_type AS status",
]

JOB_EXPRS = [
    "o_orderkey AS job_execution_id",
    "CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS job_id",
    "CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'InProgress' ELSE 'Succeeded' END AS lifecycle",
    "CAST(1 + o_orderkey % 3 AS BIGINT) AS current_attempts",
    "o_orderdate AS create_time",
    "o_orderdate + INTERVAL 30 SECOND AS start_time",
    "CAST(floor(o_totalprice / 100) AS BIGINT) AS seconds_run",
]

SESSION_EXPRS = [
    "event_id AS session_id",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id - 1 END AS blocker_id",
    "CAST(value AS DECIMAL(18,2)) AS wait_ms",
    "ts",
    "user_id",
    "event_type",
]

# The same ids on three hosts and in every snapshot: blockers are meant within host and snapshot.
FLEET_EXPRS = [
    "CAST(event_id // 200 % 3 AS INTEGER) AS host",
    "event_id // 600 AS captured_at",
    "event_id % 200 AS session_id",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 200 - 1 END AS blocker_id",
    "CAST(value AS DECIMAL(18,2)) AS wait_ms",
    "event_type",
]
FLEET_SCOPE = ["host", "captured_at"]

# Sessions with no, one or several blockers, some of which wait for each other.
WAIT_GRAPH_EXPRS = [
    "host",
    "captured_at",
    "session_id",
    "CASE WHEN session_id % 50 = 31 THEN {list}(session_id + 1) WHEN session_id % 50 = 32 THEN {list}(session_id - 1) "
    "WHEN session_id % 9 = 0 THEN {none} WHEN session_id % 20 = 7 THEN {list}(session_id + 2, session_id - 1) "
    "WHEN session_id % 4 = 1 THEN {list}(session_id - 1, session_id - 6) ELSE {list}(session_id - 1) END AS blockers",
]

WAIT_EXPRS = [
    "event_id",
    "ts",
    "user_id AS host",
    "CASE event_type WHEN 'signup' THEN 'LCK_M_X' WHEN 'purchase' THEN 'WRITELOG' WHEN 'click' THEN 'PAGEIOLATCH_SH' "
    "WHEN 'error' THEN 'CXPACKET' ELSE 'SLEEP_TASK' END AS wait_type",
    "CAST(value AS DECIMAL(18,2)) AS wait_ms",
]

LOCK_EXPRS = [
    "event_id",
    "user_id AS pid",
    "CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS lock_mode",
    "CAST(ts AS DATE) AS lock_day",
    "event_type IN ('purchase', 'signup') AS granted",
    "ts",
]

FIXTURE_SQL = {
    "target_orders": """
        SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 101 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
               o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 0
        UNION ALL
        SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
        FROM orders WHERE o_orderkey % 499 = 0""",
    "change_log": f"SELECT {', '.join(CHANGE_EXPRS)} FROM events",
    "seed": """
        SELECT user_id AS id, CAST(max(value) AS DECIMAL(18,2)) AS amount, min(event_type) AS status
        FROM events GROUP BY user_id HAVING min(ts) < TIMESTAMP '2024-01-05 00:00:00'""",
    "job_runs": f"""
        SELECT *, CASE WHEN lifecycle = 'InProgress' THEN NULL
                       ELSE start_time + to_seconds(seconds_run) END AS end_time
        FROM (SELECT {', '.join(JOB_EXPRS)} FROM orders)""",
    "job_names": """
        SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS job_id, o_orderpriority AS job_name FROM orders""",
    "sessions": f"SELECT {', '.join(SESSION_EXPRS)} FROM events",
    "fleet": f"SELECT {', '.join(FLEET_EXPRS)} FROM events",
    "wait_graph": f"SELECT {', '.join(WAIT_GRAPH_EXPRS)} FROM fleet".format(list="list_value", none="CAST([] AS BIGINT[])"),
    "waits": f"SELECT {', '.join(WAIT_EXPRS)} FROM events",
    "locks": f"SELECT {', '.join(LOCK_EXPRS)} FROM events",
}


def target_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drifted copy: keys missing (97), status changed (101), keys extra (499, negative, so that they meet no real key)."""
    orders = table(spark, sf_dir, "orders")
    kept = orders.where("o_orderkey % 97 <> 0").withColumn(
        "o_orderstatus", F.when(F.expr("o_orderkey % 101 = 0"), "X").otherwise(F.col("o_orderstatus"))
    )
    extra = orders.where("o_orderkey % 499 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    return kept.unionByName(extra)


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered changes per user; position is (ts, event_id)."""
    return table(spark, sf_dir, "events").selectExpr(*CHANGE_EXPRS).withColumn("seq", F.struct("ts", "event_id"))


def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the target before the log: users seen in the first four days."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("id"))
        .agg(F.max("value").cast("decimal(18,2)").alias("amount"), F.min("event_type").alias("status"), F.min("ts").alias("_first"))
        .where("_first < TIMESTAMP_NTZ '2024-01-05 00:00:00'")
        .drop("_first")
    )


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").selectExpr(*JOB_EXPRS)
    return runs.withColumn(
        "end_time",
        F.when(F.col("lifecycle") != "InProgress", F.expr("start_time + make_dt_interval(0, 0, 0, seconds_run)")),
    )


def job_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job dimension as a table of its own, so its size is known to the joins."""
    orders = table(spark, sf_dir, "orders")
    names = orders.selectExpr(
        "CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS job_id", "o_orderpriority AS job_name"
    ).distinct()
    return materialize(names, "job_names")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a session; each waits for its neighbour but every fifth, which waits for none."""
    return table(spark, sf_dir, "events").selectExpr(*SESSION_EXPRS)


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of three hosts over many snapshots, with ids that repeat from one to the next."""
    return table(spark, sf_dir, "events").selectExpr(*[e.replace("//", "DIV") for e in FLEET_EXPRS])


def wait_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet(spark, sf_dir).selectExpr(*[e.format(list="array", none="cast(array() AS array<bigint>)") for e in WAIT_GRAPH_EXPRS])


def waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*WAIT_EXPRS)


def locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*LOCK_EXPRS)
