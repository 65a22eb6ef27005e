"""Job history queries; runs are derived from ``orders``, targets from ``nation`` and ``region``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from tidemark.operators.telemetry import jobs
from tidemark.plans.fixtures import job_names, job_runs, table
from tidemark.plans.registry import plan

AS_OF = "2001-12-31 00:00:00"

# Steps: every nation is a step of job 1 + key % 5; its region is the target group, whose members are suppliers.
TARGET_SQL = """
    steps AS (SELECT CAST(1 + n_nationkey % 5 AS INTEGER) AS job_id, n_nationkey AS step_id, n_name AS step_name, n_regionkey AS target_group_id FROM nation),
    grp AS (SELECT r_regionkey AS target_group_id, r_name AS target_group_name FROM region WHERE r_name <> 'EUROPE'),
    members AS (SELECT CAST(s_suppkey % 4 AS INTEGER) AS target_group_id, s_name AS server_name, s_nationkey AS database_id FROM supplier)"""


def _targets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    steps = table(spark, d, "nation").selectExpr(
        "CAST(1 + n_nationkey % 5 AS INTEGER) AS job_id",
        "n_nationkey AS step_id",
        "n_name AS step_name",
        "n_regionkey AS target_group_id",
    )
    groups = table(spark, d, "region").where("r_name <> 'EUROPE'").selectExpr(
        "r_regionkey AS target_group_id", "r_name AS target_group_name"
    )
    members = table(spark, d, "supplier").selectExpr(
        "CAST(s_suppkey % 4 AS INTEGER) AS target_group_id", "s_name AS server_name", "s_nationkey AS database_id"
    )
    return steps, groups, members


@plan(
    "job_history",
    "T32 J1 F8",
    "job_runs job_names",
    """SELECT job_id, job_name, job_execution_id, lifecycle, current_attempts, create_time, start_time, end_time,
              datediff('second', start_time, end_time) AS duration_sec FROM job_runs JOIN job_names USING (job_id)""",
)
def job_history(spark: SparkSession, d: str) -> DataFrame:
    return jobs.history(job_runs(spark, d), job_names(spark, d)).drop("seconds_run")


@plan(
    "job_latest",
    "T33 W1",
    "job_runs job_names",
    """l AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY create_time DESC, job_execution_id DESC) AS rn FROM job_runs)
       SELECT job_id, job_name, job_execution_id, lifecycle, start_time, end_time, datediff('second', start_time, end_time) AS duration_sec
       FROM l JOIN job_names USING (job_id) WHERE rn = 1""",
)
def job_latest(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest(job_runs(spark, d), job_names(spark, d)).drop("seconds_run", "current_attempts", "create_time")


@plan(
    "job_running",
    "T34 F8",
    "job_runs job_names",
    f"""SELECT job_name, job_execution_id, start_time, datediff('minute', start_time, TIMESTAMP '{AS_OF}') AS running_minutes
        FROM job_runs JOIN job_names USING (job_id)
        WHERE lifecycle = 'InProgress' AND datediff('minute', start_time, TIMESTAMP '{AS_OF}') >= 1000000""",
)
def job_running(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.running(job_runs(spark, d), job_names(spark, d), AS_OF, min_minutes=1_000_000)
    return out.select("job_name", "job_execution_id", "start_time", "running_minutes")


@plan(
    "job_failures",
    "T35 P5",
    "job_runs job_names",
    """SELECT job_name, job_execution_id, start_time, end_time FROM job_runs JOIN job_names USING (job_id)
       WHERE lifecycle IN ('Failed', 'TimedOut')""",
)
def job_failures(spark: SparkSession, d: str) -> DataFrame:
    return jobs.failures(job_runs(spark, d), job_names(spark, d)).select(
        "job_name", "job_execution_id", "start_time", "end_time"
    )


@plan(
    "job_failure_trend",
    "T35 F9",
    "job_runs job_names",
    """SELECT job_name, CAST(create_time AS DATE) AS run_date, count(*) AS failure_count
       FROM job_runs JOIN job_names USING (job_id) WHERE lifecycle IN ('Failed', 'TimedOut') GROUP BY 1, 2""",
)
def job_failure_trend(spark: SparkSession, d: str) -> DataFrame:
    return jobs.failure_trend(job_runs(spark, d), job_names(spark, d))


@plan(
    "job_targets",
    "T36 J2",
    "job_names",
    TARGET_SQL
    + """ SELECT job_id, job_name, step_id, step_name, target_group_id, target_group_name, server_name, database_id
          FROM job_names JOIN steps USING (job_id) LEFT JOIN grp USING (target_group_id) LEFT JOIN members USING (target_group_id)""",
)
def job_targets(spark: SparkSession, d: str) -> DataFrame:
    steps, groups, members = _targets(spark, d)
    return jobs.targets(job_names(spark, d), steps, groups, members)


@plan(
    "job_target_runs",
    "T36 J2",
    "job_runs job_names",
    TARGET_SQL
    + """ SELECT job_name, lifecycle, step_name, count(*) AS fanned_out, count(server_name) AS with_target
          FROM job_runs JOIN job_names USING (job_id) LEFT JOIN steps USING (job_id) LEFT JOIN members USING (target_group_id) GROUP BY 1, 2, 3""",
)
def job_target_runs(spark: SparkSession, d: str) -> DataFrame:
    steps, _, members = _targets(spark, d)
    return jobs.fan_out_counts(job_runs(spark, d), job_names(spark, d), steps, members, ["lifecycle"])


@plan(
    "job_target_distinct",
    "T36 J3 U4",
    "job_runs job_names",
    TARGET_SQL
    + """ SELECT DISTINCT job_name, job_execution_id, lifecycle, start_time, end_time, database_id
          FROM job_runs JOIN job_names USING (job_id) LEFT JOIN steps USING (job_id) LEFT JOIN members USING (target_group_id)""",
)
def job_target_distinct(spark: SparkSession, d: str) -> DataFrame:
    steps, _, members = _targets(spark, d)
    out = jobs.expanded(job_runs(spark, d), job_names(spark, d), steps, members, ["database_id"])
    return out.select("job_name", "job_execution_id", "lifecycle", "start_time", "end_time", "database_id")


@plan(
    "job_sla",
    "T37 F8",
    "job_runs job_names",
    """SELECT job_name, job_execution_id, start_time, end_time, datediff('minute', start_time, end_time) AS duration_min
       FROM job_runs JOIN job_names USING (job_id) WHERE lifecycle = 'Succeeded' AND datediff('minute', start_time, end_time) > 10""",
)
def job_sla(spark: SparkSession, d: str) -> DataFrame:
    return jobs.sla_breaches(job_runs(spark, d), job_names(spark, d)).select(
        "job_name", "job_execution_id", "start_time", "end_time", "duration_min"
    )


@plan(
    "job_retry",
    "T38 A3 A7",
    "job_runs job_names",
    """SELECT job_name, count(*) AS total_runs, count(*) FILTER (WHERE current_attempts > 1) AS retried_runs,
              max(current_attempts) AS max_attempts_seen FROM job_runs JOIN job_names USING (job_id) GROUP BY 1""",
)
def job_retry(spark: SparkSession, d: str) -> DataFrame:
    return jobs.retries(job_runs(spark, d), job_names(spark, d))


@plan(
    "job_success_rate",
    "T39 A3",
    "job_runs job_names",
    """SELECT job_name, count(*) AS total_runs, count(*) FILTER (WHERE lifecycle = 'Succeeded') AS success_runs,
              CAST(round(100.0 * count(*) FILTER (WHERE lifecycle = 'Succeeded') / count(*), 2) AS DECIMAL(5,2)) AS success_rate_pct
       FROM job_runs JOIN job_names USING (job_id) GROUP BY 1""",
)
def job_success_rate(spark: SparkSession, d: str) -> DataFrame:
    return jobs.success_rate(job_runs(spark, d), job_names(spark, d))
