"""Job run history views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clock_diff

FAILED_STATES = ("Failed", "TimedOut")
SLA_MINUTES = 10


def history(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Runs with job name and seconds between start and end."""
    return runs.join(jobs, "job_id").withColumn(
        "duration_sec", clock_diff("SECOND", F.col("start_time"), F.col("end_time"))
    )


def latest(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Newest run per job. The rank limit prunes each task's rows before the shuffle."""
    window = Window.partitionBy("job_id").orderBy(F.desc("create_time"), F.desc("job_execution_id"))
    newest = runs.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") == 1).drop("_rn")
    return history(newest, jobs)


def running(runs: DataFrame, jobs: DataFrame, as_of: str, min_minutes: int = 0) -> DataFrame:
    """Runs in progress with the minutes since start."""
    out = runs.where(F.col("lifecycle") == "InProgress").join(jobs, "job_id")
    minutes = clock_diff("MINUTE", F.col("start_time"), F.lit(as_of).cast("timestamp_ntz"))
    return out.withColumn("running_minutes", minutes).where(F.col("running_minutes") >= min_minutes)


def failures(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    return runs.where(F.col("lifecycle").isin(*FAILED_STATES)).join(jobs, "job_id")


def failure_trend(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Failures per job and day; counted before the name is joined."""
    counted = (
        runs.where(F.col("lifecycle").isin(*FAILED_STATES))
        .groupBy("job_id", F.to_date("create_time").alias("run_date"))
        .agg(F.count("*").alias("failure_count"))
    )
    return counted.join(jobs, "job_id").select("job_name", "run_date", "failure_count")


def targets(jobs: DataFrame, steps: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Job, step, target group and member; groups or members may be missing."""
    return (
        jobs.join(steps, "job_id").join(groups, "target_group_id", "left").join(members, "target_group_id", "left")
    )


def with_targets(runs: DataFrame, jobs: DataFrame, steps: DataFrame, members: DataFrame) -> DataFrame:
    """Every run fanned out to its steps' targets."""
    return (
        runs.join(jobs, "job_id").join(steps, "job_id", "left").join(members, "target_group_id", "left")
    )


def fan_out_counts(runs: DataFrame, jobs: DataFrame, steps: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``with_targets`` per job name, ``by`` and step, without fanning out.

    Runs are counted per job, targets per step, and the counts multiplied.
    """
    counted = runs.groupBy("job_id", *by).agg(F.count("*").alias("_runs"))
    per_group = members.groupBy("target_group_id").agg(F.count("*").alias("_targets"))
    targets = steps.join(per_group, "target_group_id", "left").groupBy("job_id", "step_name").agg(
        F.sum(F.coalesce("_targets", F.lit(1))).alias("_rows"),
        F.sum(F.coalesce("_targets", F.lit(0))).alias("_held"),
    )
    joined = counted.join(jobs, "job_id").join(targets, "job_id", "left")
    return joined.select(
        "job_name",
        *by,
        "step_name",
        (F.col("_runs") * F.coalesce("_rows", F.lit(1))).alias("fanned_out"),
        (F.col("_runs") * F.coalesce("_held", F.lit(0))).alias("with_target"),
    )


def expanded(runs: DataFrame, jobs: DataFrame, steps: DataFrame, members: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct (run, target): the target side is made distinct per job before runs fan out."""
    per_job = steps.join(members, "target_group_id", "left").select("job_id", *columns).distinct()
    return runs.distinct().join(jobs, "job_id").join(per_job, "job_id", "left")


def sla_breaches(runs: DataFrame, jobs: DataFrame, minutes: int = SLA_MINUTES) -> DataFrame:
    out = runs.where(F.col("lifecycle") == "Succeeded").join(jobs, "job_id")
    duration = clock_diff("MINUTE", F.col("start_time"), F.col("end_time"))
    return out.withColumn("duration_min", duration).where(F.col("duration_min") > minutes)


def retries(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    counted = runs.groupBy("job_id").agg(
        F.count("*").alias("total_runs"),
        F.count_if(F.col("current_attempts") > 1).alias("retried_runs"),
        F.max("current_attempts").alias("max_attempts_seen"),
    )
    return counted.join(jobs, "job_id").drop("job_id")


def success_rate(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    counted = runs.groupBy("job_id").agg(
        F.count("*").alias("total_runs"), F.count_if(F.col("lifecycle") == "Succeeded").alias("success_runs")
    )
    rate = (F.lit(100) * F.col("success_runs") / F.col("total_runs")).cast("decimal(5,2)")
    return counted.withColumn("success_rate_pct", rate).join(jobs, "job_id").drop("job_id")
