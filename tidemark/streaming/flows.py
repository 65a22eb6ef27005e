"""Structured Streaming flows: change apply, windowed rates, heartbeats, dead letters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.scalars import ratio_or_null
from tidemark.operators.ordered import runs
from tidemark.sources.readers import parse_lines, split_corrupt, to_line
from tidemark.streaming.store import ChangeStore


def line_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Landed JSON-lines files as a stream of text lines."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def start_batches(
    stream: DataFrame,
    step: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Run ``step`` per micro-batch: all available input, or polling when ``every`` is given.

    Restarting with the same checkpoint resumes; a new checkpoint folder restarts.
    """
    writer = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    start_batches(stream, step, checkpoint, mode).awaitTermination()


def apply_changes(
    store: ChangeStore,
    required: list[str],
    known_ops: tuple[str, ...] = ("I", "U", "D"),
    start: str | None = None,
    dedupe_on: list[str] | None = None,
) -> Callable[[DataFrame, int], None]:
    """Batch step: valid changes to the log, the rest to the dead-letter table with a reason.

    ``start`` is a SQL condition on the rows to take, for a restart from a position.
    Changes that agree in ``dedupe_on`` are stored once, within and across batches.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_lines(batch, store.log_schema).persist()
        rows, malformed = split_corrupt(parsed)
        missing = F.lit(False)
        for name in required:
            missing = missing | F.col(name).isNull()
        reason = F.when(missing, "MISSING FIELD").when(~F.col("op").isin(*known_ops), "UNKNOWN OPERATION")
        judged = rows.withColumn("_reason", reason)
        invalid = judged.where(F.col("_reason").isNotNull()).select(
            to_line(*rows.columns).alias("line"), F.col("_reason").alias("reason")
        )
        valid = judged.where(F.col("_reason").isNull()).drop("_reason")
        if start:
            valid = valid.where(start)
        if dedupe_on:
            valid = store.not_seen(valid, dedupe_on, batch_id)
        store.append(valid, batch_id)
        store.append_dead(malformed.unionByName(invalid), batch_id)
        store.record_positions(batch_id)
        parsed.unpersist()

    return step


def windowed_rates(
    stream: DataFrame, ts: str, by: list[str], late: str, width: str = "5 minutes", slide: str | None = None
) -> DataFrame:
    """Events and errors per window; rows later than ``late`` behind the newest event are dropped.

    ``is_error`` marks errors. Watermarks need an instant, so ``ts`` is read in
    the session time zone and buckets are given back without one.
    """
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = (
        stream.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, late)
        .groupBy(*by, window.alias("_w"))
        .agg(F.count("*").alias("events"), F.count_if(F.col("is_error")).alias("errors"))
    )
    return counted.select(
        *by, F.col("_w.start").cast("timestamp_ntz").alias("bucket"), "events", "errors", ratio_or_null(F.col("errors"), F.col("events")).alias("error_ratio")
    )


def upsert_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Batch step that keeps the updates of every batch in a folder of its own."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))

    return step


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest update per key of an ``upsert_sink`` folder."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*values), "batch_id")
    return rows.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*")


def heartbeat_step(
    spark: SparkSession, root: str, key: str, ts: str, tie: str, failed: str, threshold: int = 3, **options
) -> Callable[[DataFrame, int], None]:
    """Batch step that follows runs of consecutive failures per target across batches.

    State is one row per target with an open run: its start and length so far.
    A batch's runs are found by the chunked scan, so a target with a third of
    the rows is not one task's work. The run that opens a batch continues the
    open run of the batch before.
    """
    state_schema = f"{key} bigint, open_start timestamp_ntz, open_length bigint"

    def state(batch_id: int) -> DataFrame:
        try:
            return spark.read.schema(state_schema).parquet(os.path.join(root, "state", f"batch_id={batch_id}"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], state_schema)

    def step(batch: DataFrame, batch_id: int) -> None:
        before = state(batch_id - 1).select(F.col(key).alias("_k"), "open_start", "open_length")
        found = runs(batch, [key], [ts, tie], F.expr(failed), bounds=True, **options)
        seen = batch.groupBy(key).agg(F.min(F.struct(ts, tie)).alias("_first"), F.max(F.struct(ts, tie)).alias("_last"))
        bounds = seen.join(before, F.col(key) == F.col("_k"), "full").select(
            F.coalesce(F.col(key), F.col("_k")).alias("_target"), "_first", "_last", "open_start", "open_length"
        )
        joined = found.join(bounds, F.col(key) == F.col("_target"))
        continues = F.col("open_length").isNotNull() & (F.col("first_row") == F.col("_first"))
        merged = joined.select(
            key,
            F.when(continues, F.col("open_start")).otherwise(F.col("run_start")).alias("run_start"),
            "run_end",
            (F.col("run_length") + F.when(continues, F.col("open_length")).otherwise(0)).alias("run_length"),
            (F.col("last_row") == F.col("_last")).alias("_open"),
        )
        merged.where(F.col("run_length") >= threshold).drop("_open").write.mode("overwrite").parquet(
            os.path.join(root, "runs", f"batch_id={batch_id}")
        )
        still_open = merged.where("_open").select(
            key, F.col("run_start").alias("open_start"), F.col("run_length").alias("open_length")
        )
        untouched = bounds.where(F.col("_first").isNull() & F.col("open_length").isNotNull()).select(
            F.col("_target").alias(key), "open_start", "open_length"
        )
        still_open.unionByName(untouched).write.mode("overwrite").parquet(os.path.join(root, "state", f"batch_id={batch_id}"))

    return step
