"""Most frequent items of a stream, from a summary of fixed size that every micro-batch carries on."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Items that a summary tracks. Counts of items are off by at most about 4 / TRACKED of all rows, not at all below that many items.
TRACKED = 10_000


def _state(spark: SparkSession, root: str, batch_id: int) -> DataFrame | None:
    try:
        return spark.read.parquet(os.path.join(root, f"batch_id={batch_id}"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def top_items_step(root: str, item: str, scope: str | None = None, tracked: int = TRACKED) -> Callable[[DataFrame, int], None]:
    """Batch step: summary of all batches so far, per ``scope`` if one is named, as the state of this batch.

    Tasks summarise what they read and summaries are combined, so an item with most of the rows costs
    nothing extra. A batch reads the state of the batch before, never older ones, and overwrites its own
    when it is run again. Null items are not counted.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        named = F.lit("") if scope is None else F.coalesce(F.col(scope).cast("string"), F.lit(""))
        rows = batch.where(F.col(item).isNotNull()).select(named.alias("scope"), F.col(item).cast("string").alias("item"))
        made = rows.groupBy("scope").agg(F.expr(f"approx_top_k_accumulate(item, {tracked})").alias("summary"), F.count("*").alias("rows"))
        before = _state(batch.sparkSession, root, batch_id - 1)
        both = made if before is None else made.unionByName(before.select(*made.columns))
        state = both.groupBy("scope").agg(F.expr(f"approx_top_k_combine(summary, {tracked})").alias("summary"), F.sum("rows").alias("rows"))
        state.write.mode("overwrite").parquet(os.path.join(root, f"batch_id={batch_id}"))

    return step


def top_items(spark: SparkSession, root: str, batch_id: int, k: int = 10) -> DataFrame:
    """Rows (scope, item, count, rows): the ``k`` most frequent items per scope as of a batch; ``rows`` are all rows of the scope."""
    state = _state(spark, root, batch_id)
    if state is None:
        raise ValueError(f"no state of batch {batch_id}")
    listed = state.select("scope", "rows", F.explode(F.expr(f"approx_top_k_estimate(summary, {k})")).alias("e"))
    return listed.select("scope", F.col("e.item").alias("item"), F.col("e.count").alias("count"), "rows")
