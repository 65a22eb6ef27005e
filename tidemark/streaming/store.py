"""Log-structured target of a change stream.

Every micro-batch writes its valid changes, malformed lines and positions below
``batch_id=N`` and overwrites that directory when the batch is replayed, so a
retried batch changes nothing. The current state folds the changes over the
newest base version. ``compact`` writes a new base and then one manifest row;
a base without a manifest row is ignored. A base keeps the last change of every
key with its position, deletes included, so a change that arrives late can
never undo a newer one. Work per batch grows with the batch, not with the target.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import cdc


@dataclass(frozen=True)
class ChangeStore:
    """State of one table below ``root``. ``schema`` and ``log_schema`` are DDL strings."""

    spark: SparkSession
    root: str
    keys: tuple[str, ...]
    schema: str
    log_schema: str

    def _path(self, name: str, batch_id: int | None = None) -> str:
        path = os.path.join(self.root, name)
        return path if batch_id is None else os.path.join(path, f"batch_id={batch_id}")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, batch_id bigint").parquet(self._path(name))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, batch_id bigint")

    def seed(self, df: DataFrame) -> None:
        """Write the first base version, before any batch; its rows precede every position."""
        kind = self._log_type("seq")
        lowest = F.from_json(F.lit("{}"), kind)
        self._publish(df.withColumn("op", F.lit("I")).withColumn("seq", lowest).select(*self._log_names()), -1)

    def _log_names(self) -> list[str]:
        return T.StructType.fromDDL(self.log_schema).names

    def _log_type(self, name: str) -> T.DataType:
        return T.StructType.fromDDL(self.log_schema)[name].dataType

    def append(self, changes: DataFrame, batch_id: int) -> None:
        changes.write.mode("overwrite").parquet(self._path("changes", batch_id))

    def not_seen(self, changes: DataFrame, on: list[str], batch_id: int) -> DataFrame:
        """``changes`` without those whose ``on`` an earlier batch has stored, and each of the others once.

        Changes after the newest stored position are new. Only the others, late
        or delivered again, are looked up among the stored changes from their
        first position on, so a batch that comes in order reads no history.
        """
        kind = self._log_type("seq")
        changes = changes.dropDuplicates(on)
        positions = self._read("positions", f"last_seq {kind.simpleString()}, rows_applied bigint")
        newest = positions.where(F.col("batch_id") < batch_id).agg(F.max("last_seq").alias("last")).first()["last"]
        if newest is None:
            return changes
        last = F.struct(*[F.lit(newest[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])
        old = changes.where(F.col("seq") <= last)
        first = old.agg(F.min("seq").alias("first")).first()["first"]
        if first is None:
            return changes
        from_first = F.struct(*[F.lit(first[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])
        stored = self._read("changes", self.log_schema).where((F.col("batch_id") < batch_id) & (F.col("seq") >= from_first))
        again = stored.select(*[F.col(c).alias(f"_s_{c}") for c in on])
        same = F.lit(True)
        for c in on:
            same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
        return changes.where(F.coalesce(F.col("seq") > last, F.lit(True))).unionByName(old.join(again, same, "left_anti"))

    def append_dead(self, dead: DataFrame, batch_id: int) -> None:
        dead.write.mode("overwrite").parquet(self._path("dead", batch_id))

    def record_positions(self, batch_id: int) -> None:
        """Newest position and rows of a batch; one row, written after its changes."""
        batch = self.spark.read.schema(self.log_schema).parquet(self._path("changes", batch_id))
        batch.agg(F.max("seq").alias("last_seq"), F.count("*").alias("rows_applied")).write.mode("overwrite").parquet(
            self._path("positions", batch_id)
        )

    def changes(self) -> DataFrame:
        return self._read("changes", self.log_schema)

    def dead(self) -> DataFrame:
        return self._read("dead", "line string, reason string")

    def checkpoint(self) -> DataFrame:
        """Greatest position and total rows over all batches."""
        positions = self.spark.read.parquet(self._path("positions"))
        return positions.agg(F.max("last_seq").alias("last_seq"), F.sum("rows_applied").alias("rows_applied"))

    def base_batch(self) -> int:
        """Batch id folded into the newest published base; -2 when there is none."""
        newest = self._read("manifest", "upto bigint").agg(F.max("upto")).first()[0]
        return -2 if newest is None else newest

    def base(self) -> DataFrame:
        """Last change per key of the newest published base."""
        newest = self.base_batch()
        if newest == -2:
            return self.spark.createDataFrame([], self.log_schema)
        return self.spark.read.schema(self.log_schema).parquet(self._path("base", newest))

    def _folded(self, upto: int | None = None) -> DataFrame:
        later = self.changes().where(F.col("batch_id") > self.base_batch())
        if upto is not None:
            later = later.where(F.col("batch_id") <= upto)
        both = self.base().unionByName(later.drop("batch_id"))
        values = [c for c in self._log_names() if c not in (*self.keys, "op", "seq")]
        return cdc.net_changes(both, list(self.keys), values).select(*self._log_names())

    def current(self) -> DataFrame:
        """Base and all later changes folded by position; order of arrival does not matter."""
        names = T.StructType.fromDDL(self.schema).names
        return self._folded().where(F.col("op") != "D").select(*names)

    def compact(self, upto: int, forget: str | None = None) -> None:
        """Fold batches up to ``upto`` into a new base.

        ``forget`` is a SQL condition on ``seq``: deletes that meet it are
        dropped for good. Let it name positions that no late change can precede.
        """
        net = self._folded(upto)
        if forget:
            net = net.where(~((F.col("op") == "D") & F.coalesce(F.expr(forget), F.lit(False))))
        self._publish(net, upto)

    def _publish(self, df: DataFrame, upto: int) -> None:
        df.write.mode("overwrite").parquet(self._path("base", upto))
        self.spark.range(1).select(F.lit(upto).cast("bigint").alias("upto")).write.mode("overwrite").parquet(
            self._path("manifest", upto)
        )
