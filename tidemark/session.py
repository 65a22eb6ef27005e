"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, skew-join handling and a UTC clock."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: on a
    cluster a machine-local folder would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        root = context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="tidemark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, below the shared folder."""
    return os.path.join(checkpoint_root(spark), "tables", f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    This cuts the lineage, survives lost executors and, unlike a checkpoint,
    gives the optimizer the true size of the result for its join choice.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def inline_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of configuration rows whose size Catalyst can estimate.

    ``schema`` is a DDL string. The rows are literals in the plan, so the
    optimizer sees the size and picks the join strategy itself.
    """
    names = [part.strip().split()[0] for part in schema.split(",")]
    types = [part.strip().split(None, 1)[1] for part in schema.split(",")]

    def struct(row: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(t.replace(";", ",")).alias(n) for v, n, t in zip(row, names, types)])

    return spark.range(1).select(F.inline(F.array(*[struct(r) for r in rows])))
