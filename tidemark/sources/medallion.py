"""Raw, typed and aggregated layers of a sales flow."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALES_SCHEMA = "order_id bigint, order_date date, region string, product string, quantity bigint, price decimal(10,2)"


def bronze(df: DataFrame) -> DataFrame:
    """Raw copy: every value as text."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def silver(raw: DataFrame) -> DataFrame:
    """Typed rows; values that do not fit become null and are counted by ``misfits``."""
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(SALES_SCHEMA)])


def misfits(raw: DataFrame) -> DataFrame:
    """Values per column that are set but do not fit its type, in one pass."""
    fields = T.StructType.fromDDL(SALES_SCHEMA).fields
    lost = [F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name) for f in fields]
    return raw.agg(*lost).unpivot([], [f.name for f in fields], "column_name", "misfits")


def daily_revenue(sales: DataFrame) -> DataFrame:
    """Revenue by day and region. Rows without a key are left out; a group of nulls sums to zero."""
    revenue = (F.col("quantity") * F.col("price")).cast("decimal(38,2)")
    zero = F.lit(0).cast("decimal(38,2)")
    return (
        sales.where(F.col("order_date").isNotNull() & F.col("region").isNotNull())
        .groupBy("order_date", "region")
        .agg(F.coalesce(F.sum(revenue), zero).cast("decimal(38,2)").alias("revenue"))
    )


def run_flow(spark: SparkSession, source: DataFrame, root: str) -> DataFrame:
    """Each layer is a written table, and the next layer reads it back; values lost by typing are counted in ``misfits``."""
    paths = {layer: os.path.join(root, layer) for layer in ("bronze", "misfits", "silver", "gold")}
    bronze(source).write.mode("overwrite").parquet(paths["bronze"])
    misfits(spark.read.parquet(paths["bronze"])).write.mode("overwrite").parquet(paths["misfits"])
    silver(spark.read.parquet(paths["bronze"])).write.mode("overwrite").parquet(paths["silver"])
    daily_revenue(spark.read.parquet(paths["silver"])).write.mode("overwrite").parquet(paths["gold"])
    return spark.read.parquet(paths["gold"])
