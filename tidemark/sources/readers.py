"""Scans with explicit or frozen schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"

# JSON text of timestamps, to the microsecond (the default keeps milliseconds only).
JSON_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def csv_schema(spark: SparkSession, path: str) -> T.StructType:
    """Schema inferred from the whole table, in one distributed pass."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path).schema


def read_csv_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed columns plus ``_corrupt``: the line of a row that does not fit the schema, else null."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return spark.read.schema(full).options(**options).csv(path)


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def to_line(*columns: str) -> Column:
    """Columns as one JSON line, timestamps to the microsecond."""
    return F.to_json(F.struct(*columns), JSON_TIMES)


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Text lines (column ``value``) to typed columns plus ``_corrupt``; blank lines are left out.

    Works on batch and streaming input alike.
    """
    full = T.StructType.fromDDL(f"{schema}, {CORRUPT} string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **JSON_TIMES}
    parsed = F.from_json("value", full, options)
    return lines.where(F.length(F.trim("value")) > 0).select(parsed.alias("_p")).select("_p.*")


def read_change_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines to (valid rows, malformed lines)."""
    return split_corrupt(parse_lines(spark.read.text(path), schema))


def split_corrupt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    valid = rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    dead = rows.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), F.lit("MALFORMED").alias("reason"))
    return valid, dead


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Text reports, one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("report_id"), F.col("value").alias("text")
    )


def generate_rows(spark: SparkSession, rows: int) -> DataFrame:
    """Row generator: ids from zero, spread over the cluster."""
    return spark.range(rows)
