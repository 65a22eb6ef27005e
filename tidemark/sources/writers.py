"""Sinks: tables, change logs, reports, partitioned snapshots with retention, bulk conversion."""

from __future__ import annotations

import os
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import hex_text, iso_text
from tidemark.sources.readers import CORRUPT, csv_schema, read_csv_lines

CODECS = ("snappy", "gzip", "zstd", "none")
RETENTION_DAYS = 7


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def replace_table(df: DataFrame, path: str | None = None, url: str | None = None, table: str | None = None) -> None:
    """Replace a table: a parquet path, or a database table over JDBC."""
    if url:
        df.write.mode("overwrite").jdbc(url, table)
    else:
        df.write.mode("overwrite").parquet(path)


def json_ready(df: DataFrame) -> DataFrame:
    """Binary columns as lower-case hex, timestamps as ISO text."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BinaryType):
            out.append(hex_text(F.col(f.name)).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(iso_text(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def append_changes(df: DataFrame, path: str) -> None:
    json_ready(df).write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A reconciliation report twice: JSON with the delta map, CSV with the map as JSON text."""
    df.write.mode("overwrite").json(os.path.join(path, "json"))
    write_csv(df.withColumn("deltas", F.to_json("deltas")), os.path.join(path, "csv"))


def append_snapshot(df: DataFrame, path: str, captured_at: str) -> None:
    """Append a telemetry snapshot, one directory per capture day."""
    day = F.col(captured_at).cast("date")
    dated = df.withColumn("captured_date", day).hint("rebalance", "captured_date")
    dated.write.mode("append").partitionBy("captured_date").parquet(path)


def expire_snapshots(spark: SparkSession, path: str, as_of: str, days: int = RETENTION_DAYS) -> list[str]:
    """Drop snapshot days older than the retention. Only directories are touched, no data is rewritten."""
    cutoff = spark.range(1).select(F.date_sub(F.lit(as_of).cast("date"), days).cast("string")).first()[0]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dropped = []
    for status in files.globStatus(hadoop.Path(root, "captured_date=*")):
        day = status.getPath().getName().split("=", 1)[1]
        if day < cutoff:
            files.delete(status.getPath(), True)
            dropped.append(day)
    return sorted(dropped)


def write_by_month(df: DataFrame, path: str, date_column: str) -> None:
    """Partition by month. Rows are rebalanced by month first: small months share a task, a large one is split."""
    dated = df.withColumn("order_month", F.date_format(date_column, "yyyy-MM"))
    dated.hint("rebalance", "order_month").write.mode("overwrite").partitionBy("order_month").parquet(path)


@dataclass(frozen=True)
class Conversion:
    """Rows written, rows that did not fit, and where those went (None if there were none)."""

    rows: int
    rejected: int
    rejected_path: str | None


def convert_csv(
    spark: SparkSession,
    csv_path: str,
    out_path: str,
    schema: str | T.StructType | None = None,
    compression: str = "snappy",
    rows_per_file: int = 5_000_000,
) -> Conversion:
    """One CSV table to parquet, with the given schema or one that fits all its rows; counts are observed while writing.

    Lines that do not fit are written to ``<out_path>_rejected``, whole and with what could be read of them, so no value is lost.
    """
    if compression not in CODECS:
        raise ValueError(f"compression must be one of {CODECS}")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    lines = read_csv_lines(spark, csv_path, schema or csv_schema(spark, csv_path))
    fits = F.col(CORRUPT).isNull()
    seen = Observation()
    df = lines.observe(seen, F.count_if(fits).alias("rows"), F.count_if(~fits).alias("rejected")).where(fits).drop(CORRUPT)
    df.write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", rows_per_file).parquet(out_path)
    rejected_path = None
    if seen.get["rejected"]:
        rejected_path = out_path.rstrip("/") + "_rejected"
        lines.where(~fits).withColumnRenamed(CORRUPT, "line").write.mode("overwrite").parquet(rejected_path)
    return Conversion(seen.get["rows"], seen.get["rejected"], rejected_path)


def convert_all(
    spark: SparkSession,
    tables: dict[str, str],
    out_dir: str,
    schemas: dict[str, str] | None = None,
    at_once: int = 8,
    **options,
) -> DataFrame:
    """Convert many tables (name -> CSV path), several jobs at once. A failing table is reported and the rest go on.

    ``ok`` means that every line is in the table or among its rejected lines.
    """

    def convert(name: str) -> tuple:
        out_path = os.path.join(out_dir, name)
        try:
            done = convert_csv(spark, tables[name], out_path, (schemas or {}).get(name), **options)
            return name, True, done.rows, done.rejected, out_path, done.rejected_path, None
        except Exception as error:
            return name, False, 0, 0, out_path, None, f"{type(error).__name__}: {str(error)[:500]}"

    with ThreadPoolExecutor(at_once) as pool:
        results = list(pool.map(convert, tables))
    return spark.createDataFrame(results, "table_name string, ok boolean, rows bigint, rejected bigint, path string, rejected_path string, error string")


def conversion_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("tables"),
        F.count_if("ok").alias("converted"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.sum("rows").alias("rows"),
        F.sum("rejected").alias("rejected"),
    )


FORMATS = ("parquet", "orc", "json", "csv")


def write_formats(df: DataFrame, root: str) -> dict[str, str]:
    """The same rows in a columnar and row layouts; returns the path per format."""
    paths = {}
    for name in FORMATS:
        paths[name] = os.path.join(root, name)
        writer = df.write.mode("overwrite").format(name)
        (writer.option("header", True) if name == "csv" else writer).save(paths[name])
    return paths


def format_scans(spark: SparkSession, paths: dict[str, str], schema: T.StructType) -> DataFrame:
    """Rows and seconds of one full scan (every column of every row) per format."""
    rows = []
    for name, path in paths.items():
        began = time.perf_counter()
        scanned = spark.read.schema(schema).option("header", True).format(name).load(path)
        n = scanned.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*schema.names))).first()[0]
        rows.append((name, n, time.perf_counter() - began))
    return spark.createDataFrame(rows, "format string, rows bigint, scan_seconds double")


def format_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Files and bytes per format from file metadata; no content is read."""
    out = None
    for name, path in paths.items():
        files = spark.read.format("binaryFile").load(path).agg(
            F.count("*").alias("files"), F.sum("length").alias("bytes")
        )
        row = files.select(F.lit(name).alias("format"), "files", "bytes")
        out = row if out is None else out.unionByName(row)
    return out
