"""Scan, sink and layout queries: data is written to a fresh shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import money_sum
from tidemark.plans.fixtures import table, target_orders
from tidemark.plans.reconciliation import _compared
from tidemark.plans.registry import plan
from tidemark.session import scratch_path
from tidemark.sources import medallion, readers, typemap, writers

SALES_SQL = """sales AS (SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date, n_name AS region, c_mktsegment AS product,
                          CAST(1 + o_orderkey % 7 AS BIGINT) AS quantity, CAST(o_totalprice AS DECIMAL(10,2)) AS price
                   FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def sales(spark: SparkSession, d: str) -> DataFrame:
    joined = (
        table(spark, d, "orders")
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.selectExpr(
        "o_orderkey AS order_id",
        "CAST(o_orderdate AS DATE) AS order_date",
        "n_name AS region",
        "c_mktsegment AS product",
        "1 + o_orderkey % 7 AS quantity",
        "CAST(o_totalprice AS DECIMAL(10,2)) AS price",
    )


@plan(
    "etl_daily_revenue",
    "S1 S7 P2 A1 A2",
    "",
    SALES_SQL + " SELECT order_date, region, CAST(sum(quantity * price) AS DECIMAL(38,2)) AS revenue FROM sales GROUP BY 1, 2",
)
def etl_daily_revenue(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "sales_csv")
    writers.write_csv(sales(spark, d), path)
    return medallion.daily_revenue(readers.read_csv(spark, path, medallion.SALES_SCHEMA))


@plan(
    "medallion_flow",
    "S12 S8 P3",
    "",
    SALES_SQL + " SELECT order_date, region, CAST(sum(quantity * price) AS DECIMAL(38,2)) AS revenue FROM sales GROUP BY 1, 2",
)
def medallion_flow(spark: SparkSession, d: str) -> DataFrame:
    return medallion.run_flow(spark, sales(spark, d), scratch_path(spark, "medallion"))


@plan(
    "csv_to_parquet",
    "S2 S3 S4",
    "",
    """SELECT 'orders' AS table_name, true AS ok, count(*) AS rows, CAST(0 AS BIGINT) AS rejected FROM orders
       UNION ALL SELECT 'nation', true, count(*), 0 FROM nation UNION ALL SELECT 'absent', false, 0, 0""",
)
def csv_to_parquet(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "convert")
    paths = {}
    for name in ("orders", "nation"):
        paths[name] = f"{root}/csv/{name}"
        writers.write_csv(table(spark, d, name), paths[name])
    paths["absent"] = f"{root}/csv/absent"
    results = writers.convert_all(spark, paths, f"{root}/parquet", rows_per_file=50_000)
    return results.select("table_name", "ok", "rows", "rejected")


@plan(
    "csv_to_parquet_late_types",
    "S2 S4",
    "",
    """SELECT 'inferred' AS table_name, count(*) AS rows, CAST(0 AS BIGINT) AS rejected,
              CAST(sum(CASE WHEN o_orderkey < 1200 THEN o_orderkey ELSE o_orderkey + 0.5 END) AS DECIMAL(28,2)) AS total FROM orders
       UNION ALL SELECT 'given', count(*) FILTER (WHERE o_orderkey < 1200), count(*) FILTER (WHERE o_orderkey >= 1200),
              CAST(sum(o_orderkey) FILTER (WHERE o_orderkey < 1200) AS DECIMAL(28,2)) FROM orders""",
)
def csv_to_parquet_late_types(spark: SparkSession, d: str) -> DataFrame:
    """Whole numbers first and halves from row 1200 on: inference keeps all, a given integer type rejects the halves."""
    root = scratch_path(spark, "convert")
    key = F.col("o_orderkey")
    half = F.when(key < 1200, key.cast("string")).otherwise(F.concat(key.cast("string"), F.lit(".5")))
    writers.write_csv(table(spark, d, "orders").orderBy(key).select(half.alias("amount"), F.col("o_orderstatus").alias("note")), f"{root}/csv")
    paths = {"inferred": f"{root}/csv", "given": f"{root}/csv"}
    results = writers.convert_all(spark, paths, f"{root}/parquet", {"given": "amount bigint, note string"})
    out = None
    for name in paths:
        total = spark.read.parquet(f"{root}/parquet/{name}").agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("decimal(28,2)").alias("total"))
        out = total.withColumn("name", F.lit(name)) if out is None else out.unionByName(total.withColumn("name", F.lit(name)))
    return results.join(out, F.col("table_name") == F.col("name")).select("table_name", "rows", "rejected", "total")


@plan(
    "conversion_summary",
    "S2",
    "",
    """n AS (SELECT count(*) AS n FROM customer), r AS (SELECT count(*) AS n FROM region)
       SELECT CAST(3 AS BIGINT) AS tables, CAST(2 AS BIGINT) AS converted, CAST(1 AS BIGINT) AS failed, n.n + r.n AS rows, CAST(0 AS BIGINT) AS rejected FROM n, r""",
)
def conversion_summary(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "convert")
    paths = {"absent": f"{root}/csv/absent"}
    for name in ("customer", "region"):
        paths[name] = f"{root}/csv/{name}"
        writers.write_csv(table(spark, d, name), paths[name])
    return writers.conversion_summary(writers.convert_all(spark, paths, f"{root}/parquet", compression="zstd"))


TYPES = {"o_orderkey": "NUMBER(19)", "o_orderstatus": "CHAR(3)", "o_totalprice": "NUMBER(18,2)", "o_orderdate": "DATE", "o_note": "INTEGER"}


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.rpad("o_orderstatus", 3, " ").alias("o_orderstatus"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
        F.col("o_orderpriority").alias("o_note"),
    )


@plan(
    "typed_cast",
    "S5 P3",
    "",
    """SELECT CAST(o_orderkey AS DECIMAL(19,0)) AS o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, o_orderdate, CAST(NULL AS BIGINT) AS o_note FROM orders""",
)
def typed_cast(spark: SparkSession, d: str) -> DataFrame:
    return typemap.cast_columns(_raw(spark, d), TYPES)


@plan(
    "cast_failures",
    "S5",
    "",
    """SELECT unnest(['o_orderkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_note']) AS column_name,
              unnest([0, 0, 0, 0, (SELECT count(*) FROM orders)]) AS cast_failures""",
)
def cast_failures(spark: SparkSession, d: str) -> DataFrame:
    return typemap.cast_failures(_raw(spark, d), TYPES)


@plan(
    "json_roundtrip",
    "S6 F1 P1",
    "",
    "SELECT user_id, event_id AS id, props AS body, length(props) AS body_length FROM events",
)
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "posts")
    posts = table(spark, d, "events").select(F.col("user_id").alias("userId"), F.col("event_id").alias("id"), F.col("props").alias("body"))
    posts.write.json(path)
    back = spark.read.schema("userId bigint, id bigint, body string").json(path)
    return back.withColumnRenamed("userId", "user_id").withColumn("body_length", F.length("body").cast("bigint"))


@plan(
    "json_array_scan",
    "S6",
    "",
    "SELECT user_id, count(*) AS posts, min(event_id) AS first_id FROM events GROUP BY 1",
)
def json_array_scan(spark: SparkSession, d: str) -> DataFrame:
    """One JSON array of records per user and day, each written as a document of its own and scanned with a schema."""
    path = scratch_path(spark, "arrays")
    record = F.to_json(F.struct("user_id", "event_id"))
    documents = (
        table(spark, d, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"), F.floor(F.col("event_id") / 10_000).alias("part"))
        .agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    )
    documents.select("value").write.text(path)
    rows = spark.read.text(path).select(
        F.inline(F.from_json("value", "array<struct<user_id: bigint, event_id: bigint>>"))
    )
    return rows.groupBy("user_id").agg(F.count("*").alias("posts"), F.min("event_id").alias("first_id"))


@plan(
    "change_log_files",
    "S9 S10 F10 F17",
    "",
    """SELECT event_id, lower(hex(event_type)) AS payload, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts FROM events""",
)
def change_log_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "changes")
    log = table(spark, d, "events").select("event_id", F.col("event_type").cast("binary").alias("payload"), "ts")
    half = F.col("event_id") < 1000
    writers.append_changes(log.where(half), path)
    writers.append_changes(log.where(~half), path)
    valid, _ = readers.read_change_log(spark, path, "event_id bigint, payload string, ts string")
    return valid


@plan(
    "change_log_rejects",
    "S9 X8",
    "",
    "SELECT event_type AS kind, count(*) AS lines FROM (SELECT CASE WHEN event_type = 'error' THEN 'MALFORMED' ELSE 'VALID' END AS event_type FROM events) GROUP BY 1",
)
def change_log_rejects(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    good = F.to_json(F.struct("event_id", "user_id"))
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("{\"event_id\": oops "), good)).otherwise(good)
    table(spark, d, "events").select(F.concat(line, F.lit("\n")).alias("value")).write.text(path)
    valid, dead = readers.read_change_log(spark, path, "event_id bigint, user_id bigint")
    kinds = valid.select(F.lit("VALID").alias("kind")).unionByName(dead.select(F.col("reason").alias("kind")))
    return kinds.groupBy("kind").agg(F.count("*").alias("lines"))


@plan(
    "report_sinks",
    "S11 R3",
    "target_orders",
    """s AS (SELECT o_orderpriority AS table_name, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT o_orderpriority AS table_name, count(*) AS n FROM target_orders GROUP BY 1)
       SELECT table_name, 'json' AS sink, nullif(t.n - s.n, 0) AS row_count_delta FROM s JOIN t USING (table_name)
       UNION ALL SELECT table_name, 'csv', nullif(t.n - s.n, 0) FROM s JOIN t USING (table_name)""",
)
def report_sinks(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "report")
    writers.write_report(_compared(spark, d), path)
    fields = "table_name string, count_match boolean, hash_match boolean, update_match boolean, delete_match boolean, {} , severity string"
    from_json = spark.read.schema(fields.format("deltas map<string,bigint>")).json(f"{path}/json")
    from_csv = readers.read_csv(spark, f"{path}/csv", fields.format("deltas string")).withColumn(
        "deltas", F.from_json("deltas", "map<string,bigint>")
    )
    both = from_json.withColumn("sink", F.lit("json")).unionByName(from_csv.withColumn("sink", F.lit("csv")))
    return both.select("table_name", "sink", F.try_element_at("deltas", F.lit("row_count_delta")).alias("row_count_delta"))


@plan(
    "table_replace",
    "S8",
    "target_orders",
    "SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY 1",
)
def table_replace(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "replaced")
    writers.replace_table(target_orders(spark, d), path)
    writers.replace_table(table(spark, d, "orders"), path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


@plan(
    "partition_prune",
    "S13",
    "",
    """SELECT strftime(o_orderdate, '%Y-%m') AS order_month, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
       FROM orders WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1997-03' AND '1997-09' GROUP BY 1""",
)
def partition_prune(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "by_month")
    writers.write_by_month(table(spark, d, "orders"), path, "o_orderdate")
    rows = spark.read.parquet(path).where(F.col("order_month").between("1997-03", "1997-09"))
    return rows.groupBy("order_month").agg(
        F.count("*").alias("orders"), money_sum(F.col("o_totalprice")).alias("total")
    )


@plan(
    "row_generator",
    "S14 J5",
    "target_orders",
    """SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM target_orders)
         AND o_orderkey <= (SELECT max(o_orderkey) FROM orders)""",
)
def row_generator(spark: SparkSession, d: str) -> DataFrame:
    """Generated ids up to the newest order, less those the target holds."""
    newest = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    held = target_orders(spark, d).select(F.col("o_orderkey").alias("id"))
    return readers.generate_rows(spark, newest + 1).join(held, "id", "left_anti")


@plan(
    "snapshot_retention",
    "S15",
    "",
    """SELECT CAST(ts AS DATE) AS captured_date, count(*) AS samples FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 7 GROUP BY 1""",
)
def snapshot_retention(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "snapshots")
    writers.append_snapshot(table(spark, d, "events"), path, "ts")
    writers.expire_snapshots(spark, path, "2024-01-31")
    return spark.read.parquet(path).groupBy("captured_date").agg(F.count("*").alias("samples"))


@plan(
    "format_roundtrip",
    "S17",
    "",
    """t AS (SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM orders)
       SELECT unnest(['parquet', 'orc', 'json', 'csv']) AS format, n AS rows, total FROM t""",
)
def format_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    paths = writers.write_formats(orders, scratch_path(spark, "formats"))
    out = None
    for name, path in paths.items():
        rows = spark.read.schema(orders.schema).option("header", True).format(name).load(path).agg(
            F.count("*").alias("rows"), money_sum(F.col("o_totalprice")).alias("total")
        )
        labelled = rows.select(F.lit(name).alias("format"), "rows", "total")
        out = labelled if out is None else out.unionByName(labelled)
    return out


@plan(
    "format_sizes",
    "S17",
    "",
    """SELECT unnest(['parquet', 'orc', 'json', 'csv']) AS format, n AS rows, n > 0 AS has_bytes, true AS timed FROM (SELECT count(*) AS n FROM orders)""",
)
def format_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes, files and scan time of each format; the figures themselves differ from run to run."""
    orders = table(spark, d, "orders")
    paths = writers.write_formats(orders, scratch_path(spark, "formats"))
    sizes = writers.format_sizes(spark, paths)
    scans = writers.format_scans(spark, paths, orders.schema)
    both = sizes.join(scans, "format")
    return both.select("format", "rows", ((F.col("files") > 0) & (F.col("bytes") > 0)).alias("has_bytes"), (F.col("scan_seconds") > 0).alias("timed"))
