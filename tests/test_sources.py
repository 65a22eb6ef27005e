"""Readers, writers, type maps and the medallion flow."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.session import checkpoint_root, scratch_path
from tidemark.sources import medallion, readers, typemap, writers

SALES = """order_id,order_date,region,product,quantity,price
901,2023-11-30,Harbour,Lamp,4,3.25
902,2023-11-30,Harbour,Rug,1,118.40
903,2023-12-01,Uplands,Lamp,10,3.25
903,2023-12-01,Uplands,Lamp,10,3.25
904,2023-12-01,,Kettle,2,31.05
905,,Uplands,Kettle,1,31.05
906,2023-12-04,Delta,Bench,,250.00
"""


def test_daily_revenue_of_a_file(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text(SALES)
    sales = readers.read_csv(spark, str(path), medallion.SALES_SCHEMA)
    want = [
        (date(2023, 11, 30), "Harbour", Decimal("131.40")),
        (date(2023, 12, 1), "Uplands", Decimal("65.00")),
        (date(2023, 12, 4), "Delta", Decimal("0.00")),
    ]
    assert [tuple(r) for r in medallion.daily_revenue(sales).orderBy("order_date", "region").collect()] == want
    assert rows(medallion.run_flow(spark, sales, str(tmp_path / "flow"))) == rows(medallion.daily_revenue(sales))


def test_silver_counts_what_does_not_fit(spark, tmp_path):
    raw = spark.createDataFrame(
        [("1", "2023-11-30", "A", "p", "2", "1.50"), ("x", "soon", "A", "p", "2.5", "1"), (None, None, None, None, None, None)],
        "order_id string, order_date string, region string, product string, quantity string, price string",
    )
    found = {r.column_name: r.misfits for r in medallion.misfits(raw).collect()}
    assert found == {"order_id": 1, "order_date": 1, "region": 0, "product": 0, "quantity": 1, "price": 0}
    medallion.run_flow(spark, raw, str(tmp_path / "flow"))
    assert spark.read.parquet(str(tmp_path / "flow" / "misfits")).agg(F.sum("misfits")).first()[0] == 3


def test_null_keys_and_null_groups(spark):
    sales = spark.createDataFrame(
        [(1, date(2024, 1, 1), None, "p", 1, Decimal("2.00")), (2, date(2024, 1, 1), "N", "p", None, Decimal("2.00"))], medallion.SALES_SCHEMA
    )
    assert [r.revenue for r in medallion.daily_revenue(sales).collect()] == [Decimal("0.00")]


def test_types_that_change_late_are_kept(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "\n".join(f"{i}{'.5' if i >= 1500 else ''},x{i}" for i in range(3000)))
    done = writers.convert_csv(spark, str(path), str(tmp_path / "out"), compression="gzip", rows_per_file=500)
    assert (done.rows, done.rejected) == (3000, 0)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.agg(F.sum("a")).first()[0] == sum(range(3000)) + 750 and back.where("a IS NULL").count() == 0
    with pytest.raises(ValueError):
        writers.convert_csv(spark, str(path), str(tmp_path / "out"), compression="brotli")


def test_rows_that_do_not_fit_a_given_schema_are_dead_letters(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,x\n2.5,y\n3,z\n4,w,more\n")
    out = writers.convert_all(spark, {"t": str(path), "gone": str(tmp_path / "gone")}, str(tmp_path / "out"), {"t": "a int, b string"})
    got = {r.table_name: r for r in out.collect()}
    assert (got["t"].ok, got["t"].rows, got["t"].rejected) == (True, 2, 2)
    assert sorted(r.line for r in spark.read.parquet(got["t"].rejected_path).collect()) == ["2.5,y", "4,w,more"]
    assert not got["gone"].ok and "gone" in got["gone"].error


def test_type_map(spark):
    assert typemap.spark_type("NUMBER") == "decimal(38,10)"
    assert typemap.spark_type("number(10,2)") == "decimal(10,2)"
    assert typemap.spark_type("VARCHAR2(20)") == "string"
    assert typemap.spark_type("DATE") == "timestamp_ntz"
    assert typemap.spark_type("DATE", date_as_date=True) == "date"
    assert typemap.target_schema({"a": "NUMBER(5)", "b": "BLOB"}).simpleString() == "struct<a:decimal(5,0),b:binary>"
    df = spark.createDataFrame([("1", "ab "), ("x", None)], "a string, c string")
    out = typemap.cast_columns(df, {"a": "INTEGER", "c": "CHAR(3)"})
    assert [tuple(r) for r in out.collect()] == [(1, "ab"), (None, None)]
    failed = {r.column_name: r.cast_failures for r in typemap.cast_failures(df, {"a": "INTEGER", "c": "CHAR(3)"}).collect()}
    assert failed == {"a": 1, "c": 0}


def test_change_log_lines(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"a": 1, "ts": "2024-01-01T00:00:00.123456"}\n\n   \n{"a": oops\n{"a": 2}\n')
    valid, dead = readers.read_change_log(spark, str(tmp_path / "log.json"), "a bigint, ts timestamp_ntz")
    assert sorted(r.a for r in valid.collect()) == [1, 2]
    assert valid.where("a = 1").first().ts.microsecond == 123456
    assert [(r.line, r.reason) for r in dead.collect()] == [('{"a": oops', "MALFORMED")]


def test_json_array_and_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"userId": 1, "id": 2, "title": "t"}, {"userId": 1, "id": 3, "title": "uvw"}]')
    posts = readers.read_json_array(spark, str(tmp_path / "a.json"), "userId int, id int, title string")
    assert rows(posts.select("id", F.length("title").alias("n"))) == [(2, 1), (3, 3)]
    (tmp_path / "r.txt").write_text("## A\nx\n")
    report = readers.read_reports(spark, str(tmp_path / "r.txt")).first()
    assert report.text == "## A\nx\n" and report.report_id.endswith("r.txt")


def test_append_is_hex_and_iso(spark, tmp_path):
    df = spark.sql("SELECT X'0AFF' AS b, TIMESTAMP_NTZ '2024-01-02 03:04:05.000006' AS t")
    writers.append_changes(df, str(tmp_path / "x"))
    writers.append_changes(df, str(tmp_path / "x"))
    back = spark.read.json(str(tmp_path / "x"))
    assert back.count() == 2 and tuple(back.select("b", "t").first()) == ("0aff", "2024-01-02T03:04:05.000006")


def test_partitions_and_retention(spark, tmp_path, sf):
    path = str(tmp_path / "snap")
    events = spark.read.parquet(f"{sf}/events.parquet")
    writers.append_snapshot(events, path, "ts")
    dropped = writers.expire_snapshots(spark, path, "2024-01-20", days=7)
    assert dropped == [f"2024-01-{d:02d}" for d in range(1, 13)]
    left = spark.read.parquet(path)
    assert left.agg(F.min("captured_date")).first()[0] == date(2024, 1, 13)
    month = str(tmp_path / "month")
    writers.write_by_month(events, month, "ts")
    plan = spark.read.parquet(month).where("order_month = '2024-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_month" in plan


def test_format_sizes(spark, tmp_path, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    sizes = {r.format: r.bytes for r in writers.format_sizes(spark, writers.write_formats(orders, str(tmp_path / "f"))).collect()}
    assert set(sizes) == set(writers.FORMATS) and sizes["parquet"] < sizes["json"]


def test_scratch_is_below_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")
