"""Basic relational shapes: projections, predicates, joins, sorts, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.plans.fixtures import AS_OF, table, target_orders
from tidemark.plans.registry import plan


@plan(
    "text_projection",
    "P1 P2 P3 F1 F2 F3 F7",
    "",
    """SELECT doc_id AS document_id, length(text) AS text_length, substr(text, 1, 20) AS head, upper(lang) || '|' || trim(source) AS origin,
              CAST(n_chars AS DOUBLE) AS chars, round(CAST(n_chars AS DOUBLE) / 1024.0, 2) AS kb FROM documents""",
)
def text_projection(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "document_id")
    return docs.select(
        "document_id",
        F.length("text").cast("bigint").alias("text_length"),
        F.left("text", F.lit(20)).alias("head"),
        F.concat_ws("|", F.upper("lang"), F.trim("source")).alias("origin"),
        F.col("n_chars").cast("double").alias("chars"),
        F.round(F.col("n_chars").cast("double") / 1024.0, 2).alias("kb"),
    )


@plan(
    "recent_rows",
    "P4 P11",
    "",
    f"""SELECT event_type, count(*) FILTER (WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS last_7_days,
               count(*) FILTER (WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR) AS last_hour,
               count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11') AS one_day
        FROM events WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY 1""",
)
def recent_rows(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count_if(s.recent(ts, AS_OF, "7 DAYS")).alias("last_7_days"),
        F.count_if(s.recent(ts, AS_OF, "1 HOUR")).alias("last_hour"),
        F.count_if(s.half_open(ts, "2024-01-10", "2024-01-11")).alias("one_day"),
    )


@plan(
    "list_and_pattern",
    "P5 P6 P7 P8",
    "",
    """SELECT c_custkey, c_name, c_mktsegment FROM customer
       WHERE c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD') AND c_nationkey IN (1, 2, 3, 5, 8, 13, 21) AND c_name LIKE 'Customer#%'
         AND c_name NOT LIKE '%\\_7' ESCAPE '\\' AND (c_acctbal > 5000 OR c_acctbal < 100) AND nullif(c_mktsegment, 'MACHINERY') IS NOT NULL""",
)
def list_and_pattern(spark: SparkSession, d: str) -> DataFrame:
    segment, name = F.col("c_mktsegment"), F.col("c_name")
    return table(spark, d, "customer").where(
        ~segment.isin("BUILDING", "HOUSEHOLD")
        & F.col("c_nationkey").isin(1, 2, 3, 5, 8, 13, 21)
        & name.like("Customer#%")
        & ~name.like("%\\_7")
        & ((F.col("c_acctbal") > 5000) | (F.col("c_acctbal") < 100))
        & F.nullif(segment, F.lit("MACHINERY")).isNotNull()
    ).select("c_custkey", "c_name", "c_mktsegment")


@plan(
    "null_safe_join",
    "P9 J1",
    "",
    """a AS (SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM nation), b AS (SELECT r_name, nullif(r_regionkey, 2) AS k FROM region)
       SELECT n_nationkey, r_name FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""",
)
def null_safe_join(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").select("n_nationkey", F.nullif(F.col("n_regionkey"), F.lit(2)).alias("k"))
    b = table(spark, d, "region").select("r_name", F.nullif(F.col("r_regionkey"), F.lit(2)).alias("rk"))
    return a.join(b, F.col("k").eqNullSafe(F.col("rk"))).select("n_nationkey", "r_name")


@plan(
    "four_table_join",
    "J1 A2",
    "",
    """SELECT r_name, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def four_table_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders are summed per customer before they meet the dimensions."""
    per_customer = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), s.money_sum(F.col("o_totalprice")).alias("t")
    )
    joined = (
        per_customer.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("r_name").agg(F.sum("n").alias("orders"), F.sum("t").cast("decimal(28,2)").alias("total"))


@plan(
    "right_outer",
    "J16",
    "",
    """l AS (SELECT l_suppkey, count(*) AS used FROM lineitem GROUP BY 1)
       SELECT s_suppkey, s_name, used FROM l RIGHT JOIN supplier ON l_suppkey = s_suppkey""",
)
def right_outer(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("used")
    )
    suppliers = table(spark, d, "supplier")
    return used.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "right").select("s_suppkey", "s_name", "used")


@plan(
    "semi_and_anti",
    "J5 J6 J7",
    "target_orders",
    """SELECT 'kept' AS side, o_orderkey FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM target_orders WHERE o_orderstatus = 'X')
       UNION ALL SELECT 'lost', o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM target_orders t WHERE t.o_orderkey = orders.o_orderkey)""",
)
def semi_and_anti(spark: SparkSession, d: str) -> DataFrame:
    orders, target = table(spark, d, "orders"), target_orders(spark, d)
    changed = target.where("o_orderstatus = 'X'").select("o_orderkey")
    kept = orders.join(changed, "o_orderkey", "left_semi").select(F.lit("kept").alias("side"), "o_orderkey")
    lost = orders.join(target.select("o_orderkey"), "o_orderkey", "left_anti")
    return kept.unionByName(lost.select(F.lit("lost").alias("side"), "o_orderkey"))


@plan(
    "lateral_lookup",
    "J13",
    "",
    """SELECT p_partkey, p_name, x.calls, x.biggest FROM part LEFT JOIN LATERAL
         (SELECT count(*) AS calls, max(l_extendedprice) AS biggest FROM lineitem WHERE l_partkey = p_partkey HAVING count(*) > 0) x ON true""",
)
def lateral_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A per-row lookup is an equi-join with a pre-aggregated side."""
    looked_up = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.count("*").alias("calls"), F.max("l_extendedprice").alias("biggest")
    )
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    return parts.join(looked_up, F.col("p_partkey") == F.col("l_partkey"), "left").drop("l_partkey")


@plan(
    "scalar_subqueries",
    "J14 J8",
    "",
    """SELECT c_mktsegment, count(*) AS customers, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders,
              count(*) FILTER (WHERE c_acctbal > (SELECT avg(CAST(c_acctbal AS DECIMAL(18,2))) FROM customer)) AS above_mean FROM customer GROUP BY 1""",
)
def scalar_subqueries(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer")
    mean = table(spark, d, "customer").agg(s.exact_mean(F.col("c_acctbal"))).scalar()
    opened = table(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "O")).scalar()
    grouped = customers.withColumn("_above", F.col("c_acctbal") > mean).groupBy("c_mktsegment").agg(
        F.count("*").alias("customers"), F.count_if("_above").alias("above_mean")
    )
    return grouped.withColumn("open_orders", opened)


@plan(
    "null_placement",
    "K3",
    "",
    """SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer ORDER BY segment ASC NULLS LAST, c_custkey DESC""",
)
def null_placement(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"))
    return named.orderBy(F.col("segment").asc_nulls_last(), F.desc("c_custkey"))


@plan(
    "paging",
    "K4",
    "",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100",
)
def paging(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


@plan(
    "clock_functions",
    "F8 F9 F10",
    "",
    """SELECT event_id, datediff('minute', TIMESTAMP '2024-01-01 00:00:30', ts) AS minutes_crossed, datediff('day', TIMESTAMP '2024-01-01 23:59:59', ts) AS days_crossed,
              date_sub('second', TIMESTAMP '2024-01-01', ts) AS seconds_elapsed, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS hour,
              strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, strptime(strftime(ts, '%Y%m%d %H%M%S'), '%Y%m%d %H%M%S') AS parsed FROM events""",
)
def clock_functions(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")

    def at(text: str):
        return F.lit(text).cast("timestamp_ntz")

    return table(spark, d, "events").select(
        "event_id",
        s.clock_diff("MINUTE", at("2024-01-01 00:00:30"), ts).alias("minutes_crossed"),
        s.clock_diff("DAY", at("2024-01-01 23:59:59"), ts).alias("days_crossed"),
        s.elapsed_seconds(at("2024-01-01"), ts).alias("seconds_elapsed"),
        F.to_date(ts).alias("day"),
        F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour"),
        s.iso_text(ts).alias("iso"),
        F.to_timestamp_ntz(F.date_format(ts, "yyyyMMdd HHmmss"), F.lit("yyyyMMdd HHmmss")).alias("parsed"),
    )


@plan(
    "lenient_parsing",
    "F11 F12 F5",
    "",
    """r AS (SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN '' WHEN 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS v,
                    CASE event_type WHEN 'view' THEN 'TRUE' WHEN 'click' THEN 'Y' WHEN 'error' THEN '1' ELSE 'no' END AS f FROM events)
       SELECT event_id, coalesce(CAST(trunc(TRY_CAST(v AS DOUBLE)) AS BIGINT), 0) AS as_int, lower(f) = 'true' AS is_true, f IN ('1', 'Y', 'true', 't') AS is_deleted FROM r""",
)
def lenient_parsing(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "events").selectExpr(
        "event_id",
        "CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN '' WHEN 'error' THEN 'n/a' ELSE CAST(value AS STRING) END AS v",
        "CASE event_type WHEN 'view' THEN 'TRUE' WHEN 'click' THEN 'Y' WHEN 'error' THEN '1' ELSE 'no' END AS f",
    )
    return raw.select(
        "event_id",
        s.lenient_int(F.col("v")).alias("as_int"),
        s.is_true_text(F.col("f")).alias("is_true"),
        s.is_deleted(F.col("f")).alias("is_deleted"),
    )


@plan(
    "digests_and_hex",
    "F4 F17 F3",
    "",
    """SELECT c_custkey, md5(c_name) AS digest, sha256(c_name) AS sha, CAST('0x' || substr(md5(c_name), 1, 8) AS BIGINT) AS number,
              lower(hex(c_mktsegment)) AS hex_text, c_mktsegment AS back FROM customer""",
)
def digests_and_hex(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "customer")
    hexed = s.hex_text(F.col("c_mktsegment").cast("binary"))
    return raw.select(
        "c_custkey",
        F.md5("c_name").alias("digest"),
        F.sha2("c_name", 256).alias("sha"),
        F.conv(F.substring(F.md5("c_name"), 1, 8), 16, 10).cast("bigint").alias("number"),
        hexed.alias("hex_text"),
        s.bytes_of_hex(hexed).cast("string").alias("back"),
    )


@plan(
    "arrays_and_json",
    "F14 F15",
    "",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) > 50 AS big, CAST(3 AS INTEGER) AS n,
              event_type IN ('click', 'view') AS listed, '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS compact FROM events""",
)
def arrays_and_json(spark: SparkSession, d: str) -> DataFrame:
    parsed = table(spark, d, "events").withColumn("m", F.from_json("props", "map<string,bigint>"))
    k = F.element_at("m", F.lit("k"))
    return parsed.select(
        "event_id",
        k.alias("k"),
        F.coalesce(F.size(F.map_filter("m", lambda _, v: v > 50)) > 0, F.lit(False)).alias("big"),
        F.size(F.array("event_type", "props", F.lit("x"))).alias("n"),
        F.array_contains(F.array(F.lit("click"), F.lit("view")), F.col("event_type")).alias("listed"),
        F.to_json("m").alias("compact"),
    )


@plan(
    "safe_division",
    "F6 F5 F7",
    "",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0 THEN 0.0 ELSE l_discount / l_tax END AS or_zero, l_discount / nullif(l_tax, 0) AS or_null,
              round(l_extendedprice / 1048576.0, 4) AS mb FROM lineitem""",
)
def safe_division(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        s.ratio_or_zero(F.col("l_discount"), F.col("l_tax")).alias("or_zero"),
        s.ratio_or_null(F.col("l_discount"), F.col("l_tax")).alias("or_null"),
        F.round(F.col("l_extendedprice") / 1048576.0, 4).alias("mb"),
    )


@plan(
    "distinct_union",
    "U2 U3 U4",
    "target_orders",
    """SELECT o_orderkey FROM orders UNION SELECT o_orderkey FROM target_orders""",
)
def distinct_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey").union(target_orders(spark, d).select("o_orderkey")).distinct()
