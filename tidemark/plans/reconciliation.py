"""Source-to-target reconciliation queries over ``orders`` and its drifted copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import money_sum, ratio_or_null
from tidemark.functions.signature import hash_sum, raw_signature, row_number60, segment_digest, signature
from tidemark.operators import cdc, compare, diff, integrity, repair, sampling, sketch, summary
from tidemark.plans.fixtures import (
    COMPARED,
    ORDER_COLUMNS,
    RUN_TS,
    WINDOW_END,
    WINDOW_START,
    change_log,
    seed,
    table,
    target_orders,
)
from tidemark.plans.registry import plan
from tidemark.session import inline_rows

SPEC = summary.TableSpec(
    "orders", ["o_orderkey"], "o_orderdate", "o_orderstatus", hash_cols=ORDER_COLUMNS, deleted_values=("F", "X")
)

# Oracle text of the canonical signature of an order row.
SIGNATURE_SQL = (
    "concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), "
    "strlen(trim(o_orderstatus)) || ':' || trim(o_orderstatus), "
    "CAST(CAST(round(o_totalprice * 1000000) AS BIGINT) AS VARCHAR), CAST(epoch_us(o_orderdate) AS VARCHAR), "
    "strlen(trim(o_orderpriority)) || ':' || trim(o_orderpriority))"
)
HASH_SQL = f"CAST('0x' || substr(md5({SIGNATURE_SQL}), 1, 15) AS BIGINT)"
MEASURES_SQL = f"""
    count(*) AS row_count, CAST(sum({HASH_SQL}) AS DECIMAL(38,0)) AS hash_sum,
    count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '{WINDOW_START}' AND o_orderdate < TIMESTAMP '{WINDOW_END}') AS updated_count,
    count(*) FILTER (WHERE o_orderstatus IN ('F', 'X')) AS deleted_count"""
STATE_SQL = f"""
    s AS (SELECT o_orderpriority AS table_name, {MEASURES_SQL} FROM orders GROUP BY 1),
    t AS (SELECT o_orderpriority AS table_name, {MEASURES_SQL} FROM target_orders GROUP BY 1),
    c AS (SELECT table_name,
                 coalesce(s.row_count, 0) = coalesce(t.row_count, 0) AS count_match,
                 coalesce(CAST(s.hash_sum AS VARCHAR), '') = coalesce(CAST(t.hash_sum AS VARCHAR), '') AS hash_match,
                 coalesce(s.updated_count, 0) = coalesce(t.updated_count, 0) AS update_match,
                 coalesce(s.deleted_count, 0) = coalesce(t.deleted_count, 0) AS delete_match,
                 CAST(coalesce(t.row_count, 0) - coalesce(s.row_count, 0) AS BIGINT) AS dn,
                 CAST(coalesce(t.updated_count, 0) - coalesce(s.updated_count, 0) AS BIGINT) AS du,
                 CAST(coalesce(t.deleted_count, 0) - coalesce(s.deleted_count, 0) AS BIGINT) AS dd
          FROM s FULL JOIN t USING (table_name)),
    v AS (SELECT *, CASE WHEN NOT count_match AND NOT hash_match THEN 'SEV1'
                         WHEN NOT (count_match AND hash_match AND update_match AND delete_match) THEN 'SEV2'
                         ELSE 'OK' END AS severity,
                 CASE WHEN NOT count_match THEN 'CLASS-A' WHEN NOT hash_match THEN 'CLASS-B'
                      WHEN NOT update_match OR NOT delete_match THEN 'CLASS-C' ELSE 'OK' END AS documented_class,
                 CASE WHEN NOT count_match AND NOT hash_match THEN 'CLASS-A' WHEN count_match AND NOT hash_match THEN 'CLASS-B'
                      WHEN NOT update_match OR NOT delete_match THEN 'CLASS-C' ELSE 'OK' END AS literal_class
          FROM c)"""
STATUS_SQL = """
    st AS (SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
                  CASE WHEN count(*) OVER (PARTITION BY coalesce(s.o_orderkey, t.o_orderkey)) > 1 THEN 'DUPLICATE'
                       WHEN t.o_orderkey IS NULL THEN 'MISSING' WHEN s.o_orderkey IS NULL THEN 'EXTRA'
                       WHEN s.o_custkey IS DISTINCT FROM t.o_custkey OR s.o_orderstatus IS DISTINCT FROM t.o_orderstatus
                         OR s.o_totalprice IS DISTINCT FROM t.o_totalprice OR s.o_orderdate IS DISTINCT FROM t.o_orderdate
                         OR s.o_orderpriority IS DISTINCT FROM t.o_orderpriority THEN 'CHANGED' ELSE 'SAME' END AS status
           FROM orders s FULL JOIN target_orders t ON s.o_orderkey = t.o_orderkey)"""


def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "orders"), target_orders(spark, d)


def _by_priority(df: DataFrame) -> DataFrame:
    return summary.summarize_by(df, SPEC, WINDOW_START, WINDOW_END, F.col("o_orderpriority")).withColumnRenamed(
        "segment", "table_name"
    )


def _compared(spark: SparkSession, d: str) -> DataFrame:
    source, target = _pair(spark, d)
    return compare.compare_summaries(_by_priority(source), _by_priority(target), ["table_name"])


@plan(
    "recon_summary",
    "R1 R2 A3 A4 A10 F3 F4 F5 F10 F12 P11",
    "target_orders",
    f"""SELECT 'public' AS schema_name, 'orders' AS table_name, {MEASURES_SQL}, TIMESTAMP '{RUN_TS}' AS run_ts, 'source' AS side
        FROM orders
        UNION ALL
        SELECT 'public', 'orders', {MEASURES_SQL}, TIMESTAMP '{RUN_TS}', 'target' FROM target_orders""",
)
def recon_summary(spark: SparkSession, d: str) -> DataFrame:
    source, target = _pair(spark, d)
    one = summary.summarize(source, SPEC, WINDOW_START, WINDOW_END, RUN_TS).withColumn("side", F.lit("source"))
    return one.unionByName(
        summary.summarize(target, SPEC, WINDOW_START, WINDOW_END, RUN_TS).withColumn("side", F.lit("target"))
    )


@plan(
    "recon_compare",
    "J4 R3 U3 F11 F15 Q11",
    "target_orders",
    STATE_SQL
    + """ SELECT table_name, count_match, hash_match, update_match, delete_match, severity,
         '{' || concat_ws(',', CASE WHEN dn <> 0 THEN '"row_count_delta":' || dn END,
                               CASE WHEN du <> 0 THEN '"update_delta":' || du END,
                               CASE WHEN dd <> 0 THEN '"delete_delta":' || dd END) || '}' AS deltas FROM v""",
)
def recon_compare(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).withColumn("deltas", F.to_json("deltas"))


@plan(
    "recon_classify",
    "R4 F12 F13",
    "target_orders",
    STATE_SQL
    + """ SELECT table_name, severity, documented_class AS gap_class, literal_class,
          CASE documented_class
            WHEN 'CLASS-A' THEN 'Re-extract and replay missing/extra key ranges; then hash validate'
            WHEN 'CLASS-B' THEN 'Run row-level diff and targeted UPDATE remediation'
            WHEN 'CLASS-C' THEN 'Replay CDC from safe checkpoint and validate operation parity'
            ELSE 'No remediation required' END AS recommended_action FROM v""",
)
def recon_classify(spark: SparkSession, d: str) -> DataFrame:
    out = compare.classify(_compared(spark, d)).withColumn("literal_class", compare.gap_class("literal"))
    return out.select("table_name", "severity", "gap_class", "literal_class", "recommended_action")


@plan(
    "gap_tally",
    "A13",
    "target_orders",
    STATE_SQL + " SELECT documented_class AS gap_class, count(*) AS tables FROM v GROUP BY 1",
)
def gap_tally(spark: SparkSession, d: str) -> DataFrame:
    return compare.tally(compare.classify(_compared(spark, d)), "gap_class")


@plan(
    "gap_class_extended",
    "R5 R2",
    "",
    f"""padded AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus || ' ' ELSE o_orderstatus END AS o_orderstatus,
                         o_totalprice + CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS o_totalprice, o_orderdate, o_orderpriority FROM orders),
       s AS (SELECT o_orderpriority, sum({HASH_SQL}) AS h, sum(CAST('0x' || substr(md5(o_orderstatus), 1, 15) AS BIGINT)) AS r FROM orders GROUP BY 1),
       t AS (SELECT o_orderpriority, sum({HASH_SQL}) AS h, sum(CAST('0x' || substr(md5(o_orderstatus), 1, 15) AS BIGINT)) AS r FROM padded GROUP BY 1)
       SELECT o_orderpriority, CASE WHEN s.r <> t.r AND s.h = t.h THEN 'CLASS-E' WHEN s.h <> t.h THEN 'CLASS-B' ELSE 'OK' END AS gap_class
       FROM s JOIN t USING (o_orderpriority)""",
)
def gap_class_extended(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "orders")
    urgent, low = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    target = source.withColumns({
        "o_orderstatus": F.when(urgent, F.concat("o_orderstatus", F.lit(" "))).otherwise(F.col("o_orderstatus")),
        "o_totalprice": F.col("o_totalprice") + F.when(low, 1).otherwise(0),
    })

    def sums(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy("o_orderpriority").agg(
            hash_sum(row_number60(signature(df, ORDER_COLUMNS))).alias(f"{p}_h"),
            hash_sum(row_number60(raw_signature(["o_orderstatus"]))).alias(f"{p}_r"),
        )

    joined = sums(source, "s").join(sums(target, "t"), "o_orderpriority")
    canonical = F.col("s_h") == F.col("t_h")
    base = F.when(canonical, "OK").otherwise("CLASS-B")
    return joined.select(
        "o_orderpriority",
        compare.extended_class(F.col("s_r") == F.col("t_r"), canonical, F.lit(True), base).alias("gap_class"),
    )


def _segment_sql(segment: str) -> str:
    side = f"SELECT {segment} AS segment, count(*) AS n, sum({HASH_SQL}) AS h FROM"
    return f"""s AS ({side} orders GROUP BY 1), t AS ({side} target_orders GROUP BY 1)
        SELECT segment, coalesce(s.n, 0) AS source_count, coalesce(t.n, 0) AS target_count,
               coalesce(t.n, 0) - coalesce(s.n, 0) AS count_delta, s.h IS NOT DISTINCT FROM t.h AS hash_match
        FROM s FULL JOIN t USING (segment)
        WHERE coalesce(t.n, 0) <> coalesce(s.n, 0) OR s.h IS DISTINCT FROM t.h"""


def _segments(spark: SparkSession, d: str, segment) -> DataFrame:
    source, target = _pair(spark, d)
    return summary.compare_segments(
        summary.summarize_by(source, SPEC, WINDOW_START, WINDOW_END, segment),
        summary.summarize_by(target, SPEC, WINDOW_START, WINDOW_END, segment),
    )


@plan("recon_segments", "R7", "target_orders", _segment_sql("CAST(floor(o_orderkey / 1000) AS BIGINT)"))
def recon_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d, F.floor(F.col("o_orderkey") / 1000))


@plan("recon_month_segments", "R7", "target_orders", _segment_sql("CAST(date_trunc('month', o_orderdate) AS DATE)"))
def recon_month_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d, F.trunc(F.col("o_orderdate").cast("date"), "month"))


@plan(
    "operation_parity",
    "R24 R7",
    "change_log",
    """side AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, op, count(*) AS n FROM change_log GROUP BY 1, 2),
       kept AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, op, count(*) AS n FROM change_log
                WHERE NOT (op = 'D' AND amount > 100) GROUP BY 1, 2)
       SELECT day, op, coalesce(side.n, 0) AS source_ops, coalesce(kept.n, 0) AS target_ops,
              coalesce(kept.n, 0) - coalesce(side.n, 0) AS delta FROM side FULL JOIN kept USING (day, op)""",
)
def operation_parity(spark: SparkSession, d: str) -> DataFrame:
    log = change_log(spark, d).withColumn("day", F.to_date("ts"))
    replayed = log.where(~((F.col("op") == "D") & (F.col("amount") > 100)))
    return cdc.operation_parity(log, replayed, ["day", "op"])


@plan("row_diff", "R6 J4 P9", "target_orders", STATUS_SQL + " SELECT o_orderkey, status FROM st")
def row_diff(spark: SparkSession, d: str) -> DataFrame:
    source, target = _pair(spark, d)
    return diff.key_status(source, target, ["o_orderkey"], COMPARED).select("o_orderkey", "status")


@plan("sketch_diff", "R7 R6", "target_orders", STATUS_SQL + " SELECT o_orderkey, status FROM st WHERE status <> 'SAME'")
def sketch_diff(spark: SparkSession, d: str) -> DataFrame:
    return sketch.sketch_diff(*_pair(spark, d), ["o_orderkey"], COMPARED).select("o_orderkey", "status")


@plan(
    "row_diff_columns",
    "R6 P9",
    "target_orders",
    """SELECT s.o_orderkey, concat_ws(',', CASE WHEN s.o_custkey IS DISTINCT FROM t.o_custkey THEN 'o_custkey' END,
              CASE WHEN s.o_orderstatus IS DISTINCT FROM t.o_orderstatus THEN 'o_orderstatus' END,
              CASE WHEN s.o_totalprice IS DISTINCT FROM t.o_totalprice THEN 'o_totalprice' END,
              CASE WHEN s.o_orderdate IS DISTINCT FROM t.o_orderdate THEN 'o_orderdate' END,
              CASE WHEN s.o_orderpriority IS DISTINCT FROM t.o_orderpriority THEN 'o_orderpriority' END) AS changed_columns
       FROM orders s JOIN target_orders t ON s.o_orderkey = t.o_orderkey
       WHERE (s.o_custkey, s.o_orderstatus, s.o_totalprice, s.o_orderdate, s.o_orderpriority) IS DISTINCT FROM
             (t.o_custkey, t.o_orderstatus, t.o_totalprice, t.o_orderdate, t.o_orderpriority)""",
)
def row_diff_columns(spark: SparkSession, d: str) -> DataFrame:
    source, target = _pair(spark, d)
    return diff.changed_columns(source, target, ["o_orderkey"], COMPARED)


@plan(
    "diff_drill_down",
    "R7 R6",
    "target_orders",
    STATUS_SQL
    + " SELECT CAST(floor(o_orderkey / 10000) AS BIGINT) AS segment, o_orderkey, status FROM st WHERE status <> 'SAME'",
)
def diff_drill_down(spark: SparkSession, d: str) -> DataFrame:
    source, target = _pair(spark, d)
    out = diff.drill_down(source, target, ["o_orderkey"], COMPARED, F.floor(F.col("o_orderkey") / 10000))
    return out.select("segment", "o_orderkey", "status")


@plan(
    "count_by_state",
    "R8",
    "target_orders",
    """s AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1),
       t AS (SELECT o_orderstatus, count(*) AS n FROM target_orders GROUP BY 1)
       SELECT o_orderstatus, coalesce(s.n, 0) AS source_count, coalesce(t.n, 0) AS target_count,
              coalesce(t.n, 0) - coalesce(s.n, 0) AS delta FROM s FULL JOIN t USING (o_orderstatus)""",
)
def count_by_state(spark: SparkSession, d: str) -> DataFrame:
    return summary.counts_by_state(*_pair(spark, d), "o_orderstatus")


@plan(
    "row_count_match",
    "R20 Q11 A2",
    "target_orders",
    """s AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1),
       t AS (SELECT o_orderpriority, count(*) AS n FROM target_orders GROUP BY 1)
       SELECT o_orderpriority, s.n AS source_count, t.n AS target_count,
              CASE WHEN s.n = t.n THEN 'MATCH' ELSE 'MISMATCH' END AS exact_status,
              CASE WHEN abs(s.n - t.n) <= 0.01 * s.n THEN 'MATCH' ELSE 'MISMATCH' END AS restore_status
       FROM s JOIN t USING (o_orderpriority)""",
)
def row_count_match(spark: SparkSession, d: str) -> DataFrame:
    counts = summary.counts_by_state(*_pair(spark, d), "o_orderpriority")
    s, t = F.col("source_count"), F.col("target_count")
    return counts.select(
        "o_orderpriority",
        s,
        t,
        compare.within_tolerance(s, t).alias("exact_status"),
        compare.within_tolerance(s, t, 0.01).alias("restore_status"),
    )


@plan(
    "sampled_checksum",
    "R9",
    "target_orders",
    f"""s AS (SELECT o_orderkey, {HASH_SQL} AS h FROM orders
              WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) % 100 < 10),
        t AS (SELECT o_orderkey, {HASH_SQL} AS h FROM target_orders),
        m AS (SELECT count(*) AS sampled, count(*) FILTER (WHERE s.h IS NOT DISTINCT FROM t.h) AS matched
              FROM s LEFT JOIN t USING (o_orderkey))
        SELECT sampled, matched, round(CAST(100.0 AS DOUBLE) * matched / sampled, 4) AS match_pct,
               CASE WHEN round(CAST(100.0 AS DOUBLE) * matched / sampled, 4) >= 99.9 THEN 'PASS' ELSE 'FAIL' END AS status FROM m""",
)
def sampled_checksum(spark: SparkSession, d: str) -> DataFrame:
    source, target = _pair(spark, d)
    return diff.sampled_checksum(source, target, ["o_orderkey"], ORDER_COLUMNS)


@plan(
    "sampled_parity",
    "R9",
    "target_orders",
    f"""o AS (SELECT o_orderkey, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) % 100 AS b, {HASH_SQL} AS h FROM orders),
        t AS (SELECT o_orderkey, {HASH_SQL} AS h FROM target_orders),
        j AS (SELECT b, o.h IS DISTINCT FROM t.h AS bad FROM o LEFT JOIN t USING (o_orderkey)),
        g AS (SELECT p, count(*) AS n, count(*) FILTER (WHERE bad) AS w FROM j, (SELECT unnest([1, 4, 16, 64, 100]) AS p) WHERE b < p GROUP BY 1),
        x AS (SELECT p, n, w, unnest(range(w + 1)) AS i FROM g),
        q AS (SELECT p, n, w, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.001) + (n - i) * ln(0.999))) AS upto,
                     coalesce(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.001) + (n - i) * ln(0.999))) FILTER (WHERE i < w), 0) AS below FROM x GROUP BY 1, 2, 3),
        v AS (SELECT p, n, w, CASE WHEN upto <= 0.001 OR p = 100 AND w <= 0.001 * n THEN 'PASS' WHEN 1 - below < 0.001 OR p = 100 THEN 'FAIL' ELSE 'MORE' END AS verdict FROM q)
        SELECT CAST(p AS INTEGER) AS stage_pct, n AS sampled, w AS wrong, verdict FROM v WHERE p = (SELECT min(p) FROM v WHERE verdict <> 'MORE')""",
)
def sampled_parity(spark: SparkSession, d: str) -> DataFrame:
    out = sampling.sampled_parity(*_pair(spark, d), ["o_orderkey"], ORDER_COLUMNS, "o_orderpriority")
    return out.where("stratum IS NULL").select("stage_pct", "sampled", "wrong", "verdict")


@plan(
    "segment_digest",
    "A11",
    "",
    f"""k AS (SELECT o_orderkey, count(*) || ':' || CAST(sum({HASH_SQL}) AS VARCHAR) AS x, count(*) AS n FROM orders GROUP BY 1)
        SELECT CAST(floor(o_orderkey / 500) AS BIGINT) AS segment, CAST(sum(n) AS BIGINT) AS row_count,
               md5(string_agg(x, ',' ORDER BY o_orderkey)) AS digest FROM k GROUP BY 1""",
)
def ordered_digest(spark: SparkSession, d: str) -> DataFrame:
    return segment_digest(table(spark, d, "orders"), "o_orderkey", ORDER_COLUMNS, 500)


@plan(
    "pk_duplicates",
    "R10 A8",
    "",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def pk_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return integrity.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@plan(
    "pk_nulls",
    "R10 P8",
    "",
    """SELECT count(*) FILTER (WHERE nullif(event_type, 'view') IS NULL) AS null_keys FROM events""",
)
def pk_nulls(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "events").withColumn("k", F.nullif(F.col("event_type"), F.lit("view")))
    return integrity.null_keys(keyed, ["event_id", "k"])


@plan(
    "fk_orphans",
    "R11 J5 J6",
    "target_orders",
    """SELECT l_orderkey, count(*) AS child_rows FROM lineitem
       WHERE NOT EXISTS (SELECT 1 FROM target_orders t WHERE t.o_orderkey = l_orderkey) GROUP BY 1""",
)
def fk_orphans(spark: SparkSession, d: str) -> DataFrame:
    return integrity.orphan_counts(table(spark, d, "lineitem"), "l_orderkey", target_orders(spark, d), "o_orderkey")


@plan(
    "fk_orphan_rows",
    "R11 J6",
    "target_orders",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
       WHERE NOT EXISTS (SELECT 1 FROM target_orders t WHERE t.o_orderkey = l_orderkey)""",
)
def fk_orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = integrity.orphans(table(spark, d, "lineitem"), "l_orderkey", target_orders(spark, d), "o_orderkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@plan(
    "null_violations",
    "R12",
    "",
    """n AS (SELECT count(*) FILTER (WHERE e.user_id IS NULL) AS a, count(*) FILTER (WHERE nullif(e.event_type, 'view') IS NULL) AS b,
                    count(*) FILTER (WHERE l.quality IS NULL) AS c FROM events e LEFT JOIN labels l ON e.event_id = l.doc_id)
       SELECT 'user_id' AS column_name, a AS null_rows FROM n UNION ALL SELECT 'event_type', b FROM n UNION ALL SELECT 'quality', c FROM n""",
)
def null_violations(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("event_type", F.nullif(F.col("event_type"), F.lit("view")))
    joined = events.join(table(spark, d, "labels"), F.col("event_id") == F.col("doc_id"), "left")
    return integrity.null_violations(joined, ["user_id", "event_type", "quality"])


@plan(
    "range_anomalies",
    "R13 A7",
    "",
    """SELECT 'l_quantity' AS column_name, CAST(CAST(min(l_quantity) AS BIGINT) AS VARCHAR) AS min_value, CAST(CAST(max(l_quantity) AS BIGINT) AS VARCHAR) AS max_value,
              count(*) FILTER (WHERE NOT (l_quantity BETWEEN 1 AND 45)) AS out_of_range, count(*) FILTER (WHERE l_quantity IS NULL) AS null_rows FROM lineitem
       UNION ALL
       SELECT 'l_shipdate', strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S'), strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S'),
              count(*) FILTER (WHERE NOT (l_shipdate BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '2001-06-01')),
              count(*) FILTER (WHERE l_shipdate IS NULL) FROM lineitem""",
)
def range_anomalies(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("bigint"))
    return integrity.range_anomalies(
        lines,
        {
            "l_quantity": ("1", "45"),
            "l_shipdate": ("TIMESTAMP_NTZ '1995-06-01'", "TIMESTAMP_NTZ '2001-06-01'"),
        },
    )


@plan(
    "rule_violations",
    "P10 P7",
    "",
    """SELECT 'discount_below_tax' AS rule, count(*) FILTER (WHERE NOT (l_discount < l_tax)) AS violations FROM lineitem
       UNION ALL SELECT 'large_or_cheap', count(*) FILTER (WHERE NOT (l_quantity > 10 OR l_extendedprice < 20000)) FROM lineitem
       UNION ALL SELECT 'flag_unless_a', count(*) FILTER (WHERE NOT (nullif(l_returnflag, 'A') = 'N')) FROM lineitem""",
)
def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    return integrity.violations(
        table(spark, d, "lineitem"),
        {
            "discount_below_tax": F.expr("l_discount < l_tax"),
            "large_or_cheap": F.expr("l_quantity > 10 OR l_extendedprice < 20000"),
            "flag_unless_a": F.expr("nullif(l_returnflag, 'A') = 'N'"),
        },
    )


@plan(
    "object_parity",
    "R14 U2 P5",
    "target_orders",
    """s AS (SELECT o_orderpriority AS object_type, count(*) AS n FROM orders GROUP BY 1),
       t AS (SELECT o_orderpriority AS object_type, count(*) AS n FROM target_orders GROUP BY 1),
       k AS (SELECT object_type FROM s UNION SELECT object_type FROM t UNION SELECT 'NONE')
       SELECT object_type, coalesce(s.n, 0) AS source_count, coalesce(t.n, 0) AS target_count,
              CASE WHEN coalesce(s.n, 0) = coalesce(t.n, 0) THEN 'MATCH' ELSE 'MISMATCH' END AS status
       FROM k LEFT JOIN s USING (object_type) LEFT JOIN t USING (object_type)""",
)
def object_parity(spark: SparkSession, d: str) -> DataFrame:
    source, target = (df.withColumnRenamed("o_orderpriority", "object_type") for df in _pair(spark, d))
    return integrity.object_parity(source, target, ["NONE"])


@plan(
    "schema_parity",
    "R14 Q3 R13",
    "",
    """n AS (SELECT count(l_discount) AS a, count(l_linenumber) AS b, count(nullif(l_returnflag, 'A')) AS c FROM lineitem)
       SELECT 'l_discount' AS column_name, 'double' AS old_type, CAST(NULL AS VARCHAR) AS new_type, a AS old_filled, CAST(NULL AS BIGINT) AS new_filled, 'REMOVED' AS change FROM n
       UNION ALL SELECT 'l_linenumber', 'int', 'bigint', b, b, 'RETYPED' FROM n
       UNION ALL SELECT 'l_note', NULL, 'string', NULL, c, 'ADDED' FROM n""",
)
def schema_parity(spark: SparkSession, d: str) -> DataFrame:
    """Column drift with the number of filled rows behind each column."""
    lines = table(spark, d, "lineitem")
    changed = lines.drop("l_discount").withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))
    changed = changed.withColumn("l_note", F.nullif(F.col("l_returnflag"), F.lit("A")))
    return integrity.schema_drift(integrity.column_profile(lines), integrity.column_profile(changed))


@plan(
    "document_schema_drift",
    "Q3 R14",
    "",
    """k AS (SELECT ts, unnest(json_keys(props)) AS column_name, props FROM events),
       b AS (SELECT column_name, 'number' AS t, count(*) AS n FROM k WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
       a AS (SELECT column_name, 'text' AS t, count(*) AS n FROM k WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1
             UNION ALL SELECT 'kind', 'text', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-16')
       SELECT column_name, b.t AS old_type, a.t AS new_type, b.n AS old_filled, a.n AS new_filled,
              CASE WHEN b.t IS NULL THEN 'ADDED' WHEN a.t IS NULL THEN 'REMOVED' ELSE 'RETYPED' END AS change
       FROM b FULL JOIN a USING (column_name) WHERE a.t IS DISTINCT FROM b.t""",
)
def document_schema_drift(spark: SparkSession, d: str) -> DataFrame:
    """Fields and value kinds seen in JSON documents before and after a date; later ones gain a field and quote their values."""
    events = table(spark, d, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    quoted = F.transform_values("m", lambda _, v: F.concat(F.lit("#"), v))
    later = F.map_concat(quoted, F.create_map(F.lit("kind"), F.col("event_type")))
    return integrity.schema_drift(
        integrity.document_profile(events.where(early), "m"),
        integrity.document_profile(events.where(~early).withColumn("m", later), "m"),
    )


@plan(
    "id_gaps",
    "R15",
    "target_orders",
    """g AS (SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS b FROM (SELECT DISTINCT o_orderkey FROM target_orders))
       SELECT b + 1 AS gap_start, o_orderkey - 1 AS gap_end, o_orderkey - b - 1 AS missing_ids FROM g WHERE o_orderkey - b > 1""",
)
def id_gaps(spark: SparkSession, d: str) -> DataFrame:
    return integrity.id_gaps(target_orders(spark, d), "o_orderkey", width=1000)


@plan(
    "max_id",
    "R15 A7",
    "target_orders",
    """SELECT (SELECT max(o_orderkey) FROM orders) AS source_max, (SELECT max(o_orderkey) FROM target_orders) AS target_max""",
)
def max_id(spark: SparkSession, d: str) -> DataFrame:
    source, target = _pair(spark, d)
    return source.agg(F.max("o_orderkey").alias("source_max")).select(
        "source_max", target.agg(F.max("o_orderkey")).scalar().alias("target_max")
    )


@plan(
    "daily_completeness",
    "R16 A14",
    "",
    """c AS (SELECT CAST(unnest(generate_series(DATE '2024-01-26', DATE '2024-02-01', INTERVAL 1 DAY)) AS DATE) AS day),
       n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
       SELECT day, coalesce(n, 0) AS rows FROM c LEFT JOIN n USING (day)""",
)
def daily_completeness(spark: SparkSession, d: str) -> DataFrame:
    return integrity.daily_completeness(table(spark, d, "events"), "ts", "2024-02-01")


@plan(
    "balance_invariant",
    "R17 A8",
    "",
    """SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DECIMAL(28,2)) AS balance
       FROM lineitem GROUP BY 1 HAVING sum(CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END) <> 0""",
)
def balance_invariant(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    signed = F.when(F.col("l_returnflag") == "R", -price).otherwise(price).cast("decimal(18,2)")
    return integrity.unbalanced(table(spark, d, "lineitem"), ["l_suppkey"], signed)


@plan(
    "business_parity",
    "R18 F9 A1",
    "target_orders",
    """s AS (SELECT CAST(o_orderdate AS DATE) AS business_date, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS g FROM orders GROUP BY 1),
       t AS (SELECT CAST(o_orderdate AS DATE) AS business_date, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS g FROM target_orders GROUP BY 1)
       SELECT business_date, coalesce(s.n, 0) AS source_orders, coalesce(t.n, 0) AS target_orders,
              CAST(coalesce(s.g, 0) AS DECIMAL(28,2)) AS source_sales, CAST(coalesce(t.g, 0) AS DECIMAL(28,2)) AS target_sales
       FROM s FULL JOIN t USING (business_date)""",
)
def business_parity(spark: SparkSession, d: str) -> DataFrame:
    source, target = _pair(spark, d)

    def daily(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy(F.to_date("o_orderdate").alias("business_date")).agg(
            F.count("*").alias(f"{p}_orders"), money_sum(F.col("o_totalprice")).alias(f"{p}_sales")
        )

    joined = daily(source, "source").join(daily(target, "target"), "business_date", "full")
    return joined.fillna(0, ["source_orders", "target_orders"]).select(
        "business_date",
        "source_orders",
        "target_orders",
        *[F.coalesce(f"{p}_sales", F.lit(0).cast("decimal(28,2)")).alias(f"{p}_sales") for p in ("source", "target")],
    )


SALES = ("{0} AS (SELECT {1}, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS v FROM {2} {3} GROUP BY 1)")


@plan(
    "business_parity_deltas",
    "R18 F9 A1 J4",
    "target_orders",
    SALES.format("s", "CAST(o_orderdate AS DATE) AS business_date", "orders", "")
    + ", "
    + SALES.format("t", "CAST(o_orderdate AS DATE) AS business_date", "target_orders", "")
    + """ SELECT business_date, coalesce(s.n, 0) AS source_orders, coalesce(t.n, 0) AS target_orders, coalesce(t.n, 0) - coalesce(s.n, 0) AS orders_delta,
                 CAST(coalesce(s.v, 0) AS DECIMAL(28,2)) AS source_sales, CAST(coalesce(t.v, 0) AS DECIMAL(28,2)) AS target_sales,
                 CAST(coalesce(t.v, 0) - coalesce(s.v, 0) AS DECIMAL(29,2)) AS sales_delta FROM s FULL JOIN t USING (business_date)""",
)
def business_parity_deltas(spark: SparkSession, d: str) -> DataFrame:
    source, target = (df.withColumn("business_date", F.to_date("o_orderdate")) for df in _pair(spark, d))
    return integrity.parity_by(source, target, ["business_date"], {"orders": F.count("*"), "sales": money_sum(F.col("o_totalprice"))})


@plan(
    "top_customers_parity",
    "R18 K1 J4",
    "target_orders",
    SALES.format("s", "o_custkey", "orders", "")
    + ", "
    + SALES.format("t", "o_custkey", "target_orders", "")
    + """, rs AS (SELECT o_custkey, v, row_number() OVER (ORDER BY v DESC, o_custkey) AS r FROM s), rt AS (SELECT o_custkey, v, row_number() OVER (ORDER BY v DESC, o_custkey) AS r FROM t)
         SELECT o_custkey, CAST(coalesce(rs.v, 0) AS DECIMAL(28,2)) AS source_value, CAST(coalesce(rt.v, 0) AS DECIMAL(28,2)) AS target_value,
                CAST(coalesce(rt.v, 0) - coalesce(rs.v, 0) AS DECIMAL(29,2)) AS value_delta,
                CAST(CASE WHEN rs.r <= 50 THEN rs.r END AS INTEGER) AS source_rank, CAST(CASE WHEN rt.r <= 50 THEN rt.r END AS INTEGER) AS target_rank
         FROM rs FULL JOIN rt USING (o_custkey) WHERE rs.r <= 50 OR rt.r <= 50""",
)
def top_customers_parity(spark: SparkSession, d: str) -> DataFrame:
    return integrity.top_parity(*_pair(spark, d), "o_custkey", money_sum(F.col("o_totalprice")))


@plan(
    "backlog_parity",
    "R18 P5 J4",
    "target_orders",
    SALES.format("s", "o_orderstatus", "orders", "WHERE o_orderstatus IN ('O', 'P', 'X')")
    + ", "
    + SALES.format("t", "o_orderstatus", "target_orders", "WHERE o_orderstatus IN ('O', 'P', 'X')")
    + """ SELECT o_orderstatus, coalesce(s.n, 0) AS source_orders, coalesce(t.n, 0) AS target_orders, coalesce(t.n, 0) - coalesce(s.n, 0) AS orders_delta FROM s FULL JOIN t USING (o_orderstatus)""",
)
def backlog_parity(spark: SparkSession, d: str) -> DataFrame:
    source, target = (df.where(F.col("o_orderstatus").isin("O", "P", "X")) for df in _pair(spark, d))
    return integrity.parity_by(source, target, ["o_orderstatus"], {"orders": F.count("*")})


@plan(
    "gate_tiers",
    "R21 R22",
    "target_orders",
    """k AS (SELECT coalesce(s.o_orderpriority, t.o_orderpriority) AS table_name, s.o_orderkey IS NOT NULL AND t.o_orderkey IS NOT NULL AND s.o_custkey IS NOT DISTINCT FROM t.o_custkey
                    AND s.o_orderstatus IS NOT DISTINCT FROM t.o_orderstatus AND s.o_totalprice IS NOT DISTINCT FROM t.o_totalprice AND s.o_orderdate IS NOT DISTINCT FROM t.o_orderdate AS same
             FROM orders s FULL JOIN target_orders t ON s.o_orderkey = t.o_orderkey AND s.o_orderpriority = t.o_orderpriority),
       r AS (SELECT table_name, round(100.0 * (CAST(count(*) FILTER (WHERE same OR table_name LIKE '5%') AS DOUBLE) / count(*)), 4) AS match_pct FROM k GROUP BY 1),
       g AS (SELECT *, CASE WHEN table_name LIKE '4%' OR table_name LIKE '5%' THEN 'LOW' ELSE 'HIGH' END AS tier FROM r),
       h AS (SELECT *, CASE WHEN tier = 'LOW' THEN 99.99 ELSE 100.0 END AS threshold FROM g)
       SELECT table_name, match_pct, tier, CAST(threshold AS DOUBLE) AS threshold, CASE WHEN match_pct >= threshold THEN 'PASS' ELSE 'FAIL' END AS status FROM h""",
)
def gate_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Order priorities stand for tables; those of class 4 and 5 are low-risk, and what differs in class 5 has been accepted."""
    rest = [c for c in COMPARED if c != "o_orderpriority"]
    status = diff.key_status(*_pair(spark, d), ["o_orderpriority", "o_orderkey"], rest)
    same = (F.col("status") == "SAME") | F.col("o_orderpriority").startswith("5")
    pct = F.round(F.lit(100.0) * ratio_or_null(F.count_if(same), F.count("*")), 4)
    rates = status.groupBy(F.col("o_orderpriority").alias("table_name")).agg(pct.alias("match_pct"))
    return compare.tier_gate(rates, F.col("table_name").rlike("^[45]"))


@plan(
    "top_customers",
    "R18 K1",
    "",
    """SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS revenue
       FROM orders GROUP BY 1 ORDER BY revenue DESC, o_custkey LIMIT 50""",
)
def top_customers(spark: SparkSession, d: str) -> DataFrame:
    totals = table(spark, d, "orders").groupBy("o_custkey").agg(money_sum(F.col("o_totalprice")).alias("revenue"))
    return totals.orderBy(F.desc("revenue"), "o_custkey").limit(50)


@plan(
    "open_backlog",
    "R18 P5",
    "target_orders",
    """SELECT o_orderstatus, count(*) AS orders FROM target_orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1""",
)
def open_backlog(spark: SparkSession, d: str) -> DataFrame:
    backlog = target_orders(spark, d).where(F.col("o_orderstatus").isin("O", "P"))
    return backlog.groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


@plan(
    "period_over_period",
    "R19 W6",
    "",
    """m AS (SELECT n_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
             FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
       SELECT n_name, period, total, lag(total) OVER (PARTITION BY n_name ORDER BY period) AS previous_total,
              CAST(total - lag(total) OVER (PARTITION BY n_name ORDER BY period) AS DECIMAL(29,2)) AS change FROM m""",
)
def period_over_period(spark: SparkSession, d: str) -> DataFrame:
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    monthly = table(spark, d, "orders").groupBy("o_custkey", month.alias("month")).agg(
        money_sum(F.col("o_totalprice")).alias("sales")
    )
    joined = monthly.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    total = F.sum("sales").cast("decimal(28,2)")
    return integrity.period_over_period(joined, ["n_name"], F.col("month"), total)


GATE_SQL = (
    STATE_SQL
    + """, k AS (
      SELECT 'count_match_pct' AS check_name, round(CAST(100.0 AS DOUBLE) * count(*) FILTER (WHERE count_match) / count(*), 4) AS observed, '>=' AS op, CAST(100.0 AS DOUBLE) AS threshold FROM v
      UNION ALL SELECT 'hash_match_pct', round(CAST(100.0 AS DOUBLE) * count(*) FILTER (WHERE hash_match) / count(*), 4), '>=', 100.0 FROM v
      UNION ALL SELECT 'ops_match_pct', round(CAST(100.0 AS DOUBLE) * count(*) FILTER (WHERE update_match AND delete_match) / count(*), 4), '>=', 100.0 FROM v
      UNION ALL SELECT 'lag_minutes', round(CAST(date_sub('second', max(ts), TIMESTAMP '2024-01-31 00:00:00') AS DOUBLE) / 60, 4), '<', 5.0 FROM events
      UNION ALL SELECT 'fk_orphans', CAST(count(*) AS DOUBLE), '<=', 0.0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))"""
)


def _gate(spark: SparkSession, d: str) -> DataFrame:
    compared = _compared(spark, d)

    def pct(flag) -> F.Column:
        return F.round(F.lit(100.0) * F.count_if(flag).cast("double") / F.count("*").cast("double"), 4)

    rates = compared.agg(
        pct(F.col("count_match")).alias("count_match_pct"),
        pct(F.col("hash_match")).alias("hash_match_pct"),
        pct(F.col("update_match") & F.col("delete_match")).alias("ops_match_pct"),
    ).unpivot([], ["count_match_pct", "hash_match_pct", "ops_match_pct"], "check_name", "observed")
    least = {"count_match_pct": compare.GATE_COUNT_PCT, "hash_match_pct": compare.GATE_HASH_PCT, "ops_match_pct": compare.GATE_OPS_PCT}
    threshold = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("check_name")]
    rates = rates.select("check_name", "observed", F.lit(">=").alias("op"), threshold.alias("threshold"))
    newest = table(spark, d, "events").agg(F.max("ts").alias("ts"))
    seconds = F.timestamp_diff("SECOND", F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    lag = newest.select(
        F.lit("lag_minutes").alias("check_name"),
        F.round(seconds.cast("double") / 60.0, 4).alias("observed"),
        F.lit("<").alias("op"),
        F.lit(compare.GATE_LAG_MINUTES).alias("threshold"),
    )
    lost = integrity.orphans(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "c_custkey").agg(
        F.lit("fk_orphans").alias("check_name"),
        F.count("*").cast("double").alias("observed"),
        F.lit("<=").alias("op"),
        F.lit(0.0).alias("threshold"),
    )
    return compare.gate(rates.unionByName(lag).unionByName(lost))


@plan(
    "gate",
    "R21",
    "target_orders",
    GATE_SQL
    + """ SELECT *, CASE WHEN (op = '>=' AND observed >= threshold) OR (op = '<' AND observed < threshold)
                           OR (op = '<=' AND observed <= threshold) THEN 'PASS' ELSE 'FAIL' END AS status FROM k""",
)
def go_no_go(spark: SparkSession, d: str) -> DataFrame:
    return _gate(spark, d)


@plan(
    "gate_verdict",
    "R21",
    "target_orders",
    GATE_SQL
    + """, g AS (SELECT *, (op = '>=' AND observed >= threshold) OR (op = '<' AND observed < threshold)
                           OR (op = '<=' AND observed <= threshold) AS ok FROM k)
         SELECT count(*) AS checks, count(*) FILTER (WHERE NOT ok) AS failed,
                CASE WHEN bool_and(ok) THEN 'GO' ELSE 'NO-GO' END AS decision FROM g""",
)
def gate_verdict(spark: SparkSession, d: str) -> DataFrame:
    return compare.verdict(_gate(spark, d))


@plan(
    "policy_severity",
    "R22",
    "target_orders",
    STATE_SQL
    + """ SELECT table_name, severity, CASE WHEN severity = 'OK' THEN 'OK' WHEN table_name = '5-LOW' THEN 'Sev-3'
               WHEN table_name IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED') THEN 'Sev-1' ELSE 'Sev-2' END AS policy_severity FROM v""",
)
def policy_severity(spark: SparkSession, d: str) -> DataFrame:
    exceptions = inline_rows(
        spark, [("5-LOW", "2024-03-01"), ("2-HIGH", "2024-01-15")], "table_name string, expiry_date date"
    )
    critical = ["1-URGENT", "2-HIGH", "4-NOT SPECIFIED"]
    out = compare.policy_severity(_compared(spark, d), critical, exceptions, "2024-02-01")
    return out.select("table_name", "severity", "policy_severity")


@plan(
    "summary_metrics",
    "R25 A5 A6",
    "",
    """m AS (SELECT count(*) AS a, count(DISTINCT o_custkey) AS b, max(o_orderkey) AS c FROM orders)
       SELECT 'rows' AS metric, CAST(a AS DOUBLE) AS value FROM m UNION ALL SELECT 'customers', CAST(b AS DOUBLE) FROM m
       UNION ALL SELECT 'max_key', CAST(c AS DOUBLE) FROM m""",
)
def summary_metrics(spark: SparkSession, d: str) -> DataFrame:
    metrics = {"rows": F.count("*"), "customers": F.countDistinct("o_custkey"), "max_key": F.max("o_orderkey")}
    return summary.metric_rows(table(spark, d, "orders"), metrics)


@plan(
    "pk_coverage",
    "R26",
    "",
    """SELECT s_name AS table_name, count(l_suppkey) AS row_estimate,
              CASE WHEN s_acctbal > 0 THEN 'PK_PRESENT' ELSE 'NO_PK' END AS pk_status
       FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_name, s_acctbal""",
)
def pk_coverage(spark: SparkSession, d: str) -> DataFrame:
    supplier = table(spark, d, "supplier")
    counts = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    estimates = supplier.join(counts, "s_suppkey", "left").select(
        F.col("s_name").alias("table_name"), F.coalesce("n", F.lit(0).cast("bigint")).alias("row_estimate")
    )
    keyed = supplier.where("s_acctbal > 0").select(F.col("s_name").alias("table_name"))
    return integrity.key_coverage(estimates, keyed)


@plan(
    "replay_sanity",
    "R27",
    "",
    """l AS (SELECT event_type AS table_name, event_id, (event_id * 7919) % 100003 AS position FROM events),
       a AS (SELECT *, lag(position) OVER (PARTITION BY table_name ORDER BY event_id) AS b FROM l),
       p AS (SELECT DISTINCT table_name, position FROM l),
       g AS (SELECT table_name, position, lag(position) OVER (PARTITION BY table_name ORDER BY position) AS b FROM p),
       j AS (SELECT table_name, count(*) FILTER (WHERE position - b > 1) AS position_gaps FROM g GROUP BY 1)
       SELECT table_name, count(*) AS changes, count(*) FILTER (WHERE position < b) AS out_of_order, max(position) AS newest_position, max(position_gaps) AS position_gaps
       FROM a JOIN j USING (table_name) GROUP BY 1""",
)
def replay_sanity(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").selectExpr(
        "event_type AS table_name", "event_id", "(event_id * 7919) % 100003 AS position"
    )
    return cdc.replay_sanity(log, "event_id", "position", ["table_name"])


@plan(
    "presence_by_side",
    "T57",
    "target_orders",
    """p AS (SELECT o_orderkey FROM orders), r AS (SELECT o_orderkey FROM target_orders),
       q AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'),
       k AS (SELECT o_orderkey FROM p UNION SELECT o_orderkey FROM r UNION SELECT o_orderkey FROM q),
       h AS (SELECT o_orderkey, o_orderkey IN (SELECT o_orderkey FROM p) AS a, o_orderkey IN (SELECT o_orderkey FROM r) AS b,
                    o_orderkey IN (SELECT o_orderkey FROM q) AS c FROM k)
       SELECT o_orderkey, concat_ws(',', CASE WHEN a THEN 'primary' END, CASE WHEN b THEN 'replica1' END, CASE WHEN c THEN 'replica2' END) AS present_on,
              CASE WHEN a AND b AND c THEN 'EVERYWHERE' WHEN a AND NOT b AND NOT c THEN 'PRIMARY_ONLY'
                   WHEN NOT a THEN 'MISSING_ON_PRIMARY' ELSE 'PARTIAL' END AS presence FROM h""",
)
def presence_by_side(spark: SparkSession, d: str) -> DataFrame:
    source, target = _pair(spark, d)
    sides = {"primary": source, "replica1": target, "replica2": source.where("o_orderstatus <> 'P'")}
    return diff.presence(sides, ["o_orderkey"])


def _scope(source: DataFrame, target: DataFrame) -> DataFrame:
    return diff.drifted_keys(source, target, ["o_orderkey"], COMPARED)


@plan(
    "repair_insert",
    "M5 J5 J7",
    "target_orders",
    """SELECT * FROM target_orders UNION ALL
       SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM target_orders)""",
)
def repair_insert(spark: SparkSession, d: str) -> DataFrame:
    source, target = _pair(spark, d)
    return repair.insert_missing(source, target, _scope(source, target), ["o_orderkey"])


@plan(
    "repair_delete",
    "M6 J6 J7",
    "target_orders",
    "SELECT * FROM target_orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders)",
)
def repair_delete(spark: SparkSession, d: str) -> DataFrame:
    source, target = _pair(spark, d)
    return repair.delete_extra(source, target, _scope(source, target), ["o_orderkey"])


@plan(
    "repair_update",
    "M7 J7",
    "target_orders",
    """SELECT o_orderkey, coalesce(s.o_custkey, t.o_custkey) AS o_custkey, coalesce(s.o_orderstatus, t.o_orderstatus) AS o_orderstatus,
              coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice, coalesce(s.o_orderdate, t.o_orderdate) AS o_orderdate,
              coalesce(s.o_orderpriority, t.o_orderpriority) AS o_orderpriority
       FROM target_orders t LEFT JOIN orders s USING (o_orderkey)""",
)
def repair_update(spark: SparkSession, d: str) -> DataFrame:
    source, target = _pair(spark, d)
    return repair.update_changed(source, target, _scope(source, target), ["o_orderkey"])


@plan("repair_full", "M5 M6 M7 R23", "", "SELECT * FROM orders")
def repair_full(spark: SparkSession, d: str) -> DataFrame:
    source, target = _pair(spark, d)
    return repair.repair(source, target, _scope(source, target), ["o_orderkey"])


@plan(
    "repair_verify",
    "R23 R7",
    "target_orders",
    STATUS_SQL
    + """, b AS (SELECT DISTINCT CAST(floor(o_orderkey / 100) AS BIGINT) AS g FROM st WHERE status <> 'SAME'),
         a AS (SELECT DISTINCT g + unnest([-1, 0, 1]) AS segment FROM b),
         n AS (SELECT CAST(floor(o_orderkey / 100) AS BIGINT) AS segment, count(*) AS n FROM orders GROUP BY 1)
         SELECT segment, n AS source_count, n AS target_count, CAST(0 AS BIGINT) AS count_delta, true AS hash_match FROM n JOIN a USING (segment)""",
)
def repair_verify(spark: SparkSession, d: str) -> DataFrame:
    source, target = _pair(spark, d)
    scope = _scope(source, target)
    repaired = repair.repair(source, target, scope, ["o_orderkey"])
    return repair.verify(source, repaired, scope, SPEC, "o_orderkey", 100, WINDOW_START, WINDOW_END)


@plan(
    "repair_residual",
    "R23 R6",
    "",
    "SELECT 'SAME' AS status, count(*) AS keys FROM orders",
)
def repair_residual(spark: SparkSession, d: str) -> DataFrame:
    source, target = _pair(spark, d)
    repaired = repair.repair(source, target, _scope(source, target), ["o_orderkey"])
    return repair.residual(source, repaired, ["o_orderkey"], COMPARED)


@plan(
    "repair_delta_merge",
    "M8",
    "change_log seed",
    """n AS (SELECT id, max_by(op, (ts, event_id)) AS op, max_by(amount, (ts, event_id)) AS amount, max_by(status, (ts, event_id)) AS status FROM change_log GROUP BY id)
       SELECT id, CASE WHEN n.op IS NULL THEN seed.amount ELSE n.amount END AS amount, CASE WHEN n.op IS NULL THEN seed.status ELSE n.status END AS status
       FROM seed FULL JOIN n USING (id) WHERE n.op IS DISTINCT FROM 'D'""",
)
def repair_delta_merge(spark: SparkSession, d: str) -> DataFrame:
    return cdc.apply_full(seed(spark, d), change_log(spark, d), ["id"])
