"""Change-log queries over ``events`` read as an ordered log per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cdc, integrity
from tidemark.plans.fixtures import AS_OF, RUN_TS, change_log, seed, table
from tidemark.plans.registry import plan
from tidemark.session import inline_rows, materialize

ORDER = ["ts", "event_id"]

NET_SQL = """n AS (SELECT id, max_by(op, (ts, event_id)) AS op, max_by(amount, (ts, event_id)) AS amount,
                         max_by(status, (ts, event_id)) AS status FROM change_log GROUP BY id)"""


def position_log(spark: SparkSession, d: str) -> DataFrame:
    """The log with a table name per event type and event_id as position."""
    return table(spark, d, "events").select(
        F.col("event_type").alias("table_name"), F.col("event_id").alias("scn"), "ts", F.col("user_id").alias("id")
    )


@plan("cdc_net", "M1", "change_log", NET_SQL + " SELECT id, op, amount, status FROM n")
def cdc_net(spark: SparkSession, d: str) -> DataFrame:
    return cdc.net_changes(change_log(spark, d), ["id"], ["amount", "status"]).drop("seq")


@plan(
    "cdc_apply",
    "M1 M8",
    "change_log seed",
    NET_SQL
    + """ SELECT id, CASE WHEN n.op IS NULL THEN seed.amount ELSE n.amount END AS amount,
                 CASE WHEN n.op IS NULL THEN seed.status ELSE n.status END AS status
          FROM seed FULL JOIN n USING (id) WHERE n.op IS DISTINCT FROM 'D'""",
)
def cdc_apply(spark: SparkSession, d: str) -> DataFrame:
    return cdc.apply_full(seed(spark, d), change_log(spark, d), ["id"])


def partial_log(spark: SparkSession, d: str) -> DataFrame:
    """Updates carry one column: clicks the amount, views the status, purchases an explicit null status."""
    amount, status = F.col("amount").cast("string"), F.col("status")
    data = (
        F.when(F.col("status") == "click", F.create_map(F.lit("amount"), amount))
        .when(F.col("status") == "view", F.create_map(F.lit("status"), status))
        .when(F.col("status") == "purchase", F.create_map(F.lit("status"), F.lit(None).cast("string")))
        .otherwise(F.create_map(F.lit("amount"), amount, F.lit("status"), status))
    )
    return change_log(spark, d).select("id", "ts", "event_id", "seq", "op", data.alias("data"))


PARTIAL_SQL = """
    r AS (SELECT id, max((ts, event_id)) FILTER (WHERE op IN ('I', 'D')) AS since, max_by(op, (ts, event_id)) AS op FROM change_log GROUP BY id),
    j AS (SELECT c.*, r.since FROM change_log c JOIN r USING (id)),
    a AS (SELECT id, max_by(amount, (ts, event_id)) AS amount, true AS hit FROM j
          WHERE op <> 'D' AND status IN ('click', 'signup') AND (since IS NULL OR (ts, event_id) >= since) GROUP BY id),
    b AS (SELECT id, arg_max_null(CASE WHEN status = 'purchase' THEN NULL ELSE status END, (ts, event_id)) AS status, true AS hit FROM j
          WHERE op <> 'D' AND status IN ('view', 'signup', 'purchase') AND (since IS NULL OR (ts, event_id) >= since) GROUP BY id)"""


@plan(
    "cdc_apply_partial",
    "M4 M1 F15",
    "change_log seed",
    PARTIAL_SQL
    + """ SELECT id, CASE WHEN a.hit THEN a.amount WHEN r.since IS NULL THEN seed.amount END AS amount,
                 CASE WHEN b.hit THEN b.status WHEN r.since IS NULL THEN seed.status END AS status
          FROM seed FULL JOIN r USING (id) LEFT JOIN a USING (id) LEFT JOIN b USING (id)
          WHERE r.op IS DISTINCT FROM 'D'""",
)
def cdc_apply_partial(spark: SparkSession, d: str) -> DataFrame:
    return cdc.apply_partial(seed(spark, d), partial_log(spark, d), ["id"])


@plan(
    "cdc_apply_partial_strict",
    "M1 M11",
    "change_log seed",
    PARTIAL_SQL
    + """ SELECT id, CASE WHEN a.hit THEN a.amount WHEN r.since IS NULL THEN seed.amount END AS amount,
                 CASE WHEN b.hit THEN b.status WHEN r.since IS NULL THEN seed.status END AS status
          FROM seed FULL JOIN r USING (id) LEFT JOIN a USING (id) LEFT JOIN b USING (id)
          WHERE r.op IS DISTINCT FROM 'D' AND (seed.id IS NOT NULL OR r.since IS NOT NULL)""",
)
def cdc_apply_partial_strict(spark: SparkSession, d: str) -> DataFrame:
    return cdc.apply_partial(seed(spark, d), partial_log(spark, d), ["id"], create=False)


@plan(
    "opcode_apply",
    "M2 M3 F17",
    "seed",
    """c AS (SELECT user_id AS id, CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'I' WHEN 'purchase' THEN 'U' WHEN 'click' THEN 'U' END AS op,
                    CAST(value AS DECIMAL(18,2)) AS amount, event_type AS status, event_id FROM events WHERE event_type <> 'view' AND user_id <> 0),
       n AS (SELECT id, max_by(op, event_id) AS op, max_by(amount, event_id) AS amount, max_by(status, event_id) AS status FROM c GROUP BY id)
       SELECT id, CASE WHEN n.op IS NULL THEN seed.amount ELSE n.amount END AS amount,
              CASE WHEN n.op IS NULL THEN seed.status ELSE n.status END AS status
       FROM seed FULL JOIN n USING (id) WHERE n.op IS DISTINCT FROM 'D'""",
)
def opcode_apply(spark: SparkSession, d: str) -> DataFrame:
    code = F.expr("CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE 4 END")
    captured = table(spark, d, "events").select(
        code.alias("__$operation"),
        F.lpad(F.lower(F.hex("event_id")), 20, "0").alias("__$start_lsn"),
        F.lpad(F.lower(F.hex("event_id")), 20, "0").alias("__$seqval"),
        F.nullif(F.col("user_id"), F.lit(0)).alias("id"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
        F.col("event_type").alias("status"),
    )
    return cdc.apply_full(seed(spark, d), cdc.flat_changes(captured, ["id"]), ["id"])


@plan(
    "cdc_window_read",
    "S16 F17",
    "",
    """SELECT lpad(lower(to_hex(event_id)), 20, '0') AS lsn, event_type, user_id FROM events
       WHERE lpad(lower(to_hex(event_id)), 20, '0') BETWEEN '00000000000000000100' AND '00000000000000001fff'""",
)
def cdc_window_read(spark: SparkSession, d: str) -> DataFrame:
    """The log stores its position, so the window reaches the scan."""
    events = table(spark, d, "events")
    log = materialize(events.select(F.lpad(F.lower(F.hex("event_id")), 20, "0").alias("lsn"), "event_type", "user_id"), "log")
    return cdc.in_window(log, "lsn", "00000000000000000100", "00000000000000001fff")


@plan(
    "cdc_dedup",
    "M15",
    "change_log",
    "SELECT id, event_id, op, amount FROM change_log",
)
def cdc_dedup(spark: SparkSession, d: str) -> DataFrame:
    log = change_log(spark, d).select("id", "event_id", "op", "amount")
    return cdc.dedupe(log.unionByName(log.where("op <> 'I'")).unionByName(log), ["id", "event_id", "op", "amount"])


CONFLICT_SQL = """
    m AS (SELECT *, last_value(CASE WHEN op IN ('I', 'D') THEN op END IGNORE NULLS) OVER
                    (PARTITION BY id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM change_log),
    x AS (SELECT m.*, CASE WHEN b IS NOT NULL THEN b = 'I' ELSE seed.id IS NOT NULL END AS held FROM m LEFT JOIN seed ON m.id = seed.id),
    k AS (SELECT id, ts, event_id, op, amount, status, CASE WHEN op = 'I' AND held THEN 'DUPLICATE_INSERT' WHEN op = 'U' AND NOT held THEN 'MISSING_ON_UPDATE'
                      WHEN op = 'D' AND NOT held THEN 'MISSING_ON_DELETE' ELSE 'NONE' END AS conflict FROM x)"""


@plan("cdc_conflicts", "M11", "change_log seed", CONFLICT_SQL + " SELECT event_id, id, op, conflict FROM k")
def cdc_conflicts(spark: SparkSession, d: str) -> DataFrame:
    marked = cdc.conflicts(seed(spark, d), change_log(spark, d), ["id"], ORDER)
    return marked.select("event_id", "id", "op", "conflict")


@plan(
    "cdc_conflict_apply",
    "M11 M1",
    "change_log seed",
    CONFLICT_SQL
    + """, z AS (SELECT * FROM k WHERE conflict = 'NONE'),
         n AS (SELECT id, max_by(op, (ts, event_id)) AS op, max_by(amount, (ts, event_id)) AS amount, max_by(status, (ts, event_id)) AS status FROM z GROUP BY id)
         SELECT id, CASE WHEN n.op IS NULL THEN seed.amount ELSE n.amount END AS amount,
                CASE WHEN n.op IS NULL THEN seed.status ELSE n.status END AS status
         FROM seed FULL JOIN n USING (id) WHERE n.op IS DISTINCT FROM 'D'""",
)
def cdc_conflict_apply(spark: SparkSession, d: str) -> DataFrame:
    marked = cdc.conflicts(seed(spark, d), change_log(spark, d), ["id"], ORDER)
    return cdc.apply_full(seed(spark, d), cdc.resolve_conflicts(marked, "SKIP", "SKIP"), ["id"])


@plan(
    "cdc_tallies",
    "M13",
    "change_log seed",
    CONFLICT_SQL
    + """ SELECT status AS table_name, count(*) FILTER (WHERE conflict = 'NONE') AS applied,
                 count(*) FILTER (WHERE conflict <> 'NONE') AS failed FROM k GROUP BY 1""",
)
def cdc_tallies(spark: SparkSession, d: str) -> DataFrame:
    marked = cdc.conflicts(seed(spark, d), change_log(spark, d), ["id"], ORDER).withColumn("table_name", F.col("status"))
    return cdc.batch_tallies(marked, F.when(F.col("conflict") == "NONE", "APPLIED").otherwise("FAILED"))


MARKS = [("click", 1000, "2024-01-05 00:00:00", 7), ("view", 2000, "2024-01-06 00:00:00", 9), ("idle", 5, "2024-01-01 00:00:00", 1)]
MARKS_SQL = """marks AS (SELECT * FROM (VALUES ('click', CAST(1000 AS BIGINT), TIMESTAMP '2024-01-05', CAST(7 AS BIGINT)),
                                 ('view', 2000, TIMESTAMP '2024-01-06', 9), ('idle', 5, TIMESTAMP '2024-01-01', 1)) v(table_name, last_scn, last_timestamp, rows_applied))"""


def marks(spark: SparkSession) -> DataFrame:
    return inline_rows(
        spark, MARKS, "table_name string, last_scn bigint, last_timestamp timestamp_ntz, rows_applied bigint"
    )


@plan(
    "cdc_resume",
    "M10",
    "",
    MARKS_SQL
    + """ SELECT event_type AS table_name, event_id AS scn, ts, user_id AS id FROM events LEFT JOIN marks ON event_type = table_name
          WHERE event_id > coalesce(last_scn, 0)""",
)
def cdc_resume(spark: SparkSession, d: str) -> DataFrame:
    return cdc.after_checkpoint(position_log(spark, d), marks(spark))


@plan(
    "cdc_checkpoint",
    "M9 M10",
    "",
    MARKS_SQL
    + """, f AS (SELECT event_type AS table_name, max(event_id) AS last_scn, max_by(ts, event_id) AS last_timestamp, count(*) AS rows_applied
                 FROM events LEFT JOIN marks ON event_type = table_name WHERE event_id > coalesce(last_scn, 0) GROUP BY 1),
          u AS (SELECT * FROM marks UNION ALL SELECT * FROM f)
          SELECT table_name, max(last_scn) AS last_scn, max_by(last_timestamp, last_scn) AS last_timestamp,
                 CAST(sum(rows_applied) AS BIGINT) AS rows_applied, TIMESTAMP '2024-02-01 00:00:00' AS updated_at FROM u GROUP BY 1""",
)
def cdc_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    stored = marks(spark)
    fresh = cdc.after_checkpoint(position_log(spark, d), stored)
    return cdc.advance_checkpoint(stored, fresh, RUN_TS)


@plan(
    "cdc_lag",
    "T30 F8 X9",
    "",
    MARKS_SQL
    + """, f AS (SELECT event_type AS table_name, max(event_id) AS last_scn, max_by(ts, event_id) AS last_timestamp FROM events GROUP BY 1),
          l AS (SELECT table_name, last_scn, round(CAST(date_sub('second', last_timestamp, TIMESTAMP '2024-01-31') AS DOUBLE) / 60.0, 2) AS lag_minutes FROM f)
          SELECT *, CASE WHEN lag_minutes < 5 THEN 'PASS' WHEN lag_minutes > 15 THEN 'ALERT' ELSE 'WARN' END AS status FROM l""",
)
def cdc_lag(spark: SparkSession, d: str) -> DataFrame:
    newest = position_log(spark, d).groupBy("table_name").agg(
        F.max("scn").alias("last_scn"), F.max_by("ts", "scn").alias("last_timestamp")
    )
    return cdc.checkpoint_lag(newest, AS_OF)


@plan(
    "cdc_scope",
    "M12 P5",
    "",
    """SELECT event_type AS table_name, count(*) AS changes,
              CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS replay_rank
       FROM events WHERE event_type IN ('signup', 'purchase', 'click', 'view') AND event_type NOT IN ('view') GROUP BY 1, 3""",
)
def cdc_scope(spark: SparkSession, d: str) -> DataFrame:
    scoped = cdc.in_scope(position_log(spark, d), ["signup", "purchase", "click", "view"], ["view"])
    counted = scoped.groupBy("table_name").agg(F.count("*").alias("changes"))
    return counted.withColumn("replay_rank", cdc.replay_rank(["signup", "purchase"]))


#: Columns that may refer to another table's key; the data decide which do.
CANDIDATE_LINKS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("part", "p_size", "lineitem", "l_linenumber"),
    ("events", "user_id", "customer", "c_custkey"),
    ("labels", "doc_id", "documents", "doc_id"),
]
LINKED = sorted({t for c in CANDIDATE_LINKS for t in (c[0], c[2])})
LINKS_SQL = "c AS (" + " UNION ALL ".join(
    f"SELECT '{child}' AS child, '{key}' AS child_key, '{parent}' AS parent, count(DISTINCT {key}) FILTER (WHERE {key} NOT IN (SELECT {parent_key} FROM {parent})) AS orphan_keys FROM {child}"
    for child, key, parent, parent_key in CANDIDATE_LINKS
) + ")"


def _link_orphans(spark: SparkSession, d: str) -> DataFrame:
    return integrity.link_orphans({t: table(spark, d, t) for t in LINKED}, CANDIDATE_LINKS)


@plan("link_orphans", "M12 R11", "", LINKS_SQL + " SELECT child, child_key, parent, orphan_keys FROM c")
def link_orphans(spark: SparkSession, d: str) -> DataFrame:
    return _link_orphans(spark, d)


@plan(
    "replay_layers",
    "M12",
    "",
    LINKS_SQL
    + f""", t AS (SELECT unnest({LINKED}) AS table_name),
       l AS (SELECT table_name, 0 AS layer FROM t UNION ALL SELECT c.child, l.layer + 1 FROM l JOIN c ON c.parent = l.table_name WHERE c.orphan_keys = 0)
       SELECT table_name, max(layer)::INT AS layer, 'READY' AS state FROM l GROUP BY 1""",
)
def replay_layers(spark: SparkSession, d: str) -> DataFrame:
    links = materialize(_link_orphans(spark, d).where("orphan_keys = 0"), "links")
    tables = inline_rows(spark, [(t,) for t in LINKED], "table_name string")
    return cdc.replay_layers(tables, links)


@plan(
    "cdc_history",
    "M14",
    "change_log",
    """h AS (SELECT *, lead(ts) OVER (PARTITION BY id ORDER BY ts, event_id) AS valid_to FROM change_log)
       SELECT id, event_id, amount, status, ts AS valid_from, valid_to, valid_to IS NULL AS is_current FROM h WHERE op <> 'D'""",
)
def cdc_history(spark: SparkSession, d: str) -> DataFrame:
    out = cdc.history(change_log(spark, d), ["id"], ORDER, "ts")
    return out.select("id", "event_id", "amount", "status", "valid_from", "valid_to", "is_current")
