"""Streaming queries. Events are landed in three slices; each slice is followed by a stream run on the same checkpoint.

The final state is compared with the batch SQL, which also shows that stop and resume lose nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.quality import route_events
from tidemark.plans.fixtures import change_log, seed, table
from tidemark.plans.registry import plan
from tidemark.session import scratch_path
from tidemark.sources.readers import parse_lines, to_line
from tidemark.streaming import flows, heartbeat, top
from tidemark.streaming.store import ChangeStore

SLICES = ("ts < TIMESTAMP_NTZ '2024-01-11'", "ts >= TIMESTAMP_NTZ '2024-01-11' AND ts < TIMESTAMP_NTZ '2024-01-21'", "ts >= TIMESTAMP_NTZ '2024-01-21'")
STATE_SCHEMA = "id bigint, amount decimal(18,2), status string"
LOG_SCHEMA = "id bigint, op string, amount decimal(18,2), status string, seq struct<ts: timestamp_ntz, event_id: bigint>"


def replay(lines: DataFrame, landing: str, run: Callable[[], None]) -> None:
    """Land each slice of ``lines`` (ts, value) and run the stream over what is new."""
    for part in SLICES:
        lines.where(part).select("value").write.mode("append").text(landing)
        run()


def change_lines(spark: SparkSession, d: str) -> DataFrame:
    log = change_log(spark, d)
    return log.select("ts", to_line("id", "op", "amount", "status", "seq").alias("value"))


def _stored(spark: SparkSession, lines: DataFrame, first: DataFrame, compact: bool = False) -> ChangeStore:
    root = scratch_path(spark, "stream")
    store = ChangeStore(spark, f"{root}/store", ("id",), STATE_SCHEMA, LOG_SCHEMA)
    store.seed(first)
    step = flows.apply_changes(store, ["id", "op"], dedupe_on=["id", "seq"])

    def run() -> None:
        flows.run_available(flows.line_stream(spark, f"{root}/landing"), step, f"{root}/checkpoint")
        if compact and store.base_batch() == -1:
            store.compact(0)

    replay(lines, f"{root}/landing", run)
    return store


NET_SQL = """n AS (SELECT id, max_by(op, (ts, event_id)) AS op, max_by(amount, (ts, event_id)) AS amount,
                         max_by(status, (ts, event_id)) AS status FROM change_log GROUP BY id)
    SELECT id, CASE WHEN n.op IS NULL THEN seed.amount ELSE n.amount END AS amount, CASE WHEN n.op IS NULL THEN seed.status ELSE n.status END AS status
    FROM seed FULL JOIN n USING (id) WHERE n.op IS DISTINCT FROM 'D'"""


@plan("stream_cdc_apply", "X1 X2 X3 X4 M1 M9 M15", "change_log seed", NET_SQL)
def stream_cdc_apply(spark: SparkSession, d: str) -> DataFrame:
    lines = change_lines(spark, d)
    doubled = lines.unionByName(lines.where(F.hour("ts") < 6))
    return _stored(spark, doubled, seed(spark, d), compact=True).current()


@plan(
    "stream_redelivery",
    "M15 X2 M9",
    "change_log",
    """SELECT max(ts) AS last_ts, count(*) AS rows_applied FROM change_log""",
)
def stream_redelivery(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last slice are delivered once more in later batches; no change counts twice."""
    root = scratch_path(spark, "stream")
    store = ChangeStore(spark, f"{root}/store", ("id",), STATE_SCHEMA, LOG_SCHEMA)
    store.seed(seed(spark, d))
    step = flows.apply_changes(store, ["id", "op"], dedupe_on=["id", "seq"])
    lines = change_lines(spark, d)
    for part in (*SLICES, SLICES[0], SLICES[2]):
        lines.where(part).select("value").write.mode("append").text(f"{root}/landing")
        flows.run_available(flows.line_stream(spark, f"{root}/landing"), step, f"{root}/checkpoint")
    return store.checkpoint().select(F.col("last_seq.ts").alias("last_ts"), "rows_applied")


@plan(
    "stream_checkpoint",
    "X3 M9",
    "change_log",
    """SELECT max(ts) AS last_ts, max_by(event_id, ts) AS last_event_id, count(*) AS rows_applied FROM change_log""",
)
def stream_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    position = _stored(spark, change_lines(spark, d), seed(spark, d)).checkpoint()
    return position.select(
        F.col("last_seq.ts").alias("last_ts"), F.col("last_seq.event_id").alias("last_event_id"), "rows_applied"
    )


@plan(
    "stream_dead_letter",
    "X8 S9",
    "change_log",
    """SELECT CASE WHEN status = 'view' THEN 'MALFORMED' WHEN status = 'click' THEN 'UNKNOWN OPERATION' ELSE 'APPLIED' END AS reason, count(*) AS lines FROM change_log GROUP BY 1""",
)
def stream_dead_letter(spark: SparkSession, d: str) -> DataFrame:
    log = change_log(spark, d).withColumn("op", F.when(F.col("status") == "click", "Z").otherwise(F.col("op")))
    good = to_line("id", "op", "amount", "status", "seq")
    broken = F.when(F.col("status") == "view", F.concat(F.lit("{oops "), good)).otherwise(good)
    store = _stored(spark, log.select("ts", broken.alias("value")), seed(spark, d))
    labelled = store.dead().select("reason").unionByName(store.changes().select(F.lit("APPLIED").alias("reason")))
    return labelled.groupBy("reason").agg(F.count("*").alias("lines"))


EVENT_SCHEMA = "event_id bigint, user_id bigint, event_type string, ts timestamp_ntz"


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    record = to_line("event_id", "user_id", "event_type", "ts")
    return table(spark, d, "events").select("ts", record.alias("value"))


def _rates(spark: SparkSession, d: str, width: str, slide: str | None) -> DataFrame:
    root = scratch_path(spark, "rates")

    def run() -> None:
        parsed = parse_lines(flows.line_stream(spark, f"{root}/landing"), EVENT_SCHEMA)
        marked = parsed.select("event_type", "ts", (F.col("event_type") == "error").alias("is_error"))
        rates = flows.windowed_rates(marked, "ts", ["event_type"] if not slide else [], "10 minutes", width, slide)
        flows.run_available(rates, flows.upsert_sink(f"{root}/sink"), f"{root}/checkpoint", "update")

    replay(event_lines(spark, d), f"{root}/landing", run)
    keys = ["bucket"] if slide else ["event_type", "bucket"]
    return flows.latest_rows(spark, f"{root}/sink", keys)


@plan(
    "stream_rates",
    "X5 X1",
    "",
    """SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors,
              CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*) AS error_ratio FROM events GROUP BY 1, 2""",
)
def stream_rates(spark: SparkSession, d: str) -> DataFrame:
    return _rates(spark, d, "1 hour", None)


@plan(
    "stream_error_alert",
    "X9 X5 X7",
    "",
    """s AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS bucket FROM events, (SELECT unnest([0, 1]) AS k)),
       r AS (SELECT bucket, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors FROM s GROUP BY 1)
       SELECT bucket, events, errors, CAST(errors AS DOUBLE) / events AS error_ratio, 'ALERT' AS severity FROM r WHERE CAST(errors AS DOUBLE) / events > 0.25""",
)
def stream_error_alert(spark: SparkSession, d: str) -> DataFrame:
    rates = _rates(spark, d, "1 hour", "30 minutes")
    return rates.where(F.col("error_ratio") > 0.25).withColumn("severity", F.lit("ALERT"))


@plan(
    "stream_heartbeat",
    "X6 W3",
    "",
    """m AS (SELECT *, count(*) FILTER (WHERE event_type NOT IN ('error', 'signup')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
       r AS (SELECT user_id, min(ts) AS run_start, max(ts) AS run_end, count(*) AS run_length FROM m WHERE event_type IN ('error', 'signup') GROUP BY user_id, island)
       SELECT * FROM r WHERE run_length >= 3""",
)
def stream_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "heartbeat")
    step = flows.heartbeat_step(spark, f"{root}/out", "user_id", "ts", "event_id", "event_type IN ('error', 'signup')")

    def run() -> None:
        parsed = parse_lines(flows.line_stream(spark, f"{root}/landing"), EVENT_SCHEMA).drop("_corrupt")
        flows.run_available(parsed, step, f"{root}/checkpoint")

    replay(event_lines(spark, d), f"{root}/landing", run)
    return flows.latest_rows(spark, f"{root}/out/runs", ["user_id", "run_start"])


@plan(
    "stream_top_statements",
    "T6 K1",
    "",
    """s AS (SELECT event_type AS scope, 'statement ' || (user_id * user_id % 97) AS item, count(*) AS count FROM events GROUP BY 1, 2),
       r AS (SELECT *, rank() OVER (PARTITION BY scope ORDER BY count DESC) AS r, sum(count) OVER (PARTITION BY scope)::BIGINT AS rows FROM s)
       SELECT scope, count, rows, count(*) AS items FROM r WHERE r <= 5 GROUP BY 1, 2, 3""",
)
def stream_top_statements(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the five most frequent statements per type, ties included, and how many statements have them."""
    root = scratch_path(spark, "top")
    record = to_line("event_type", "statement")
    statement = F.concat(F.lit("statement "), (F.col("user_id") * F.col("user_id") % 97).cast("string"))
    lines = table(spark, d, "events").withColumn("statement", statement).select("ts", record.alias("value"))
    step = top.top_items_step(f"{root}/state", "statement", "event_type")

    def run() -> None:
        parsed = parse_lines(flows.line_stream(spark, f"{root}/landing"), "event_type string, statement string").drop("_corrupt")
        flows.run_available(parsed, step, f"{root}/checkpoint")

    replay(lines, f"{root}/landing", run)
    found = top.top_items(spark, f"{root}/state", len(SLICES) - 1, k=97)
    place = F.rank().over(Window.partitionBy("scope").orderBy(F.desc("count")))
    first = found.withColumn("_r", place).where("_r <= 5")
    return first.groupBy("scope", "count", "rows").agg(F.count("*").alias("items"))


#: Events of the first slice that are held back until their buckets are closed.
HELD_BACK = "event_id % 50 = 0 AND ts < TIMESTAMP_NTZ '2024-01-11'"
HELD_BACK_SQL = "event_id % 50 = 0 AND ts < TIMESTAMP '2024-01-11'"


def _late_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Slices landed out of order, then a tick that closes all buckets, then what was held back."""
    root = scratch_path(spark, "heartbeat")
    lines = table(spark, d, "events").select("ts", "event_id", to_line("event_id", "user_id", "event_type", "ts").alias("value"))
    tick = spark.range(1).selectExpr("TIMESTAMP_NTZ '2024-06-01' AS ts", "-1L AS event_id", "cast(NULL AS bigint) AS user_id", "cast(NULL AS string) AS event_type")
    tick = tick.select("ts", "event_id", to_line("event_id", "user_id", "event_type", "ts").alias("value"))
    in_time = lines.where(f"NOT ({HELD_BACK})")
    for landed in (in_time.where(SLICES[1]), in_time.where(SLICES[0]), in_time.where(SLICES[2]), tick, lines.where(HELD_BACK)):
        landed.select("value").write.mode("append").text(f"{root}/landing")
        parsed = parse_lines(flows.line_stream(spark, f"{root}/landing"), EVENT_SCHEMA).drop("_corrupt")
        pieces = heartbeat.event_time_pieces(parsed, "user_id", "ts", "event_id", "event_type IN ('error', 'signup')", "30 days", bucket_seconds=86_400)
        flows.run_available(pieces, flows.upsert_sink(f"{root}/sink"), f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/sink").drop("batch_id")


@plan(
    "stream_heartbeat_late",
    "X6 W3",
    "",
    f"""e AS (SELECT * FROM events WHERE NOT ({HELD_BACK_SQL})),
        m AS (SELECT *, count(*) FILTER (WHERE event_type NOT IN ('error', 'signup')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e),
        r AS (SELECT user_id, min(ts) AS run_start, max(ts) AS run_end, count(*) AS run_length FROM m WHERE event_type IN ('error', 'signup') GROUP BY user_id, island)
        SELECT * FROM r WHERE run_length >= 3""",
)
def stream_heartbeat_late(spark: SparkSession, d: str) -> DataFrame:
    return heartbeat.failure_runs(_late_pieces(spark, d)).withColumnRenamed("target", "user_id")


@plan(
    "stream_heartbeat_dead",
    "X6 X8",
    "",
    f"""SELECT user_id, ts, event_id, 'LATE' AS reason FROM events WHERE {HELD_BACK_SQL}""",
)
def stream_heartbeat_dead(spark: SparkSession, d: str) -> DataFrame:
    dead = heartbeat.dead_letters(_late_pieces(spark, d))
    return dead.select(F.col("target").alias("user_id"), "ts", F.col("tie").alias("event_id"), "reason")


@plan(
    "stream_route",
    "X10",
    "",
    """SELECT CASE WHEN event_type = 'error' THEN 'prepare_action' ELSE 'no_action' END AS action, count(*) AS events FROM events GROUP BY 1""",
)
def stream_route(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "route")

    def run() -> None:
        parsed = parse_lines(flows.line_stream(spark, f"{root}/landing"), EVENT_SCHEMA)
        kind = F.when(F.col("event_type") == "error", "health_threshold_reached").otherwise(F.col("event_type"))
        routed = route_events(parsed.select("event_id", kind.alias("kind")), "kind")
        flows.run_available(routed, flows.upsert_sink(f"{root}/sink"), f"{root}/checkpoint")

    replay(event_lines(spark, d), f"{root}/landing", run)
    return spark.read.parquet(f"{root}/sink").groupBy("action").agg(F.count("*").alias("events"))
