"""Quality, guardrail, report-text and alert queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio_or_null
from tidemark.operators import alerts, intervals, quality
from tidemark.operators.ordered import exact_percentiles
from tidemark.operators.rules import Rule, detect, evaluate
from tidemark.operators.telemetry import report_text
from tidemark.plans.fixtures import sessions, table
from tidemark.plans.registry import plan


@plan(
    "contract_violations",
    "Q1 F10",
    "",
    """r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS order_id,
                    CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_totalprice AS VARCHAR) END AS price FROM orders)
       SELECT o_orderkey, 'order_id' AS field, 'NOT INT' AS reason FROM r WHERE TRY_CAST(order_id AS INTEGER) IS NULL
       UNION ALL SELECT o_orderkey, 'price', 'MISSING' FROM r WHERE price IS NULL""",
)
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderstatus = 'F' THEN concat('F', o_custkey) ELSE CAST(o_custkey AS STRING) END AS order_id",
        "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_totalprice AS STRING) END AS price",
    )
    return quality.contract_violations(raw, "o_orderkey", {"order_id": "int", "price": "double"})


@plan(
    "keys_present",
    "Q2 F15",
    "",
    """SELECT bool_and(json_exists(props, '$.k')) AS key_present, count(*) FILTER (WHERE json_extract(props, '$.k') IS NULL) = 0 AS value_present FROM events""",
)
def keys_present(spark: SparkSession, d: str) -> DataFrame:
    parsed = table(spark, d, "events").select(F.from_json("props", "map<string,bigint>").alias("props"))
    return quality.keys_present(parsed, "props", "k")


@plan(
    "bench_gate",
    "Q4",
    "",
    """b AS (SELECT l_partkey AS query, CAST(min(l_extendedprice) AS DECIMAL(18,3)) AS base, CAST(max(CAST(l_extendedprice AS DECIMAL(18,3))) AS DECIMAL(18,3)) AS cur FROM lineitem GROUP BY 1)
       SELECT query, base, cur, round(CAST(cur - base AS DOUBLE) / nullif(CAST(base AS DOUBLE), 0), 4) AS change, CASE WHEN cur - base > base * 0.10 THEN 'FAIL' ELSE 'PASS' END AS status FROM b""",
)
def bench_gate(spark: SparkSession, d: str) -> DataFrame:
    grouped = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("query"))
    baseline = grouped.agg(F.min("l_extendedprice").cast("decimal(18,3)").alias("seconds"))
    current = grouped.agg(F.max("l_extendedprice").cast("decimal(18,3)").alias("seconds"))
    return quality.regression_gate(baseline, current)


@plan(
    "timing_delta",
    "Q5",
    "",
    """t AS (SELECT l_suppkey, CAST(count(*) FILTER (WHERE l_linenumber < 4) AS DOUBLE) AS source_ms, CAST(count(*) FILTER (WHERE l_linenumber >= 4) AS DOUBLE) AS target_ms FROM lineitem GROUP BY 1),
       p AS (SELECT *, CASE WHEN source_ms = 0 THEN 0.0 ELSE round((target_ms - source_ms) * 100.0 / source_ms, 2) END AS delta_pct FROM t)
       SELECT *, delta_pct > 20 AS flagged FROM p""",
)
def timing_delta(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("l_linenumber")
    times = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(line < 4).cast("double").alias("source_ms"), F.count_if(line >= 4).cast("double").alias("target_ms")
    )
    return quality.timing_delta(times, "source_ms", "target_ms")


@plan(
    "precheck",
    "Q6",
    "sessions",
    """n AS (SELECT user_id, count(*) AS active_sessions FROM sessions GROUP BY 1)
       SELECT *, CASE WHEN active_sessions > 70 THEN 'REJECT' ELSE 'ALLOW' END AS decision FROM n""",
)
def precheck(spark: SparkSession, d: str) -> DataFrame:
    return quality.precheck(sessions(spark, d), ["user_id"], 70)


RISK_SQL = """r AS (SELECT p_partkey, CAST(1 + p_size % 5 AS INTEGER) AS blast_radius, CAST(1 + (p_size // 5) % 5 AS INTEGER) AS data_risk,
                   CAST(1 + p_partkey % 5 AS INTEGER) AS rollback, CAST(1 + (p_partkey // 5) % 5 AS INTEGER) AS load, CAST(1 + (p_partkey // 25) % 5 AS INTEGER) AS coupling FROM part),
     s AS (SELECT p_partkey, 3 * blast_radius + 3 * data_risk + 2 * rollback + load + coupling AS risk_score FROM r)"""


@plan(
    "change_risk",
    "Q7",
    "",
    RISK_SQL
    + """ SELECT p_partkey, risk_score, CASE WHEN risk_score >= 35 THEN 'Tier-1 High' WHEN risk_score >= 25 THEN 'Tier-2 Medium' ELSE 'Tier-3 Low' END AS tier,
                 CASE WHEN risk_score >= 35 THEN 'DBRE + Service owner + Platform lead' WHEN risk_score >= 25 THEN 'DBRE + Service owner' ELSE 'DBRE' END AS approval FROM s""",
)
def change_risk(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "part").selectExpr(
        "p_partkey",
        "CAST(1 + p_size % 5 AS INT) AS blast_radius",
        "CAST(1 + (p_size DIV 5) % 5 AS INT) AS data_risk",
        "CAST(1 + p_partkey % 5 AS INT) AS rollback",
        "CAST(1 + (p_partkey DIV 5) % 5 AS INT) AS load",
        "CAST(1 + (p_partkey DIV 25) % 5 AS INT) AS coupling",
    )
    return quality.change_risk(changes).select("p_partkey", "risk_score", "tier", "approval")


TIER_SQL = "CASE WHEN user_id % 3 = 0 THEN 'Tier 0' WHEN user_id % 3 = 1 THEN 'Tier 1' ELSE 'Tier 2' END"


@plan(
    "slo_attainment",
    "Q8 A14",
    "",
    f"""e AS (SELECT *, {TIER_SQL} AS tier FROM events),
        a AS (SELECT tier, count(*) AS requests, round(100.0 * (CAST(count(*) FILTER (WHERE event_type <> 'error' OR value < 200) AS DOUBLE) / count(*)), 4) AS availability_pct,
                     quantile_cont(value, 0.95) AS q FROM e GROUP BY 1),
        s AS (SELECT * FROM (VALUES ('Tier 0', CAST(99.99 AS DOUBLE), CAST(50 AS DOUBLE)), ('Tier 1', 99.95, 120), ('Tier 2', 99.9, 2000)) v(tier, goal, lim))
        SELECT tier, requests, availability_pct, round(q, 6) AS p95, round((100.0 - availability_pct) / (100.0 - goal), 2) AS budget_burn,
               availability_pct >= goal AND q < lim AS attained FROM a JOIN s USING (tier)""",
)
def slo_attainment(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "events").withColumn("tier", F.expr(TIER_SQL))
    return quality.slo_attainment(requests, "tier", F.expr("event_type <> 'error' OR value < 200"), "value")


@plan(
    "latency_quantiles",
    "A14",
    "",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""",
)
def latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    out = exact_percentiles(table(spark, d, "events"), ["event_type"], "value", points)
    return out.select("event_type", *[F.round(p, 6).alias(p) for p in points])


@plan(
    "latency_quantiles_approx",
    "A14",
    "",
    """SELECT event_type, count(*) AS samples, true AS p50_within, true AS p95_within, true AS p99_within FROM events GROUP BY 1""",
)
def latency_quantiles_approx(spark: SparkSession, d: str) -> DataFrame:
    """Sketched quantiles with the rank they really have: within the sketch's bound of 1/10000 of the rows, plus one row."""
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    events = table(spark, d, "events")
    levels = F.percentile_approx("value", F.array(*map(F.lit, points.values())), F.lit(10_000))
    sketched = events.groupBy(F.col("event_type").alias("kind")).agg(levels.alias("q"))
    joined = events.join(sketched, F.col("event_type") == F.col("kind"))
    ranks = []
    for i, name in enumerate(points):
        level = F.col("q")[i]
        ranks += [F.count_if(F.col("value") < level).alias(f"{name}_below"), F.count_if(F.col("value") <= level).alias(f"{name}_upto")]
    counted = joined.groupBy("event_type").agg(F.count("*").alias("samples"), *ranks)
    slack = F.col("samples") / 10_000 + 1

    def within(name: str, p: float) -> F.Column:
        rank = p * F.col("samples")
        return ((F.col(f"{name}_below") - slack <= rank) & (rank <= F.col(f"{name}_upto") + slack)).alias(f"{name}_within")

    return counted.select("event_type", "samples", *[within(n, p) for n, p in points.items()])


@plan(
    "rollback_trigger",
    "Q9",
    "",
    """g AS (SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS DOUBLE) / count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS b,
                    CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS DOUBLE) / count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS a,
                    round(100.0 * (CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16' AND event_type = 'error' AND value > 100) AS DOUBLE) / nullif(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16'), 0)), 4) AS error_pct FROM events GROUP BY 1)
       SELECT user_id, b AS before_ms, a AS after_ms, error_pct,
              CASE WHEN coalesce(a > b * 1.5, false) OR error_pct > 0.1 THEN 'ROLLBACK' ELSE 'KEEP' END AS decision FROM g""",
)
def rollback_trigger(spark: SparkSession, d: str) -> DataFrame:
    after = F.expr("ts >= TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    error = F.expr("event_type = 'error' AND value > 100")
    return quality.rollback_trigger(table(spark, d, "events"), ["user_id"], after, F.col("value"), error)


@plan(
    "kpi_check",
    "Q10",
    "",
    """m AS (SELECT CAST(count(*) AS DOUBLE) / 100 AS a, 100.0 * count(*) FILTER (WHERE event_type = 'error' AND value > 200) / count(*) AS b, CAST(date_sub('minute', max(ts), TIMESTAMP '2024-01-31') AS DOUBLE) AS c FROM events)
       SELECT 'full_load_hours' AS kpi, CAST(a AS DOUBLE) AS value, CASE WHEN a > 120 THEN 'ALERT' WHEN a > 96 THEN 'WARN' ELSE 'OK' END AS status FROM m
       UNION ALL SELECT 'replay_failure_pct', round(CAST(b AS DOUBLE), 4), CASE WHEN b > 1 THEN 'ALERT' WHEN b > 0.1 THEN 'WARN' ELSE 'OK' END FROM m
       UNION ALL SELECT 'cdc_lag_minutes', c, CASE WHEN c > 15 THEN 'ALERT' WHEN c > 5 THEN 'WARN' ELSE 'OK' END FROM m""",
)
def kpi_check(spark: SparkSession, d: str) -> DataFrame:
    bad = F.count_if(F.expr("event_type = 'error' AND value > 200"))
    one = table(spark, d, "events").agg(
        (F.count("*").cast("double") / 100).alias("full_load_hours"),
        F.round(F.lit(100.0) * ratio_or_null(bad, F.count("*")), 4).alias("replay_failure_pct"),
        F.timestamp_diff("MINUTE", F.max("ts"), F.lit("2024-01-31").cast("timestamp_ntz")).cast("double").alias("cdc_lag_minutes"),
    )
    return quality.kpi_check(one.unpivot([], one.columns, "kpi", "value"))


# Alerts from errors and incidents from sign-ups, per service; every engine adds the minutes in its own way.
ALERT_EXPRS = ["event_id AS alert_id", "user_id % 10 AS service", "ts AS fired_at", "ts + {minutes}(5 + event_id % 50) AS cleared_at"]
INCIDENT_EXPRS = ["event_id AS incident_id", "user_id % 10 AS service", "ts AS opened_at", "ts + {minutes}(event_id % 2000) AS closed_at"]


def _minutes(expressions: list[str], spark_sql: bool) -> list[str]:
    return [e.replace("{minutes}(", "make_dt_interval(0, 0, " if spark_sql else "to_minutes(") for e in expressions]


MET_SQL = f"""
    a AS (SELECT {", ".join(_minutes(ALERT_EXPRS, False))} FROM events WHERE event_type = 'error'),
    i AS (SELECT {", ".join(_minutes(INCIDENT_EXPRS, False))} FROM events WHERE event_type = 'signup'),
    m AS (SELECT alert_id, incident_id, a.service FROM a JOIN i ON a.service = i.service AND fired_at < closed_at AND opened_at < cleared_at AND opened_at < closed_at)"""


def _alerts_met(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events")
    fired = events.where("event_type = 'error'").selectExpr(*_minutes(ALERT_EXPRS, True))
    incidents = events.where("event_type = 'signup'").selectExpr(*_minutes(INCIDENT_EXPRS, True))
    return fired, intervals.overlaps(fired, incidents, ["service"], ["fired_at", "cleared_at"], ["opened_at", "closed_at"])


@plan("alert_incidents", "Q12", "", MET_SQL + " SELECT service, alert_id, incident_id FROM m")
def alert_incidents(spark: SparkSession, d: str) -> DataFrame:
    return _alerts_met(spark, d)[1].select("service", "alert_id", "incident_id")


@plan(
    "alert_outcomes",
    "Q12",
    "",
    MET_SQL
    + """, f AS (SELECT service, CAST(date_trunc('week', fired_at) AS DATE) AS week, count(*) AS fired, count(*) FILTER (WHERE alert_id IN (SELECT alert_id FROM m)) AS led FROM a GROUP BY 1, 2)
       SELECT *, round(100.0 * (CAST(led AS DOUBLE) / fired), 2) AS incident_pct, round(100.0 * (CAST(led AS DOUBLE) / fired), 2) > 70 AS on_target FROM f""",
)
def alert_outcomes(spark: SparkSession, d: str) -> DataFrame:
    fired, met = _alerts_met(spark, d)
    return quality.alert_outcomes(fired, met, "alert_id", ["service"], "fired_at")


@plan(
    "config_at_finding",
    "J13 T51",
    "",
    """f AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
       c AS (SELECT user_id, ts AS since, max(event_id) AS setting FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
       SELECT f.event_id, f.user_id, f.ts, c.since, c.setting FROM f ASOF LEFT JOIN c ON f.user_id = c.user_id AND f.ts >= c.since""",
)
def config_at_finding(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    findings = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    settings = events.where("event_type = 'purchase'").selectExpr("user_id", "ts AS since", "event_id AS setting")
    return intervals.as_of(findings, settings, ["user_id"], "ts", "since", ["since", "setting"])


@plan(
    "alert_quality",
    "Q12",
    "",
    """g AS (SELECT event_type AS alert, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS fired,
                    round(100.0 * (CAST(count(*) FILTER (WHERE value < 5) AS DOUBLE) / count(*)), 2) AS false_pct,
                    round(100.0 * (CAST(count(*) FILTER (WHERE value > 20) AS DOUBLE) / count(*)), 2) AS incident_pct,
                    round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS mttr_minutes FROM events GROUP BY 1, 2)
       SELECT *, fired < 10 AND false_pct < 20 AND incident_pct > 70 AND mttr_minutes < 10 AS on_target FROM g""",
)
def alert_quality(spark: SparkSession, d: str) -> DataFrame:
    alerts = table(spark, d, "events").selectExpr(
        "event_type AS alert", "ts", "value < 5 AS false_alarm", "value > 20 AS incident", "CAST(value AS DECIMAL(18,2)) AS minutes"
    )
    return quality.alert_quality(alerts, "ts")


@plan(
    "patch_sla",
    "Q13",
    "",
    """a AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' ELSE 'Medium' END AS severity,
                    CAST(coalesce(CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_custkey % 60 AS INTEGER) END, DATE '2001-12-31') - CAST(o_orderdate AS DATE) AS INTEGER) AS age_days FROM orders),
       l AS (SELECT *, CASE severity WHEN 'Critical' THEN 7 WHEN 'High' THEN 30 END AS limit_days FROM a)
       SELECT *, CASE WHEN limit_days IS NULL THEN 'MONTHLY_CYCLE' WHEN age_days > limit_days THEN 'OVERDUE' ELSE 'WITHIN_SLA' END AS status FROM l""",
)
def patch_sla(spark: SparkSession, d: str) -> DataFrame:
    findings = table(spark, d, "orders").selectExpr(
        "o_orderkey",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' ELSE 'Medium' END AS severity",
        "o_orderdate AS found",
        "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE date_add(CAST(o_orderdate AS DATE), CAST(o_custkey % 60 AS INT)) END AS patched",
    )
    out = quality.patch_sla(findings, "found", "patched", "severity", "2001-12-31")
    return out.select("o_orderkey", "severity", "age_days", "limit_days", "status")


@plan(
    "unsupported_versions",
    "Q13",
    "",
    """SELECT p_partkey, p_type, p_size, CASE p_type WHEN 'ECONOMY' THEN 15 WHEN 'STANDARD' THEN 8 END AS minimum_version FROM part
       WHERE p_size < CASE p_type WHEN 'ECONOMY' THEN 15 WHEN 'STANDARD' THEN 8 END""",
)
def unsupported_versions(spark: SparkSession, d: str) -> DataFrame:
    fleet = table(spark, d, "part").select("p_partkey", "p_type", "p_size")
    return quality.unsupported_versions(fleet, {"ECONOMY": 15, "STANDARD": 8}, "p_type", "p_size")


@plan(
    "drill_rto",
    "Q14 F8",
    "",
    """a AS (SELECT o_orderkey, CAST(o_custkey % 240 AS BIGINT) AS actual_rto, CAST(o_orderkey % 90 AS BIGINT) AS actual_rpo FROM orders)
       SELECT *, CASE WHEN actual_rto <= 120 THEN 'Met' ELSE 'Exceeded' END AS rto_status, CASE WHEN actual_rpo <= 15 THEN 'Met' ELSE 'Exceeded' END AS rpo_status FROM a""",
)
def drill_rto(spark: SparkSession, d: str) -> DataFrame:
    drills = table(spark, d, "orders").selectExpr(
        "o_orderkey",
        "o_orderdate AS started",
        "o_orderdate + make_dt_interval(0, 0, CAST(o_custkey % 240 AS INT)) AS restored",
        "o_orderdate - make_dt_interval(0, 0, CAST(o_orderkey % 90 AS INT)) AS last_commit",
        "120 AS rto_target",
        "15 AS rpo_target",
    )
    out = quality.drill_result(drills, "started", "restored", "last_commit", "rto_target", "rpo_target")
    return out.select("o_orderkey", "actual_rto", "actual_rpo", "rto_status", "rpo_status")


@plan(
    "event_route",
    "X10 F13",
    "",
    """r AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'health_threshold_reached' ELSE event_type END AS kind FROM events)
       SELECT event_id, kind, CASE WHEN kind = 'health_threshold_reached' THEN 'prepare_action' ELSE 'no_action' END AS action,
              CASE WHEN kind = 'health_threshold_reached' THEN 'execution_triggered' ELSE 'no_execution' END AS outcome FROM r""",
)
def event_route(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "health_threshold_reached").otherwise(F.col("event_type"))
    return quality.route_events(table(spark, d, "events").select("event_id", kind.alias("kind")), "kind")


@plan(
    "alert_rules",
    "X7 P7",
    "",
    """w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS e, max(value) AS m FROM events GROUP BY 1),
       r AS (SELECT bucket, 'THROUGHPUT_SPIKE' AS issue, n AS observed, CAST(4 AS DOUBLE) AS threshold, 'SEV2' AS severity FROM w WHERE n > 4
             UNION ALL SELECT bucket, 'ERROR_RATE', e / n, 0.001, 'SEV1' FROM w WHERE e / n > 0.001
             UNION ALL SELECT bucket, 'LATENCY_AND_LOAD', CASE WHEN m > 150 AND n > 1 THEN 1.0 ELSE 0.0 END, 0, 'SEV1' FROM w WHERE m > 150 AND n > 1)
       SELECT *, CASE severity WHEN 'SEV1' THEN 0 ELSE 5 END AS page_after_minutes FROM r""",
)
def alert_rules(spark: SparkSession, d: str) -> DataFrame:
    windowed = table(spark, d, "events").groupBy(F.window("ts", "5 minutes").alias("w")).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"), F.max("value").alias("m")
    ).select(F.col("w.start").alias("bucket"), "n", "e", "m")
    rules = [
        Rule("THROUGHPUT_SPIKE", "n", ">", 4, "SEV2"),
        Rule("ERROR_RATE", "CAST(e AS DOUBLE) / CAST(n AS DOUBLE)", ">", 0.001, "SEV1"),
        Rule("LATENCY_AND_LOAD", "CASE WHEN m > 150 AND n > 1 THEN 1.0 ELSE 0.0 END", ">", 0, "SEV1"),
    ]
    fired = evaluate(windowed, rules, ["bucket"])
    return fired.withColumn("page_after_minutes", F.when(F.col("severity") == "SEV1", 0).otherwise(5))


def _held_sql(alert: str, condition: str, seconds: int, severity: str, page: int) -> str:
    """Oracle text of one rule: islands of rows where the condition holds."""
    return f"""SELECT user_id, '{alert}' AS alert, min(day) AS run_start, max(day) AS run_end, count(*) AS run_length,
                   date_sub('second', min(day), max(day)) AS held_seconds, '{severity}' AS severity, {page} AS page_after_minutes
            FROM (SELECT *, count(*) FILTER (WHERE NOT coalesce({condition}, false)) OVER (PARTITION BY user_id ORDER BY day) AS island FROM m)
            WHERE {condition} GROUP BY user_id, island HAVING date_sub('second', min(day), max(day)) >= {seconds}"""


HELD_RULES = (
    alerts.AlertRule("SLOW", "peak > 100", 86_400, "Sev-1"),
    alerts.AlertRule("ERRORS", "error_ratio > 0.3", 86_400, "Sev-2"),
    alerts.AlertRule("BUSY_AND_SLOW", "n > 2 AND peak > 60", 172_800, "Sev-1"),
    alerts.AlertRule("QUIET", "n < 2", 0, "Sev-3"),
)


@plan(
    "alert_for_duration",
    "X7 W5",
    "",
    """m AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, max(value) AS peak, CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*) AS error_ratio
             FROM events GROUP BY 1, 2) """
    + " UNION ALL ".join(
        _held_sql(r.name, r.condition, r.for_seconds, r.severity, alerts.PAGE_MINUTES[r.severity]) for r in HELD_RULES
    ),
)
def alert_for_duration(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("timestamp_ntz").alias("day")).agg(
        F.count("*").alias("n"),
        F.max("value").alias("peak"),
        ratio_or_null(F.count_if(F.col("event_type") == "error"), F.count("*")).alias("error_ratio"),
    )
    return alerts.fire(daily, ["user_id"], "day", HELD_RULES)


@plan(
    "error_rate_alert",
    "X9 X7",
    "",
    """m AS (SELECT CAST(ts AS DATE) AS day, CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*) AS r FROM events GROUP BY 1)
       SELECT day, 'REPLAY_FAILURES' AS issue, r AS observed, CAST(0.01 AS DOUBLE) AS threshold, 'ALERT' AS severity FROM m WHERE r > 0.01""",
)
def error_rate_alert(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    rate = ratio_or_null(F.count_if(F.col("event_type") == "error"), F.count("*"))
    return detect(events, {"rate": rate}, [Rule("REPLAY_FAILURES", "rate", ">", 0.01, "ALERT")], ["day"])


def _finding_sql() -> str:
    """Oracle text of the keyword rules, from the same fixed table."""
    branches = []
    hits = []
    for i, (groups, finding) in enumerate(report_text.FINDING_RULES):
        test = " AND ".join("(" + " OR ".join(f"contains(t, '{k}')" for k in g) + ")" for g in groups)
        text = finding.replace("'", "''")
        branches.append(f"SELECT doc_id, {i} AS rule_no, '{text}' AS finding FROM l WHERE {test}")
        hits.append(f"({test})")
    none = f"SELECT doc_id, {len(hits)}, '{report_text.DEFAULT_FINDING}' FROM l WHERE NOT ({' OR '.join(hits)})"
    return "l AS (SELECT doc_id, lower(text) AS t FROM docs) " + " UNION ALL ".join([*branches, none])


REPORTS_SQL = """docs AS (SELECT doc_id, text || CASE WHEN lang = 'en' THEN chr(10) || '## Lock Wait ' || source || chr(10) || 'Deadlock row_lock' ELSE '' END AS text FROM documents), """


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Documents as reports; English ones end with a titled section."""
    tail = F.concat(F.lit("\n## Lock Wait "), F.col("source"), F.lit("\nDeadlock row_lock"))
    return table(spark, d, "documents").select(
        "doc_id", F.concat("text", F.when(F.col("lang") == "en", tail).otherwise("")).alias("text")
    )


@plan("report_findings", "T44 P6", "", REPORTS_SQL + _finding_sql())
def report_findings(spark: SparkSession, d: str) -> DataFrame:
    return report_text.findings(reports(spark, d), "doc_id", "text")


@plan(
    "report_sections",
    "T44 T45 F14",
    "",
    REPORTS_SQL
    + """b AS (SELECT doc_id, unnest(string_split(chr(10) || regexp_replace(text, '\\n\\z', ''), chr(10) || '## ')) AS block,
                      generate_subscripts(string_split(chr(10) || regexp_replace(text, '\\n\\z', ''), chr(10) || '## '), 1) - 1 AS section_no FROM docs WHERE length(text) > 0)
          SELECT doc_id, CAST(section_no AS INTEGER) AS section_no, CASE WHEN section_no = 0 THEN 'Overview' ELSE trim(split_part(block, chr(10), 1)) END AS title,
                 CAST(length(regexp_replace(substr(block, instr(block, chr(10)) + 1), '^\\s+|\\s+$', '', 'g')) AS INTEGER) AS content_length,
                 CASE WHEN section_no = 0 THEN 'telemetry' ELSE 'lock waits' END AS section_class,
                 CASE WHEN section_no = 0 THEN 'telemetry' ELSE 'waits' END AS literal_class
          FROM b WHERE instr(block, chr(10)) > 0""",
)
def report_sections(spark: SparkSession, d: str) -> DataFrame:
    parts = report_text.sections(reports(spark, d), "doc_id", "text")
    return parts.select(
        "doc_id",
        "section_no",
        "title",
        F.length("content").alias("content_length"),
        report_text.classify_section(F.col("title"), F.col("content")).alias("section_class"),
        report_text.classify_section(F.col("title"), F.col("content"), "literal").alias("literal_class"),
    )


@plan(
    "report_tables",
    "T46 F14 F15",
    "",
    """SELECT event_id, 'host' AS header, CAST(user_id AS VARCHAR) AS cell FROM events
       UNION ALL SELECT event_id, 'event', event_type FROM events UNION ALL SELECT event_id, 'props', props FROM events""",
)
def report_tables(spark: SparkSession, d: str) -> DataFrame:
    """Each event is rendered as a small pipe table, with a row of the wrong width, and parsed back."""
    lines = F.concat_ws(
        "\n",
        F.lit("intro text\n\nhost | event | props\n---- | ----- | -----"),
        F.concat_ws(" | ", F.col("user_id").cast("string"), "event_type", "props"),
        F.lit("too | short\n\ntail"),
    )
    rendered = table(spark, d, "events").select("event_id", lines.alias("content"))
    rows = report_text.pipe_tables(rendered, ["event_id"], "content")
    return rows.select("event_id", F.inline("cells"))


@plan(
    "report_key_values",
    "T46",
    "",
    """SELECT event_id, 'type' AS key, event_type AS value FROM events UNION ALL SELECT event_id, 'props', props FROM events""",
)
def report_key_values(spark: SparkSession, d: str) -> DataFrame:
    lines = F.concat(F.lit("type: "), F.col("event_type"), F.lit("\nnothing here\nempty:\nprops: "), F.col("props"))
    rendered = table(spark, d, "events").select("event_id", lines.alias("content"))
    return report_text.key_values(rendered, ["event_id"], "content").select("event_id", "key", "value")


@plan(
    "unavailable_sections",
    "T44",
    "",
    """SELECT doc_id, CAST((length(lower(t)) - length(replace(lower(t), 'section unavailable', ''))) / 19 AS INTEGER) AS unavailable
       FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 'Section unavailable ' ELSE '' END || text AS t FROM documents)""",
)
def unavailable_sections(spark: SparkSession, d: str) -> DataFrame:
    note = F.when(F.col("lang") == "en", "Section unavailable ").otherwise("")
    noted = table(spark, d, "documents").select("doc_id", F.concat(note, "text").alias("t"))
    return noted.select("doc_id", report_text.unavailable_count(F.col("t")).alias("unavailable"))
