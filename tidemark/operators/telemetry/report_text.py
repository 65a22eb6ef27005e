"""Sectioned text reports: sections, findings by keyword, pipe tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERVIEW = "Overview"
UNAVAILABLE = "section unavailable"

# Fixed values: (all of these groups must hold: any keyword of a group in the lower-cased text, finding).
FINDING_RULES = (
    ((("section unavailable",),), "Some sections were unavailable due to privileges, feature flags, or engine/version differences."),
    ((("deadlock",),), "Deadlock signals were detected; review lock chains and top contending statements."),
    ((("lock wait", "row_lock"),), "Lock wait pressure detected; investigate blocking sessions and transaction scope."),
    ((("log waits",),), "Redo/log write pressure may be present; validate IOPS and log file throughput."),
    ((("tmp_disk", "tmp table"),), "Temporary object usage observed; inspect sort/hash memory limits and query patterns."),
    ((("blocking_session_id", "head blocker"),), "Blocking chain data is present; check head blockers, transaction scope, and lock duration."),
    ((("memory grants pending", "resource_semaphore"),), "Memory grant pressure indicators are present; inspect grant queues and large query concurrency."),
    ((("pageiolatch", "io/log", "writelog"),), "IO or log-write pressure indicators are present; correlate file latency with top read/write statements."),
    ((("query store",),), "Query Store data is available; compare runtime outliers and plan regressions against recent change windows."),
    ((("innodb_deadlocks", "innodb_row_lock_waits"),), "InnoDB deadlock or row lock wait pressure detected; investigate lock order and transaction scope."),
    ((("created_tmp_disk_tables",),), "Temporary disk table usage detected; consider raising tmp_table_size/max_heap_table_size."),
    ((("innodb_log_waits",),), "InnoDB log wait pressure present; consider increasing innodb_log_buffer_size."),
    ((("select_full_join", "no_index_used"),), "Full-table scan or no-index-used signals present; review query plans and index coverage."),
    ((("slave_sql_running", "replica_sql_running"),), "Replication data is present; validate replica lag and IO/SQL thread state."),
    ((("wal_buffers_full", "checkpoints_req"),), "PostgreSQL WAL/checkpoint pressure signals detected; review checkpoint cadence and write bursts."),
    ((("n_dead_tup", "autovacuum"),), "Table bloat or autovacuum pressure may be present; inspect dead tuples and vacuum throughput."),
    ((("aggregate pga", "over allocation count"),), "Oracle PGA pressure indicators detected; validate memory targets and workarea policy."),
    ((("tablespace",), ("used_percent",)), "Tablespace utilization data present; review high used-percent tablespaces for capacity risk."),
)
DEFAULT_FINDING = "No explicit high-risk indicators were auto-detected; validate against workload SLO baselines."

# Fixed values: (title keywords, specificity rank, section class). In literal mode the order of the list decides.
SECTION_RULES = (
    (("wait",), 2, "waits"),
    (("active requests", "ash"), 1, "workload sample"),
    (("cpu", "duration", "read and write"), 1, "top statements"),
    (("blocking", "deadlock"), 1, "concurrency"),
    (("memory", "tempdb"), 1, "memory"),
    (("alwayson", "replica"), 1, "replica health"),
    (("io", "log"), 3, "storage latency"),
    (("query store",), 0, "plan history"),
    (("buffer pool",), 0, "buffer pool"),
    (("innodb io", "log pressure"), 0, "redo pressure"),
    (("statement wait",), 0, "wait events"),
    (("lock wait", "transaction"), 0, "lock waits"),
    (("table io",), 0, "table io"),
    (("wal", "checkpoint"), 1, "wal"),
    (("vacuum", "analyze"), 1, "vacuum"),
    (("slot health",), 0, "slots"),
    (("sga", "pga"), 1, "memory pools"),
    (("tablespace",), 1, "tablespace"),
    (("undo",), 1, "undo"),
    (("user and host", "session mix"), 0, "session mix"),
    (("schema", "inventory"), 1, "inventory"),
    (("binary log",), 0, "binary log"),
    (("replication",), 1, "replication"),
    (("rows examined", "execution count", "temp disk", "errors"), 0, "secondary statements"),
    (("throughput", "workload"), 1, "throughput"),
    (("configuration", "server config"), 1, "configuration"),
    (("active sessions",), 0, "workload sample"),
)
UNAVAILABLE_CLASS = "unavailable"
DEFAULT_CLASS = "telemetry"


def sections(df: DataFrame, report_id: str, text: str) -> DataFrame:
    """One row per ``## title`` block; lines before the first title form the overview.

    A block without any line under its title is left out.
    """
    unix = F.regexp_replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), r"\n\z", "")
    blocks = F.split(F.concat(F.lit("\n"), unix), "\n## ")
    exploded = df.where(F.length(text) > 0).select(report_id, F.posexplode(blocks).alias("section_no", "_block"))
    title = F.when(F.col("section_no") == 0, OVERVIEW).otherwise(F.trim(F.substring_index("_block", "\n", 1)))
    body = F.expr("substring(_block, instr(_block, '\\n') + 1)")
    return exploded.where(F.instr("_block", "\n") > 0).select(
        report_id, "section_no", title.alias("title"), _strip(body).alias("content")
    )


def _strip(column: Column) -> Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def _matches(lower: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    every = F.lit(True)
    for group in groups:
        some = F.lit(False)
        for keyword in group:
            some = some | F.contains(lower, F.lit(keyword))
        every = every & some
    return every


def findings(df: DataFrame, report_id: str, text: str) -> DataFrame:
    """Findings per report in rule order, or the default finding. Rules are literals, so no join."""
    lowered = df.select(report_id, F.lower(text).alias("_lower"))
    hits = F.array_compact(F.array(*[
        F.when(_matches(F.col("_lower"), groups), F.struct(F.lit(i).alias("rule_no"), F.lit(f).alias("finding")))
        for i, (groups, f) in enumerate(FINDING_RULES)
    ]))
    default = F.array(F.struct(F.lit(len(FINDING_RULES)).alias("rule_no"), F.lit(DEFAULT_FINDING).alias("finding")))
    return lowered.select(report_id, hits.alias("_hits")).select(
        report_id, F.inline(F.when(F.size("_hits") == 0, default).otherwise(F.col("_hits")))
    )


def unavailable_count(text: Column) -> Column:
    lower = F.lower(text)
    return ((F.length(lower) - F.length(F.replace(lower, F.lit(UNAVAILABLE), F.lit("")))) / len(UNAVAILABLE)).cast("int")


def classify_section(title: Column, content: Column, mode: str = "specific") -> Column:
    """``specific``: the most specific matching rule wins. ``literal``: the first in list order wins."""
    lower = F.lower(title)
    rules = [(words, name) for words, _, name in SECTION_RULES]
    if mode == "specific":
        rules = [(words, name) for words, _, name in sorted(SECTION_RULES, key=lambda r: r[1])]
    expression = F.when(F.contains(F.lower(content), F.lit(UNAVAILABLE)), UNAVAILABLE_CLASS).otherwise(DEFAULT_CLASS)
    for words, name in reversed(rules):
        expression = F.when(_matches(lower, (words,)), name).otherwise(expression)
    return expression


def pipe_tables(df: DataFrame, ids: list[str], content: str) -> DataFrame:
    """Rows of pipe tables as maps header -> cell.

    Blocks are separated by blank lines. A table block has a header with a pipe
    and a rule line of dashes; rows of another width are dropped.
    """
    blocks = df.select(*ids, F.posexplode(F.split(F.col(content), r"\n[ \t]*\n")).alias("block_no", "_b"))
    lines = blocks.select(*ids, "block_no", F.filter(F.split("_b", "\n"), lambda x: F.length(F.trim(x)) > 0).alias("_l"))

    def cells(line: Column) -> Column:
        return F.transform(F.split(line, r"\|"), lambda c: F.trim(c))

    rule = F.regexp_replace(F.get("_l", F.lit(1)), r"[| ]", "")
    tables = lines.where(
        (F.size("_l") >= 3) & F.contains(F.get("_l", F.lit(0)), F.lit("|")) & rule.rlike("^-+$")
    ).select(*ids, "block_no", cells(F.get("_l", F.lit(0))).alias("_h"), F.posexplode(F.expr("slice(_l, 3, size(_l))")).alias("row_no", "_r"))
    rows = tables.where(F.contains("_r", F.lit("|"))).withColumn("_c", cells(F.col("_r")))
    return rows.where(F.size("_c") == F.size("_h")).select(
        *ids, "block_no", "row_no", F.arrays_zip(F.col("_h").alias("header"), F.col("_c").alias("cell")).alias("cells")
    )


def key_values(df: DataFrame, ids: list[str], content: str) -> DataFrame:
    """``key: value`` lines; the first colon splits."""
    lines = df.select(*ids, F.posexplode(F.split(F.col(content), "\n")).alias("line_no", "_l"))
    at = F.instr("_l", ":")
    return lines.where(at > 0).select(
        *ids,
        "line_no",
        F.trim(F.expr("substring(_l, 1, instr(_l, ':') - 1)")).alias("key"),
        F.trim(F.expr("substring(_l, instr(_l, ':') + 1)")).alias("value"),
    ).where((F.length("key") > 0) & (F.length("value") > 0))
