"""Change-log application: net changes, merges, checkpoints, conflicts, history.

A change row has key columns, an ordering struct ``seq``, an operation ``op``
(I, U or D) and either typed columns or a ``data`` map of the columns present.
Later positions win, so every fold is an aggregate with partial combining and a
key that owns a third of the log is reduced before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import label
from tidemark.operators import graphs
from tidemark.operators.ordered import ROWS_PER_CHUNK, Running, following, previous, running

# Operation codes of a captured change table.
OPERATION_CODES = {1: "D", 2: "I", 4: "U"}

# Thresholds on checkpoint lag, in minutes.
LAG_PASS_MINUTES = 5
LAG_ALERT_MINUTES = 15


def decode_operation(code: Column) -> Column:
    """1 deletes, 2 inserts, 4 is an update's after-image; the rest gives null (skip)."""
    return F.when(code == 1, "D").when(code == 2, "I").when(code == 4, "U")


def flat_changes(df: DataFrame, keys: list[str], code: str = "__$operation", seq: list[str] | None = None) -> DataFrame:
    """Flat captured rows to change rows; ``__$`` columns are metadata, rows without a key are rejected."""
    seq = seq or ["__$start_lsn", "__$seqval"]
    data = [c for c in df.columns if not c.startswith("__$")]
    out = df.select(
        *data, decode_operation(F.col(f"`{code}`")).alias("op"), F.struct(*[F.col(f"`{c}`") for c in seq]).alias("seq")
    ).where(F.col("op").isNotNull())
    for key in keys:
        out = out.where(F.col(key).isNotNull())
    return out


def in_window(df: DataFrame, position: str, low: str, high: str) -> DataFrame:
    """Changes with ``low <= position <= high``; reaches the scan as a pushed filter."""
    return df.where(F.col(position).between(low, high))


def dedupe(df: DataFrame, identity: list[str]) -> DataFrame:
    return df.dropDuplicates(identity)


def net_changes(log: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Last change per key.

    The rank limit keeps one row per key and task before the shuffle, so a hot
    key sends no more rows than there are tasks.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))
    last = log.select(*keys, "op", *columns, "seq").withColumn("_rank", rank)
    return last.where(F.col("_rank") == 1).drop("_rank")


def apply_full(target: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Apply full-image changes: D drops the row, I and U replace it."""
    columns = [c for c in target.columns if c not in keys]
    net = net_changes(log, keys, columns).select(*keys, "op", F.struct(*columns).alias("_new"))
    old = target.select(*keys, F.struct(*columns).alias("_old"))
    merged = old.join(net, keys, "full").where(~F.col("op").eqNullSafe(F.lit("D")))
    row = F.when(F.col("op").isNotNull(), F.col("_new")).otherwise(F.col("_old"))
    return merged.select(*keys, row.alias("_row")).select(*keys, "_row.*").select(*target.columns)


def fold_partial(log: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Fold partial updates in one aggregate.

    Per key: the last reset (an insert or a delete) and, per column, the last
    change that carried it. A column counts only if it is not older than the
    reset; an explicit null in ``data`` is a value, an absent key is not.
    """
    reset = F.max(F.when(F.col("op").isin("I", "D"), F.struct("seq", "op"))).alias("_reset")
    lasts = []
    for c in columns:
        present = (F.col("op") != "D") & F.map_contains_key("data", F.lit(c))
        lasts.append(F.max(F.when(present, F.struct("seq", F.element_at("data", F.lit(c)).alias("v")))).alias(f"_c_{c}"))
    last = F.max_by("op", "seq").alias("op")
    folded = log.groupBy(*keys).agg(last, reset, F.max("seq").alias("seq"), *lasts)
    since = F.col("_reset.seq")

    def kept(c: str) -> Column:
        box = F.col(f"_c_{c}")
        return F.when(box.isNotNull() & (since.isNull() | (box["seq"] >= since)), F.struct(box["v"].alias("v")))

    return folded.select(*keys, "op", "seq", since.isNotNull().alias("was_reset"), *[kept(c).alias(c) for c in columns])


def apply_partial(target: DataFrame, log: DataFrame, keys: list[str], create: bool = True) -> DataFrame:
    """Apply changes whose ``data`` map holds only the columns present.

    ``create`` makes an update of an absent key insert it; otherwise such a row
    appears only if the log inserted it.
    """
    columns = [c for c in target.columns if c not in keys]
    folded = fold_partial(log, keys, columns)
    old = target.select(*keys, F.lit(True).alias("_held"), F.struct(*columns).alias("_old"))
    merged = old.join(folded, keys, "full").where(~F.col("op").eqNullSafe(F.lit("D")))
    if not create:
        merged = merged.where(F.col("_held") | F.col("was_reset"))
    kinds = {f.name: f.dataType for f in target.schema.fields}

    def value(c: str) -> Column:
        fresh = F.col(c)["v"].cast(kinds[c])
        kept = F.when(~F.coalesce("was_reset", F.lit(False)), F.col("_old")[c])
        return F.when(F.col(c).isNotNull(), fresh).otherwise(kept).alias(c)

    return merged.select(*keys, *[value(c) for c in columns]).select(*target.columns)


def conflicts(
    target: DataFrame, log: DataFrame, keys: list[str], order: list[str], rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Mark each change against the state it meets.

    The target's keys join the log as inserts before its first position, so one
    scan per key answers whether the key exists: its last insert or delete
    before a change was an insert.
    """
    given = target.select(*keys, F.lit("I").alias("op"), F.lit(True).alias("_given"))
    births = F.when(F.col("op").isin("I", "D"), F.col("op"))
    marked = running(
        log.withColumn("_given", F.lit(False)).unionByName(given, allowMissingColumns=True),
        keys,
        order,
        {"_last": Running("last", births, inclusive=False)},
        rows_per_chunk=rows_per_chunk,
        probe=log,
    ).where(~F.col("_given"))
    exists = F.coalesce(F.col("_last") == "I", F.lit(False))
    return marked.withColumn(
        "conflict",
        label(
            exists,
            [
                ((F.col("op") == "I") & exists, "DUPLICATE_INSERT"),
                ((F.col("op") == "U") & ~exists, "MISSING_ON_UPDATE"),
                ((F.col("op") == "D") & ~exists, "MISSING_ON_DELETE"),
            ],
            "NONE",
        ),
    ).drop("_last", "_given")


def resolve_conflicts(marked: DataFrame, duplicate_insert: str = "UPSERT", missing_row: str = "SKIP") -> DataFrame:
    """SKIP drops a conflicting change, UPSERT keeps an insert, ABORT raises if there is any."""
    duplicate = F.col("conflict") == "DUPLICATE_INSERT"
    missing = F.col("conflict").isin("MISSING_ON_UPDATE", "MISSING_ON_DELETE")
    out = marked
    for flag, policy in ((duplicate, duplicate_insert), (missing, missing_row)):
        if policy == "ABORT":
            if not marked.where(flag).isEmpty():
                raise ValueError("conflicting changes found and the policy is ABORT")
        elif policy == "SKIP":
            out = out.where(~flag)
        elif policy != "UPSERT":
            raise ValueError(f"unknown policy {policy}")
    return out


def advance_checkpoint(checkpoint: DataFrame, applied: DataFrame, run_ts: str) -> DataFrame:
    """Per table: greatest position, its time, rows added. ``applied`` is the log just applied."""
    fresh = applied.groupBy("table_name").agg(
        F.max("scn").alias("last_scn"),
        F.max_by("ts", F.struct("scn", "ts")).alias("last_timestamp"),
        F.count("*").alias("rows_applied"),
    )
    return (
        checkpoint.select("table_name", "last_scn", "last_timestamp", "rows_applied")
        .unionByName(fresh)
        .groupBy("table_name")
        .agg(
            F.max("last_scn").alias("last_scn"),
            F.max_by("last_timestamp", F.struct("last_scn", "last_timestamp")).alias("last_timestamp"),
            F.sum("rows_applied").alias("rows_applied"),
        )
        .withColumn("updated_at", F.lit(run_ts).cast("timestamp_ntz"))
    )


def after_checkpoint(log: DataFrame, checkpoint: DataFrame, position: str = "scn") -> DataFrame:
    """Changes beyond the stored position of their table; tables without one start at 0."""
    marks = checkpoint.select("table_name", F.col("last_scn").alias("_mark"))
    joined = log.join(marks, "table_name", "left")
    return joined.where(F.col(position) > F.coalesce("_mark", F.lit(0))).drop("_mark")


def in_scope(log: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    out = log.where(F.col("table_name").isin(*include)) if include else log
    return out.where(~F.col("table_name").isin(*exclude)) if exclude else out


def replay_rank(tables: list[str]) -> Column:
    """Position of a table in the dependency order; unlisted tables come last."""
    pairs = [(F.col("table_name") == t, str(i)) for i, t in enumerate(tables)]
    return label(F.col("table_name"), pairs, str(len(tables))).cast("int")


def replay_tables(
    targets: dict[str, DataFrame], log: DataFrame, keys: dict[str, list[str]], order: list[str]
) -> dict[str, DataFrame]:
    """New version of every target, parents before children; ``log`` holds full images of all tables."""
    ranked = [t for t in order if t in targets] + [t for t in targets if t not in order]
    return {t: apply_full(targets[t], log.where(F.col("table_name") == t), keys[t]) for t in ranked}


def batch_tallies(marked: DataFrame, status: Column, by: list[str] | None = None) -> DataFrame:
    """Applied and failed changes per table."""
    return marked.groupBy(*(by or ["table_name"])).agg(
        F.count_if(status == "APPLIED").alias("applied"), F.count_if(status == "FAILED").alias("failed")
    )


def history(
    log: DataFrame, keys: list[str], order: list[str], valid: str, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Validity intervals of each version; a delete closes the interval before it and has none."""
    ahead = following(log, keys, order, {"valid_to": valid}, rows_per_chunk=rows_per_chunk)
    return (
        ahead.where(F.col("op") != "D")
        .withColumn("valid_from", F.col(valid))
        .withColumn("is_current", F.col("valid_to").isNull())
    )


def checkpoint_lag(checkpoint: DataFrame, as_of: str) -> DataFrame:
    """Minutes since the last applied change, with PASS / WARN / ALERT."""
    seconds = F.timestamp_diff("SECOND", F.col("last_timestamp"), F.lit(as_of).cast("timestamp_ntz"))
    lag = F.round(seconds.cast("double") / 60.0, 2)
    status = F.when(lag < LAG_PASS_MINUTES, "PASS").when(lag > LAG_ALERT_MINUTES, "ALERT").otherwise("WARN")
    return checkpoint.select("table_name", "last_scn", lag.alias("lag_minutes"), status.alias("status"))


def replay_layers(tables: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (table_name, layer, state) of the order in which tables can be replayed.

    ``tables`` has table_name, ``links`` child and parent: a child's changes need its
    parents' first, so tables of one layer can be replayed side by side. Tables on a
    cycle of links or behind one have no layer and state ``CYCLE`` or ``BLOCKED``.
    """
    nodes = tables.select(F.col("table_name").alias("node"))
    return graphs.layers(nodes, links.select(F.col("child").alias("src"), F.col("parent").alias("dst"))).withColumnRenamed("node", "table_name")


def replay_sanity(
    log: DataFrame, arrival: str, position: str, by: list[str], rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Per table: changes that arrived out of order and jumps in a dense position sequence."""
    arrived = previous(log, by, [arrival], {"_before": position}, rows_per_chunk=rows_per_chunk)
    late = arrived.groupBy(*by).agg(
        F.count("*").alias("changes"),
        F.count_if(F.col(position) < F.col("_before")).alias("out_of_order"),
        F.max(position).alias("newest_position"),
    )
    dense = previous(
        log.select(*by, position).distinct(), by, [position], {"_before": position}, rows_per_chunk=rows_per_chunk
    )
    jumps = dense.groupBy(*by).agg(F.count_if(F.col(position) - F.col("_before") > 1).alias("position_gaps"))
    named = jumps.select(*[F.col(c).alias(f"_j_{c}") for c in by], "position_gaps")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_j_{c}"))
    return late.join(named, same).select(*late.columns, "position_gaps")


def operation_parity(source: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """Operations per window, table and kind on both logs, with the difference."""
    s = source.groupBy(*by).agg(F.count("*").alias("_s"))
    t = target.groupBy(*by).agg(F.count("*").alias("_t"))
    zero = F.lit(0).cast("bigint")
    return s.join(t, by, "full").select(
        *by,
        F.coalesce("_s", zero).alias("source_ops"),
        F.coalesce("_t", zero).alias("target_ops"),
        (F.coalesce("_t", zero) - F.coalesce("_s", zero)).alias("delta"),
    )
