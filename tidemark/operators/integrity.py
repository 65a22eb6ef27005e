"""Key, reference, null, range, schema and completeness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import previous
from tidemark.session import materialize


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    any_null = F.lit(False)
    for key in keys:
        any_null = any_null | F.col(key).isNull()
    return df.agg(F.count_if(any_null).alias("null_keys"))


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    parents = parent.select(F.col(parent_key).alias(foreign_key))
    return child.where(F.col(foreign_key).isNotNull()).join(parents, foreign_key, "left_anti")


def orphan_counts(child: DataFrame, foreign_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Orphan keys with the number of child rows; the child is counted per key before the join."""
    referenced = child.where(F.col(foreign_key).isNotNull()).groupBy(foreign_key).agg(F.count("*").alias("child_rows"))
    parents = parent.select(F.col(parent_key).alias(foreign_key))
    return referenced.join(parents, foreign_key, "left_anti")


def link_orphans(tables: dict[str, DataFrame], candidates: list[tuple[str, str, str, str]]) -> DataFrame:
    """Rows (child, child_key, parent, orphan_keys), one per candidate (child, column, parent, column).

    Both sides are reduced to distinct keys before they meet. A candidate without
    orphan keys is a link that the data keep.
    """
    parts = []
    for child, key, parent, parent_key in candidates:
        keys = tables[child].select(F.col(key).alias("k")).where("k IS NOT NULL").distinct()
        lost = keys.join(tables[parent].select(F.col(parent_key).alias("k")), "k", "left_anti").agg(F.count("*").alias("orphan_keys"))
        parts.append(lost.select(F.lit(child).alias("child"), F.lit(key).alias("child_key"), F.lit(parent).alias("parent"), "orphan_keys"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def parity_by(source: DataFrame, target: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """Per group both sides' measures and the difference: ``source_<m>``, ``target_<m>``, ``<m>_delta``.

    ``measures`` are aggregates. Each side is aggregated before the two meet; a group of one side has
    zeros on the other, and null groups meet each other.
    """
    names = list(measures)
    sides = [df.groupBy(*by).agg(*[m.alias(n) for n, m in measures.items()]).withColumn("_side", F.lit(i)) for i, df in enumerate((source, target))]
    both = sides[0].unionByName(sides[1])
    kinds = {f.name: f.dataType for f in both.schema}

    def of(name: str, side: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("_side") == side, F.col(name))), F.lit(0)).cast(kinds[name])

    joined = both.groupBy(*by).agg(*[of(n, i).alias(f"{p}_{n}") for n in names for i, p in enumerate(("source", "target"))])
    return joined.select("*", *[(F.col(f"target_{n}") - F.col(f"source_{n}")).alias(f"{n}_delta") for n in names])


def top_parity(source: DataFrame, target: DataFrame, key: str, measure: Column, top: int = 50) -> DataFrame:
    """Keys among the ``top`` of either side by ``measure``: both values, difference and both ranks.

    A rank is null where the key is not among the side's top; equal values are ranked by key.
    """
    totals = parity_by(source, target, [key], {"value": measure})
    totals = materialize(totals, "top_parity")

    def ranks(side: str, held: DataFrame) -> DataFrame:
        own = held.groupBy(key).agg(measure.alias("_v")).orderBy(F.desc("_v"), key).limit(top)
        number = F.row_number().over(Window.orderBy(F.desc("_v"), key)).cast("int")  # over ``top`` rows
        return own.select(F.col(key).alias(f"_{side}"), number.alias(f"{side}_rank"))

    joined = totals
    for side, held in (("source", source), ("target", target)):
        joined = joined.join(ranks(side, held), F.col(key).eqNullSafe(F.col(f"_{side}")), "left")
    listed = joined.where("source_rank IS NOT NULL OR target_rank IS NOT NULL")
    return listed.select(key, "source_value", "target_value", "value_delta", "source_rank", "target_rank")


def null_violations(df: DataFrame, required: list[str]) -> DataFrame:
    """Null rows per required column, all columns in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return one.unpivot([], required, "column_name", "null_rows")


def range_anomalies(df: DataFrame, bounds: dict[str, tuple[str, str]]) -> DataFrame:
    """Minimum, maximum and rows out of bounds per column; bounds are SQL literals."""
    rows = []
    for name, (low, high) in bounds.items():
        inside = (F.col(name) >= F.expr(low)) & (F.col(name) <= F.expr(high))
        rows.append((
            name,
            F.min(name).cast("string"),
            F.max(name).cast("string"),
            F.count_if(~inside),
            F.count_if(F.col(name).isNull()),
        ))
    one = df.agg(*[
        F.struct(
            F.lit(n).alias("column_name"),
            lo.alias("min_value"),
            hi.alias("max_value"),
            bad.alias("out_of_range"),
            nulls.alias("null_rows"),
        ).alias(n)
        for n, lo, hi, bad, nulls in rows
    ])
    return one.select(F.inline(F.array(*[F.col(r[0]) for r in rows])))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking a rule, per rule. A rule that is null for a row is not broken."""
    one = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    return one.unpivot([], list(rules), "rule", "violations")


def column_profile(df: DataFrame) -> DataFrame:
    """Type and number of filled rows of every column, in one pass."""
    one = df.agg(*[
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.count(F.col(f.name)).alias("filled"),
        ).alias(f"_c{i}")
        for i, f in enumerate(df.schema.fields)
    ])
    return one.select(F.inline(F.array(*[F.col(c) for c in one.columns])))


def document_profile(df: DataFrame, fields: str) -> DataFrame:
    """Field names and value kinds found in a map column of text values."""
    seen = df.select(F.explode(fields).alias("column_name", "_v"))
    number = F.coalesce(F.bool_and(F.col("_v").try_cast("double").isNotNull() | F.col("_v").isNull()), F.lit(True))
    return seen.groupBy("column_name").agg(
        F.when(number, "number").otherwise("text").alias("data_type"), F.count("*").alias("filled")
    )


def schema_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """ADDED / REMOVED / RETYPED columns between two (column_name, data_type, filled) tables."""
    b = before.select("column_name", F.col("data_type").alias("old_type"), F.col("filled").alias("old_filled"))
    a = after.select("column_name", F.col("data_type").alias("new_type"), F.col("filled").alias("new_filled"))
    change = (
        F.when(F.col("old_type").isNull(), "ADDED")
        .when(F.col("new_type").isNull(), "REMOVED")
        .when(F.col("old_type") != F.col("new_type"), "RETYPED")
    )
    return b.join(a, "column_name", "full").withColumn("change", change).where(F.col("change").isNotNull())


def object_parity(source: DataFrame, target: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Object counts per kind on both sides; inputs have one row per object with ``object_type``.

    Every kind on either side is compared; ``expected`` kinds appear even where neither side has them.
    """
    none = F.lit(0).cast("bigint")
    counts = [df.groupBy("object_type").agg(F.count("*").alias(n)) for df, n in ((source, "source_count"), (target, "target_count"))]
    joined = counts[0].join(counts[1], "object_type", "full")
    if expected:
        listed = source.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, expected))).alias("object_type"))
        joined = joined.join(listed, "object_type", "full")
    joined = joined.select("object_type", *[F.coalesce(n, none).alias(n) for n in ("source_count", "target_count")])
    return joined.withColumn(
        "status", F.when(F.col("source_count") == F.col("target_count"), "MATCH").otherwise("MISMATCH")
    )


def key_coverage(tables: DataFrame, primary_keys: DataFrame) -> DataFrame:
    """PK_PRESENT / NO_PK per table; inputs (table_name, row_estimate) and (table_name)."""
    keyed = primary_keys.select("table_name").distinct().withColumn("_pk", F.lit(True))
    return tables.join(keyed, "table_name", "left").select(
        "table_name", "row_estimate", F.when(F.col("_pk"), "PK_PRESENT").otherwise("NO_PK").alias("pk_status")
    )


def id_gaps(df: DataFrame, key: str, width: int = 1_000_000) -> DataFrame:
    """Holes in a sequence of ids. Ranges of ``width`` ids are scanned apart and stitched."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_all", F.lit(0))
    lagged = previous(ids, ["_all"], [key], {"_before": key}, chunk=F.floor(F.col(key) / width))
    gap = F.col(key) - F.col("_before")
    return lagged.where(gap > 1).select(
        (F.col("_before") + 1).alias("gap_start"), (F.col(key) - 1).alias("gap_end"), (gap - 1).alias("missing_ids")
    )


def daily_completeness(df: DataFrame, ts: str, last_day: str, days: int = 7) -> DataFrame:
    """Rows per day for the last days; days without rows show zero."""
    end = F.lit(last_day).cast("date")
    start = F.date_sub(end, days - 1)
    calendar = df.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("day"))
    counts = (
        df.where((F.col(ts) >= start.cast("timestamp_ntz")) & (F.col(ts) < F.date_add(end, 1).cast("timestamp_ntz")))
        .groupBy(F.to_date(ts).alias("day"))
        .agg(F.count("*").alias("_n"))
    )
    return calendar.join(counts, "day", "left").select("day", F.coalesce("_n", F.lit(0).cast("bigint")).alias("rows"))


def unbalanced(df: DataFrame, group: list[str], amount: Column) -> DataFrame:
    """Groups whose amounts do not sum to zero."""
    return df.groupBy(*group).agg(F.sum(amount).alias("balance")).where(F.col("balance") != 0)


def period_over_period(df: DataFrame, dims: list[str], period: Column, amount: Column) -> DataFrame:
    """Total per dimension and period with the change to the period before."""
    totals = df.groupBy(*dims, period.alias("period")).agg(amount.alias("total"))
    window = Window.partitionBy(*dims).orderBy("period") if dims else Window.partitionBy(F.lit(0)).orderBy("period")
    return totals.withColumn("previous_total", F.lag("total").over(window)).withColumn(
        "change", F.col("total") - F.col("previous_total")
    )
