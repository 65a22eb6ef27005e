"""Counter deltas, resampling, alerts, replicas, capacity and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import epoch_micros, exact_mean, ratio_or_null
from tidemark.operators.ordered import ROWS_PER_CHUNK, Running, exact_percentiles, previous, running, runs

FORECAST_DAYS = (30, 90, 180)


def counter_deltas(
    df: DataFrame, keys: list[str], ts: str, tie: str, counter: str, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Change since the snapshot before; a fall means a reset, then the new value is the change."""
    out = previous(df, keys, [ts, tie], {"previous_value": counter}, rows_per_chunk=rows_per_chunk)
    change = F.col(counter) - F.col("previous_value")
    return out.withColumn("was_reset", F.coalesce(change < 0, F.lit(False))).withColumn(
        "delta", F.when(change < 0, F.col(counter)).otherwise(change)
    )


def delta_findings(deltas: DataFrame, warn: float, critical: float) -> DataFrame:
    """Deltas above a limit with severity and recommendation."""
    level = F.when(F.col("delta") > critical, "CRITICAL").when(F.col("delta") > warn, "WARN")
    advice = F.when(F.col("delta") > critical, "Investigate now").otherwise("Watch next window")
    return deltas.withColumn("severity", level).where(F.col("severity").isNotNull()).withColumn("recommendation", advice)


def resample(df: DataFrame, ts: str, by: list[str], value: str, width: str = "5 minutes") -> DataFrame:
    """Mean, maximum and total per window."""
    grouped = df.groupBy(*by, F.window(ts, width).alias("_w")).agg(
        F.count("*").alias("samples"), F.sum(value).alias("total"), F.max(value).alias("maximum")
    )
    return grouped.select(
        *by,
        F.col("_w.start").alias("bucket"),
        "samples",
        "total",
        "maximum",
        ratio_or_null(F.col("total"), F.col("samples")).alias("average"),
    )


def sliding_rates(df: DataFrame, ts: str, by: list[str], width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Events per second and error share in sliding windows; ``is_error`` marks errors.

    ``width`` must be a multiple of ``slide``. Rows are counted per slide first,
    and only those counts are copied into the windows that overlap them.
    """
    per_slide = df.groupBy(*by, F.window(ts, slide)["start"].alias("_t")).agg(
        F.count("*").alias("_n"), F.count_if(F.col("is_error")).alias("_e")
    )
    counted = per_slide.groupBy(*by, F.window("_t", width, slide).alias("_w")).agg(
        F.sum("_n").alias("events"), F.sum("_e").alias("errors")
    )
    seconds = F.timestamp_diff("SECOND", F.col("_w.start"), F.col("_w.end")).cast("double")
    return counted.select(
        *by,
        F.col("_w.start").alias("bucket"),
        "events",
        "errors",
        (F.col("events").cast("double") / seconds).alias("per_second"),
        ratio_or_null(F.col("errors"), F.col("events")).alias("error_ratio"),
    )


def failure_runs(
    df: DataFrame, keys: list[str], ts: str, tie: str, failed: Column, threshold: int = 3, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Runs of at least ``threshold`` consecutive failures."""
    out = runs(df, keys, [ts, tie], failed, rows_per_chunk=rows_per_chunk)
    return out.where(F.col("run_length") >= threshold)


def sustained(
    df: DataFrame, keys: list[str], ts: str, tie: str, condition: Column, seconds: int, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Runs in which a condition held for at least ``seconds``."""
    out = runs(df, keys, [ts, tie], condition, rows_per_chunk=rows_per_chunk)
    held = F.timestamp_diff("SECOND", F.col("run_start"), F.col("run_end"))
    return out.withColumn("held_seconds", held).where(F.col("held_seconds") >= seconds)


def week_over_week(df: DataFrame, keys: list[str], ts: str, value: str, p: float = 0.99, limit_pct: float = 20.0) -> DataFrame:
    """Weekly percentile per key with the change to the week before."""
    weekly = exact_percentiles(
        df.withColumn("week", F.trunc(F.col(ts).cast("date"), "week")), [*keys, "week"], value, {"p": p}
    )
    window = Window.partitionBy(*keys).orderBy("week")
    change = F.round(F.lit(100.0) * (F.col("p") - F.col("_before")) / F.nullif(F.col("_before"), F.lit(0.0)), 4)
    return (
        weekly.withColumn("p", F.round("p", 6))
        .withColumn("_before", F.lag("p").over(window))
        .select(
            *keys, "week", F.col("p").alias("p_value"), change.alias("change_pct"),
            F.coalesce(change > limit_pct, F.lit(False)).alias("degraded"),
        )
    )


def counter_panel(df: DataFrame, ids: list[str], name: str, value: str, wanted: list[str]) -> DataFrame:
    """Chosen counters as columns; the value list is explicit, so one pass suffices."""
    picked = df.where(F.col(name).isin(*wanted))
    return picked.groupBy(*ids).agg(*[
        F.sum(F.when(F.col(name) == w, F.col(value))).alias(w) for w in wanted
    ])


def config_drift(df: DataFrame, parameter: str, value: str) -> DataFrame:
    """Parameters with more than one value in the fleet."""
    grouped = df.groupBy(parameter).agg(
        F.countDistinct(value).alias("distinct_values"), F.min(value).alias("lowest"), F.max(value).alias("highest")
    )
    return grouped.where(F.col("distinct_values") > 1)


def config_changes(before: DataFrame, after: DataFrame, parameter: str, value: str) -> DataFrame:
    """Parameters added, removed or set to another value between two snapshots or hosts."""
    b = before.select(parameter, F.col(value).alias("old_value"), F.lit(True).alias("_b"))
    a = after.select(parameter, F.col(value).alias("new_value"), F.lit(True).alias("_a"))
    change = F.when(F.col("_b").isNull(), "ADDED").when(F.col("_a").isNull(), "REMOVED").when(
        ~F.col("old_value").eqNullSafe(F.col("new_value")), "CHANGED"
    )
    joined = b.join(a, parameter, "full").withColumn("change", change)
    return joined.where(F.col("change").isNotNull()).drop("_a", "_b")


def replica_lag(df: DataFrame, by: list[str], ts: str, as_of: str, warn: int = 10, critical: int = 60) -> DataFrame:
    """Seconds since the newest applied change per replica."""
    newest = df.groupBy(*by).agg(F.max(ts).alias("last_applied"))
    lag = F.timestamp_diff("SECOND", F.col("last_applied"), F.lit(as_of).cast("timestamp_ntz"))
    return newest.withColumn("lag_seconds", lag).withColumn(
        "status",
        F.when(F.col("lag_seconds") > critical, "CRITICAL").when(F.col("lag_seconds") > warn, "HIGH").otherwise("OK"),
    )


def last_by(df: DataFrame, keys: list[str], sequence: str, value: str, out: str) -> DataFrame:
    """Highest sequence per key and the greatest value at it."""
    return (
        df.groupBy(*keys)
        .agg(F.max(F.struct(sequence, value)).alias("_m"))
        .select(*keys, F.col(f"_m.{sequence}").alias(f"last_{sequence}"), F.col(f"_m.{value}").alias(out))
    )


def promotion_rank(
    replicas: DataFrame,
    cluster: list[str],
    healthy: Column,
    same_version: Column,
    lag: str,
    name: str,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Healthy replicas of the same major version, lowest lag first."""
    fit = replicas.where(healthy & same_version)
    return running(fit, cluster, [lag, name], {"promotion_rank": Running("count", F.lit(1))}, rows_per_chunk=rows_per_chunk)


def capacity_forecast(
    df: DataFrame, keys: list[str], ts: str, value: str, warn: float, limit: float, scale: int = 100
) -> DataFrame:
    """Least-squares trend per key over daily peaks, projected with a two-sigma band.

    Peaks are held as whole multiples of ``1/scale`` and the sums are exact, so
    the fit does not depend on the order in which tasks finish.
    """
    whole = "decimal(38,0)"
    peaks = df.groupBy(*keys, F.to_date(ts).alias("_day")).agg(F.max(value).alias("_p"))
    x = F.datediff(F.col("_day"), F.lit("2000-01-01").cast("date")).cast("decimal(10,0)")
    y = F.round(F.col("_p") * scale).cast("decimal(18,0)")
    sums = peaks.select(*keys, x.alias("_x"), y.alias("_y")).groupBy(*keys).agg(
        F.count("*").cast("decimal(10,0)").alias("_n"),
        F.sum("_x").cast("decimal(18,0)").alias("_sx"),
        F.sum("_y").cast("decimal(25,0)").alias("_sy"),
        F.sum(F.col("_x") * F.col("_x")).cast("decimal(25,0)").alias("_sxx"),
        F.sum(F.col("_x") * F.col("_y")).cast("decimal(28,0)").alias("_sxy"),
        F.sum((F.col("_y") * F.col("_y")).cast(whole)).cast(whole).alias("_syy"),
        F.max("_x").cast("double").alias("_last"),
    )

    def number(column: Column) -> Column:
        return column.cast(whole).cast("double")

    n = F.col("_n")
    spread = number((n * F.col("_sxx")).cast(whole) - (F.col("_sx") * F.col("_sx")).cast(whole))
    fitted = sums.where(n > 2).withColumns({
        "_dx": spread,
        "_dxy": number((n * F.col("_sxy")).cast(whole) - (F.col("_sx") * F.col("_sy")).cast(whole)),
        "_dy": number((n * F.col("_syy")).cast(whole) - (F.col("_sy") * F.col("_sy")).cast(whole)),
        "_n": n.cast("double"),
    })
    fitted = fitted.withColumn("_slope", F.col("_dxy") / F.col("_dx"))
    intercept = (number(F.col("_sy")) - F.col("_slope") * number(F.col("_sx"))) / F.col("_n")
    residual = (F.col("_dy") - F.col("_slope") * F.col("_dxy")) / F.col("_n")
    out = fitted.select(
        *keys,
        F.explode(F.array(*[F.lit(h) for h in FORECAST_DAYS])).alias("horizon_days"),
        "_last",
        "_slope",
        intercept.alias("_b"),
        F.sqrt(F.greatest(residual, F.lit(0.0)) / (F.col("_n") - 2)).alias("_sd"),
    )
    projected = (F.col("_b") + F.col("_slope") * (F.col("_last") + F.col("horizon_days"))) / float(scale)
    band = F.lit(2.0) * F.col("_sd") / float(scale)
    return out.select(
        *keys,
        "horizon_days",
        projected.alias("projected"),
        (projected - band).alias("low"),
        (projected + band).alias("high"),
        F.when(projected > limit, "SCALE").when(projected > warn, "ALERT").otherwise("OK").alias("trigger"),
    )


def unit_cost(spend: DataFrame, usage: DataFrame, key: list[str], spend_col: str, usage_col: str, per: float) -> DataFrame:
    joined = spend.join(usage, key, "left")
    cost = F.round(ratio_or_null(F.col(spend_col).cast("double") * per, F.col(usage_col)), 4)
    return joined.withColumn("unit_cost", cost)


def peak_profile(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Load by weekday (1 = Sunday) and hour."""
    return df.groupBy(F.dayofweek(ts).alias("weekday"), F.hour(ts).alias("hour")).agg(
        F.count("*").alias("samples"), F.sum(value).alias("total")
    )


def backup_rules(df: DataFrame, keys: list[str], ts: str, size: str, as_of: str) -> DataFrame:
    """BackupMissing: older than 25 hours. BackupSizeDrop: newest below half the mean."""
    grouped = df.groupBy(*keys).agg(
        F.max(ts).alias("last_backup"),
        F.max_by(size, epoch_micros(F.col(ts))).alias("last_size"),
        exact_mean(F.col(size)).alias("mean_size"),
    )
    hours = F.timestamp_diff("SECOND", F.col("last_backup"), F.lit(as_of).cast("timestamp_ntz")) / 3600.0
    return grouped.select(
        *keys,
        "last_backup",
        (hours > 25).alias("backup_missing"),
        (F.col("last_size").cast("double") < F.col("mean_size") * 0.5).alias("size_drop"),
    )


def freshness(df: DataFrame, source: str, ts: str, as_of: str, max_minutes: int) -> DataFrame:
    """Minutes since the newest event per source against its schedule."""
    newest = df.groupBy(source).agg(F.max(ts).alias("newest"))
    age = F.timestamp_diff("MINUTE", F.col("newest"), F.lit(as_of).cast("timestamp_ntz"))
    return newest.withColumn("age_minutes", age).withColumn(
        "status", F.when(F.col("age_minutes") > max_minutes, "STALE").otherwise("FRESH")
    )
