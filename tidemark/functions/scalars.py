"""Scalar expressions: safe arithmetic, lenient parsing, clock differences, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The texts that mark a row as soft-deleted.
DELETED_VALUES = ("1", "Y", "true", "t")

# Seconds per unit.
UNIT_SECONDS = {"SECOND": 1, "MINUTE": 60, "HOUR": 3600, "DAY": 86400}


UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def _utc_session() -> bool:
    spark = SparkSession.getActiveSession()
    return spark is not None and spark.conf.get("spark.sql.session.timeZone") in UTC_NAMES


def epoch_micros(column: Column) -> Column:
    """Microseconds since 1970 of a date or of a timestamp without time zone, as bigint.

    In a UTC session this is one cast. Elsewhere that cast would bend local
    times around clock changes, so the parts are added up.
    """
    local = column.cast("timestamp_ntz")
    if _utc_session():
        return F.unix_micros(local.cast("timestamp"))
    days = F.unix_date(local.cast("date")).cast("bigint")
    seconds = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    return (days * 86_400 + seconds) * 1_000_000 + F.date_format(local, "SSSSSS").cast("bigint")


def order_number(df: DataFrame, name: str) -> Column:
    """A numeric stand-in for an ordering column, monotone in it."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name))
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return epoch_micros(F.col(name))
    return F.col(name)


def scaled_int(column: Column, scale: int) -> Column:
    """``column * 10^scale`` rounded half up, as bigint.

    A double that is within rounding error of a multiple takes the short way;
    any other value goes through its decimal text.
    """
    shifted = column.cast("double") * float(10**scale)
    near = (F.abs(shifted - F.rint(shifted)) < 0.001) & (F.abs(shifted) < 9e15)
    exact = (column.cast(f"decimal(38,{scale})") * F.lit(10**scale)).cast("decimal(38,0)").cast("bigint")
    return F.when(near, F.rint(shifted).cast("bigint")).otherwise(exact)


def exact_sum(column: Column, scale: int) -> Column:
    """Exact sum of numbers with at most ``scale`` decimals, as decimal(38, scale).

    The scaled integers are summed in two limbs as bigint, which stays in
    generated code where a sum of wide decimals would not.
    """
    number = scaled_int(column, scale)
    mask = (1 << 24) - 1
    high = F.sum(F.shiftright(number, 24)).cast("decimal(19,0)") * F.lit(1 << 24).cast("decimal(9,0)")
    low = F.sum(number.bitwiseAND(F.lit(mask).cast("bigint"))).cast("decimal(19,0)")
    unit = F.lit(f"0.{'0' * (scale - 1)}1").cast(f"decimal({scale},{scale})") if scale else F.lit(1).cast("decimal(1,0)")
    return ((high + low).cast("decimal(30,0)") * unit).cast(f"decimal(38,{scale})")


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator.cast("double") / denominator.cast("double"))


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def percent(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    return F.round(ratio_or_null(F.lit(100.0) * numerator.cast("double"), denominator), digits)


def money_sum(column: Column) -> Column:
    """Exact sum of a two-decimal amount held as a float."""
    return exact_sum(column, 2).cast("decimal(28,2)")


def exact_mean(column: Column) -> Column:
    """Mean over an exact sum to six decimals, so the result does not depend on task order."""
    return ratio_or_null(exact_sum(column, 6), F.count(column))


def clock_diff(unit: str, start: Column, end: Column) -> Column:
    """Number of ``unit`` boundaries crossed between two timestamps."""
    unit = unit.upper()
    return F.timestamp_diff(unit, F.date_trunc(unit, start), F.date_trunc(unit, end))


def elapsed_seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def lenient_int(column: Column) -> Column:
    """Text to bigint: null or unreadable gives 0, fractions are cut off."""
    return F.coalesce(column.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def is_true_text(column: Column) -> Column:
    return F.coalesce(F.lower(column.cast("string")) == "true", F.lit(False))


def is_deleted(column: Column, values: tuple[str, ...] = DELETED_VALUES) -> Column:
    return F.coalesce(column.cast("string"), F.lit("0")).isin(*values)


def like_literal(column: Column, prefix: str) -> Column:
    """LIKE with the underscores of ``prefix`` taken literally."""
    return column.like(prefix.replace("_", "\\_"))


def label(column: Column, pairs: list[tuple[Column, str]], default: str) -> Column:
    """First matching label of an ordered list of conditions."""
    expression = F.lit(default)
    for condition, name in reversed(pairs):
        expression = F.when(condition, F.lit(name)).otherwise(expression)
    return expression


def recent(column: Column, as_of: str, interval: str) -> Column:
    """Rows newer than ``as_of`` minus an interval such as '7 DAYS'."""
    moment = F.lit(as_of).cast("timestamp_ntz")
    return (column > moment - F.expr(f"INTERVAL {interval}")) & (column <= moment)


def half_open(column: Column, start: str, end: str) -> Column:
    return (column >= F.lit(start).cast("timestamp_ntz")) & (column < F.lit(end).cast("timestamp_ntz"))


def hex_text(column: Column) -> Column:
    return F.lower(F.hex(column))


def bytes_of_hex(column: Column) -> Column:
    return F.unhex(column)


def iso_text(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
