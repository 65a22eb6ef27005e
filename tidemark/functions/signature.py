"""Canonical row signatures and order-free hash aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import epoch_micros

NULL_TOKEN = "~"
SEPARATOR = "|"
LIMB_BITS = 20


def canonical_text(column: Column, kind: T.DataType, scale: int = 6) -> Column:
    """One text form per value, equal across engines.

    Timestamps become microseconds since 1970 (UTC), numbers with a fraction
    whole multiples of ``10^-scale``, text is trimmed and carries its length in
    bytes, so that neither a separator nor a null token inside it can make two
    different rows look alike.
    """
    if isinstance(kind, T.TimestampType):
        text = F.unix_micros(column).cast("string")
    elif isinstance(kind, T.TimestampNTZType):
        text = epoch_micros(column).cast("string")
    elif isinstance(kind, T.DateType):
        text = F.date_format(column, "yyyy-MM-dd")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        shifted = column.cast("double") * float(10**scale)
        near = (F.abs(shifted - F.rint(shifted)) < 0.001) & (F.abs(shifted) < 9e15)
        text = F.when(near, F.rint(shifted).cast("bigint").cast("string")).otherwise(
            F.coalesce(_whole(column.try_cast(T.DecimalType(38, scale)), scale), column.cast("string"))
        )
    elif isinstance(kind, T.DecimalType):
        text = _whole(column.cast(T.DecimalType(38, scale)), scale)
    elif isinstance(kind, T.BooleanType):
        text = F.when(column, F.lit("1")).when(~column, F.lit("0"))
    elif isinstance(kind, T.BinaryType):
        text = F.lower(F.hex(column))
    elif isinstance(kind, (T.StringType, T.ArrayType, T.MapType, T.StructType)):
        plain = F.trim(column) if isinstance(kind, T.StringType) else F.to_json(column)
        text = F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain)
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit(NULL_TOKEN))


def _whole(column: Column, scale: int) -> Column:
    """Digits of a decimal without its point, in the form of a whole number."""
    if not scale:
        return column.cast("string")
    digits = F.regexp_replace(F.replace(column.cast("string"), F.lit("."), F.lit("")), r"^(-?)0+(?=\d)", "$1")
    return F.when(column == 0, F.lit("0")).otherwise(digits)


def signature(df: DataFrame, columns: list[str], scale: int = 6) -> Column:
    return F.concat_ws(SEPARATOR, *[canonical_text(F.col(c), df.schema[c].dataType, scale) for c in columns])


def raw_signature(columns: list[str]) -> Column:
    """Signature without normalisation; differs where only formatting differs."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_TOKEN)) for c in columns])


def row_number60(text: Column, digest: str = "md5") -> Column:
    """A 60-bit number of a text, as bigint.

    ``md5`` takes its first 15 hex digits, which any engine can reproduce.
    ``xxhash64`` is much cheaper and serves where Spark reads both sides.
    """
    if digest == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(text), 4)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_sum(number: Column) -> Column:
    """Exact sum of 60-bit numbers as decimal(38,0).

    Three 20-bit limbs are summed as bigint, which keeps the aggregate in
    generated code and cannot overflow below 2^43 rows.
    """
    mask = F.lit((1 << LIMB_BITS) - 1).cast("bigint")
    total = F.lit(0).cast("decimal(38,0)")
    for limb in range(3):
        part = F.shiftright(number, limb * LIMB_BITS).bitwiseAND(mask)
        weight = F.lit(1 << (limb * LIMB_BITS)).cast("decimal(13,0)")
        total = total + F.coalesce(F.sum(part), F.lit(0)).cast("decimal(19,0)") * weight
    return total.cast("decimal(38,0)")


def fingerprint(df: DataFrame, columns: list[str]) -> list[Column]:
    """Three limbs (22, 21 and 21 bits) of a fast 64-bit hash of raw values, nulls included.

    Sums of a limb fit a bigint up to 2^41 rows, even if one key holds them all.
    """
    if not columns:
        return [F.lit(0).cast("bigint")] * 3
    masks = []
    for start in range(0, len(columns), 60):
        bits = [F.when(F.col(c).isNull(), 1 << i).otherwise(0).cast("bigint") for i, c in enumerate(columns[start : start + 60])]
        masks.append(reduce(lambda a, b: a.bitwiseOR(b), bits))
    values = [F.to_json(F.col(c)) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c) for c in columns]
    number = F.xxhash64(*masks, *values)
    mask = F.lit((1 << 21) - 1).cast("bigint")
    return [
        F.shiftrightunsigned(number, 42),
        F.shiftrightunsigned(number, 21).bitwiseAND(mask),
        number.bitwiseAND(mask),
    ]


def segment_digest(df: DataFrame, key: str, columns: list[str], width: int, scale: int = 6) -> DataFrame:
    """Order-dependent digest per key range.

    Rows of one key are first folded to one text, so a segment never holds more
    than ``width`` texts however often a key repeats.
    """
    hashed = df.select(F.col(key), row_number60(signature(df, columns, scale)).alias("_h"))
    per_key = hashed.groupBy(key).agg(F.count("*").alias("_n"), hash_sum(F.col("_h")).alias("_s"))
    text = F.concat_ws(":", F.col("_n").cast("string"), F.col("_s").cast("string"))
    return (
        per_key.withColumn("segment", F.floor(F.col(key) / width))
        .groupBy("segment")
        .agg(
            F.sum("_n").alias("row_count"),
            F.md5(
                F.array_join(
                    F.transform(F.array_sort(F.collect_list(F.struct(F.col(key), text.alias("t")))), lambda s: s["t"]),
                    ",",
                )
            ).alias("digest"),
        )
    )
