"""Source-engine type names to Spark types, and cast projections that report failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Source type name -> Spark type. NUMBER stays decimal; a source DATE carries a time of day.
TYPE_MAP = {
    "NUMBER": "decimal(38,10)",
    "INTEGER": "bigint",
    "VARCHAR2": "string",
    "VARCHAR": "string",
    "CHAR": "string",
    "CLOB": "string",
    "LONG": "string",
    "DATE": "timestamp_ntz",
    "TIMESTAMP": "timestamp_ntz",
    "TIMESTAMP WITH TIME ZONE": "timestamp",
    "BLOB": "binary",
    "FLOAT": "double",
}


def spark_type(name: str, date_as_date: bool = False) -> str:
    """Spark type of a source type such as ``VARCHAR2(20)`` or ``NUMBER(10,2)``."""
    upper = name.strip().upper()
    base, _, arguments = upper.partition("(")
    if date_as_date and base == "DATE":
        return "date"
    if base == "NUMBER" and arguments:
        digits = [int(x) for x in arguments.rstrip(")").split(",")]
        return f"decimal({digits[0]},{digits[1] if len(digits) > 1 else 0})"
    return TYPE_MAP.get(base.strip(), "string")


def target_schema(columns: dict[str, str]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{n}` {spark_type(t)}" for n, t in columns.items()))


def _cast(name: str, source_type: str) -> Column:
    target = spark_type(source_type)
    column = F.col(name)
    if source_type.upper().startswith("CHAR"):
        column = F.rtrim(column)
    if target == "binary":
        return F.unhex(column).alias(name)
    return column.try_cast(target).alias(name)


def cast_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[_cast(n, t) for n, t in columns.items()])


def cast_failures(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Values per column that are set in the source but do not fit the target type, in one pass."""
    one = df.agg(*[F.count_if(F.col(n).isNotNull() & _cast(n, t).isNull()).alias(n) for n, t in columns.items()])
    return one.unpivot([], list(columns), "column_name", "cast_failures")
