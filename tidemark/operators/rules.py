"""Threshold rules over metric columns, all evaluated in one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``metric op threshold`` breaches; ``metric`` is a column name or SQL expression."""

    name: str
    metric: str
    op: str
    threshold: float
    severity: str = "WARN"

    def breached(self) -> Column:
        value = F.expr(self.metric).cast("double")
        bound = F.lit(float(self.threshold))
        return {">": value > bound, ">=": value >= bound, "<": value < bound, "<=": value <= bound, "<>": value != bound}[
            self.op
        ]


def evaluate(df: DataFrame, rules: list[Rule], ids: list[str], only_breached: bool = True) -> DataFrame:
    """One row per input row and rule: issue, observed, threshold, severity, breached.

    The rules are an array of structs built per row, so no join is needed.
    """
    entries = F.array(*[
        F.struct(
            F.lit(r.name).alias("issue"),
            F.expr(r.metric).cast("double").alias("observed"),
            F.lit(float(r.threshold)).alias("threshold"),
            F.lit(r.severity).alias("severity"),
            F.coalesce(r.breached(), F.lit(False)).alias("breached"),
        )
        for r in rules
    ])
    wanted = F.filter(entries, lambda e: e["breached"]) if only_breached else entries
    out = df.select(*ids, F.inline(wanted))
    return out.drop("breached") if only_breached else out


def detect(df: DataFrame, metrics: dict[str, Column], rules: list[Rule], by: list[str] | None = None) -> DataFrame:
    """Aggregate all metrics in one scan, then report the breached rules."""
    by = by or []
    grouped = df.groupBy(*by).agg(*[c.alias(n) for n, c in metrics.items()])
    return evaluate(grouped, rules, by)


def band(value: Column, target: float, alert: float, higher_is_worse: bool = True) -> Column:
    """OK within target, WARN between target and alert, ALERT beyond."""
    if higher_is_worse:
        return F.when(value > alert, "ALERT").when(value > target, "WARN").otherwise("OK")
    return F.when(value < alert, "ALERT").when(value < target, "WARN").otherwise("OK")
