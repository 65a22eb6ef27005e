"""Sampled parity with a confidence statement: stratified samples, exact binomial bounds, sequential stop."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.signature import row_number60, signature

#: Shares of the keys in percent that are looked at one after the other.
STAGES = (1, 4, 16, 64, 100)


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b), by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value, c, d = 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or 1e-300)
        c = 1 + step / c or 1e-300
        value *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return front * (value - 1)


def bounds(wrong: int, n: int, alpha: float) -> tuple[float, float]:
    """Exact two-sided bounds of a share of which ``wrong`` of ``n`` were seen, each side missed with alpha / 2 at most."""

    def root(a: float, b: float, level: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if beta_share(middle, a, b) < level else (low, middle)
        return high

    if n == 0:
        return 0.0, 1.0
    lower = 0.0 if wrong == 0 else root(wrong, n - wrong + 1, alpha / 2)
    upper = 1.0 if wrong == n else root(wrong + 1, n - wrong, 1 - alpha / 2)
    return lower, upper


def stratum_counts(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], stratum: str, percent: int) -> DataFrame:
    """Rows (stratum, sampled, wrong): keys of the source with a hash below ``percent`` that the target lacks or has otherwise.

    The same hash chooses on both sides, before the rows meet, and the sample of a larger
    percentage holds that of a smaller one. ``keys`` are unique and not null.
    """
    chosen = F.pmod(row_number60(signature(source, keys)), F.lit(100)) < percent
    s = source.where(chosen).select(*keys, F.col(stratum).alias("stratum"), row_number60(signature(source, columns)).alias("_s"))
    t = target.where(F.pmod(row_number60(signature(target, keys)), F.lit(100)) < percent).select(*keys, row_number60(signature(target, columns)).alias("_t"))
    joined = s.join(t, keys, "left")
    return joined.groupBy("stratum").agg(F.count("*").alias("sampled"), F.count_if(~F.col("_s").eqNullSafe(F.col("_t"))).alias("wrong"))


def sampled_parity(
    source: DataFrame,
    target: DataFrame,
    keys: list[str],
    columns: list[str],
    stratum: str,
    least_pct: float = 99.9,
    confidence: float = 0.99,
    stages: tuple[int, ...] = STAGES,
) -> DataFrame:
    """Rows (stratum, stage_pct, sampled, wrong, lower_pct, upper_pct, verdict), the stratum null for all together.

    The verdict is PASS when with ``confidence`` at least ``least_pct`` % of the keys match, FAIL when less do, else MORE.
    Samples grow stage by stage until all together have a verdict; each stage may err by its part of the error
    allowed, so stopping early costs no confidence. The last stage sees every key and decides by its share.
    Strata, such as partitions or key ranges, are few: their counts come to the driver.
    """
    alpha = (1 - confidence) / len(stages)
    limit = round((100 - least_pct) / 100, 12)
    for i, percent in enumerate(stages):
        counts = {r["stratum"]: (r["sampled"], r["wrong"]) for r in stratum_counts(source, target, keys, columns, stratum, percent).collect()}
        rows = [(None, *(sum(c[j] for c in counts.values()) for j in (0, 1))), *((str(k), *v) for k, v in counts.items())]
        out = []
        for name, n, wrong in rows:
            low, high = bounds(wrong, n, alpha)
            whole = percent >= 100 and n > 0
            verdict = "PASS" if high <= limit or whole and wrong <= limit * n else "FAIL" if low > limit or whole else "MORE"
            out.append((name, percent, n, wrong, 100 * (1 - high), 100 * (1 - low), verdict))
        if out[0][-1] != "MORE" or i == len(stages) - 1:
            return source.sparkSession.createDataFrame(
                out, "stratum string, stage_pct int, sampled bigint, wrong bigint, lower_pct double, upper_pct double, verdict string"
            )
    raise ValueError("no stages")
