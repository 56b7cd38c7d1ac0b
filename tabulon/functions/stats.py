"""Survey statistics as column expressions, and the F distribution's upper tail."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tabulon.functions.exprs import jround

#: Two-sided critical values by confidence in percent.
CRITICAL = {90: 1.645, 95: 1.96, 99: 2.576}
#: Base sizes below which a segment is small or borderline.
SMALL_BASE, BORDERLINE_BASE = 30, 50


def margin_of_error(n: Column, p: Column, confidence: int = 95) -> Column:
    """Margin in percent to one decimal; an error for n <= 0."""
    value = jround(F.lit(CRITICAL[confidence]) * F.sqrt(p * (1 - p) / n) * 100, 1)
    return F.when(n > 0, value).otherwise(F.raise_error(F.lit("n must be positive")).cast("double"))


def design_effect(weight: Column) -> Column:
    """Aggregate: 1 + cv^2 of the weights, population variance, two decimals; null for a zero mean."""
    return jround(1 + F.pow(F.try_divide(F.stddev_pop(weight), F.avg(weight)), F.lit(2.0)), 2)


def base_size_tag(n: Column) -> Column:
    """The names of the two tags."""
    return F.when(n < SMALL_BASE, "base_size_small").when(n < BORDERLINE_BASE, "base_size_borderline")


def proportion_gap(n1: Column, p1: Column, n2: Column, p2: Column, confidence: int = 95) -> tuple[Column, Column, Column]:
    """(gap in points, z, significant) of two proportions with pooled error; no error, no z."""
    pooled = (n1 * p1 + n2 * p2) / (n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    z = F.when(se > 0, (p1 - p2) / se)
    return jround((p1 - p2) * 100, 1), jround(z, 2), F.coalesce(F.abs(z) >= CRITICAL[confidence], F.lit(False))


def mean_gap(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column, confidence: int = 95) -> tuple[Column, Column, Column]:
    """(gap, t, significant) of two means with unequal variances; nulls if a group has fewer than two values."""
    enough = (n1 >= 2) & (n2 >= 2)
    se = F.sqrt(v1 / n1 + v2 / n2)
    t = F.when(enough & (se > 0), (m1 - m2) / se)
    return F.when(enough, jround(m1 - m2, 2)), jround(t, 2), F.coalesce(F.abs(t) >= CRITICAL[confidence], F.lit(False))


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """r to two decimals from sums of centred values; null under three pairs or without spread."""
    cov, vx, vy = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
    return F.when((n >= 3) & (vx > 0) & (vy > 0), jround(cov / F.sqrt(vx * vy), 2))


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    total = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * total


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F >= f) for d1 and d2 degrees of freedom."""
    return 1.0 if f <= 0 else _beta_tail(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or pd.isna(c) or c <= 0 else f_tail(a, b, c) for a, b, c in zip(f, d1, d2, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def log_gamma(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) or v <= 0 else math.lgamma(v)).astype("float64")
