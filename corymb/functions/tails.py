"""Tail probabilities of the normal, chi-square, F and t distributions, in numpy (no SciPy is needed)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0 or a <= 0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * math.exp(log_front))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(log_front) * h


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (tiny if abs(d) < tiny else d)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (tiny if abs(d) < tiny else d)
            c = 1 + num / c
            c = tiny if abs(c) < tiny else c
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def chi2_sf(x: float, df: float) -> float:
    return math.nan if not (x == x and df > 0) else _gamma_q(df / 2, x / 2)


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def f_sf(x: float, d1: float, d2: float) -> float:
    if not (x == x and d1 > 0 and d2 > 0):
        return math.nan
    return 1.0 if x <= 0 else _beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return math.nan if not (t == t and df > 0) else _beta_i(df / 2, 0.5, df / (df + t * t))


def correlation_p(r: float, n: float) -> float:
    if not (r == r and n > 2):
        return math.nan
    return 0.0 if abs(r) >= 1 else t_sf2(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def _column(f, *args: Column) -> Column:
    """A function of numbers as a column: one call for each row of small result tables, null for nan."""

    def apply(*series: pd.Series) -> pd.Series:
        out = np.array([f(*map(float, row)) for row in zip(*(s.astype(float) for s in series), strict=True)], float)
        return pd.Series(np.where(np.isnan(out), None, out), dtype=object).astype("Float64")

    if len(args) == 1:
        return F.pandas_udf(lambda a: apply(a), "double")(*args)
    if len(args) == 2:
        return F.pandas_udf(lambda a, b: apply(a, b), "double")(*args)
    return F.pandas_udf(lambda a, b, c: apply(a, b, c), "double")(*args)


def chi2_p(x: Column, df: Column) -> Column:
    return _column(chi2_sf, x, df)


def f_p(x: Column, d1: Column, d2: Column) -> Column:
    return _column(f_sf, x, d1, d2)


def pearson_p(r: Column, n: Column) -> Column:
    return _column(correlation_p, r, n)


def normal_p(z: Column) -> Column:
    return _column(lambda x: normal_sf(x) if x == x else math.nan, z)
