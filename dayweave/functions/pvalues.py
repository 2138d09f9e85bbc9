"""Tail probabilities for result-sized tables.

Spark has no distribution functions, so the tails are evaluated in Arrow
batches on the already aggregated rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_regularised(a: float, b: float, x: float) -> float:
    if not 0.0 < x < 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    tiny = 1e-300
    b = x + 1.0 - s
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 1000):
        num = -i * (i - s)
        b += 2.0
        d = num * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + num / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def _each(fn, *columns: pd.Series) -> pd.Series:
    """Row-wise call; any missing argument or invalid domain gives missing."""

    def call(*args: float) -> float:
        if any(a is None or not np.isfinite(a) for a in args):
            return np.nan
        try:
            return fn(*args)
        except (ValueError, ZeroDivisionError, OverflowError):
            return np.nan

    values = [call(*row) for row in zip(*columns, strict=True)]
    out = pd.Series(values, dtype="float64")
    return out.astype(object).where(out.notna(), None)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|)."""

    def tail(z: pd.Series) -> pd.Series:
        return _each(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), z)

    return F.pandas_udf(tail, T.DoubleType())(z)


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|) for Student's t."""

    def tail(t: pd.Series, dof: pd.Series) -> pd.Series:
        return _each(lambda v, n: beta_regularised(n / 2.0, 0.5, n / (n + v * v)) if n > 0 else np.nan, t, dof)

    return F.pandas_udf(tail, T.DoubleType())(t, dof)


def chi2_upper(x: Column, dof: Column) -> Column:
    """P(X >= x) for chi-squared."""

    def tail(x: pd.Series, dof: pd.Series) -> pd.Series:
        return _each(lambda v, n: gamma_upper(n / 2.0, v / 2.0), x, dof)

    return F.pandas_udf(tail, T.DoubleType())(x, dof)
