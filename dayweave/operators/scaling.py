"""Scaling, deltas and fills over a whole daily series of an entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def whole(keys: Sequence[str]):
    """Window over the entire series of the keys."""
    return Window.partitionBy(*keys)


def ordered(keys: Sequence[str], day: str = "day"):
    return Window.partitionBy(*keys).orderBy(day)


def minmax(x: Column | str, w) -> Column:
    """(x - min) / (max - min); a constant series gives 0, NULL stays NULL."""
    x = F.col(x) if isinstance(x, str) else x
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(x.isNotNull(), F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0)))


def minmax_columns(df: DataFrame, keys: Sequence[str], cols: Sequence[str], suffix: str = "") -> DataFrame:
    w = whole(keys)
    scaled = {c + suffix: minmax(c, w) for c in cols}
    return df.withColumns(scaled)


def divide_by_max(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    w = whole(keys)
    return df.withColumns({c: F.try_divide(F.col(c), F.max(c).over(w)) for c in cols})


def tame_outliers(df: DataFrame, keys: Sequence[str], cols: Sequence[str], limit: float = 4.0, factor: float = 3.0) -> DataFrame:
    """Values further than ``limit`` population deviations out are divided."""
    w = whole(keys)
    out = {}
    for c in cols:
        z = F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w))
        out[c] = F.when(F.abs(z) > limit, F.col(c) / F.lit(factor)).otherwise(F.col(c))
    return df.withColumns(out)


def changes(df: DataFrame, keys: Sequence[str], cols: Sequence[str], day: str = "day") -> DataFrame:
    """``<c>_change`` and ``<c>_pct_change`` against the previous row."""
    w = ordered(keys, day)
    out = {}
    for c in cols:
        before = F.lag(c).over(w)
        out[f"{c}_change"] = F.col(c) - before
        out[f"{c}_pct_change"] = F.try_divide(F.col(c), before) - 1
    return df.withColumns(out)


def fill_with_mean(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    w = whole(keys)
    return df.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(w)) for c in cols})


def weighted_strain(cols: Mapping[str, float]) -> Column:
    """Sum of coefficient times column, in the given order."""
    total = None
    for c, k in cols.items():
        term = F.lit(float(k)) * F.col(c)
        total = term if total is None else total + term
    return total


def factor_strain(cols: Mapping[str, float]) -> Column:
    """Sum of column over its normalisation factor, in the given order."""
    total = None
    for c, k in cols.items():
        term = F.col(c) / F.lit(float(k))
        total = term if total is None else total + term
    return total
