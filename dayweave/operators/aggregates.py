"""Grouped aggregations: sums, matrices, ratios, regressions, correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.operators import ordered
from dayweave.operators.scaling import whole


def class_totals(df: DataFrame, keys: Sequence[str], label: str, value: str) -> DataFrame:
    """Sum per key and activity class."""
    return df.groupBy(*keys, label).agg(F.sum(value).alias(value))


def epoch_day_totals(df: DataFrame, keys: Sequence[str], seconds: str, cols: Sequence[str]) -> DataFrame:
    """Sums per day number ``floor(t / 86400)`` of a unix-seconds column."""
    day = F.floor(F.col(seconds) / 86400).cast("long").alias("day_number")
    return df.groupBy(*keys, day).agg(*[F.sum(c).alias(c) for c in cols])


def day_matrix(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str], trim: int = 2) -> DataFrame:
    """Day x variable matrix of sums without the first and last ``trim`` days."""
    wide = df.groupBy(*keys, "day").pivot(name, list(names)).agg(F.sum(value))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("day"))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("day")))
    out = wide.fillna(0.0, subset=list(names)).withColumns({"_f": first, "_l": last})
    return out.where((F.col("_f") > trim) & (F.col("_l") > trim)).drop("_f", "_l")


def ordered_list(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Values as an array in time order, one cell per key.

    The cell is the feature, so use keys whose rows fit in one (entity and day
    of track points).  Sums over long tracks use :func:`elevation_gain`.
    """
    packed = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(*keys).agg(F.transform(packed, lambda s: s["_v"]).alias(name))


def mean_and_max(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))


def fetch_labels(df: DataFrame, labels: Sequence[str], start, end, label: str = "label", ts: str = "ts") -> DataFrame:
    """Rows with one of the labels inside a half-open time range."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return df.where(F.col(label).isin(list(labels)) & (F.col(ts) >= lo) & (F.col(ts) < hi))


# --- ratios ------------------------------------------------------------------

def usable_ratio(main: str, other: str) -> Column:
    """main/other where finite and non-zero, else NULL."""
    value = F.try_divide(F.col(main), F.col(other))
    return F.when(value != 0, value)


def median_ratio(df: DataFrame, keys: Sequence[str], main: str, other: str) -> DataFrame:
    """Median of the usable daily ratios per key."""
    rows = df.select(*keys, usable_ratio(main, other).alias("_ratio"))
    return ordered.exact_quantiles(rows, list(keys), "_ratio", {"ratio": 0.5}).drop("n_values")


def mean_ratio(df: DataFrame, keys: Sequence[str], main: str, other: str, start=None, end=None) -> DataFrame:
    """Mean of main/other over an overlap period."""
    inside = F.lit(True)
    if start is not None:
        inside = F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    value = F.when(inside, F.try_divide(F.col(main), F.col(other)))
    return df.groupBy(*keys).agg(F.avg(value).alias("ratio"))


def elevation_gain(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bucket: Column) -> DataFrame:
    """Sum of positive steps per key; one point or none gives 0.

    The neighbour is found bucket-wise, so a very long track is split.
    """
    rows = ordered.previous_row(df, list(keys), list(order), [value], bucket)
    step = F.col(value) - F.col(f"{value}_prev")
    return rows.groupBy(*keys).agg(
        F.coalesce(F.sum(F.greatest(step, F.lit(0.0))), F.lit(0.0)).alias("gain"),
        F.coalesce(F.sum(F.greatest(-step, F.lit(0.0))), F.lit(0.0)).alias("loss"),
    )


def backfill_with_period_mean(df: DataFrame, keys: Sequence[str], col: str, source: tuple, before) -> DataFrame:
    """Days before a date take the mean of a reference period."""
    inside = F.col("day").between(F.lit(source[0]).cast("date"), F.lit(source[1]).cast("date"))
    mean = F.avg(F.when(inside, F.col(col))).over(whole(keys))
    early = F.col("day") < F.lit(before).cast("date")
    return df.withColumn(col, F.when(early, mean).otherwise(F.col(col)))


def impute_by_median_ratio(df: DataFrame, keys: Sequence[str], col: str, by: str, where_zero: bool = True, truncate: bool = False) -> DataFrame:
    """Fill ``col`` with median(col/by) times ``by`` where it is zero (or NULL)."""
    value = F.when(F.col(col) != 0, usable_ratio(col, by))
    filled = F.percentile(value, F.lit(0.5)).over(whole(keys)) * F.col(by)
    if truncate:
        filled = F.floor(filled).cast("double")
    gap = (F.col(col) == 0) if where_zero else F.col(col).isNull()
    return df.withColumn(col, F.when(gap, filled).otherwise(F.col(col)))


def impute_by_mean_ratio(df: DataFrame, keys: Sequence[str], col: str, by: str) -> DataFrame:
    """col = mean(col/by) * by on days where col is 0 and by is not."""
    both = (F.col(col) != 0) & (F.col(by) != 0)
    mean = F.avg(F.when(both, F.try_divide(F.col(col), F.col(by)))).over(whole(keys))
    gap = (F.col(col) == 0) & (F.col(by) != 0)
    return df.withColumn(col, F.when(gap, mean * F.col(by)).otherwise(F.col(col)))


# --- profiles ---------------------------------------------------------------------

def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of non-zero values and of distinct values per column, long form.

    Distinct values are counted per column after a map-side de-duplication, so
    no task holds a whole column.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "x")
    per_value = long.groupBy("column", "x").agg(F.count(F.lit(1)).alias("k"))
    out = per_value.groupBy("column").agg(
        F.sum("k").alias("rows"),
        F.sum(F.when(F.col("x") != 0, F.col("k")).otherwise(F.lit(0))).alias("_nz"),
        F.count("x").alias("_distinct"),
    )
    return out.select(
        "column",
        "rows",
        (100.0 * F.col("_nz") / F.col("rows")).alias("nonzero_pct"),
        (100.0 * F.col("_distinct") / F.col("rows")).alias("unique_pct"),
    )


def yearly_means(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, F.year("day").alias("year")).agg(*[F.avg(c).alias(c) for c in cols])


def confusion_counts(df: DataFrame, truth: str, guess: str, labels: Sequence[str], overlap: str | None = None, threshold: float = 0.9) -> DataFrame:
    """Counts of (truth, guess) as a wide table; empty rows do not appear."""
    rows = df.where(F.col(overlap) > threshold) if overlap else df
    return rows.groupBy(truth).pivot(guess, list(labels)).agg(F.count(F.lit(1))).fillna(0)


def binned_summary(df: DataFrame, keys: Sequence[str], x: str, y: str, bins: int = 10) -> DataFrame:
    """Quartiles and spread of y in equal x bins over [0, max x); a bin may be of any size."""
    keys = list(keys)
    top = df.groupBy(*keys).agg(F.max(F.abs(x)).alias("_top"))
    rows = ordered.attach(df, keys, top)
    width = F.col("_top") / F.lit(float(bins))
    rows = rows.withColumn("bin", F.floor(F.try_divide(F.col(x).cast("double"), width)).cast("int"))
    rows = rows.where((F.col(x) >= 0) & (F.col("bin") < bins) & F.col(y).isNotNull())
    return ordered.exact_quantiles(rows, keys + ["bin"], y, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, {"sd": F.stddev_pop(y)})


def histogram_2d(df: DataFrame, keys: Sequence[str], x: str, y: str, bins: int = 10) -> DataFrame:
    """Counts on an equal grid over [0, max|x|] x [-max|y|, max|y|]; upper edges closed."""
    keys = list(keys)
    top = df.groupBy(*keys).agg(F.max(F.abs(x)).alias("_tx"), F.max(F.abs(y)).alias("_ty"))
    rows = ordered.attach(df, keys, top)
    n = F.lit(float(bins))
    xb = F.least(F.floor(F.try_divide(F.col(x).cast("double") * n, F.col("_tx"))), F.lit(bins - 1))
    yb = F.least(F.floor(F.try_divide((F.col(y) + F.col("_ty")) * n, F.col("_ty") * 2)), F.lit(bins - 1))
    rows = rows.where(F.col(x) >= 0)
    return rows.groupBy(*keys, xb.cast("int").alias("x_bin"), yb.cast("int").alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))


# --- regression and correlation ---------------------------------------------------

def linear_fit(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Slope, intercept and R-squared of y on x."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"),
    )


def harmonise_by_regression(df: DataFrame, keys: Sequence[str], main: str, other: str, target: str, start, end) -> DataFrame:
    """target = mean of main and its regression on other, inside a period.

    Without variance in ``other`` the prediction is the mean of ``main``.
    """
    inside = F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    y, x = F.when(inside, F.col(main)), F.when(inside, F.col(other))
    w = whole(keys)
    mean_x, mean_y = F.avg(x).over(w), F.avg(y).over(w)
    cov, var = F.covar_pop(y, x).over(w), F.var_pop(x).over(w)
    slope = F.coalesce(F.try_divide(cov, var), F.lit(0.0))
    predicted = mean_y + slope * (F.col(other) - mean_x)
    return df.withColumn(target, F.when(inside, (predicted + F.col(main)) / 2).otherwise(F.col(target)))


def correlation_matrix(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """All pairwise correlations in one pass, long form (each pair once)."""
    pairs = list(combinations(cols, 2))
    wide = df.groupBy(*keys).agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    items = F.array(
        *[
            F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"`{i}`").alias("corr"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(*keys, F.explode(items).alias("p")).select(*keys, "p.*")


def correlations_with(df: DataFrame, keys: Sequence[str], target: str, cols: Sequence[str]) -> DataFrame:
    """Correlation of every column with a target, strongest first."""
    wide = df.groupBy(*keys).agg(*[F.corr(target, c).alias(c) for c in cols])
    long = wide.unpivot(list(keys), list(cols), "variable", "corr")
    return long.orderBy(*keys, F.desc("corr"))


def blend(parts: Mapping[str, float]) -> Column:
    """Combined factor: product of single factors given as constants."""
    out = 1.0
    for v in parts.values():
        out *= v
    return F.lit(out)
