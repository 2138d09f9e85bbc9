"""Rolling and recursive transforms of a daily series.

All windows run over day-grain series, so a window partition holds at most one
row per calendar day of an entity, whatever the size of the raw data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayweave.operators.ordered import scan
from dayweave.operators.scaling import minmax, ordered, whole


def _frame(keys, day, lo, hi):
    return Window.partitionBy(*keys).orderBy(day).rowsBetween(lo, hi)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _full(x: Column, w, n: int, value: Column) -> Column:
    """``value`` only where all ``n`` rows of the frame are present."""
    return F.when(F.count(x).over(w) == n, value)


# --- means and medians -----------------------------------------------------------

def trailing_mean(x, keys, n: int, day: str = "day", partial: bool = False) -> Column:
    """Mean of the last ``n`` rows, NULL until all are present."""
    x, w = _c(x), _frame(keys, day, -(n - 1), 0)
    mean = F.avg(x).over(w)
    return mean if partial else _full(x, w, n, mean)


def trailing_median(x, keys, n: int, day: str = "day") -> Column:
    x, w = _c(x), _frame(keys, day, -(n - 1), 0)
    return _full(x, w, n, F.percentile(x, F.lit(0.5)).over(w))


def centred_mean(x, keys, n: int, day: str = "day") -> Column:
    """Trailing mean moved back by ``n // 2`` rows."""
    x, w = _c(x), _frame(keys, day, -(n - 1) + n // 2, n // 2)
    return _full(x, w, n, F.avg(x).over(w))


def centred_median(x, keys, n: int, day: str = "day") -> Column:
    x, w = _c(x), _frame(keys, day, -(n - 1) + n // 2, n // 2)
    return _full(x, w, n, F.percentile(x, F.lit(0.5)).over(w))


def _has_ahead(keys, day, steps: int) -> Column:
    """True where ``steps`` more rows follow."""
    return F.lead(F.lit(1), steps).over(ordered(keys, day)).isNotNull() if steps else F.lit(True)


def centred_mean_partial(x, keys, n: int, day: str = "day") -> Column:
    """Centred mean that accepts short heads; the tail is filled with 0."""
    x, w = _c(x), _frame(keys, day, -(n - 1) + n // 2, n // 2)
    return F.coalesce(F.when(_has_ahead(keys, day, n // 2), F.avg(x).over(w)), F.lit(0.0))


def centred_median_partial(x, keys, n: int, day: str = "day") -> Column:
    x, w = _c(x), _frame(keys, day, -(n - 1) + n // 2, n // 2)
    value = F.percentile(x, F.lit(0.5)).over(w)
    return F.coalesce(F.when(_has_ahead(keys, day, n // 2), value), F.lit(0.0))


def rolling_mean_columns(df: DataFrame, keys, cols: Sequence[str], n: int, day: str = "day") -> DataFrame:
    """MinMax-scale the columns, then add ``<c>_RollingMean``."""
    w = whole(keys)
    scaled = df.withColumns({c: minmax(c, w) for c in cols})
    return scaled.withColumns({f"{c}_RollingMean": trailing_mean(c, keys, n, day) for c in cols})


def relative_median_columns(df: DataFrame, keys, cols: Sequence[str], short: int, long: int, day: str = "day") -> DataFrame:
    """Ratio of a short to a long trailing median."""
    return df.withColumns(
        {
            f"{c}_relative_{short}_{long}": F.try_divide(
                trailing_median(c, keys, short, day), trailing_median(c, keys, long, day)
            )
            for c in cols
        }
    )


# --- rolling MinMax ---------------------------------------------------------------

def _carried(df: DataFrame, keys, raw: str, out: str, day: str) -> DataFrame:
    """Undefined values repeat the previous result; a leading gap is 0."""
    w = _frame(keys, day, Window.unboundedPreceding, 0)
    return df.withColumn(out, F.coalesce(F.last(raw, ignorenulls=True).over(w), F.lit(0.0))).drop(raw)


def _sliced_minmax(df: DataFrame, keys, col: str, out: str, back: int, ahead: int, day: str) -> DataFrame:
    """MinMax of the current value inside rows [-back, ahead], last row unseen.

    A slice whose first value is missing has no result.
    """
    o = ordered(keys, day)
    x = F.col(col)
    masked = F.when(F.lead(F.lit(1)).over(o).isNotNull(), x)
    df = df.withColumns({"_m": masked, "_n": F.row_number().over(o)})
    w = _frame(keys, day, -back, ahead)
    first = F.when(F.col("_n") > back, F.lag(x, back).over(o) if back else x).otherwise(
        F.first(x).over(_frame(keys, day, Window.unboundedPreceding, Window.unboundedFollowing))
    )
    low, high = F.min("_m").over(w), F.max("_m").over(w)
    value = F.when(first.isNotNull(), F.try_divide(x - low, high - low))
    df = df.withColumn("_raw", value).drop("_m", "_n")
    return _carried(df, keys, "_raw", out, day)


def rolling_minmax(df: DataFrame, keys, col: str, n: int, out: str, day: str = "day") -> DataFrame:
    """Centred rolling MinMax."""
    return _sliced_minmax(df, keys, col, out, -(-n // 2), n // 2 - 1, day)


def rolling_minmax_shifted(df: DataFrame, keys, col: str, n: int, mean_window: int, out: str, day: str = "day") -> DataFrame:
    """Rolling MinMax over the slice that the centred mean could know."""
    return _sliced_minmax(df, keys, col, out, n - mean_window, mean_window - 1, day)


def trailing_minmax_days(x, keys, days: int = 180, day: str = "day") -> Column:
    """MinMax of the current value inside the last ``days`` calendar days."""
    x = _c(x)
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*keys).orderBy(number).rangeBetween(-(days - 1), 0)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(x.isNotNull(), F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0)))


def relative_minmax_column(df: DataFrame, keys, col: str, n: int, out: str, day: str = "day") -> DataFrame:
    """Trailing MinMax whose first ``n - 1`` rows use the limits seen at row ``n``."""
    trailing = _frame(keys, day, -(n - 1), 0)
    row = F.row_number().over(ordered(keys, day))
    df = df.withColumns({"_lo": F.min(col).over(trailing), "_hi": F.max(col).over(trailing), "_row": row})
    w = whole(keys)

    def limit(c: str) -> Column:
        reference = F.max(F.when(F.col("_row") == n + 1, F.col(c))).over(w)
        return F.when(F.col("_row") >= n, F.col(c)).otherwise(reference)

    lo, hi = limit("_lo"), limit("_hi")
    return df.withColumn(out, F.try_divide(F.col(col) - lo, hi - lo)).drop("_lo", "_hi", "_row")


# --- recursive transforms -----------------------------------------------------------

def _per_series(df: DataFrame, keys, day: str, new: Sequence[str], fn) -> DataFrame:
    """Apply ``fn(series frame) -> frame with new columns`` to every series.

    A series has one row per day, so a group is bounded by the calendar.
    """
    schema = T.StructType(list(df.schema.fields) + [T.StructField(c, T.DoubleType()) for c in new])

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values(day))

    return df.groupBy(*keys).applyInPandas(apply, schema)


def ewm_mean(
    df: DataFrame,
    keys,
    cols: Sequence[str],
    span: float | None = None,
    halflife: float | None = None,
    adjust: bool = True,
    day: str = "day",
) -> DataFrame:
    """``<c>_ewm``: exponentially weighted mean of every column."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        weights = pdf[list(cols)].astype(float).ewm(span=span, halflife=halflife, adjust=adjust).mean()
        return pdf.assign(**{f"{c}_ewm": weights[c] for c in cols})

    return _per_series(df, keys, day, [f"{c}_ewm" for c in cols], fn)


def repair_low_values(df: DataFrame, keys, col: str, companion: str, limit: float = 1700.0, n: int = 3, day: str = "day") -> DataFrame:
    """Low values become the mean of the previous ``n`` repaired values.

    The companion column is repaired on the same days.
    """

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        main, side = (pdf[c].to_numpy(dtype=float, copy=True) for c in (col, companion))
        low = main < limit
        for i in np.flatnonzero(low):
            if i >= n:
                main[i], side[i] = main[i - n : i].mean(), side[i - n : i].mean()
        return pdf.assign(**{f"{col}_repaired": main, f"{companion}_repaired": side})

    return _per_series(df, keys, day, [f"{col}_repaired", f"{companion}_repaired"], fn)


# --- insult, thresholds, load -----------------------------------------------------------

def insult_intensity(df: DataFrame, keys, cols: Sequence[str], n: int, m: int, day: str = "day") -> DataFrame:
    """Mean of the previous ``n`` days and its rise over the recent minimum."""
    w = whole(keys)
    row = F.row_number().over(ordered(keys, day))
    df = df.withColumns({c: minmax(c, w) for c in cols}).withColumn("_row", row)
    before = _frame(keys, day, -n, -1)
    for c in cols:
        mean = _full(F.col(c), before, n, F.avg(c).over(before))
        df = df.withColumn(f"{c}InsultIntensity", F.when(F.col("_row") <= n, 0.0).otherwise(mean))
    recent = _frame(keys, day, -m, -1)
    for c in cols:
        i = F.col(f"{c}InsultIntensity")
        low = F.when(F.col("_row") <= m, 0.0).otherwise(_full(i, recent, m, F.min(i).over(recent)))
        df = df.withColumn(f"{c}MaxInsultDiff", i - low)
    return df.drop("_row")


def above_with_neighbour(x, keys, limit: float, day: str = "day") -> Column:
    """1 where the value and a neighbour reach the limit; both ends are 0."""
    x, o = _c(x), ordered(keys, day)
    before, after = F.lag(x).over(o), F.lead(x).over(o)
    inner = before.isNotNull() & after.isNotNull()
    hit = (x >= limit) & ((before >= limit) | (after >= limit))
    return F.when(inner & hit, 1.0).otherwise(0.0)


def above_row_limit(x, limit, keys, day: str = "day") -> Column:
    """1/0 against a per-row limit; the first and last row keep their value."""
    x, o = _c(x), ordered(keys, day)
    edge = F.lag(F.lit(1)).over(o).isNull() | F.lead(F.lit(1)).over(o).isNull()
    return F.when(edge, x).when(x >= _c(limit), 1.0).otherwise(0.0)


def acute_chronic_load(df: DataFrame, keys, load: str, symptom: str, n1: int, n2: int, big: int, day: str = "day") -> DataFrame:
    """Excess of two acute loads over the chronic load, rescaled to a common peak."""
    row = F.row_number().over(ordered(keys, day))
    df = df.withColumn("_row", row)

    def previous_mean(c: str, n: int) -> Column:
        w = _frame(keys, day, -n, -1)
        head = F.avg(F.when(F.col("_row") < n, F.col(c))).over(whole(keys))
        return F.when(F.col("_row") <= n, head).otherwise(F.avg(c).over(w))

    df = df.withColumns(
        {
            "_acute1": previous_mean(load, n1),
            "_acute2": previous_mean(load, n2),
            "_chronic": previous_mean(load, big),
            "_symptom": previous_mean(symptom, big),
        }
    )

    def excess(c: str) -> Column:
        diff = F.col(c) - F.col("_chronic")
        scale = F.try_divide(F.col("_chronic"), F.col("_symptom"))
        return F.when(diff < 0, 0.0).otherwise(F.try_divide(diff, scale))

    df = df.withColumns({"_d1": excess("_acute1"), "_d2": excess("_acute2")})
    second = F.when(F.col("_row") == 1, F.lead("_d2").over(ordered(keys, day))).otherwise(F.col("_d2"))
    df = df.withColumn("_d2", second)
    w = whole(keys)
    df = df.withColumns({"_m1": F.max("_d1").over(w), "_m2": F.max("_d2").over(w)})
    d1 = F.when(F.col("_m2") > F.col("_m1"), F.col("_d1")).otherwise(F.col("_d1") * F.try_divide(F.col("_m2"), F.col("_m1")))
    d2 = F.when(F.col("_m2") > F.col("_m1"), F.col("_d2") * F.try_divide(F.col("_m1"), F.col("_m2"))).otherwise(F.col("_d2"))
    df = df.withColumns({"load_excess_1": d1, "load_excess_2": d2})
    df = df.withColumn("load_excess", F.greatest("load_excess_1", "load_excess_2"))
    return df.drop("_row", "_acute1", "_acute2", "_chronic", "_symptom", "_d1", "_d2", "_m1", "_m2")


# --- fills ---------------------------------------------------------------------------

def forward_fill(x, keys, day: str = "day") -> Column:
    """Forward fill; a missing first row takes the first known value."""
    x = _c(x)
    w = _frame(keys, day, Window.unboundedPreceding, 0)
    everything = _frame(keys, day, Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(x, ignorenulls=True).over(everything)
    return F.coalesce(F.last(x, ignorenulls=True).over(w), first)


def fill_zeros_with_neighbours(df: DataFrame, keys, col: str, n: int = 10, day: str = "day") -> DataFrame:
    """Zeros become the median of up to ``n`` non-zero values on either side.

    The median belongs to a rank among the non-zero values, so it is computed
    once per non-zero row and carried to the zeros that follow it.
    """
    x = F.col(col)
    used = df.withColumn("_zero", x == 0)
    ranks = Window.partitionBy(*keys, "_zero").orderBy(day)
    around = F.percentile(x, F.lit(0.5)).over(ranks.rowsBetween(-(n - 1), n))
    head = F.percentile(x, F.lit(0.5)).over(ranks.rowsBetween(0, n - 1))
    used = used.withColumns(
        {"_mid": F.when(~F.col("_zero"), around), "_head": F.when(~F.col("_zero"), head)}
    )
    w = _frame(keys, day, Window.unboundedPreceding, 0)
    everything = _frame(keys, day, Window.unboundedPreceding, Window.unboundedFollowing)
    fill = F.coalesce(
        F.last("_mid", ignorenulls=True).over(w),
        F.first("_head", ignorenulls=True).over(everything),
        F.lit(0.0),
    )
    return used.withColumn(col, F.when(F.col("_zero"), fill).otherwise(x)).drop("_zero", "_mid", "_head")


def extend_with_recent_mean(df: DataFrame, keys, col: str, until, n: int = 7, day: str = "day") -> DataFrame:
    """Continue every series up to a date with the mean of its last ``n`` rows."""
    keys = list(keys)
    newest = Window.partitionBy(*keys).orderBy(F.desc(day))
    tail = df.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n)
    ends = tail.groupBy(*keys).agg(F.max(day).alias("_last"), F.avg(col).alias(col))
    limit = F.lit(until).cast("date")
    ends = ends.where(F.col("_last") < limit)
    days = F.explode(F.sequence(F.date_add("_last", 1), limit, F.expr("interval 1 day"))).alias(day)
    return df.unionByName(ends.select(*keys, days, col), allowMissingColumns=True)


# --- sequence helpers -------------------------------------------------------------------

def number_in_group(df: DataFrame, keys, order: Sequence[str], bucket: Column, name: str = "activity_n") -> DataFrame:
    """0-based sequence number inside a group, counted bucket by bucket."""
    counted = scan(df.withColumn("_one", F.lit(1)), list(keys), list(order), bucket, sums={name: "_one"})
    return counted.withColumn(name, F.col(name) - 1).drop("_one")


def consecutive_days(df: DataFrame, keys, day: str = "day") -> DataFrame:
    """``event_num`` of runs of consecutive days (0-based) and ``day_num`` inside (1-based)."""
    o = ordered(keys, day)
    gap = F.when(F.datediff(day, F.lag(day).over(o)) > 1, 1).otherwise(0)
    df = df.withColumn("_gap", gap)
    df = df.withColumn("event_num", F.sum("_gap").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "event_num").orderBy(day)
    return df.withColumn("day_num", F.row_number().over(run)).drop("_gap")


def difference(x, keys, n: int = 15, day: str = "day") -> Column:
    x = _c(x)
    return x - F.lag(x, n).over(ordered(keys, day))


# --- strain --------------------------------------------------------------------------------

def region_strain(df: DataFrame, keys, factors: dict[str, float], pain: str, n: int = 14, day: str = "day") -> DataFrame:
    """Strain as sum of stressor/factor, trailing means, and both scaled."""
    from dayweave.operators.scaling import factor_strain

    w = whole(keys)
    df = df.withColumn("strain", factor_strain(factors))
    df = df.withColumns(
        {
            **{f"{c}_RollingMean": trailing_mean(c, keys, n, day) for c in factors},
            "strain_RollingMean": trailing_mean("strain", keys, n, day),
            f"{pain}_RollingMean": trailing_mean(pain, keys, n, day),
        }
    )
    df = df.withColumns(
        {"strain_scaled": minmax("strain_RollingMean", w), "pain_scaled": minmax(f"{pain}_RollingMean", w)}
    )
    filled = ["strain_RollingMean", f"{pain}_RollingMean", "strain_scaled", "pain_scaled"]
    filled += [f"{c}_RollingMean" for c in factors]
    return df.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(w)) for c in filled})


def tune_factors(df: DataFrame, keys, factors: dict[str, float], pain: str, n: int = 14, rate: float = 10000.0, eps: float = 10.0, steps: int = 1000, floor: float = 10.0, day: str = "day") -> DataFrame:
    """Normalisation factors that raise the strain-pain correlation.

    A rolling mean is linear, so the correlation for any factors follows from
    the covariances of the rolled columns: one aggregation in Spark, then a
    finite-difference ascent on a (k+1) x (k+1) matrix per key.  The best
    factors met on the way are returned.
    """
    names = list(factors)
    cols = names + [pain]
    rolled = df.select(*keys, *[trailing_mean(c, keys, n, day).alias(c) for c in cols]).dropna(subset=cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    cov = rolled.groupBy(*keys).agg(*[F.covar_pop(a, b).alias(f"{cols.index(a)}_{cols.index(b)}") for a, b in pairs])
    start = np.array([float(factors[c]) for c in names])
    schema = T.StructType(
        [f for f in df.schema.fields if f.name in keys]
        + [T.StructField(f"factor_{c}", T.DoubleType()) for c in names]
        + [T.StructField("corr_before", T.DoubleType()), T.StructField("corr_after", T.DoubleType())]
    )

    def solve(row: pd.Series) -> list[float]:
        k = len(names)
        m = np.zeros((k + 1, k + 1))
        for a, b in pairs:
            i, j = cols.index(a), cols.index(b)
            m[i, j] = m[j, i] = row[f"{i}_{j}"]

        def corr(f: np.ndarray) -> float:
            w = 1.0 / f
            spread = np.sqrt((w @ m[:k, :k] @ w) * m[k, k])
            return float(w @ m[:k, k] / spread) if spread > 0 else 0.0

        f, best = start.copy(), (corr(start), start)
        for _ in range(steps):
            grad = np.zeros(k)
            for i in range(k):
                up, down = f.copy(), f.copy()
                up[i] += eps
                down[i] = max(f[i] - eps, eps / 10)  # factors stay positive
                grad[i] = (corr(up) - corr(down)) / (up[i] - down[i])
            f = np.maximum(floor, f + rate * grad)
            best = max(best, (corr(f), f), key=lambda pair: pair[0])
        return [*best[1], corr(start), best[0]]

    def batches(frames):
        for pdf in frames:
            rows = [[*(row[c] for c in keys), *solve(row)] for _, row in pdf.iterrows()]
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return cov.mapInPandas(batches, schema)
