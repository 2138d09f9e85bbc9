"""Lagged correlations between drivers and pain, whole and in sliding windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.operators import rolling as ro
from dayweave.operators.ordered import spread
from dayweave.operators.scaling import whole
from dayweave.operators.stats import with_pearson_p


def _shifted(x: str, lag: int, w) -> Column:
    """Value ``lag`` rows earlier (later for a negative lag)."""
    if lag == 0:
        return F.col(x)
    return F.lag(x, lag).over(w) if lag > 0 else F.lead(x, -lag).over(w)


def cross_correlation(
    df: DataFrame,
    keys: Sequence[str],
    drivers: Sequence[str],
    pains: Sequence[str],
    lags: Sequence[int] = range(-50, 51),
    min_pairs: int = 6,
    day: str = "day",
) -> DataFrame:
    """``keys, pain, driver, lag, corr``: pain today against the driver ``lag`` days before.

    One window gathers the driver values around each day; unfolding them feeds
    a partial aggregation in the same stage.  Nothing is joined and the
    unfolded rows are never shuffled.  Fewer valid pairs than ``min_pairs``
    give NULL, and every lag has a row.
    """
    keys, lags = list(keys), sorted(lags)
    lo, hi = lags[0], lags[-1]
    long = df.select(
        *keys,
        day,
        *pains,
        F.inline(F.array(*[F.struct(F.lit(d).alias("driver"), F.col(d).cast("double").alias("_x")) for d in drivers])),
    )
    w = Window.partitionBy(*keys, "driver").orderBy(day)
    long = spread(long, *keys, "driver").withColumn("_pos", F.row_number().over(w))
    around = F.collect_list(F.struct("_pos", "_x")).over(w.rowsBetween(-hi, -lo))
    # the first row also carries every lag once without a value
    empty = F.transform(
        F.sequence(F.lit(lo), F.lit(hi)), lambda k: F.struct((F.col("_pos") - k).alias("_pos"), F.lit(None).cast("double").alias("_x"))
    )
    long = long.withColumn("_near", around)
    near = F.when(F.col("_pos") == 1, F.concat("_near", empty)).otherwise(F.col("_near"))
    pairs = long.select(*keys, "driver", *pains, F.col("_pos").alias("_here"), F.explode(near).alias("_n"))
    pairs = pairs.select("*", (F.col("_here") - F.col("_n._pos")).alias("lag"), F.col("_n._x").alias("_x"))
    if len(lags) < hi - lo + 1:
        pairs = pairs.where(F.col("lag").isin(lags))
    aggs = []
    for j, p in enumerate(pains):
        both = F.col(p).isNotNull() & F.col("_x").isNotNull()
        aggs.append(F.when(F.count(F.when(both, 1)) >= min_pairs, F.corr(p, "_x")).alias(f"c{j}"))
    sums = pairs.groupBy(*keys, "driver", "lag").agg(*aggs)
    items = F.array(*[F.struct(F.lit(p).alias("pain"), F.col(f"c{j}").alias("corr")) for j, p in enumerate(pains)])
    return sums.select(*keys, "driver", "lag", F.inline(items))


def sliding_windows(df: DataFrame, start: str, end: str, months: int = 6, step: int = 2, day: str = "day") -> DataFrame:
    """Repeat each row for the calendar windows ``[w_start, w_end)`` that hold it."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    starts = F.sequence(first, F.add_months(last, -months), F.make_ym_interval(months=F.lit(step)))
    inside = F.filter(starts, lambda s: (s <= F.col(day)) & (F.col(day) < F.add_months(s, months)))
    out = df.withColumn("w_start", F.explode(inside))
    return out.withColumn("w_end", F.add_months("w_start", months))


def windowed_cross_correlation(
    df: DataFrame,
    keys: Sequence[str],
    drivers: Sequence[str],
    pains: Sequence[str],
    start: str | None = None,
    end: str | None = None,
    lags: Sequence[int] = range(-50, 51),
    smooth: int = 7,
    months: int = 6,
    step: int = 2,
    day: str = "day",
) -> DataFrame:
    """Cross-correlation curves per sliding window, after a trailing mean.

    Adds ``integral``: the sum of the smoothed driver inside the window.
    Without ``start`` or ``end`` the first or last day of the data counts.
    """
    keys = list(keys)
    if start is None or end is None:
        first, last = df.agg(F.min(day).cast("string"), F.max(day).cast("string")).first()
        start, end = start or first, end or last
    cols = list(dict.fromkeys([*drivers, *pains]))
    inside = df.where(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    rolled = inside.select(*keys, day, *[ro.trailing_mean(c, keys, smooth, day).alias(c) for c in cols]).dropna(subset=cols)
    placed = sliding_windows(rolled, start, end, months, step, day)
    group = [*keys, "w_start", "w_end"]
    curves = cross_correlation(placed, group, drivers, pains, lags, day=day)
    sums = placed.groupBy(*group).agg(*[F.sum(d).alias(d) for d in drivers]).unpivot(group, list(drivers), "driver", "integral")
    return curves.join(sums, [*group, "driver"])


def best_lag(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lag of the first maximum of every curve."""
    known = F.when(F.col("corr").isNotNull(), F.struct(F.col("corr"), -F.col("lag")))
    return curves.groupBy(*keys).agg(F.max_by("lag", known).alias("best_lag"), F.max("corr").alias("best_corr"))


def curve_measures(curves: DataFrame, keys: Sequence[str], half: int = 30) -> DataFrame:
    """Phase of lag 0 between its neighbouring extrema and one-sided integrals.

    ``local_measure`` is -1..1; ``balance`` = integral after minus before lag 0,
    ``after`` the integral after, ``peak`` the largest correlation after it.
    """
    keys = list(keys)
    o = Window.partitionBy(*keys).orderBy("lag")
    c, before, after = F.col("corr"), F.lag("corr").over(o), F.lead("corr").over(o)
    turn = ((c > before) & (c > after)) | ((c < before) & (c < after))
    rows = curves.withColumn("_turn", F.coalesce(turn, F.lit(False)))
    point = F.struct(F.col("lag").alias("l"), F.col("corr").alias("c"))

    def trapezoid(lo: int, hi: int) -> Column:
        inside = F.col("lag").between(lo, hi)
        weight = F.when(F.col("lag").isin(lo, hi), 0.5).otherwise(1.0)
        complete = F.count(F.when(inside & c.isNotNull(), 1)) == hi - lo + 1
        return F.when(complete, F.sum(F.when(inside, c * weight)))

    m = rows.groupBy(*keys).agg(
        F.max_by(point, F.when(F.col("_turn") & (F.col("lag") < 0), F.col("lag"))).alias("_l"),
        F.min_by(point, F.when(F.col("_turn") & (F.col("lag") >= 0), F.col("lag"))).alias("_r"),
        trapezoid(-half, -1).alias("before"),
        trapezoid(1, half).alias("after"),
        F.max(F.when(F.col("lag") > 0, c)).alias("peak"),
    )
    left, right = F.col("_l"), F.col("_r")
    span = (right["l"] - left["l"]).cast("double")
    local = (
        F.when(left["c"] > right["c"], -right["l"] / span)
        .when(left["c"] < right["c"], -left["l"] / span)
        .otherwise(F.lit(0.0))
    )
    m = m.withColumn("local_measure", F.when(left.isNotNull() & right.isNotNull(), local + F.lit(0.0)).otherwise(F.lit(0.0)))
    return m.withColumn("balance", F.col("after") - F.col("before")).drop("_l", "_r")


# Days after a day whose mean a bucket takes.
LAG_BUCKETS = {
    "same_day": [0],
    "next_day": [1],
    "next_2_days": [1, 2],
    "next_3_days": [1, 2, 3],
    "next_4_days": [1, 2, 3, 4],
    "next_5_days": [1, 2, 3, 4, 5],
}


def bucket_correlations(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    buckets: Mapping[str, Sequence[int]] = LAG_BUCKETS,
    day: str = "day",
    with_p: bool = True,
) -> DataFrame:
    """Correlation of every ordered pair with the mean of the next days.

    The second variable is unfolded to rows and its bucket means are columns of
    one window; the first variables stay columns of one aggregation.
    """
    keys = list(keys)
    long = df.select(
        *keys,
        day,
        *cols,
        F.inline(F.array(*[F.struct(F.lit(c).alias("second"), F.col(c).cast("double").alias("_y")) for c in cols])),
    )
    w = Window.partitionBy(*keys, "second").orderBy(day)
    ahead = {k: _shifted("_y", -k, w) for k in sorted({k for ks in buckets.values() for k in ks})}
    long = long.select(*keys, "second", *cols, *[col.alias(f"_a{k}") for k, col in ahead.items()])
    for name, ks in buckets.items():
        total = sum((F.coalesce(F.col(f"_a{k}"), F.lit(0.0)) for k in ks), F.lit(0.0))
        count = sum((F.col(f"_a{k}").isNotNull().cast("int") for k in ks), F.lit(0))
        long = long.withColumn(f"_t_{name}", F.try_divide(total, count))
    aggs = []
    for i, c in enumerate(cols):
        for name in buckets:
            t = f"_t_{name}"
            both = F.col(c).isNotNull() & F.col(t).isNotNull()
            aggs += [F.corr(c, t).alias(f"r{i}_{name}"), F.count(F.when(both, 1)).alias(f"n{i}_{name}")]
    wide = long.groupBy(*keys, "second").agg(*aggs)
    items = F.array(
        *[
            F.struct(
                F.lit(c).alias("first"),
                F.lit(name).alias("bucket"),
                F.col(f"r{i}_{name}").alias("r"),
                F.col(f"n{i}_{name}").alias("n"),
            )
            for i, c in enumerate(cols)
            for name in buckets
        ]
    )
    out = wide.select(*keys, "second", F.inline(items)).where((F.col("first") != F.col("second")) & (F.col("n") > 2))
    return with_pearson_p(out) if with_p else out


def extreme_pain_pairs(tests: DataFrame, keys: Sequence[str], pains: Sequence[str], limit: float = 0.05) -> DataFrame:
    """Strongest positive and negative significant driver-to-pain correlation per pair."""
    group = [*keys, "first", "second"]
    kept = tests.where(
        (F.col("p_value") < limit) & F.col("second").isin(list(pains)) & ~F.col("first").isin(list(pains))
    ).withColumn("_side", F.signum("r"))
    w = Window.partitionBy(*group, "_side").orderBy(F.desc(F.abs(F.col("r"))), "bucket")
    best = kept.where(F.col("_side") != 0).withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1)
    return best.drop("_side", "_k").orderBy("second", F.desc("r"))


def group_report(measures: DataFrame, keys: Sequence[str], groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Measures with the driver's group and a bubble size of 10..100 by integral.

    A driver may belong to several groups; sizes are scaled per pain and driver.
    """
    pairs = [F.struct(F.lit(g).alias("group"), F.lit(d).alias("_d")) for g, ds in groups.items() for d in ds]
    matched = F.filter(F.array(*pairs), lambda p: p["_d"] == F.col("driver"))
    out = measures.withColumn("_p", F.explode(matched)).withColumn("group", F.col("_p")["group"]).drop("_p")
    w = whole([*keys, "group", "pain", "driver"])
    low, high = F.min("integral").over(w), F.max("integral").over(w)
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return out.withColumn("size", 10 + (F.col("integral") - low) / span * 90)


def smoothed_pair_test(df: DataFrame, keys: Sequence[str], x: str, y: str, n: int = 31, exclude: tuple | None = None, since=None, day: str = "day") -> DataFrame:
    """Pearson test of two trailing means after dropping zeros and a period."""
    from dayweave.operators.stats import pearson_test

    rolled = df.select(*keys, day, ro.trailing_mean(x, keys, n, day).alias("x"), ro.trailing_mean(y, keys, n, day).alias("y"))
    rolled = rolled.where((F.col("x") != 0) & (F.col("y") != 0))
    if exclude:
        rolled = rolled.where(~F.col(day).between(F.lit(exclude[0]).cast("date"), F.lit(exclude[1]).cast("date")))
    if since:
        rolled = rolled.where(F.col(day) >= F.lit(since).cast("date"))
    return pearson_test(rolled, keys, "x", "y")
