"""Merging overlapping devices into one series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.operators import rolling as ro
from dayweave.operators.aggregates import impute_by_median_ratio, usable_ratio
from dayweave.operators.scaling import whole


def _inside(period: tuple, day: str = "day") -> Column:
    return F.col(day).between(F.lit(period[0]).cast("date"), F.lit(period[1]).cast("date"))


def _median(x: Column, w) -> Column:
    return F.percentile(x, F.lit(0.5)).over(w)


def zero_repair(df: DataFrame, keys: Sequence[str], main: str, other: str, target: str, period: tuple, keep_ratio: str | None = None) -> DataFrame:
    """Inside a period: main, or ratio * other where main is almost zero.

    The ratio is the median of the usable daily main/other; "almost zero" is
    below a fifteenth of the median of main.
    """
    w, inside = whole(keys), _inside(period)
    ratio = _median(F.when(inside, usable_ratio(main, other)), w)
    low = _median(F.when(inside, F.col(main)), w) / F.lit(15.0)
    df = df.withColumns({"_ratio": ratio, "_low": low})
    fixed = F.when((F.col(main) < F.col("_low")) & (F.col(other) != 0), F.col("_ratio") * F.col(other))
    df = df.withColumn(target, F.when(inside, F.coalesce(fixed, F.col(main))).otherwise(F.col(target)))
    return (df.withColumnRenamed("_ratio", keep_ratio) if keep_ratio else df.drop("_ratio")).drop("_low")


def predict_from_other(df: DataFrame, other: str, target: str, period: tuple, ratio: str | float) -> DataFrame:
    """target = ratio * other inside a period."""
    factor = F.col(ratio) if isinstance(ratio, str) else F.lit(float(ratio))
    return df.withColumn(target, F.when(_inside(period), factor * F.col(other)).otherwise(F.col(target)))


def copy_period(df: DataFrame, main: str, target: str, period: tuple) -> DataFrame:
    """target = main inside a period."""
    return df.withColumn(target, F.when(_inside(period), F.col(main)).otherwise(F.col(target)))


def apply_plan(df: DataFrame, keys: Sequence[str], plan: Sequence[tuple]) -> DataFrame:
    """Steps ``(op, period, main, other, target)`` in order.

    ``repair`` remembers its ratio for the ``predict`` steps after it.  Every
    step works on windows of the same key, so the plan shuffles once.
    """
    for op, period, main, other, target in plan:
        if op == "copy":
            df = copy_period(df, main, target, period)
        elif op == "repair":
            df = zero_repair(df.drop("_plan_ratio"), keys, main, other, target, period, keep_ratio="_plan_ratio")
        elif op == "predict":
            df = predict_from_other(df, other, target, period, "_plan_ratio")
        else:
            raise ValueError(f"unknown step {op}")
    return df.drop("_plan_ratio")


def cross_repair(df: DataFrame, keys: Sequence[str], a: str, b: str, period: tuple) -> DataFrame:
    """``<a>_corrected`` from b and ``<b>_corrected`` from a."""
    df = df.withColumns({f"{a}_corrected": F.col(a), f"{b}_corrected": F.col(b)})
    df = zero_repair(df, keys, a, b, f"{a}_corrected", period)
    return zero_repair(df, keys, b, a, f"{b}_corrected", period)


def merge_calories(
    df: DataFrame,
    keys: Sequence[str],
    base: str,
    first: str,
    recent: str,
    first_until,
    recent_from,
    add: Column | None = None,
    floor: float = 1800.0,
    floor_value: float = 2200.0,
    factor: float = 1.05,
    n: int = 31,
) -> DataFrame:
    """One calorie series from three devices.

    The base device is corrected by ``add``, an early device replaces it up to
    a date and a recent one from a date.  Too low days get a fixed value; the
    other devices are scaled to the base device.
    """
    early = (F.col("day") <= F.lit(first_until).cast("date")) & F.col(first).isNotNull()
    late = F.col("day") >= F.lit(recent_from).cast("date")
    merged = F.col(base) + (add if add is not None else F.lit(0.0))
    merged = F.when(late, F.col(recent)).when(early, F.col(first)).otherwise(merged)
    df = df.withColumn("calories", F.when(merged < floor, F.lit(floor_value)).otherwise(merged))
    df = df.withColumn("calories_mean", ro.trailing_mean("calories", keys, n))
    scaled = (F.col("day") <= F.lit(first_until).cast("date")) | late
    k = F.when(scaled, F.lit(factor)).otherwise(F.lit(1.0))
    return df.withColumns({"calories": F.col("calories") * k, "calories_mean": F.col("calories_mean") * k})


def ride_intervals(tap: DataFrame, device: DataFrame, keys: Sequence[str], cutover, too_long_hours: float = 3.5, capped_hours: float = 3.0) -> DataFrame:
    """Rides from the tap log up to a date, from the device after it.

    ``tap`` has start_ts and end_ts, ``device`` start_ts and duration_ms; device
    rides beyond the limit are cut to the capped length.
    """
    cut = F.lit(cutover).cast("timestamp")
    old = tap.where(F.col("start_ts") <= cut).select(*keys, "start_ts", "end_ts")
    hour = 3_600_000
    ms = F.when(F.col("duration_ms") > too_long_hours * hour, capped_hours * hour).otherwise(F.col("duration_ms"))
    end = F.timestamp_micros(F.unix_micros("start_ts") + (ms * 1000).cast("long"))
    new = device.where(F.col("start_ts") > cut).select(*keys, "start_ts", end.alias("end_ts"))
    return old.unionByName(new)


def ride_steps(rides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Minutes and corrected steps of rides; zero rides take the median pace."""
    minutes = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / F.lit(60e6)
    out = rides.withColumn("minutes", minutes).withColumn("steps_corrected", F.col("steps"))
    return impute_by_median_ratio(out, keys, "steps_corrected", "minutes", truncate=True)


def prepare_sources(df: DataFrame, keys: Sequence[str], pain: str, merged: dict[str, Sequence[str]], fill: float | None = None, n: int = 15) -> DataFrame:
    """Pain gaps filled, sources divided by their maximum, row maxima taken.

    Gaps take a constant, or the centred mean of known days (partial windows);
    the first row is left as it is.
    """
    w = Window.partitionBy(*keys).orderBy("day")
    if fill is not None:
        df = df.withColumn(pain, F.coalesce(F.col(pain), F.lit(float(fill))))
    else:
        back, ahead = n - 1 - n // 2, n // 2
        near = F.avg(pain).over(w.rowsBetween(-back, ahead))
        known = F.when(F.lead(F.lit(1), ahead).over(w).isNotNull(), near)
        first = F.lag(F.lit(1)).over(w).isNull()
        df = df.withColumn(pain, F.when(first, F.col(pain)).otherwise(F.coalesce(F.col(pain), known)))
    sources = sorted({c for cs in merged.values() for c in cs} | {pain})
    top = whole(keys)
    df = df.withColumns({c: F.try_divide(F.col(c), F.max(c).over(top)) for c in sources})
    return df.withColumns({name: F.greatest(*cs) if len(cs) > 1 else F.col(cs[0]) for name, cs in merged.items()})
