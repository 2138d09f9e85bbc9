"""Strain and pain smoothing, extrema and where strain peaks fall in the pain cycle.

Every function is keyed, so regions, people and parameter sets run together.
Series are at day grain; ``pos`` is the row position of a day in its series.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayweave.operators import rolling as ro
from dayweave.operators.ordered import attach, spread
from dayweave.operators.scaling import minmax, ordered, weighted_strain, whole


# --- smoothing ---------------------------------------------------------------------

def smooth_grid(
    df: DataFrame,
    keys: Sequence[str],
    stressors: Mapping[str, float],
    pain: str,
    filters: Sequence[tuple[int, int, int]],
    day: str = "day",
    digits: int | None = None,
) -> DataFrame:
    """Strain and pain smoothed with several (mean, minmax, median) windows.

    All variants are columns of the same windowed plan - one shuffle and one
    sort for the whole grid - and are unfolded to rows at the end:
    ``keys, filter_id, day, pos, strain, pain, strain_raw, pain_raw``.
    A minmax window of 0 skips the rolling rescale.  ``digits`` rounds the
    result so that plateaus equal up to float noise stay equal.
    """
    keys = list(keys)
    w, o = whole(keys), ordered(keys, day)
    df = spread(df.select(*keys, day, *stressors, F.col(pain).alias("_pain")), *keys)
    df = df.withColumns({c: minmax(c, w) for c in stressors})
    df = df.withColumn("strain_raw", weighted_strain(stressors))
    df = df.withColumns(
        {
            "strain_raw": minmax("strain_raw", w),
            "pain_raw": minmax("_pain", w),
            "pos": F.row_number().over(o) - 1,
            "_inner": F.lead(F.lit(True)).over(o),
        }
    ).drop("_pain", *stressors)

    names = ("strain", "pain")
    means = sorted({f[0] for f in filters})
    df = df.withColumns({f"{s}_{m}": ro.centred_mean(f"{s}_raw", keys, m, day) for s in names for m in means})
    df = df.withColumns({f"{s}_{m}": minmax(f"{s}_{m}", w) for s in names for m in means})

    scaled = sorted({(f[0], f[1]) for f in filters})
    todo = [(s, m, b) for s in names for m, b in scaled if b]
    raw = {}
    for s, m, b in todo:
        x, back = F.col(f"{s}_{m}"), b - m
        seen = F.when(F.col("_inner"), x)
        frame = Window.partitionBy(*keys).orderBy(day).rowsBetween(-back, m - 1)
        start = F.first(x).over(Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
        first = F.when(F.col("pos") >= back, F.lag(x, back).over(o)).otherwise(start)
        low, high = F.min(seen).over(frame), F.max(seen).over(frame)
        raw[f"{s}_{m}_{b}"] = F.when(first.isNotNull(), F.try_divide(x - low, high - low))
    df = df.withColumns(raw) if raw else df
    history = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    carried = {c: F.coalesce(F.last(c, ignorenulls=True).over(history), F.lit(0.0)) for c in raw}
    carried.update({f"{s}_{m}_0": F.col(f"{s}_{m}") for s in names for m, b in scaled if not b})
    df = df.withColumns(carried)

    def final(s: str, m: int, b: int, k: int) -> Column:
        value = ro.centred_median(f"{s}_{m}_{b}", keys, k, day)
        return F.round(value, digits) + F.lit(0.0) if digits is not None else value

    medians = {f"{s}_{i}": final(s, *f) for i, f in enumerate(filters) for s in names}
    df = df.select(*keys, day, "pos", "strain_raw", "pain_raw", *[c.alias(n) for n, c in medians.items()])
    variants = F.array(
        *[
            F.struct(F.lit(i).alias("filter_id"), F.col(f"strain_{i}").alias("strain"), F.col(f"pain_{i}").alias("pain"))
            for i in range(len(filters))
        ]
    )
    return df.select(*keys, day, "pos", "strain_raw", "pain_raw", F.inline(variants))


def smooth(df: DataFrame, keys, stressors, pain: str, mean: int = 15, rescale: int = 270, median: int = 15, day: str = "day", digits: int | None = None) -> DataFrame:
    """One variant of :func:`smooth_grid`."""
    return smooth_grid(df, keys, stressors, pain, [(mean, rescale, median)], day, digits).drop("filter_id")


def smooth_both_ends(df: DataFrame, keys, loads: Mapping[str, float], pain: str, mean: int, rescale: int, median: int, day: str = "day", both_ends: bool = True, digits: int | None = None) -> DataFrame:
    """Region variant: weighted predictors, optional handling of short ends.

    With ``both_ends`` windows accept partial heads and the tail is filled with
    0, so the newest days take part.
    """
    keys = list(keys)
    w = whole(keys)
    mean_fn = ro.centred_mean_partial if both_ends else ro.centred_mean
    median_fn = ro.centred_median_partial if both_ends else ro.centred_median
    df = spread(df.select(*keys, day, *loads, F.col(pain).alias("pain_raw")), *keys)
    df = df.withColumns({c: minmax(c, w) for c in loads})
    df = df.withColumn("strain_raw", weighted_strain(loads)).drop(*loads)
    df = df.withColumns({f"_{s}": mean_fn(f"{s}_raw", keys, mean, day) for s in ("strain", "pain")})
    for s in ("strain", "pain"):
        df = ro.rolling_minmax_shifted(df, keys, f"_{s}", rescale, mean, f"_{s}", day)
    df = df.withColumns({s: median_fn(f"_{s}", keys, median, day) for s in ("strain", "pain")}).drop("_strain", "_pain")
    df = df.withColumns({c: minmax(c, w) for c in ("strain", "pain", "strain_raw", "pain_raw")})
    if digits is not None:
        df = df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in ("strain", "pain")})
    return df.withColumn("pos", F.row_number().over(ordered(keys, day)) - 1)


# --- extrema -------------------------------------------------------------------------

def _plateau_maxima(x: np.ndarray) -> np.ndarray:
    """Middles of the plateaus that are strictly above both neighbours."""
    if len(x) < 3:
        return np.empty(0, dtype=int)
    # NaN differs from everything, so it always ends a run
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    ends = np.r_[starts[1:] - 1, len(x) - 1]
    level = x[starts]
    above = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return ((starts[1:-1] + ends[1:-1]) // 2)[above]


def _flank_lows(x: np.ndarray) -> np.ndarray:
    """For every position the lowest value from it back to the last higher or missing one.

    A stack of falling values; each carries the lowest value since the one below
    it, so merging what a rise overtakes costs one step per value.
    """
    out = np.empty(len(x))
    tops: list[float] = []
    lows: list[float] = []
    for i, v in enumerate(x.tolist()):
        if v != v:
            tops.clear()
            lows.clear()
            out[i] = v
            continue
        low = v
        while tops and tops[-1] <= v:
            tops.pop()
            low = min(low, lows.pop())
        tops.append(v)
        lows.append(low)
        out[i] = low
    return out


def _last_under(x: np.ndarray, peaks: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """For every peak the last position before it with a value at or under its height.

    Positions that no later value goes under form a rising stack, in which the
    height is looked up.
    """
    out = np.empty(len(peaks), dtype=int)
    values: list[float] = []
    places: list[int] = []
    wanted = dict(zip(peaks.tolist(), zip(range(len(peaks)), heights.tolist(), strict=True), strict=True))
    for i, v in enumerate(x.tolist()):
        if (hit := wanted.get(i)) is not None:
            out[hit[0]] = places[bisect_right(values, hit[1]) - 1]
        if v != v:
            values.clear()
            places.clear()
            continue
        while values and values[-1] >= v:
            values.pop()
            places.pop()
        values.append(v)
        places.append(i)
    return out


def measured_maxima(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all maxima with their prominence and half-prominence width, in linear time."""
    at = _plateau_maxima(x)
    last = len(x) - 1
    low = np.maximum(_flank_lows(x)[at], _flank_lows(x[::-1])[last - at])
    prominence = x[at] - low
    height = x[at] - 0.5 * prominence
    i = _last_under(x, at, height)
    j = last - _last_under(x[::-1], (last - at)[::-1], height[::-1])[::-1]
    # interpolated crossings; a value at the height is the crossing itself
    with np.errstate(invalid="ignore"):
        left = i + np.where(x[i] < height, (height - x[i]) / (x[np.minimum(i + 1, last)] - x[i]), 0.0)
        right = j - np.where(x[j] < height, (height - x[j]) / (x[np.maximum(j - 1, 0)] - x[j]), 0.0)
    return at, prominence, right - left


def prominent_maxima(x: np.ndarray, prominence: float, width: float) -> np.ndarray:
    """Positions of maxima with enough prominence and half-prominence width."""
    at, prom, wide = measured_maxima(x)
    return at[(prom >= prominence) & (wide >= width)]


def measure_extrema(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``keys, series, kind, pos, value, prominence, width`` of all maxima and minima.

    Every series is shuffled and read once, whatever thresholds follow.  A group
    is one day-grain series, which the calendar bounds.
    """
    keys = list(keys)
    long = df.select(*keys, "pos", F.inline(F.array(*[F.struct(F.lit(v).alias("series"), F.col(v).cast("double").alias("value")) for v in values])))
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [
            T.StructField("series", T.StringType()),
            T.StructField("kind", T.StringType()),
            T.StructField("pos", T.IntegerType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("prominence", T.DoubleType()),
            T.StructField("width", T.DoubleType()),
        ]
    )

    def extrema(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x = pdf["value"].to_numpy(dtype=float)
        pos = pdf["pos"].to_numpy()
        parts = []
        for kind, series in (("max", x), ("min", -x)):
            at, prominence, width = measured_maxima(series)
            parts.append(pd.DataFrame({"kind": kind, "pos": pos[at], "value": x[at], "prominence": prominence, "width": width}))
        out = pd.concat(parts, ignore_index=True)
        for name, v in zip([*keys, "series"], key, strict=True):
            out[name] = v
        return out[[f.name for f in schema.fields]]

    return spread(long, *keys, "series").groupBy(*keys, "series").applyInPandas(extrema, schema)


def find_extrema(df: DataFrame, keys: Sequence[str], values: Sequence[str], prominence: float, width: float) -> DataFrame:
    """``keys, series, kind, pos, value`` of the prominent maxima and minima."""
    found = measure_extrema(df, keys, values)
    return found.where((F.col("prominence") >= float(prominence)) & (F.col("width") >= float(width))).drop("prominence", "width")


def extrema_by_thresholds(measured: DataFrame, thresholds: Sequence[tuple[float, float]]) -> DataFrame:
    """Measured extrema once for each (prominence, width) that they reach.

    The thresholds stand in ``min_prominence`` and ``min_width``; rows are
    unfolded in place, without a join.
    """
    sets = F.array(*[F.struct(F.lit(float(p)).alias("min_prominence"), F.lit(float(w)).alias("min_width")) for p, w in thresholds])
    reached = F.filter(sets, lambda s: (F.col("prominence") >= s["min_prominence"]) & (F.col("width") >= s["min_width"]))
    return measured.select(*[c for c in measured.columns if c not in ("prominence", "width")], F.inline(reached))


def alternate(extrema: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of every run of equal kinds keep the first, so maxima and minima alternate."""
    w = Window.partitionBy(*keys).orderBy("pos")
    previous = F.lag("kind").over(w)
    return (
        extrema.withColumn("_prev", previous)
        .where(F.col("_prev").isNull() | (F.col("_prev") != F.col("kind")))
        .drop("_prev")
    )


def of_series(extrema: DataFrame, series: str, kind: str | None = None) -> DataFrame:
    out = extrema.where(F.col("series") == series)
    return out.where(F.col("kind") == kind) if kind else out


# --- cycle score ----------------------------------------------------------------------

def cycle_scores(pain_extrema: DataFrame, strain_peaks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Relative place of every strain peak between its pain extrema.

    ``score`` is -1..0 on the way down (0 at the minimum) and 0..1 on the way
    up (1 at the maximum); NULL outside the known cycles.  ``seg_from`` and
    ``seg_to`` are the surrounding extrema.  Both neighbours come from one pass
    over the merged, ordered positions.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("pos")
    marks = pain_extrema.select(
        *keys,
        "pos",
        F.lit(1).alias("rank"),
        F.struct(
            F.col("pos").alias("p"),
            F.col("kind").alias("k"),
            F.lead("pos").over(order).alias("np"),
            F.lead("kind").over(order).alias("nk"),
        ).alias("e"),
        F.lit(None).cast("double").alias("value"),
    )
    peaks = strain_peaks.select(
        *keys, "pos", F.lit(0).alias("rank"), F.lit(None).cast(marks.schema["e"].dataType).alias("e"), "value"
    )
    merged = marks.unionByName(peaks)
    up = Window.partitionBy(*keys).orderBy("pos", "rank").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc("pos"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    both = merged.select(
        "*",
        F.last("e", ignorenulls=True).over(up).alias("a"),
        F.last("e", ignorenulls=True).over(down).alias("b"),
    ).where(F.col("rank") == 0)

    a, b, m = F.col("a"), F.col("b"), F.col("pos")
    between = a.isNotNull() & b.isNotNull()
    on_first = a.isNull() & (b["p"] == m) & b["np"].isNotNull()
    both = both.select(
        *keys,
        "pos",
        "value",
        F.when(between, a["p"]).when(on_first, b["p"]).alias("seg_from"),
        F.when(between, b["p"]).when(on_first, b["np"]).alias("seg_to"),
        F.when(between, a["k"]).when(on_first, b["k"]).alias("_from_kind"),
        F.when(between, b["np"]).alias("_after"),
    )
    lo, hi = F.col("seg_from"), F.col("seg_to")
    falling = F.col("_from_kind") == "max"
    down_score = (m - hi) / (hi - lo)
    # a strain peak on the top of an ascending pair belongs to the next descent
    top_score = F.try_divide((m - F.col("_after")).cast("double"), (F.col("_after") - hi).cast("double"))
    up_score = (m - lo) / (hi - lo)
    score = F.when(falling, down_score).when(m == hi, top_score).otherwise(up_score)
    return both.withColumn("score", F.when(lo.isNotNull(), score + F.lit(0.0))).drop("_from_kind", "_after")


def pain_slope(series: DataFrame, peaks: DataFrame, keys: Sequence[str], pain: str = "pain") -> DataFrame:
    """Next-day change of pain at each peak; 0 at the end of the series."""
    o = Window.partitionBy(*keys).orderBy("pos")
    ahead = F.lead(F.lit(1)).over(o)
    step = F.when(ahead.isNull(), F.lit(0.0)).otherwise(F.lead(pain).over(o) - F.col(pain))
    slopes = series.select(*keys, "pos", step.alias("slope"))
    return peaks.join(slopes, [*keys, "pos"], "left")


def extremum_columns(series: DataFrame, pain_extrema: DataFrame, scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``max``, ``min`` (pain at extrema) and ``maxstrain`` (0 at the days around)."""
    keys = list(keys)
    ext = pain_extrema.groupBy(*keys, "pos").agg(
        F.max(F.when(F.col("kind") == "max", F.col("value"))).alias("max"),
        F.max(F.when(F.col("kind") == "min", F.col("value"))).alias("min"),
    )
    around = scored.where(F.col("score").isNotNull()).select(
        *keys,
        F.inline(
            F.array(
                F.struct((F.col("pos") - 1).alias("pos"), F.lit(0.0).alias("v"), F.lit(0).alias("r")),
                F.struct(F.col("pos").alias("pos"), F.col("value").alias("v"), F.lit(1).alias("r")),
                F.struct((F.col("pos") + 1).alias("pos"), F.lit(0.0).alias("v"), F.lit(0).alias("r")),
            )
        ),
    )
    around = around.groupBy(*keys, "pos").agg(F.max_by("v", "r").alias("maxstrain"))
    return series.join(ext, keys + ["pos"], "left").join(around, keys + ["pos"], "left")


def cycle_days(pain_extrema: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Days of ascending and descending pain, without the first and last of each."""
    keys = list(keys)
    o = Window.partitionBy(*keys).orderBy("pos")
    gaps = pain_extrema.select(
        *keys,
        "pos",
        F.when((F.col("kind") == "max") & (F.lag("kind").over(o) == "min"), F.col("pos") - F.lag("pos").over(o)).alias("up"),
        F.when((F.col("kind") == "max") & (F.lead("kind").over(o) == "min"), F.lead("pos").over(o) - F.col("pos")).alias("down"),
    )
    upto = o.rowsBetween(Window.unboundedPreceding, 0)
    w = whole(keys)
    ranked = gaps.select(
        "*",
        F.count("up").over(upto).alias("_u"),
        F.count("down").over(upto).alias("_d"),
        F.count("up").over(w).alias("_nu"),
        F.count("down").over(w).alias("_nd"),
    )

    def inner(c: str, i: str, n: str) -> Column:
        kept = F.when((F.col(i) > 1) & (F.col(i) < F.col(n)), F.col(c))
        return F.coalesce(F.sum(kept), F.lit(0)).cast("double")

    return ranked.groupBy(*keys).agg(inner("up", "_u", "_nu").alias("asc_days"), inner("down", "_d", "_nd").alias("desc_days"))


# --- amplitudes ------------------------------------------------------------------------

def points_in_ranges(points: DataFrame, ranges: DataFrame, keys: Sequence[str], lo: str, hi: str, width: int = 64) -> DataFrame:
    """Join positions to the ranges that contain them through position buckets."""
    pieces = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    spots = points.withColumn("_b", F.floor(F.col("pos") / width))
    return spots.join(pieces, [*keys, "_b"]).where(F.col("pos").between(F.col(lo), F.col(hi))).drop("_b")


def amplitudes(pain_extrema: DataFrame, strain_extrema: DataFrame, keys: Sequence[str], before: int = 0, after: int = 0) -> DataFrame:
    """Pain rise and the strain rise that came with it, per pain maximum.

    The strain rise is 0 when no strain peak lies in the (widened) ascent; a
    peak without an earlier strain minimum drops the pair.
    """
    keys = list(keys)
    o = Window.partitionBy(*keys).orderBy("pos")
    rises = pain_extrema.select(
        *keys,
        "kind",
        F.col("pos").alias("max_pos"),
        F.lag("pos").over(o).alias("min_pos"),
        (F.col("value") - F.lag("value").over(o)).alias("pain_amp"),
    )
    rises = rises.where((F.col("kind") == "max") & F.col("min_pos").isNotNull()).select(
        *keys,
        "max_pos",
        "pain_amp",
        (F.col("min_pos") - F.lit(before)).alias("_lo"),
        (F.col("max_pos") + F.lit(after)).alias("_hi"),
    )
    upto = o.rowsBetween(Window.unboundedPreceding, 0)
    low = F.last(F.when(F.col("kind") == "min", F.col("value")), ignorenulls=True).over(upto)
    peaks = strain_extrema.withColumn("_low", low).where(F.col("kind") == "max")
    peaks = peaks.select(*keys, "pos", F.col("value").alias("_v"), "_low")
    inside = points_in_ranges(peaks, rises.select(*keys, "max_pos", "_lo", "_hi"), keys, "_lo", "_hi")
    best = inside.groupBy(*keys, "max_pos").agg(
        F.max_by(F.struct("_v", "_low"), F.struct(F.col("_v"), -F.col("pos"))).alias("_best")
    )
    out = rises.join(best, keys + ["max_pos"], "left")
    found = F.col("_best").isNotNull()
    rise = F.when(found, F.col("_best")["_v"] - F.col("_best")["_low"]).otherwise(F.lit(0.0))
    out = out.withColumn("strain_amp", rise).where(F.col("strain_amp").isNotNull())
    return out.select(*keys, F.col("max_pos").alias("pos"), "pain_amp", "strain_amp")


def split_by_strain(amps: DataFrame) -> DataFrame:
    """Label pain rises as with or without strain."""
    return amps.withColumn("group", F.when(F.col("strain_amp") == 0, "without").otherwise("with"))


def pool_regions(scores: DataFrame, days: DataFrame, keys: Sequence[str], region: str, skip_days_of: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Scores of all regions together and their summed cycle days."""
    pooled = days.where(~F.col(region).isin(list(skip_days_of))) if skip_days_of else days
    totals = pooled.groupBy(*keys).agg(F.sum("asc_days").alias("asc_days"), F.sum("desc_days").alias("desc_days"))
    return scores.drop(region), totals


# --- segments and zoom windows --------------------------------------------------------

def segment_masks(series: DataFrame, pain_extrema: DataFrame, keys: Sequence[str], pain: str = "pain") -> DataFrame:
    """Pain on ascending and on descending days; the turning days are in both."""
    keys = list(keys)
    marks = pain_extrema.select(*keys, "pos", F.col("kind").alias("_kind"))
    o = Window.partitionBy(*keys).orderBy("pos")
    out = series.join(marks, keys + ["pos"], "left")
    last = F.last("_kind", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last("_kind", ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    )
    out = out.withColumns({"_l": last, "_a": ahead})
    inside = F.col("_l").isNotNull() & F.col("_a").isNotNull()
    turn = F.col("_kind").isNotNull()
    return out.withColumns(
        {
            "pain_ascending": F.when(inside & (turn | (F.col("_l") == "min")), F.col(pain)),
            "pain_descending": F.when(inside & (turn | (F.col("_l") == "max")), F.col(pain)),
        }
    ).drop("_kind", "_l", "_a")


def _cut(series: DataFrame, windows: DataFrame, keys: Sequence[str], lo: Column, hi: Column, cols: Sequence[str]) -> DataFrame:
    """Rows of the series inside every window, columns rescaled per window."""
    keys = list(keys)
    spread = windows.withColumn("pos", F.explode(F.sequence(lo, hi)))
    rows = spread.join(series, keys + ["pos"])
    w = whole([*keys, "window_pos"])
    return rows.withColumns({c: minmax(c, w) for c in cols})


def zoom_windows(series: DataFrame, scored: DataFrame, keys: Sequence[str], left: int = 14, right: int = 14) -> DataFrame:
    """Days around the segments of strain peaks on the rise, rescaled locally.

    Peaks with a score from 0 up or below -0.8 count.  Margins are clipped to
    the series.
    """
    chosen = scored.where((F.col("score") >= 0) | (F.col("score") < -0.8)).select(
        *keys, F.col("pos").alias("window_pos"), "score", "seg_from", "seg_to"
    )
    lo = F.greatest(F.col("seg_from") - left, F.lit(0))
    return _cut(series, chosen, keys, lo, F.col("seg_to") + right, ["strain", "pain", "strain_raw", "pain_raw"])


def descending_rises(series: DataFrame, pain_extrema: DataFrame, scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest daily pain increase inside descents, with and without a strain peak."""
    keys = list(keys)
    o = Window.partitionBy(*keys).orderBy("pos")
    descents = pain_extrema.select(
        *keys,
        F.col("pos").alias("seg_from"),
        "kind",
        F.lead("pos").over(o).alias("seg_to"),
    ).where((F.col("kind") == "max") & F.col("seg_to").isNotNull())
    peaks = scored.select(*keys, "pos")
    touched = points_in_ranges(peaks, descents.select(*keys, "seg_from", "seg_to"), keys, "seg_from", "seg_to")
    free = descents.join(touched.select(*keys, "seg_from").distinct(), keys + ["seg_from"], "left_anti")
    free = free.select(*keys, F.col("seg_from").alias("window_pos"), "seg_from", "seg_to", F.lit("without").alias("group"))
    held = scored.where(F.col("score").between(-0.8, -0.2)).select(
        *keys, F.col("pos").alias("window_pos"), "seg_from", "seg_to", F.lit("with").alias("group")
    )
    both = free.unionByName(held)
    spread = both.withColumn("pos", F.explode(F.sequence("seg_from", "seg_to")))
    rows = spread.join(series.select(*keys, "pos", "pain"), keys + ["pos"])
    inside = [*keys, "group", "window_pos"]
    rows = rows.withColumn("pain", minmax("pain", whole(inside)))
    step = F.col("pain") - F.lag("pain").over(Window.partitionBy(*inside).orderBy("pos"))
    return rows.withColumn("_step", step).groupBy(*inside).agg(F.max("_step").alias("max_rise"))


def buildup_metrics(
    zoom: DataFrame,
    pain_extrema: DataFrame,
    keys: Sequence[str],
    max_gap: int = 2,
    back: int = 5,
    ahead: int = 2,
) -> DataFrame:
    """When high pain began in each zoom window, and the strain that led to it.

    The high-pain level is the median of the four days up to the first pain
    maximum of the window.  High pain reaches back over single low days.
    """
    keys = list(keys)
    group = [*keys, "window_pos"]
    tops = pain_extrema.where(F.col("kind") == "max").select(*keys, "pos", F.lit(True).alias("_top"))
    rows = zoom.join(tops, keys + ["pos"], "left")
    w = whole(group)
    rows = rows.withColumns({"_first": F.min("pos").over(w), "_len": F.count(F.lit(1)).over(w)})
    rows = rows.withColumn("i", F.col("pos") - F.col("_first"))
    rows = rows.withColumn("_max", F.min(F.when(F.col("_top"), F.col("i"))).over(w))
    top_end = F.when(F.col("_max") + 1 < F.col("_len"), F.col("_max")).otherwise(F.col("_max") - 1)
    near_top = (F.col("i") >= F.col("_max") - 3) & (F.col("i") <= top_end)
    rows = rows.withColumn("_level", F.percentile(F.when(near_top, F.col("pain_raw")), F.lit(0.5)).over(w))
    # high days and the maximum itself, walked backwards; a longer gap ends the walk
    high = (F.col("i") >= 1) & (F.col("i") <= F.col("_max")) & (F.col("pain_raw") >= F.col("_level"))
    stop = (F.col("i") == F.col("_max")) | high
    walk = Window.partitionBy(*group).orderBy(F.desc("i"))
    rows = rows.withColumn("_stop", F.when(stop, F.col("i")))
    last = F.last("_stop", ignorenulls=True).over(walk.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_break", F.when(stop & ((last - F.col("i")) > max_gap), 1).otherwise(0))
    broken = F.sum("_break").over(walk.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_ok", F.coalesce(stop & (broken == 0), F.lit(False)))
    rows = rows.withColumn("start", F.min(F.when(F.col("_ok"), F.col("i"))).over(w))
    upper = F.when(F.col("start") + ahead < F.col("_len"), F.col("start") + ahead).otherwise(F.col("start"))
    trigger = (F.col("i") >= F.col("start") - back) & (F.col("i") < upper)
    out = rows.groupBy(*group, "score").agg(
        F.max("start").alias("start"),
        F.max("_level").alias("level"),
        F.max(F.when(trigger, F.col("strain_raw"))).alias("trigger"),
        F.max(F.when(F.col("pos") == F.col("window_pos"), F.col("i"))).alias("strain_i"),
    )
    return out.withColumn("delay", F.col("start") - F.col("strain_i")).drop("strain_i")


def plausible_buildups(metrics: DataFrame) -> DataFrame:
    """Without windows whose trigger is missing or timing impossible."""
    return metrics.where(
        F.col("trigger").isNotNull()
        & (F.col("score") >= 0)
        & (F.col("delay") >= -5)
        & (F.col("delay") < 28)
        & (F.col("start") > 1)
    )


# --- summaries ------------------------------------------------------------------------

def score_histogram(scores: DataFrame, days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed and expected counts in 10 equal bins over [-1, 1]."""
    keys = list(keys)
    known = scores.where(F.col("score").isNotNull())
    bin_no = F.least(F.floor((F.col("score") + 1) * 5), F.lit(9)).cast("int")
    observed = known.groupBy(*keys, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("observed"))
    totals = observed.groupBy(*keys).agg(F.sum("observed").alias("_n"))
    grid = days.join(totals, keys).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9))))
    share = F.when(F.col("bin") < 5, F.col("desc_days")).otherwise(F.col("asc_days"))
    expected = F.col("_n") * F.try_divide(share, F.col("asc_days") + F.col("desc_days")) / 5
    out = grid.join(observed, keys + ["bin"], "left")
    return out.select(*keys, "bin", F.coalesce("observed", F.lit(0)).alias("observed"), expected.alias("expected"))


def reload_scores(scores: DataFrame) -> DataFrame:
    """Stored scores: NULL dropped, values outside [-1, 1] set to 1."""
    ok = F.col("score").between(-1, 1)
    return scores.where(F.col("score").isNotNull()).withColumn("score", F.when(ok, F.col("score")).otherwise(F.lit(1.0)))


def consistency_summary(tests: DataFrame, keys: Sequence[str], ratio: str = "ratio", p: str = "p_value") -> DataFrame:
    """Share of parameter sets with ratio above 1, and of those above / below 1
    the share that is significant."""
    sig = (F.col(p) <= 0.05).cast("int")
    return tests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sets"),
        F.avg(F.coalesce(F.col(ratio) > 1, F.lit(False)).cast("int")).alias("above"),
        F.avg(F.when(F.col(ratio) >= 1, sig)).alias("significant_above"),
        F.avg(F.when(F.col(ratio) < 1, sig)).alias("significant_below"),
    )


# --- shifts ----------------------------------------------------------------------------

def best_shift(df: DataFrame, keys: Sequence[str], strain: str, pain: str, shifts: int = 120, high: float = 0.8, day: str = "day") -> DataFrame:
    """Mean uncovered pain on high-pain days for each strain shift, and the best one.

    The strain values of the last ``shifts`` days are gathered by one window
    and unfolded into a partial aggregation; nothing is joined.
    """
    keys = list(keys)
    o = ordered(keys, day)
    df = spread(df.select(*keys, day, strain, pain), *keys).withColumn("_pos", F.row_number().over(o))
    gathered = F.collect_list(F.struct("_pos", F.col(strain).alias("_s"))).over(o.rowsBetween(-(shifts - 1), 0))
    hot = df.select(*keys, "_pos", F.col(pain).alias("_p"), gathered.alias("_near")).where(F.col("_p") >= high)
    pairs = hot.select(*keys, "_p", "_pos", F.explode("_near").alias("_n"))
    gap = F.when(F.col("_n._s").isNotNull(), F.greatest(F.col("_p") - F.col("_n._s"), F.lit(0.0)))
    curve = pairs.groupBy(*keys, (F.col("_pos") - F.col("_n._pos")).alias("shift")).agg(F.avg(gap).alias("uncovered"))
    rank = F.when(F.col("uncovered").isNotNull(), F.struct("uncovered", "shift"))
    return curve.withColumn("best_shift", F.min_by("shift", rank).over(whole(keys)))


def additive_model(df: DataFrame, keys: Sequence[str], environment: Mapping[str, float], symptom: str, n: int = 7, lags: int = 15, low: float = 0.1, day: str = "day") -> DataFrame:
    """Circular cross-correlation of a symptom with weighted environment terms.

    Rows times lags only exist between a window and the partial sums behind it; they are never shuffled.
    """
    keys = list(keys)
    w, o = whole(keys), ordered(keys, day)

    def lifted(c: str) -> Column:
        x = F.col(c)
        lo, hi = F.min(x).over(w), F.max(x).over(w)
        scaled = F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(x)
        return (scaled + F.lit(low)) / F.lit(1.0 + low)

    df = df.select(*keys, day, *[lifted(c).alias(c) for c in environment], lifted(symptom).alias("_x"))
    df = df.withColumn("_y", weighted_strain(environment))
    df = df.withColumns({c: F.coalesce(ro.trailing_mean(c, keys, n, day), F.col(c)) for c in ("_x", "_y")})
    df = df.select(
        *keys,
        (F.row_number().over(o) - 1).alias("pos"),
        F.count(F.lit(1)).over(w).alias("_n"),
        minmax("_x", w).alias("x"),
        minmax("_y", w).alias("y"),
    )
    # the values of the lags before a day come with it, those before the first day from the end of the series
    n, pos = F.col("_n"), F.col("pos")
    behind = F.collect_list(F.struct("y")).over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(-(lags - 1), 0))
    end = F.greatest(n - lags + 1, F.lit(0))
    ends = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(pos >= end, F.struct("pos", "y")))).alias("_ends"))
    near = attach(df.select(*keys, "pos", "x", "_n", behind.alias("_behind")), keys, ends)
    unfolded = near.select(*keys, "pos", "x", "_n", "_behind", "_ends", F.explode(F.sequence(F.lit(0), F.lit(lags - 1))).alias("lag"))
    back = F.get("_behind", (F.size("_behind") - 1 - F.col("lag")).cast("int"))["y"]
    round_the_end = F.get("_ends", (F.pmod(pos - F.col("lag"), n) - end).cast("int"))["y"]
    pairs = unfolded.select(*keys, "lag", "x", F.when(F.col("lag") <= pos, back).otherwise(round_the_end).alias("y"))
    curve = pairs.groupBy(*keys, "lag").agg(F.sum(F.col("x") * F.col("y")).alias("cross"), F.corr("x", "y").alias("r"))
    return curve.groupBy(*keys).agg(
        F.max_by("lag", F.struct(F.col("cross"), -F.col("lag"))).alias("shift"),
        F.max("cross").alias("cross"),
        F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("r_before"),
        F.max_by("r", F.struct(F.col("cross"), -F.col("lag"))).alias("r_after"),
    )
