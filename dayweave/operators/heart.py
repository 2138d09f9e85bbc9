"""Heart-load operators on intraday samples."""

from __future__ import annotations

import itertools
import math
from bisect import bisect_left
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayweave.functions import vocab
from dayweave.functions.expressions import lookup
from dayweave.operators import calendar as cal
from dayweave.operators import intervals as iv
from dayweave.operators import ordered
from dayweave.operators.ordered import time_bucket
from dayweave.operators.rolling import forward_fill


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- active heart rate ----------------------------------------------------------

def active_rate(rate, threshold: float) -> Column:
    """Beats above a threshold, 0 below it."""
    return F.greatest(_c(rate) - F.lit(float(threshold)), F.lit(0.0))


def band_rate(rate, low: float, high: float | None = None) -> Column:
    """Beats above ``low``, counted up to ``high``."""
    active = active_rate(rate, low)
    return active if high is None else F.least(active, F.lit(float(high - low)))


def power_load(x, exponent: float) -> Column:
    return F.pow(_c(x), F.lit(float(exponent))) if exponent else _c(x)


def second_cutoff(x, threshold: float) -> Column:
    """Minus the threshold, then 0 where the rest is still below it."""
    rest = _c(x) - F.lit(float(threshold))
    return F.when(rest < threshold, F.lit(0.0)).otherwise(rest)


# --- activity shares --------------------------------------------------------------

def activity_shares(activities: DataFrame, label: str, classes: Mapping[str, str], feed: int) -> DataFrame:
    """Low / high body share and overwrite order of every activity interval.

    Later wins: second feed after the first, then label order, then row.
    """
    kind = lookup(label, classes)
    low = lookup(kind, {k: v[0] for k, v in vocab.HEART_SHARES.items()})
    high = lookup(kind, {k: v[1] for k, v in vocab.HEART_SHARES.items()})
    return activities.withColumns({"low_share": low, "high_share": high, "feed": F.lit(feed)})


def body_load(samples: DataFrame, activities: DataFrame, keys: Sequence[str], sample_id: str, active: str, label: str, row: str, bucket_seconds: int = 1800) -> DataFrame:
    """``low_body`` and ``high_body`` load of every sample.

    Inside an activity the load is split by its shares; outside, all of it is
    low body.
    """
    painted = iv.paint_samples(
        samples, activities, keys, sample_id, ["low_share", "high_share"], ["feed", label, row], bucket_seconds
    )
    return painted.withColumns(
        {
            "low_body": F.col(active) * F.coalesce("low_share", F.lit(1.0)),
            "high_body": F.col(active) * F.coalesce("high_share", F.lit(0.0)),
        }
    ).drop("low_share", "high_share")


# --- overflow -------------------------------------------------------------------

def _carry(values: np.ndarray, factor: float, exponent: float) -> np.ndarray:
    out = values.astype(float).tolist()
    for i in range(1, len(out)):
        spill = factor * out[i - 1]
        if spill > 1.0:
            out[i] += spill
        if exponent:
            out[i] **= exponent
    return np.array(out)


def _step(value: float, share: float, factor: float) -> float:
    """The share that a sample hands on, from its load and the share handed to it; a missing load hands on nothing."""
    load = value + share if share > 1.0 else value
    return factor * load if load == load else 0.0


class SpillMap:
    """What a stretch of samples hands on as a function of what it is handed.

    The function never falls and is linear in pieces.  A share of at most
    ``limits[k]`` (and above the limits before) is lost somewhere in the stretch, and
    ``ends[k]`` leaves it whatever the share was; a larger one lasts through and
    ``base + slope * share`` leaves.  There are few pieces, as a share shrinks by
    the factor with every sample.
    """

    def __init__(self, values: Sequence[float], factor: float):
        limits, starts = [], []
        base, slope = 0.0, 1.0
        for i, v in enumerate(values):
            lost = -math.inf if base > 1.0 else (1.0 - base) / slope if slope > 0.0 else math.inf
            if not limits or lost > limits[-1]:
                limits.append(lost)
                starts.append(i)
            if lost == math.inf:
                break
            if v != v:
                limits.append(math.inf)
                starts.append(i + 1)
                break
            base, slope = factor * (v + base), slope * factor
        self.limits, self.base, self.slope = limits, base, slope
        alone = [0.0]
        for v in values:
            alone.append(_step(v, alone[-1], factor))
        self.ends = [self._end(values, factor, start, alone) for start in starts]

    @staticmethod
    def _end(values: Sequence[float], factor: float, start: int, alone: list[float]) -> float:
        """What leaves if nothing is handed to the sample at ``start``; met by the run from the first sample, it follows that one."""
        share = 0.0
        for i in range(start, len(values)):
            if share <= 1.0 and alone[i] <= 1.0:
                return alone[-1]
            share = _step(values[i], share, factor)
        return share

    def packed(self) -> list[float]:
        """The map as one list of numbers."""
        return [self.base, self.slope, *self.limits, *self.ends]

    @staticmethod
    def unpacked(numbers: list[float]) -> tuple[list[float], list[float], float, float]:
        """``limits, ends, base, slope`` of a packed map."""
        middle = len(numbers) // 2 + 1
        return numbers[2:middle], numbers[middle:], numbers[0], numbers[1]

    @staticmethod
    def apply(limits: Sequence[float], ends: Sequence[float], base: float, slope: float, share: float) -> float:
        k = bisect_left(limits, share)
        return ends[k] if k < len(limits) else base + slope * share


def _fresh(pdf: pd.DataFrame, names: Sequence[str], last: tuple | None) -> tuple[list[bool], tuple | None]:
    """Which rows of a sorted stream begin a group, given the last group of the frame before."""
    if not len(pdf):
        return [], last
    starts = (pdf[names] != pdf[names].shift()).any(axis=1).to_numpy()
    starts[0] = tuple(pdf[names].iloc[0]) != last
    return starts.tolist(), tuple(pdf[names].iloc[-1])


def overflow_carry(
    df: DataFrame,
    keys: Sequence[str],
    col: str | Mapping[str, float],
    factor: float | None = None,
    order: Sequence[str] = ("ts", "sample_id"),
    bucket_seconds: int = 86_400,
) -> DataFrame:
    """``<col>_carried``: a sample takes over ``factor`` of its predecessor while
    that share exceeds 1.

    ``col`` is one column or a mapping of columns to their factors, which share
    one shuffle.  Every time bucket of a series becomes a small map from the share
    it is handed to the share it hands on; the maps, a row per bucket, are applied
    one after the other per key, as a stream over all keys of a task; then all
    buckets run side by side.  So one dense
    series is spread over its buckets.  A missing load stays missing and hands on
    nothing.  A share that lasts through a whole bucket may differ from a row by row sum
    in the last digits.
    """
    factors = dict(col) if isinstance(col, Mapping) else {col: factor}
    if not all(f is not None and 0.0 < f < 1.0 for f in factors.values()):
        raise ValueError("factor must lie between 0 and 1")
    keys, order, cols = list(keys), list(order), list(factors)
    piece = [*keys, ordered.BUCKET]
    # filtered here as the join below would do it, so that maps and carry read one shuffle
    rows = df.withColumn(ordered.BUCKET, time_bucket(order[0], bucket_seconds)).where(" AND ".join(f"`{c}` IS NOT NULL" for c in piece))
    placed = ordered.spread(rows, *piece)
    key_fields = [df.schema[k] for k in keys]
    bucket_field = T.StructField(ordered.BUCKET, T.LongType())
    map_schema = T.StructType([*key_fields, bucket_field, *[T.StructField(f"_map_{i}", T.ArrayType(T.DoubleType())) for i in range(len(cols))]])
    entry_schema = T.StructType([*key_fields, bucket_field, *[T.StructField(f"_entry_{i}", T.DoubleType()) for i in range(len(cols))]])
    out_schema = T.StructType([*df.schema.fields, *[T.StructField(f"{c}_carried", T.DoubleType()) for c in cols]])
    names = list(df.columns)

    def maps_of(groups: list[tuple], series: list[list[list[float]]]) -> pd.DataFrame:
        out = pd.DataFrame(groups, columns=piece)
        for i, (f, stretches) in enumerate(zip(factors.values(), series, strict=True)):
            out[f"_map_{i}"] = [SpillMap(values, f).packed() for values in stretches]
        return out

    def summarise(frames):
        # the stretch a frame ends in is held until the next one begins
        last, held = None, [[] for _ in cols]
        for pdf in frames:
            ended = last
            starts, last = _fresh(pdf, piece, last)
            at = [i for i, fresh in enumerate(starts) if fresh]
            values = [pdf[c].astype(float).tolist() for c in cols]
            if not at:
                held = [have + more for have, more in zip(held, values, strict=True)]
                continue
            groups = list(pdf[piece].iloc[at[:-1]].itertuples(index=False, name=None))
            series = [[v[i:j] for i, j in itertools.pairwise(at)] for v in values]
            if ended is not None:
                groups.insert(0, ended)
                for stretches, have, v in zip(series, held, values, strict=True):
                    stretches.insert(0, have + v[: at[0]])
            held = [v[at[-1] :] for v in values]
            if groups:
                yield maps_of(groups, series)
        if last is not None:
            yield maps_of([last], [[have] for have in held])

    def enter(frames):
        last, shares = None, [0.0] * len(cols)
        for pdf in frames:
            starts, last = _fresh(pdf, keys, last) if keys else ([False] * len(pdf), None)
            out = pdf[piece].copy()
            for i in range(len(cols)):
                share, entries = shares[i], []
                for fresh, packed in zip(starts, pdf[f"_map_{i}"], strict=True):
                    share = 0.0 if fresh else share
                    entries.append(share)
                    share = SpillMap.apply(*SpillMap.unpacked(packed.tolist()), share)
                out[f"_entry_{i}"], shares[i] = entries, share
            yield out

    def carry(frames):
        last, shares = None, [0.0] * len(cols)
        for pdf in frames:
            starts, last = _fresh(pdf, piece, last)
            out = pdf[names].copy()
            for i, (c, f) in enumerate(factors.items()):
                share, carried = shares[i], []
                for fresh, entry, v in zip(starts, pdf[f"_entry_{i}"].tolist(), pdf[c].astype(float).tolist(), strict=True):
                    share = entry if fresh else share
                    carried.append(v + share if share > 1.0 else v)
                    share = _step(v, share, f)
                out[f"{c}_carried"], shares[i] = carried, share
            yield out

    maps = placed.sortWithinPartitions(*piece, *order).mapInPandas(summarise, map_schema)
    maps = ordered.spread(maps, *keys) if keys else maps.repartition(1)
    entries = maps.sortWithinPartitions(*piece).mapInPandas(enter, entry_schema)
    # a broadcast of either side would leave a dense key in the one task of its entries
    entered = placed.join(entries.hint("merge"), piece).sortWithinPartitions(*piece, *order)
    return entered.mapInPandas(carry, out_schema)


def overflow_carry_with_power(df: DataFrame, keys: Sequence[str], col: str, factor: float, exponent: float, order: Sequence[str] = ("ts", "sample_id")) -> DataFrame:
    """Overflow followed by a power at every step.

    The power makes reset points unknowable in advance, so the unit of work is
    one key; use it per entity-day (``keys`` including the day).
    """
    out_col = f"{col}_carried"
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, T.DoubleType())])

    def series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order))
        return pdf.assign(**{out_col: _carry(pdf[col].to_numpy(), factor, exponent)})

    return df.groupBy(*keys).applyInPandas(series, schema)


# --- daily -----------------------------------------------------------------------

def daily_loads(df: DataFrame, keys: Sequence[str], cols: Sequence[str], master: DataFrame | None = None) -> DataFrame:
    """Daily sums, optionally joined to a master daily table."""
    sums = cal.resample_daily(df, keys, "ts", {c: "sum" for c in cols})
    return cal.join_daily(master, sums, [*keys, "day"]) if master is not None else sums


# The option sets for turning heart rate into load.
LOAD_OPTIONS = [
    {"option": "zone2", "threshold": 110.0, "threshold2": 0.0, "exponent": 0.0, "factor": 0.0},
    {"option": "overflow_cutoff", "threshold": 70.0, "threshold2": 50.0, "exponent": 0.0, "factor": 0.5},
    {"option": "power2_overflow", "threshold": 70.0, "threshold2": 0.0, "exponent": 2.0, "factor": 0.5},
]


def load_options(samples: DataFrame, keys: Sequence[str], rate: str, options: Sequence[Mapping] = LOAD_OPTIONS, shares: Sequence[str] = ("low_share", "high_share")) -> DataFrame:
    """Daily load per option: ``active``, and ``low_body`` and ``high_body`` after overflow and second cut-off.

    All options and both halves of the body are columns of one plan: samples are
    shuffled once for all overflows, and each day is summed once.  Outside
    activities (shares missing) all load is low body.
    """
    low, high = (F.coalesce(F.col(c), F.lit(other)) for c, other in zip(shares, (1.0, 0.0), strict=True))
    x, factors = samples, {}
    for i, o in enumerate(options):
        active = active_rate(rate, o["threshold"])
        x = x.withColumns({f"{part}_{i}": power_load(active * share, o["exponent"]) for part, share in (("active", F.lit(1.0)), ("low_body", low), ("high_body", high))})
        if o["factor"]:
            factors |= {f"low_body_{i}": o["factor"], f"high_body_{i}": o["factor"]}
    names = [f"{part}_{i}" for i in range(len(options)) for part in ("active", "low_body", "high_body")]
    x = x.select(*keys, "ts", "sample_id", *names)
    x = overflow_carry(x, keys, factors) if factors else x
    x = x.withColumns({c: F.col(f"{c}_carried") for c in factors}).drop(*[f"{c}_carried" for c in factors])
    x = x.withColumns({f"{part}_{i}": second_cutoff(f"{part}_{i}", o["threshold2"]) for i, o in enumerate(options) if o["threshold2"] for part in ("low_body", "high_body")})
    days = daily_loads(x, keys, names)
    rows = F.array(*[F.struct(F.lit(o["option"]).alias("option"), *[F.col(f"{part}_{i}").alias(part) for part in ("active", "low_body", "high_body")]) for i, o in enumerate(options)])
    return days.select(*keys, "day", F.inline(rows))


def extended_export(master: DataFrame, sleep: DataFrame, summary: DataFrame, keys: Sequence[str], zero_cols: Sequence[str], fill_cols: Sequence[str], renames: Mapping[str, str]) -> DataFrame:
    """Daily export: sleep score and resting rate joined, gaps filled, renamed."""
    on = [*keys, "day"]
    out = cal.join_daily(cal.join_daily(master, sleep, on), summary, on).fillna(0.0, subset=list(zero_cols))
    out = out.withColumns({c: forward_fill(c, keys) for c in fill_cols})
    return out.withColumnsRenamed(dict(renames))
