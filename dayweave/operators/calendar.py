"""Calendar spine, alignment, merging and set operations on daily tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.operators.ordered import attach

# --- spine -------------------------------------------------------------

def calendar_spine(
    entities: DataFrame,
    keys: Sequence[str],
    start,
    end=None,
    periods: int | None = None,
    defaults: Mapping[str, float | None] | None = None,
    day: str = "day",
) -> DataFrame:
    """One row per entity and day, with columns set to their defaults.

    ``start``/``end`` are dates or columns of ``entities``; ``periods`` may
    replace ``end``.
    """
    lo = start if isinstance(start, Column) else F.lit(start).cast("date")
    if end is None:
        hi = F.date_add(lo, int(periods) - 1)
    else:
        hi = end if isinstance(end, Column) else F.lit(end).cast("date")
    spine = entities.select(*keys, F.explode(F.sequence(lo, hi, F.expr("interval 1 day"))).alias(day))
    for name, value in (defaults or {}).items():
        spine = spine.withColumn(name, F.lit(value).cast("double"))
    return spine


def fill_calendar(
    df: DataFrame,
    keys: Sequence[str],
    day: str = "day",
    defaults: Mapping[str, float | None] | None = None,
    shared_range: bool = True,
) -> DataFrame:
    """Add the missing days of every entity and fill columns with defaults.

    With ``shared_range`` all entities get the overall first..last day,
    otherwise each its own.
    """
    keys = list(keys)
    fills = {c: v for c, v in (defaults or {}).items() if v is not None}
    if shared_range:
        span = df.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
        who = attach(df.select(*keys).distinct(), [], span)
        spine = calendar_spine(who, keys, F.col("_lo"), F.col("_hi"), day=day)
        out = spine.join(df, keys + [day], "left")
    else:
        # every row with the days up to the next one: what made the rows is worked out once
        upto = F.date_sub(F.lead(day).over(Window.partitionBy(*keys).orderBy(day)), 1)
        rows = df.withColumn("_upto", F.greatest(upto, F.col(day)))
        rows = rows.withColumn("_day", F.explode(F.sequence(F.col(day), F.col("_upto"), F.expr("interval 1 day"))))
        here = reduce(and_, [F.col(k).isNotNull() for k in keys], F.col("_day") == F.col(day))
        kept = [c for c in df.columns if c not in (*keys, day)]
        out = rows.select(*keys, F.col("_day").alias(day), *[F.when(here, F.col(c)).alias(c) for c in kept])
    return out.fillna(fills) if fills else out


def complete_days(df: DataFrame, keys: Sequence[str], day: str = "day", per_entity: bool = True) -> DataFrame:
    """Drop the last, still incomplete, day."""
    keys = list(keys) if per_entity else []
    last = df.groupBy(*keys).agg(F.max(day).alias("_last"))
    return attach(df, keys, last).where(F.col(day) < F.col("_last")).drop("_last")


# --- merging ----------------------------------------------------------------

def update_from(data: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """Non-null values of ``new`` override; only existing rows and columns."""
    on = list(on)
    shared = [c for c in new.columns if c in data.columns and c not in on]
    side = new.select(*on, *[F.col(c).alias(f"_n_{c}") for c in shared])
    out = data.join(side, on, "left")
    return out.select(
        *on,
        *[
            F.coalesce(f"_n_{c}", c).alias(c) if c in shared else F.col(c)
            for c in data.columns
            if c not in on
        ],
    )


def combine_first(old: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """Old non-null values stay; gaps, rows and columns come from ``new``."""
    on = list(on)
    old_cols = [c for c in old.columns if c not in on]
    new_cols = [c for c in new.columns if c not in on]
    side = new.select(*on, *[F.col(c).alias(f"_n_{c}") for c in new_cols])
    out = old.join(side, on, "full_outer")
    cols = []
    for c in old_cols + [c for c in new_cols if c not in old_cols]:
        if c in old_cols and c in new_cols:
            cols.append(F.coalesce(c, f"_n_{c}").alias(c))
        else:
            cols.append(F.col(c) if c in old_cols else F.col(f"_n_{c}").alias(c))
    return out.select(*on, *cols)


def assign_last(df: DataFrame, on: Sequence[str], cols: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Last write wins: per key the value with the highest sequence."""
    position = F.struct(*seq)
    return df.groupBy(*on).agg(*[F.max_by(c, position).alias(c) for c in cols])


def accumulate(data: DataFrame, new: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Add the summed new values to the existing rows."""
    on = list(on)
    sums = new.groupBy(*on).agg(*[F.sum(c).alias(f"_n_{c}") for c in cols])
    out = data.join(sums, on, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(c, F.lit(0.0)) + F.coalesce(f"_n_{c}", F.lit(0.0)))
    return out.drop(*[f"_n_{c}" for c in cols])


def resample_daily(df: DataFrame, keys: Sequence[str], ts: str, how: Mapping[str, str]) -> DataFrame:
    """Daily sum (empty days 0) or mean (empty days NULL) per entity."""
    fns = {"sum": F.sum, "mean": F.avg}
    daily = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(
        *[fns[fn](c).alias(c) for c, fn in how.items()]
    )
    zeros = {c: 0.0 for c, fn in how.items() if fn == "sum"}
    return fill_calendar(daily, keys, "day", zeros, shared_range=False)


def join_daily(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of daily tables; the left days are kept."""
    return left.join(right, list(on), "left")


def merge_metrics(metrics: Mapping[str, DataFrame], on: Sequence[str], value: str = "value") -> DataFrame:
    """Outer merge of same-shaped metric tables into one column per metric.

    Long form plus one pivot: a single shuffle instead of a chain of outer joins.
    """
    long = None
    for name, df in metrics.items():
        part = df.select(*on, F.lit(name).alias("_metric"), F.col(value).alias("_v"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy(*on).pivot("_metric", list(metrics)).agg(F.first("_v", ignorenulls=True))


def concat_rows(*frames: DataFrame) -> DataFrame:
    """Row union; columns missing in a frame become NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def concat_columns(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Column concat with the outer union of the day index."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.join(frame, list(on), "full_outer")
    return out


# --- filters and shape ---------------------------------------------------------

def subset_period(df: DataFrame, start, end, day: str = "day") -> DataFrame:
    """Closed date interval; empty when start is after end."""
    return df.where(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def tidy_columns(df: DataFrame, columns: Sequence[str] | None = None, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Select, rename, lower-case and strip spaces from column names."""
    out = df.select(*columns) if columns else df
    out = out.withColumnsRenamed(dict(renames or {}))
    return out.toDF(*[c.lower().replace(" ", "") for c in out.columns])


def keep_members(df: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(members, list(on), "left_semi")


def drop_members(df: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(members, list(on), "left_anti")


def pivot_first(df: DataFrame, on: Sequence[str], name: str, value: str, names: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Long to wide with the first value in ``seq`` order."""
    return df.groupBy(*on).pivot(name, list(names)).agg(F.min_by(value, F.struct(*seq)))


def pivot_day_numbers(df: DataFrame, keys: Sequence[str], event: str, number: str, cols: Sequence[str], days: int = 2) -> DataFrame:
    """Rows of an event to ``<col>_0, <col>_1, ...`` by their day number (1-based)."""
    aggs = [
        F.max(F.when(F.col(number) == d + 1, F.col(c))).alias(f"{c}_{d}")
        for c in cols
        for d in range(days)
    ]
    return df.groupBy(*keys, event).agg(*aggs)


def manual_fill(data: DataFrame, filled: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``<c>_manualFill``: tracked value if present, else the hand-filled one."""
    side = filled.select(*on, *[F.col(c).alias(f"_f_{c}") for c in cols])
    out = data.join(side, list(on), "left")
    for c in cols:
        out = out.withColumn(f"{c}_manualFill", F.coalesce(c, f"_f_{c}"))
    return out.drop(*[f"_f_{c}" for c in cols])


def latest_per_day(df: DataFrame, on: Sequence[str], row_id: str) -> DataFrame:
    """Keep the row with the highest id per key (aggregation, no sort)."""
    on = list(on)
    rest = [c for c in df.columns if c not in on]
    best = df.groupBy(*on).agg(F.max_by(F.struct(*rest), F.col(row_id)).alias("_row"))
    return best.select(*on, "_row.*")


def keep_max(df: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Of rows with equal time keep the larger value."""
    return df.groupBy(*on).agg(F.max(value).alias(value))


def missing_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, missing, zero) in long form, counted in one pass."""
    aggs = []
    for c in cols:
        missing, zero = F.count(F.when(F.col(c).isNull(), 1)), F.count(F.when(F.col(c) == 0, 1))
        aggs.append(F.struct(F.lit(c).alias("column"), missing.alias("missing"), zero.alias("zero")))
    return df.agg(F.array(*aggs).alias("_all")).select(F.inline("_all"))


def columns_within(df: DataFrame, cols: Sequence[str], max_missing: int | None = None, max_zero: int | None = None) -> list[str]:
    """Names of the columns with few enough NULLs / zeros (one small row each)."""
    keep = F.lit(True)
    if max_missing is not None:
        keep = keep & (F.col("missing") <= max_missing)
    if max_zero is not None:
        keep = keep & (F.col("zero") <= max_zero)
    found = {r["column"] for r in missing_counts(df, cols).where(keep).collect()}
    return [c for c in cols if c in found]


def apply_patches(df: DataFrame, keys: Sequence[str], patches: Sequence[tuple], day: str = "day") -> DataFrame:
    """Date-range repairs given as ``(from, to, column, kind, value)``.

    ``set`` writes a constant, ``add`` adds one, ``copy_prev`` takes the
    previous day's original value.  The list is code-sized, so it becomes a
    ``CASE`` expression instead of a join; later patches win.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    previous = {c: F.lag(c).over(w) for _, _, c, kind, _ in patches if kind == "copy_prev"}
    out = df.select("*", *[col.alias(f"_prev_{c}") for c, col in previous.items()])
    for lo, hi, c, kind, value in patches:
        inside = F.col(day).between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
        new = {
            "set": F.lit(value),
            "add": F.col(c) + F.lit(value),
            "copy_prev": F.col(f"_prev_{c}") if c in previous else None,
        }[kind]
        out = out.withColumn(c, F.when(inside, new).otherwise(F.col(c)))
    return out.drop(*[f"_prev_{c}" for c in previous])


def split_period(df: DataFrame, cut, day: str = "day", name: str = "period") -> DataFrame:
    """Label rows ``before`` / ``from`` a cut date."""
    return df.withColumn(name, F.when(F.col(day) < F.lit(cut).cast("date"), "before").otherwise("from"))


def row_mean(cols: Sequence[str]) -> Column:
    """Mean of several columns of a row, NULLs skipped, NULL if all are."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    count = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return F.try_divide(total, count)


def weekly_mean(df: DataFrame, keys: Sequence[str], cols: Sequence[str], day: str = "day") -> DataFrame:
    """Mean per week, labelled by the Sunday that ends it."""
    week = F.date_add(F.date_trunc("week", F.col(day)).cast("date"), 6)
    return df.groupBy(*keys, week.alias("week_end")).agg(*[F.avg(c).alias(c) for c in cols])
