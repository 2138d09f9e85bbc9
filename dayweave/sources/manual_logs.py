"""Hand-kept logs: dates written once, text labels, blank cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayweave.functions.expressions import date_from_parts, numeric_or_zero
from dayweave.operators import ordered
from dayweave.sources.files import LINE_ORDER


def carry_dates(cells: DataFrame, order: Sequence[str] = LINE_ORDER, keys: Sequence[str] = ("_file",), lines_per_bucket: int = 1_000_000) -> DataFrame:
    """``day`` from year, month and day cells that are written only on change.

    Each part carries down the file on its own, in line order and in two
    levels, so one huge log is still split over tasks.
    """
    keys = [k for k in keys]
    inside = [c for c in order if c not in keys]
    parts = ("year", "month", "day_of_month")
    known = cells.withColumns({f"_{p}": F.when(F.trim(F.coalesce(p, F.lit(""))) != "", F.trim(p)) for p in parts})
    bucket = F.floor(F.col(inside[-1]) / lines_per_bucket).cast("long")
    if len(inside) > 1:
        # blocks of a file come first: their start offset orders the buckets
        bucket = F.col(inside[0]).cast("long")
    filled = ordered.scan(known, list(keys), inside, bucket, lasts={f"_c{p}": f"_{p}" for p in parts})
    out = filled.withColumn("day", date_from_parts("_cyear", "_cmonth", "_cday_of_month"))
    return out.drop(*[f"_{p}" for p in parts], *[f"_c{p}" for p in parts])


def pain_columns(rows: DataFrame, label: str, value: str, columns: Mapping[str, str], other: str, order: Sequence[str] = LINE_ORDER, keys: Sequence[str] = ()) -> DataFrame:
    """One column per region; unknown labels go to ``other``; last write wins."""
    from dayweave.functions.expressions import lookup

    target = lookup(label, columns, other)
    names = list(dict.fromkeys([*columns.values(), other]))
    number = F.col(value).try_cast("double")
    rows = rows.where(F.col("day").isNotNull()).withColumns({"_t": target, "_v": number})
    return rows.groupBy(*keys, "day").agg(*[F.max_by("_v", F.when(F.col("_t") == n, F.struct(*order))).alias(n) for n in names])


def sport_flags(rows: DataFrame, label: str, flags: Mapping[str, str], details: Mapping[str, tuple[str, str]] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """0/1 column per activity, and numeric details with bad cells as 0.

    ``details`` maps a new column to (activity, cell).
    """
    aggs = [F.max(F.when(F.col(label) == a, 1.0).otherwise(0.0)).alias(n) for a, n in flags.items()]
    for name, (activity, cell) in (details or {}).items():
        value = F.when(F.col(label) == activity, numeric_or_zero(cell))
        aggs.append(F.coalesce(F.sum(value), F.lit(0.0)).alias(name))
    return rows.where(F.col("day").isNotNull()).groupBy(*keys, "day").agg(*aggs)


def eye_activities(rows: DataFrame, screen: Sequence[str], driving: str, scooter: Sequence[str], order: Sequence[str] = LINE_ORDER, keys: Sequence[str] = ()) -> DataFrame:
    """Screen total, driving and scooter minutes per day; blanks are 0."""

    def total(cells: Sequence[str]) -> Column:
        return sum((numeric_or_zero(c) for c in cells), F.lit(0.0))

    last = F.struct(*order)
    return rows.where(F.col("day").isNotNull()).groupBy(*keys, "day").agg(
        F.max_by(total(screen), last).alias("eye_total"),
        F.max_by(numeric_or_zero(driving), last).alias("driving"),
        F.max_by(total(scooter), last).alias("scooter"),
    )


def mood_days(rows: DataFrame, score: Column, order: Sequence[str] = LINE_ORDER, keys: Sequence[str] = ()) -> DataFrame:
    """(day, mood): the last known label of a day as a number."""
    rows = rows.withColumn("_s", score).where(F.col("day").isNotNull() & F.col("_s").isNotNull())
    return rows.groupBy(*keys, "day").agg(F.max_by("_s", F.struct(*order)).alias("mood"))


# --- typed log tables -----------------------------------------------------------------

def load_log_table(
    cells: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    numbers: Sequence[str],
    texts: Sequence[str] = (),
    start: tuple[str, str] | None = None,
    end: tuple[str, str] | None = None,
    day_shift: Mapping[str, int] | None = None,
) -> DataFrame:
    """Typed log rows: blanks to 0, unix times from text, first row per key kept.

    ``start`` / ``end`` are (cell, format); ``day_shift`` adds whole days.
    """
    shift = {name: days * 86400 for name, days in (day_shift or {}).items()}
    cols = {c: numeric_or_zero(c) for c in numbers}
    cols.update({c: F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit("0")) for c in texts})
    for name, spec in (("start_time", start), ("end_time", end)):
        if spec:
            stamp = F.unix_seconds(F.try_to_timestamp(F.col(spec[0]), F.lit(spec[1])))
            cols[name] = F.coalesce(stamp + F.lit(shift.get(name, 0)), F.lit(0))
    typed = cells.withColumns(cols)
    rest = [c for c in typed.columns if c not in key]
    first = typed.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*key, "_r.*")


def shift_by_id(df: DataFrame, row_id: str, ts: str, ranges: Sequence[tuple[int, int, float]]) -> DataFrame:
    """Move instants of id ranges (from, to, hours); the list is code-sized."""
    hours = None
    for lo, hi, h in ranges:
        cond = F.col(row_id).between(lo, hi)
        hours = F.when(cond, F.lit(float(h))) if hours is None else hours.when(cond, F.lit(float(h)))
    moved = F.unix_micros(ts) + (F.coalesce(hours, F.lit(0.0)) * 3_600_000_000).cast("long")
    return df.withColumn(ts, F.timestamp_micros(moved))
