"""Scalar column expressions: recodes, corrections, time parsing, text labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayweave.functions import vocab


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- lookups -----------------------------------------------------------------

def lookup(label: str | Column, table: Mapping[str, object], default=None) -> Column:
    """Value of a label in a small fixed table."""
    flat = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*flat), _c(label)), F.lit(default))


def recode(label: str | Column, table: Mapping[str, str]) -> Column:
    """Replace labels found in the table; others stay."""
    return F.coalesce(lookup(label, table), _c(label))


# --- pain and strain -----------------------------------------------------------

def pain_recode(x: str | Column) -> Column:
    """Pain intensity to its effect score; NULL stays NULL."""
    x, out = _c(x), F
    for limit, score in vocab.PAIN_BELOW:
        out = out.when(x < limit, score)
    (value, at), (limit, up_to) = vocab.PAIN_AT, vocab.PAIN_UP_TO
    return out.when(x == value, at).when(x <= limit, up_to).when(x.isNotNull(), vocab.PAIN_BEYOND)


def cap(x: str | Column, limit: float) -> Column:
    """Limit from above (pain is capped at 3.5); NULL stays NULL."""
    return F.when(_c(x) > limit, F.lit(limit)).otherwise(_c(x))


def row_max(cols: Sequence[str]) -> Column:
    """Largest of several columns; NULLs are skipped."""
    return F.greatest(*[F.col(c) for c in cols])


def mean_of(cols: Sequence[str]) -> Column:
    """Plain mean of columns; NULL if any is NULL."""
    total = F.col(cols[0])
    for c in cols[1:]:
        total = total + F.col(c)
    return total / F.lit(float(len(cols)))


def saturate(x: str | Column, limit: float = 250.0) -> Column:
    """x/limit up to 1."""
    return F.least(_c(x) / F.lit(limit), F.lit(1.0))


def rescale(x: str | Column, target: float, source: float) -> Column:
    """Unit scaling by target/source."""
    return _c(x) * F.lit(target / source)


def add_low_level(x: str | Column, low: float) -> Column:
    return (_c(x) + F.lit(low)) / F.lit(1.0 + low)


# --- activity and energy ---------------------------------------------------------

def corrected_steps(steps, scooter, swim, cycle, per_minute: float = vocab.SCOOTER_STEPS) -> Column:
    """Steps without scooter, swim and cycling artefacts, never below zero."""
    return F.greatest(_c(steps) - F.lit(per_minute) * _c(scooter) - _c(swim) - _c(cycle), F.lit(0.0))


def active_calories(total, bmr, divisor: float = vocab.CALORIE_UNIT) -> Column:
    """(total - basal) in kilocalories."""
    return (_c(total) - _c(bmr)) / F.lit(divisor)


def active_calories_from_minutes(total, minutes, basal_per_day: float = vocab.BASAL_PER_DAY) -> Column:
    return _c(total) - F.lit(basal_per_day / 1440.0) * _c(minutes)


def jump_calories(minutes, per_minute: float = vocab.JUMP_PER_MINUTE) -> Column:
    return F.lit(per_minute) * _c(minutes)


def _shared(first: Column | None, parts: Mapping[str, Column], shares: Mapping[str, float]) -> Column:
    out = first
    for name, share in shares.items():
        part = F.lit(share) * _c(parts[name])
        out = part if out is None else out + part
    return out


def knee_calories(total, swim, climb, cliff, ski) -> Column:
    return _shared(_c(total), {"swim": swim, "climb": climb, "cliff": cliff, "ski": ski}, vocab.KNEE_SHARES)


def arm_calories(swim, climb, cycle, cliff, ski) -> Column:
    return _shared(None, {"swim": swim, "climb": climb, "cycle": cycle, "cliff": cliff, "ski": ski}, vocab.ARM_SHARES)


def activity_bucket(sport, sub_sport, name) -> Column:
    """Calorie bucket of an activity: by sport, climbing-like ones by their name."""
    effective = F.when(_c(sport) == "fitness_equipment", _c(sub_sport)).otherwise(_c(sport))
    out = F.when(effective.isin(*vocab.DIRECT_SPORTS), lookup(effective, vocab.DIRECT_SPORTS))
    climbing = effective.isin(*vocab.CLIMBING_SPORTS)
    for part, bucket in vocab.NAMED_ACTIVITIES.items():
        out = out.when(climbing & F.lower(_c(name)).contains(part), F.lit(bucket))
    return out.when(climbing, F.lit("climbing")).otherwise(F.lit("none"))


def split_between(total, first_flag, second_flag) -> tuple[Column, Column]:
    """Share a total between two flagged activities; both flagged means half each."""
    a, b = _c(first_flag) > 0, _c(second_flag) > 0
    half = _c(total) / F.lit(2.0)
    first = F.when(a & b, half).when(a, _c(total)).otherwise(F.lit(0.0))
    second = F.when(a & b, half).when(b, _c(total)).otherwise(F.lit(0.0))
    return first, second


# --- ratios and changes --------------------------------------------------------------

def ratio(a, b) -> Column:
    """a/b, NULL where b is zero."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def disagreement(other, main) -> Column:
    """Signed relative difference of a second measurement from the main one."""
    return F.try_divide(_c(other) - _c(main), _c(main))


def first_known(*cols) -> Column:
    """Fallback chain."""
    return F.coalesce(*[_c(c) for c in cols])


def is_usable(*cols: str) -> Column:
    """Neither NULL, NaN, infinite nor zero in any of the columns."""
    cond = F.lit(True)
    for c in cols:
        x = F.col(c)
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
        cond = cond & finite & (x != 0)
    return cond


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column (done once, at ingest)."""
    cols = [
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
        if f.dataType.simpleString() in ("double", "float")
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


# --- time ------------------------------------------------------------------------

def clock_to_minutes(text) -> Column:
    """``H:MM`` or ``HH:MM:SS`` to whole minutes; NULL when unreadable."""
    parts = F.split(_c(text), ":")
    hours = F.try_element_at(parts, F.lit(1)).try_cast("bigint")
    minutes = F.try_element_at(parts, F.lit(2)).try_cast("bigint")
    return hours * 60 + minutes


def epoch_to_timestamp(value, unit: str = "s") -> Column:
    v = _c(value).cast("long")
    if unit == "s":
        return F.timestamp_seconds(v)
    if unit == "ms":
        return F.timestamp_millis(v)
    if unit == "us":
        return F.timestamp_micros(v)
    return F.timestamp_micros(F.call_function("div", v, F.lit(1000)))  # nanoseconds


def local_time(ts, zone) -> Column:
    """UTC instant to the wall clock of a zone id column."""
    return F.from_utc_timestamp(_c(ts), _c(zone))


def round_to_second(ts) -> Column:
    return F.date_trunc("second", F.timestamp_micros(F.unix_micros(_c(ts)) + F.lit(500_000)))


def interval_from_parts(date, start, minutes, marker: str = "taplog") -> tuple[Column, Column]:
    """Start and end from date, start clock and duration; NULL when marked."""
    begin = F.try_to_timestamp(F.concat_ws(" ", _c(date), _c(start)), F.lit("yyyy-MM-dd HH:mm"))
    begin = F.when(_c(start) != marker, begin)
    length = F.make_dt_interval(mins=_c(minutes).try_cast("int"))
    return begin, begin + length


def date_from_parts(year, month, day) -> Column:
    """Date from text parts, padded or not; NULL when impossible."""
    text = F.concat_ws(
        "-", _c(year), F.lpad(F.trim(_c(month)), 2, "0"), F.lpad(F.trim(_c(day)), 2, "0")
    )
    complete = _c(year).isNotNull() & _c(month).isNotNull() & _c(day).isNotNull()
    return F.when(complete, text.try_cast("date"))


# --- text categories ------------------------------------------------------------------

def categories(text, table: Mapping[str, Sequence[str]]) -> Column:
    """All categories with a keyword inside the text, in table order."""
    hits = [
        F.when(_any_inside(_c(text), words), F.lit(name)) for name, words in table.items()
    ]
    return F.array_compact(F.array(*hits))


def last_category(text, table: Mapping[str, Sequence[str]]) -> Column:
    """The last matching category, NULL if none."""
    return F.try_element_at(categories(text, table), F.lit(-1))


def _any_inside(text: Column, words: Sequence[str]) -> Column:
    cond = text.contains(words[0])
    for w in words[1:]:
        cond = cond | text.contains(w)
    return cond


def one_hot(array_col: str, names: Sequence[str], prefix: str = "") -> list[Column]:
    """How often each name occurs in an array column, one column per name."""
    def count(name: str) -> Column:
        hits = F.filter(array_col, lambda v: v == F.lit(name))
        return F.coalesce(F.size(hits), F.lit(0)).cast("long").alias(prefix + name)

    return [count(name) for name in names]


def mood_score(label, modifier=None) -> Column:
    """Mood word on the 3..9 scale with an optional +/- modifier of 0.33."""
    base = lookup(label, vocab.MOOD_3_TO_9, vocab.MOOD_DEFAULT)
    if modifier is None:
        return base
    return base + F.when(_c(modifier) == "+", 0.33).when(_c(modifier) == "-", -0.33).otherwise(0.0)


def numeric_or_zero(text) -> Column:
    """Number in a cell, 0 when it cannot be read."""
    return F.coalesce(_c(text).try_cast("double"), F.lit(0.0))
