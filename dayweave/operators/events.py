"""Pain events, calm days and the event matrix that models learn from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayweave.operators import intervals as iv
from dayweave.operators.calendar import pivot_day_numbers
from dayweave.operators.rolling import consecutive_days
from dayweave.operators.scaling import ordered


def pain_events(df: DataFrame, keys: Sequence[str], pain: str, spike: bool = True, min_change: float = 1.0, day: str = "day") -> DataFrame:
    """Days on which pain jumps by more than ``min_change`` (or drops at all).

    Spikes must come more than two days after the previous jump; the first one
    has no predecessor and is left out.
    """
    o = ordered(keys, day)
    change = F.col(pain) - F.lag(pain).over(o)
    hits = df.select(*keys, day, change.alias("change"))
    hits = hits.where(F.col("change") > min_change) if spike else hits.where(F.col("change") < 0)
    hits = hits.withColumn("days_before", F.datediff(day, F.lag(day).over(ordered(keys, day))))
    return hits.where(F.col("days_before") > (2 if spike else 0))


def pain_days(events: DataFrame, keys: Sequence[str], day: str = "day") -> DataFrame:
    """Event days and the day before each."""
    both = F.explode(F.array(F.date_sub(day, 1), F.col(day))).alias(day)
    return events.select(*keys, both).distinct()


def calm_days(drops: DataFrame, pain: DataFrame, last_days: DataFrame, keys: Sequence[str], buffer: int, day: str = "day") -> DataFrame:
    """Day pairs that follow a drop after ``buffer`` free days, up to the next pain day.

    Ranges that end at the same pain day overlap, so only their union is
    unfolded: one range per stretch.  The last stretch ends with the data.
    """
    keys = list(keys)
    marks = pain.select(*keys, day, F.lit(1).alias("_pain"), F.lit(0).alias("_drop"))
    merged = marks.unionByName(drops.select(*keys, day, F.lit(0).alias("_pain"), F.lit(1).alias("_drop")))
    per_day = merged.groupBy(*keys, day).agg(F.max("_pain").alias("_pain"), F.max("_drop").alias("_drop"))
    back = Window.partitionBy(*keys).orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, 0)
    following = F.last(F.when(F.col("_pain") == 1, F.col(day)), ignorenulls=True).over(back)
    starts = per_day.withColumn("_stop", following).where(F.col("_drop") == 1)
    starts = starts.join(last_days.select(*keys, F.date_add("last_day", 1).alias("_end")), keys)
    starts = starts.withColumn("_stop", F.coalesce("_stop", "_end"))
    pairs = F.floor((F.datediff("_stop", day) - buffer) / 2)
    starts = starts.withColumn("_pairs", pairs).where(F.col("_pairs") > 0)
    first = F.date_add(day, buffer)
    ranges = starts.groupBy(*keys, "_stop").agg(
        F.min(first).alias("_lo"), F.max(F.date_add(day, (F.lit(buffer) + 2 * F.col("_pairs") - 1).cast("int"))).alias("_hi")
    )
    return ranges.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias(day))


def event_matrix(df: DataFrame, keys: Sequence[str], pain: str, cols: Sequence[str], start, buffer: int = 3, search_days: int = 30, min_change: float = 1.0, day: str = "day") -> DataFrame:
    """One row per two-day event: ``<col>_0, <col>_1``, both days, the number of
    pain events in the days before, and the label ``pain`` (1 or 0)."""
    keys = list(keys)
    spikes = pain_events(df, keys, pain, True, min_change, day)
    drops = pain_events(df, keys, pain, False, min_change, day)
    painful = pain_days(spikes, keys, day)
    last = df.groupBy(*keys).agg(F.max(day).alias("last_day"))
    calm = calm_days(drops, painful, last, keys, buffer, day)
    used = [day, *cols]

    hot = consecutive_days(df.join(painful, keys + [day], "left_semi"), keys, day)
    hot = pivot_day_numbers(hot, keys, "event_num", "day_num", used).withColumn("pain", F.lit(1))
    rest = df.join(calm, keys + [day], "left_semi").withColumn("_k", F.row_number().over(ordered(keys, day)) - 1)
    rest = rest.withColumns({"event_num": F.floor(F.col("_k") / 2) + 1, "day_num": F.col("_k") % 2 + 1})
    rest = pivot_day_numbers(rest, keys, "event_num", "day_num", used).withColumn("pain", F.lit(0))
    both = hot.unionByName(rest)

    # a half event has no second day and gets no look-back count
    asked = both.where(F.col(f"{day}_1").isNotNull()).select(*keys, F.col(f"{day}_1").alias(day)).distinct()
    counted = iv.events_before(asked, spikes, keys, start, search_days, day)
    counted = counted.withColumnRenamed(day, f"{day}_1").withColumnRenamed("num_events", "num_pain_events")
    return both.join(counted, keys + [f"{day}_1"], "left")


def drop_unchanged(matrix: DataFrame, keys: Sequence[str], col: str, search_days: int = 30, day: str = "day") -> DataFrame:
    """Drop events whose column does not change, and events in the days after them."""
    keys = list(keys)
    same = matrix.where(F.col(f"{col}_0") == F.col(f"{col}_1")).select(*keys, F.col(f"{day}_1").alias("_d"))
    spread = F.explode(F.sequence(F.lit(1), F.lit(search_days - 1)))
    near = same.select(*keys, "_d", spread.alias("_k")).select(*keys, F.date_add("_d", F.col("_k")).alias(f"{day}_1"))
    kept = matrix.where(F.col(f"{col}_0") != F.col(f"{col}_1"))
    return kept.join(near.distinct(), keys + [f"{day}_1"], "left_anti")


def model_frame(matrix: DataFrame, keep_second_day: bool = True, drop_fields: Sequence[str] = (), regression_on: str | None = None) -> DataFrame:
    """Columns for a model: complete rows, optional regression target."""
    out = matrix.dropna()
    if regression_on:
        out = out.withColumn("pain_change", F.col(f"{regression_on}_1") - F.col(f"{regression_on}_0")).drop("pain")
        drop_fields = [*drop_fields, f"{regression_on}_0", f"{regression_on}_1"]
    names = [c for c in out.columns if not any(f in c for f in drop_fields)]
    if not keep_second_day:
        names = [c for c in names if not c.endswith("1")]
    return out.select(*names)
