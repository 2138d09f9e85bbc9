"""Fast-rise warnings on smoothed strain and what pain does after them.

Input is a day-grain series with ``pos`` (row number from 0), a smoothed and
rescaled ``strain`` and ``pain``.  ``head`` is the length of the rolling
rescale; nothing is judged before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.operators.aggregates import binned_summary

# Thresholds and the codes written by the warning steps.
RISE_LIMIT = 0.02
COOL_DOWN = 10
RISE_CODE, COOL_CODE = 0.48, 0.4
SMALL_LIMIT, BIG_LIMIT = 0.4, 0.6
SMALL_CODE, BIG_CODE = 0.25, 0.52
WARN_SMALL, WARN_BIG = 0.6, 0.600001


def _order(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("pos")


def _upto(keys):
    return _order(keys).rowsBetween(Window.unboundedPreceding, 0)


def _judged(keys, head: int) -> Column:
    """Rows from ``head`` to the last but one."""
    ahead = F.lead(F.lit(1)).over(_order(keys)).isNotNull()
    return (F.col("pos") >= head) & ahead


def strain_change(df: DataFrame, keys: Sequence[str], head: int, strain: str = "strain") -> DataFrame:
    """``strain_diff``: day-to-day change, NULL for the first ``head + 1`` rows."""
    change = F.col(strain) - F.lag(strain).over(_order(keys))
    return df.withColumn("strain_diff", F.when(F.col("pos") > head, change))


def rise_flags(df: DataFrame, keys: Sequence[str], head: int, limit: float = RISE_LIMIT, cool: int = COOL_DOWN) -> DataFrame:
    """``rise``: fast rise, cool-down after it, else 0."""
    df = df.withColumns({"_up": F.coalesce(F.col("strain_diff") >= limit, F.lit(False)), "_ok": _judged(keys, head)})
    last = F.last(F.when(F.col("_up") & F.col("_ok"), F.col("pos")), ignorenulls=True).over(_upto(keys))
    cooling = F.col("_ok") & ((F.col("pos") - F.col("_last")) <= cool)
    code = F.when(F.col("_up"), RISE_CODE).when(cooling, COOL_CODE).otherwise(0.0)
    return df.withColumn("_last", last).withColumn("rise", code).drop("_up", "_ok", "_last")


def level_bands(df: DataFrame, strain: str = "strain") -> DataFrame:
    """``band``: code of the strain level."""
    s = F.col(strain)
    return df.withColumn("band", F.when(s >= BIG_LIMIT, BIG_CODE).when(s >= SMALL_LIMIT, SMALL_CODE).otherwise(0.0))


def final_warning(df: DataFrame, keys: Sequence[str], head: int, rise_only: bool = True) -> DataFrame:
    """``warning``: from the rise alone, or from rise and level together."""
    rising = F.col("_ok") & (F.col("rise") >= COOL_CODE)
    if rise_only:
        code = F.when(rising, WARN_BIG)
    else:
        code = F.when(rising & (F.col("band") == BIG_CODE), WARN_BIG).when(
            rising & (F.col("band") == SMALL_CODE), WARN_SMALL
        )
    return df.withColumn("_ok", _judged(keys, head)).withColumn("warning", code.otherwise(0.0)).drop("_ok")


def warning_sequences(df: DataFrame, keys: Sequence[str], head: int) -> DataFrame:
    """``days_since`` a warning began and the ``sequence`` between warnings.

    Both start at row ``head``; earlier rows are NULL.
    """
    active = (F.col("pos") >= head) & (F.col("warning") >= WARN_SMALL)
    df = df.withColumn("_on", active)
    begins = F.col("_on") & ~F.coalesce(F.lag("_on").over(_order(keys)), F.lit(False))
    df = df.withColumn("_begin", begins)
    start = F.last(F.when(F.col("_begin"), F.col("pos")), ignorenulls=True).over(_upto(keys))
    count = F.sum(F.col("_begin").cast("int")).over(_upto(keys))
    known = F.col("pos") >= head
    return df.withColumns(
        {
            "days_since": F.when(known, F.col("pos") - F.coalesce(start, F.lit(head)) + 1),
            "sequence": F.when(known, count + 1),
        }
    ).drop("_on", "_begin")


def pain_against_recent(df: DataFrame, keys: Sequence[str], head: int, pain: str = "pain") -> DataFrame:
    """``pain_shift``: pain minus its mean over the last ``head // 2 + 1`` rows."""
    recent = F.avg(pain).over(_order(keys).rowsBetween(-(head // 2), 0))
    return df.withColumn("pain_shift", F.when(F.col("pos") >= head, F.col(pain) - recent))


def warning_days(df: DataFrame, keys: Sequence[str], head: int, ahead: int = 7) -> DataFrame:
    """First days of warnings, ``big`` when a full warning follows within a week."""
    top = F.max("warning").over(_order(keys).rowsBetween(0, ahead - 1))
    last = F.lead(F.lit(1)).over(_order(keys)).isNull()
    rows = df.withColumns({"_top": top, "_end": last})
    firsts = rows.where((F.col("days_since") == 1) & (F.col("pos") > head) & ~F.col("_end"))
    return firsts.withColumn("size", F.when(F.col("_top") == WARN_BIG, "big").otherwise("small")).drop("_top", "_end")


def without_run_up(df: DataFrame, keys: Sequence[str], head: int, days: int = 20) -> DataFrame:
    """Rows from ``head`` on, without the last days before each next warning."""
    rows = df.where(F.col("pos") >= head)
    jump = F.col("days_since") != F.lag("days_since").over(_order(keys)) + 1
    rows = rows.withColumn("_edge", F.when(jump, F.col("pos")))
    back = Window.partitionBy(*keys).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_next", F.last("_edge", ignorenulls=True).over(back))
    near = F.coalesce((F.col("_next") - F.col("pos")) <= days, F.lit(False))
    return rows.where(~near).drop("_edge", "_next")


def sequence_traces(df: DataFrame, keys: Sequence[str], days: int = 20) -> DataFrame:
    """Length of every sequence and its least pain shift near the end."""
    group = [*keys, "sequence"]
    newest = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("pos")))
    rows = df.withColumn("_r", newest)
    tail = (F.col("_r") > 1) & (F.col("_r") <= days)
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_days"), F.min(F.when(tail, F.col("pain_shift"))).alias("min_pain")
    )


def outcome_by_days(df: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Quartiles and spread of the pain shift per days-since-warning bin."""
    return binned_summary(df, keys, "days_since", "pain_shift", bins)


def all_warnings(df: DataFrame, keys: Sequence[str], head: int, rise_only: bool = True) -> DataFrame:
    """All steps from strain change to pain shift on a smoothed series."""
    out = strain_change(df, keys, head)
    out = level_bands(rise_flags(out, keys, head))
    out = warning_sequences(final_warning(out, keys, head, rise_only), keys, head)
    return pain_against_recent(out, keys, head)
