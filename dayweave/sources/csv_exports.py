"""CSV exports of trackers, computers, phones and complaint logs.

Each source has a shape function on text cells, so it can follow any reader;
``read_*`` adds the usual file layout.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.functions.expressions import clock_to_minutes, numeric_or_zero
from dayweave.operators import calendar as cal
from dayweave.sources.files import (
    LINE_ORDER,
    comma_decimal,
    date_in_name,
    day_of,
    person_keys,
    read_cells,
    read_lines,
    whole_number,
)

TRACKER_COLUMNS = [
    "date", "calories", "steps", "distance", "floors", "sedentary", "light", "fair", "very", "activity_calories",
]


def tracker_days(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Nine daily metrics; head lines have no date and fall away."""
    ints = [c for c in TRACKER_COLUMNS[1:] if c != "distance"]
    return cells.select(
        *keys,
        day_of("date", "dd-MM-yyyy").alias("day"),
        *[whole_number(c).alias(c) for c in ints],
        comma_decimal("distance").alias("distance"),
    ).where(F.col("day").isNotNull())


def read_tracker_days(spark: SparkSession, path: str, person: str | None = None) -> DataFrame:
    return tracker_days(read_cells(spark, path, TRACKER_COLUMNS, person=person), person_keys(person))


def walking_days(cells: DataFrame, order: Sequence[str] = LINE_ORDER, keys: Sequence[str] = ()) -> DataFrame:
    """(day, steps): the last walking row of a file dated by its name."""
    rows = cells.where(F.col("activity") == "walking")
    return rows.groupBy(*keys, "day").agg(F.max_by(numeric_or_zero("steps"), F.struct(*order)).alias("steps"))


def read_walking_days(spark: SparkSession, path: str, columns: Sequence[str], person: str | None = None) -> DataFrame:
    return walking_days(read_cells(spark, path, columns, person=person).withColumn("day", date_in_name()), keys=person_keys(person))


def daily_column(cells: DataFrame, date: str, value: str, name: str = "steps", keys: Sequence[str] = ()) -> DataFrame:
    """(day, value) with blanks as 0."""
    day = F.col(date).try_cast("date")
    return cells.select(*keys, day.alias("day"), numeric_or_zero(value).alias(name)).where(F.col("day").isNotNull())


def minute_totals(cells: DataFrame, ts: str = "date", cols: Sequence[str] = ("calories", "steps"), keys: Sequence[str] = ()) -> DataFrame:
    """Daily sums of minute rows; blanks are skipped."""
    day = F.substring(ts, 1, 10).try_cast("date")
    return cells.where(day.isNotNull()).groupBy(*keys, day.alias("day")).agg(*[F.sum(F.col(c).try_cast("double")).alias(c) for c in cols])


# --- computer use -----------------------------------------------------------------

def computer_minutes(cells: DataFrame, machines: Sequence[int], prefix: str = "Acti", first_format: str = "dd/MM/yyyy", other_format: str = "M/d/yyyy", keys: Sequence[str] = ()) -> DataFrame:
    """Minutes per day and machine and in total, from (machine, name, start, duration).

    Machine 1 writes day/month/year, the others month/day/year.
    """
    date_text = F.split("start", " ")[0]
    day = F.when(F.col("machine") == machines[0], day_of(date_text, first_format)).otherwise(day_of(date_text, other_format))
    rows = cells.where(F.col("name").startswith(prefix)).withColumns({"day": day, "minutes": clock_to_minutes("duration")})
    wide = rows.where(F.col("day").isNotNull()).groupBy(*keys, "day").pivot("machine", list(machines)).agg(F.sum("minutes")).fillna(0, subset=[str(m) for m in machines])
    total = sum((F.col(str(m)) for m in machines), F.lit(0))
    return wide.select(*keys, "day", *[F.col(str(m)).alias(f"computer_{m}") for m in machines], total.alias("computer_total"))


def screen_delta(active: DataFrame, blank: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Active minutes minus blank-screen minutes per day."""
    side = blank.select(*keys, "day", F.col("computer_total").alias("blank_total"))
    out = active.join(side, [*keys, "day"], "left").fillna(0, subset=["blank_total"])
    return out.withColumn("delta", F.col("computer_total") - F.col("blank_total"))


def blank_screen_lines(lines: DataFrame, text: str = "Blank Screen Saver", keep_header: bool = False) -> DataFrame:
    """Only the lines about the blank screen, optionally with the file's first line."""
    hit = F.col("value").contains(text)
    if not keep_header:
        return lines.where(hit)
    firsts = lines.groupBy("_file").agg(F.min(F.struct("_block", "_line")).alias("_first"))
    marked = lines.join(firsts, "_file")
    return marked.where(hit | (F.struct("_block", "_line") == F.col("_first"))).drop("_first")


def key_counts(cells: DataFrame, machines: Sequence[int], order: Sequence[str] = LINE_ORDER, keys: Sequence[str] = ()) -> DataFrame:
    """Keys and clicks per day: last write per machine, then totals."""
    day = F.substring("date", 1, 10).try_cast("date")
    rows = cells.withColumn("day", day).where(F.col("day").isNotNull())
    last = F.struct(*order)
    per = rows.groupBy(*keys, "day", "machine").agg(
        F.max_by(numeric_or_zero("keys"), last).alias("keys"), F.max_by(numeric_or_zero("clicks"), last).alias("clicks")
    )
    per = per.withColumn("total", F.col("keys") + F.col("clicks")).where(F.col("machine").isin(list(machines)))
    return per.groupBy(*keys, "day").agg(
        *[F.sum(F.when(F.col("machine") == m, F.col("total")).otherwise(0.0)).alias(f"machine_{m}") for m in machines],
        F.sum("keys").alias("keys"),
        F.sum("clicks").alias("clicks"),
        F.sum("total").alias("total"),
    )


# --- pain and complaints -----------------------------------------------------------

def named_pain_days(rows: DataFrame, names: Sequence[str], order: Sequence[str], shift_days: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Daily mean per named pain, from (ts, name, intensity).

    The first value of a time stamp counts; some logs date the night before.
    """
    wide = cal.pivot_first(rows, [*keys, "ts"], "name", "intensity", names, order)
    day = F.date_sub(F.to_date("ts"), shift_days).alias("day")
    means = wide.groupBy(*keys, day).agg(*[F.avg(F.col(f"`{n}`")).alias(n.lower().replace(" ", "")) for n in names])
    return means


def complaint_days(cells: DataFrame, renames: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """(date, name, intensity) to one renamed column per complaint.

    Two values for the same day and name are an error.
    """
    counted = cells.groupBy(*keys, "date", "name").agg(
        F.max(F.col("intensity").try_cast("double")).alias("v"), F.count(F.lit(1)).alias("n")
    )
    value = F.when(F.col("n") == 1, F.col("v")).otherwise(
        F.raise_error(F.concat(F.lit("duplicate complaint: "), F.col("date"), F.lit(" "), F.col("name"))).cast("double")
    )
    wide = counted.withColumn("v", value).groupBy(*keys, F.col("date").try_cast("date").alias("day"))
    return wide.pivot("name", list(renames)).agg(F.first("v")).withColumnsRenamed(dict(renames))


def diary(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(day, text) with lower-cased notes."""
    return cells.select(*keys, F.col("date").try_cast("timestamp").cast("date").alias("day"), F.lower("text").alias("text"))


def read_diary(spark: SparkSession, path: str, person: str | None = None) -> DataFrame:
    return diary(read_cells(spark, path, ["text", "date"], person=person), person_keys(person))


def read_taps(spark: SparkSession, paths: Sequence[str], person: str | None = None) -> DataFrame:
    return taps(read_cells(spark, list(paths), ["timestamp", "cat1", "cat2"], person=person), person_keys(person))


def taps(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(ts, label) of tap logs, of any number of files."""
    rows = cells.select(*keys, F.col("timestamp").try_cast("timestamp").alias("ts"), F.col("cat2").alias("label"))
    return rows.where(F.col("ts").isNotNull())


# --- phone ------------------------------------------------------------------------

def phone_days(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(day, minutes) after the table header; the last day is incomplete and dropped."""
    header = F.regexp_replace("value", '"', "").startswith("Date,Usage time")
    position = F.struct("_block", "_line")
    starts = lines.where(header).groupBy("_file").agg(F.min(position).alias("_head"))
    rows = lines.join(starts, "_file").where(position > F.col("_head"))
    cells = F.split(F.regexp_replace("value", '"', ""), ",")
    rows = rows.select(
        *keys,
        F.try_element_at(cells, F.lit(1)).try_cast("date").alias("day"),
        F.coalesce(clock_to_minutes(F.try_element_at(cells, F.lit(2))), F.lit(0)).alias("minutes"),
    )
    daily = rows.where(F.col("day").isNotNull()).groupBy(*keys, "day").agg(F.sum("minutes").alias("minutes"))
    return cal.complete_days(daily, keys)


def read_phone_days(spark: SparkSession, path: str, person: str | None = None) -> DataFrame:
    return phone_days(read_lines(spark, path, person), person_keys(person))


# --- stored tables ------------------------------------------------------------------

def stored_days(cells: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Stored numbers by day; rows without a day, such as a head line, fall away."""
    return cells.select(
        *keys, F.col("day").try_cast("date").alias("day"), *[F.col(c).try_cast("double").alias(c) for c in columns]
    ).where(F.col("day").isNotNull())


def read_stored_gain(spark: SparkSession, path: str, columns: Sequence[str], person: str | None = None) -> DataFrame:
    """Stored cumulative gains by day, ready for combine_first / update_from."""
    return stored_days(read_cells(spark, path, ["day", *columns], person=person), columns, person_keys(person))


def read_manual_fill(spark: SparkSession, path: str, columns: Sequence[str], person: str | None = None) -> DataFrame:
    """Hand-filled sheet saved as CSV: day and numbers."""
    return read_stored_gain(spark, path, columns, person)


def read_device_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A device database table exported to Parquet."""
    return spark.read.parquet(f"{folder}/{table}")


def read_device_jdbc(spark: SparkSession, url: str, table: str, column: str, lower, upper, parts: int, **options: str) -> DataFrame:
    """A device database table read in parallel ranges of a column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return reader.options(
        partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts)
    ).load()
