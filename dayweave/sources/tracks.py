"""Activity files and GPS tracks (XML, text traces)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.operators.aggregates import elevation_gain
from dayweave.operators.ordered import time_bucket
from dayweave.sources.files import date_in_name, person_in_path, person_keys, read_lines

ACTIVITY_SCHEMA = """_Sport STRING, Id TIMESTAMP, Lap ARRAY<STRUCT<_StartTime: TIMESTAMP, Calories: DOUBLE,
 DistanceMeters: DOUBLE, TotalTimeSeconds: DOUBLE,
 Track: ARRAY<STRUCT<Trackpoint: ARRAY<STRUCT<Time: TIMESTAMP, AltitudeMeters: DOUBLE, DistanceMeters: DOUBLE>>>>>>"""

POINT_SCHEMA = "_lat DOUBLE, _lon DOUBLE, ele DOUBLE, time TIMESTAMP, speed DOUBLE"


def _climb(points: Column) -> tuple[Column, Column]:
    """Summed rises and falls of an array; NULL for an empty one."""
    n = F.size(points)
    steps = F.zip_with(F.slice(points, 2, n), F.slice(points, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)

    def total(sign: int) -> Column:
        part = F.transform(steps, lambda s: F.greatest(s * sign, F.lit(0.0)))
        return F.when(n > 0, F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v))

    return total(1), total(-1)


def read_activities(spark: SparkSession, path: str, person: str | None = None) -> DataFrame:
    """(day, elevation_gain, elevation_loss, calories) per activity file.

    Other file types in the folder are skipped; altitude may be missing.
    """
    raw = (
        spark.read.format("xml")
        .option("rowTag", "Activity")
        .option("pathGlobFilter", "*.tcx")
        .option("recursiveFileLookup", "true")
        .schema(ACTIVITY_SCHEMA)
        .load(path)
    )
    laps = F.coalesce(F.col("Lap"), F.array())
    tracks = F.flatten(F.transform(laps, lambda lap: F.coalesce(lap["Track"], F.array())))
    points = F.flatten(F.transform(tracks, lambda t: F.coalesce(t["Trackpoint"], F.array())))
    heights = F.filter(F.transform(points, lambda p: p["AltitudeMeters"]), lambda h: h.isNotNull())
    gain, loss = _climb(F.col("_heights"))
    calories = F.aggregate(
        F.transform(laps, lambda lap: F.coalesce(lap["Calories"], F.lit(0.0))), F.lit(0.0), lambda acc, v: acc + v
    )
    who = [person_in_path(person).alias("person")] if person else []
    return raw.withColumn("_heights", heights).select(
        *who,
        F.col("_Sport").alias("sport"),
        F.to_date("Id").alias("day"),
        gain.alias("elevation_gain"),
        loss.alias("elevation_loss"),
        calories.cast("bigint").alias("calories"),
    )


def daily_activities(activities: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return activities.groupBy(*keys, "day").agg(
        *[F.sum(c).alias(c) for c in ("elevation_gain", "elevation_loss", "calories")]
    )


def read_track_points(spark: SparkSession, path: str, person: str | None = None) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "trkpt").schema(POINT_SCHEMA).load(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"))
    raw = raw.withColumn("person", person_in_path(person, "file")) if person else raw
    return track_points(raw, person_keys(person))


def track_points(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(file, time, lon, lat, elevation, lat_lon) of all tracks and segments."""
    return raw.select(
        *keys,
        "file",
        "time",
        F.col("_lon").alias("lon"),
        F.col("_lat").alias("lat"),
        F.col("ele").alias("elevation"),
        F.struct(F.col("_lat").alias("lat"), F.col("_lon").alias("lon")).alias("lat_lon"),
    )


def track_gains(points: DataFrame, bucket_seconds: int = 3600, keys: Sequence[str] = ()) -> DataFrame:
    """(file, start_time, elevation_gain) per track file; points of one second in the order of their heights."""
    piece = [*keys, "file"]
    known = points.where(F.col("elevation").isNotNull())
    gains = elevation_gain(known, piece, ["time", "elevation"], "elevation", time_bucket("time", bucket_seconds))
    starts = points.groupBy(*piece).agg(F.min("time").alias("start_time"))
    out = starts.join(gains, piece, "left")
    return out.select(*piece, "start_time", F.coalesce("gain", F.lit(0.0)).alias("elevation_gain"))


def daily_track_gain(gains: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return gains.groupBy(*keys, F.to_date("start_time").alias("day")).agg(F.sum("elevation_gain").alias("elevation_gain"))


def read_altitude_traces(spark: SparkSession, path: str, skip: int = 6, field: int = 11, person: str | None = None) -> DataFrame:
    lines = read_lines(spark, path, person)
    return altitude_traces(lines.withColumn("day", date_in_name()), skip, field, person_keys(person))


def altitude_traces(lines: DataFrame, skip: int = 6, field: int = 11, keys: Sequence[str] = ()) -> DataFrame:
    """(day, gain) from text traces dated by file name.

    The head lines and the last two points are dropped, heights must lie
    strictly between 1 and 10000.
    """
    from pyspark.sql import Window

    order = [F.col("_block"), F.col("_line")]
    w = Window.partitionBy("_file").orderBy(*order)
    back = Window.partitionBy("_file").orderBy(*[c.desc() for c in order])
    rows = lines.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > skip)
    height = F.try_element_at(F.split("value", ","), F.lit(field)).try_cast("double")
    rows = rows.withColumn("z", height).where((F.col("z") > 1) & (F.col("z") < 10000))
    rows = rows.withColumn("_r", F.row_number().over(back)).where(F.col("_r") > 2)
    step = F.col("z") - F.lag("z").over(w)
    rows = rows.withColumn("_step", step)
    return rows.groupBy("_file", *keys, "day").agg(
        F.coalesce(F.sum(F.greatest("_step", F.lit(0.0))), F.lit(0.0)).alias("gain")
    ).drop("_file")
