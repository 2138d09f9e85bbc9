"""JSON exports: nested step buckets, intraday metrics, timelines, device summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.functions.expressions import epoch_to_timestamp, local_time
from dayweave.sources.files import person_in_path, person_keys

STEP_SCHEMA = """bucket ARRAY<STRUCT<dataset: ARRAY<STRUCT<point: ARRAY<STRUCT<
 startTimeNanos: STRING, endTimeNanos: STRING, value: ARRAY<STRUCT<intVal: BIGINT>>>>>>>>"""

TIMELINE_SCHEMA = """timelineObjects ARRAY<STRUCT<
 placeVisit: STRUCT<
  location: STRUCT<name: STRING, latitudeE7: BIGINT, longitudeE7: BIGINT>,
  duration: STRUCT<startTimestamp: TIMESTAMP, endTimestamp: TIMESTAMP>,
  placeVisitType: STRING, simplifiedRawPath: STRUCT<distanceMeters: DOUBLE>>,
 activitySegment: STRUCT<
  duration: STRUCT<startTimestamp: TIMESTAMP, endTimestamp: TIMESTAMP>,
  distance: DOUBLE, activityType: STRING, confidence: STRING,
  waypointPath: STRUCT<distanceMeters: DOUBLE, travelMode: STRING, confidence: DOUBLE>,
  startLocation: STRUCT<latitudeE7: BIGINT, longitudeE7: BIGINT>>>>"""

EXPORT_SCHEMA = """summarizedActivitiesExport ARRAY<STRUCT<
 activityType: STRING, sportType: STRING, distance: DOUBLE, duration: DOUBLE, elevationGain: DOUBLE,
 calories: DOUBLE, bmrCalories: DOUBLE, strokes: DOUBLE, elapsedDuration: DOUBLE, startTimeLocal: DOUBLE>>"""


def _documents(spark: SparkSession, path: str, schema: str, person: str | None = None) -> DataFrame:
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    return raw.select("*", person_in_path(person).alias("person")) if person else raw


def step_points(documents: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(start_ts, end_ts, steps) of every point in nested bucket documents."""
    data = documents.select(*keys, F.explode("bucket").alias("b")).select(*keys, F.explode("b.dataset").alias("d"))
    points = data.select(*keys, F.explode("d.point").alias("p"))
    return points.select(
        *keys,
        epoch_to_timestamp("p.startTimeNanos", "ns").alias("start_ts"),
        epoch_to_timestamp("p.endTimeNanos", "ns").alias("end_ts"),
        F.try_element_at(F.col("p.value"), F.lit(1))["intVal"].alias("steps"),
    )


def read_step_points(spark: SparkSession, path: str, person: str | None = None) -> DataFrame:
    return step_points(_documents(spark, path, STEP_SCHEMA, person), person_keys(person))


def read_api_steps(spark: SparkSession, path: str, person: str | None = None) -> DataFrame:
    return api_steps(_documents(spark, path, "`activities-steps` ARRAY<STRUCT<dateTime: STRING, value: STRING>>", person), person_keys(person))


def api_steps(documents: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(day, steps) from ``activities-steps`` lists; text is cast here."""
    items = documents.select(*keys, F.explode("activities-steps").alias("s"))
    return items.select(*keys, F.col("s.dateTime").try_cast("date").alias("day"), F.col("s.value").try_cast("double").alias("steps"))


def intraday_values(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(ts, value) of intraday rows; a heart rate comes as an object with ``bpm``."""
    number = F.coalesce(F.col("value").try_cast("double"), F.get_json_object("value", "$.bpm").try_cast("double"))
    return raw.select(*keys, F.try_to_timestamp("dateTime", F.lit("MM/dd/yy HH:mm:ss")).alias("ts"), number.alias("value"))


def read_intraday(spark: SparkSession, folder: str, prefix: str, person: str | None = None) -> DataFrame:
    """All ``prefix-*.json`` files of one metric."""
    return intraday_values(_documents(spark, f"{folder}/{prefix}-*.json", "dateTime STRING, value STRING", person), person_keys(person))


def read_device_summaries(spark: SparkSession, folder: str, person: str | None = None) -> DataFrame:
    schema = "calendarDate STRING, totalKilocalories DOUBLE, totalSteps DOUBLE, totalDistanceMeters DOUBLE"
    return device_summaries(_documents(spark, f"{folder}/UDSFile_*.json", schema, person), person_keys(person))


def device_summaries(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(day, calories, steps, distance) from the daily device summaries."""
    return raw.select(
        *keys,
        F.col("calendarDate").try_cast("date").alias("day"),
        F.col("totalKilocalories").alias("calories"),
        F.col("totalSteps").alias("steps"),
        F.col("totalDistanceMeters").alias("distance"),
    )


def read_device_activities(spark: SparkSession, path: str, person: str | None = None) -> DataFrame:
    """Activities of every export file (not only the last one)."""
    return device_activities(_documents(spark, path, EXPORT_SCHEMA, person), person_keys(person))


def device_activities(documents: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per exported activity, with a start timestamp."""
    items = documents.select(*keys, F.explode("summarizedActivitiesExport").alias("a")).select(*keys, "a.*")
    return items.withColumn("start_ts", epoch_to_timestamp("startTimeLocal", "ms")).drop("startTimeLocal")


def timeline_entries(documents: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Place visits and journeys as one table, degrees instead of E7."""
    rows = documents.select(*keys, F.explode("timelineObjects").alias("o"))
    place, move = F.col("o.placeVisit"), F.col("o.activitySegment")
    visits = rows.where(place.isNotNull()).select(
        *keys,
        place["location"]["name"].alias("location"),
        (place["location"]["latitudeE7"] / 1e7).alias("lat"),
        (place["location"]["longitudeE7"] / 1e7).alias("lon"),
        place["duration"]["startTimestamp"].alias("start_ts"),
        place["duration"]["endTimestamp"].alias("end_ts"),
        place["placeVisitType"].alias("activity_type"),
        place["simplifiedRawPath"]["distanceMeters"].alias("path_distance"),
    )
    moves = rows.where(move.isNotNull()).select(
        *keys,
        F.lit("Journey").alias("location"),
        (move["startLocation"]["latitudeE7"] / 1e7).alias("lat"),
        (move["startLocation"]["longitudeE7"] / 1e7).alias("lon"),
        move["duration"]["startTimestamp"].alias("start_ts"),
        move["duration"]["endTimestamp"].alias("end_ts"),
        move["activityType"].alias("activity_type"),
        move["distance"].alias("distance"),
        move["confidence"].alias("confidence"),
        move["waypointPath"]["distanceMeters"].alias("waypoint_distance"),
        move["waypointPath"]["travelMode"].alias("travel_mode"),
    )
    return visits.unionByName(moves, allowMissingColumns=True)


def read_timeline(spark: SparkSession, path: str, zone: str | None = None, person: str | None = None) -> DataFrame:
    """Timeline entries; with ``zone`` also the local wall-clock times."""
    out = timeline_entries(_documents(spark, path, TIMELINE_SCHEMA, person), person_keys(person))
    if zone:
        out = out.withColumns({"start_local": local_time("start_ts", F.lit(zone)), "end_local": local_time("end_ts", F.lit(zone))})
    return out
