"""Queries for source-side shapes, fed with text cells derived from the tables."""

from pyspark.sql import functions as F

from dayweave.functions import expressions as ex
from dayweave.functions import vocab
from dayweave.operators import calendar as cal
from dayweave.operators import ordered
from dayweave.plans.base import r, table
from dayweave.plans.registry import query
from dayweave.sources import csv_exports as cx
from dayweave.sources import files
from dayweave.sources import json_exports as jx
from dayweave.sources import manual_logs as ml
from dayweave.sources import sinks
from dayweave.sources import tracks as tr
from dayweave.sources.tracks import _climb, track_gains


def events(spark, sf):
    """Events with a number and the person whose file a row would come from."""
    return table(spark, sf, "events").withColumns({"k": F.get_json_object("props", "$.k").cast("long"), "person": F.col("event_id") % 4})


#: The key of all source shapes.
P = ["person"]


KEY = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(
    "a01_activity_climb",
    """WITH x AS (SELECT user_id, CAST(ts AS DATE) AS day, round(value * 100)::BIGINT - lag(round(value * 100)::BIGINT) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS d FROM events)
SELECT user_id, day, CAST(coalesce(sum(greatest(d, 0)) FILTER (d IS NOT NULL), 0) AS DOUBLE) AS gain, CAST(coalesce(sum(greatest(-d, 0)) FILTER (d IS NOT NULL), 0) AS DOUBLE) AS loss FROM x GROUP BY 1, 2""",
)
def climb(spark, sf):
    packed = F.sort_array(F.collect_list(F.struct("ts", "event_id", F.round(F.col("value") * 100).alias("h"))))
    one = events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.transform(packed, lambda p: p["h"]).alias("h"))
    gain, loss = _climb(F.col("h"))
    return one.select("user_id", "day", gain.alias("gain"), loss.alias("loss"))


@query(
    "a03_track_gains",
    """WITH x AS (SELECT user_id % 3 AS person, user_id, ts, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events)
SELECT person, CAST(user_id AS VARCHAR) AS file, min(ts) AS start_time, round(coalesce(sum(greatest(d, 0)) FILTER (d IS NOT NULL), 0), 4) AS elevation_gain FROM x GROUP BY 1, 2""",
)
def gains(spark, sf):
    points = events(spark, sf).select((F.col("user_id") % 3).alias("person"), F.col("user_id").cast("string").alias("file"), F.col("ts").alias("time"), F.col("value").alias("elevation"))
    return track_gains(points, 86400, P).withColumn("elevation_gain", r("elevation_gain", 4))


@query(
    "a04_nested_step_points",
    f"SELECT event_id % 4 AS person, date_trunc('milliseconds', ts) AS start_ts, date_trunc('milliseconds', ts) + INTERVAL 60 SECOND AS end_ts, {KEY} AS steps FROM events",
)
def step_points(spark, sf):
    ms = F.floor(F.unix_micros("ts") / 1000).cast("long")
    point = F.struct(
        (ms * 1_000_000).cast("string").alias("startTimeNanos"),
        ((ms + 60_000) * 1_000_000).cast("string").alias("endTimeNanos"),
        F.array(F.struct(F.col("k").alias("intVal"))).alias("value"),
    )
    per_day = events(spark, sf).groupBy("person", "user_id", F.to_date("ts").alias("d")).agg(F.collect_list(point).alias("point"))
    docs = per_day.select("person", F.array(F.struct(F.array(F.struct("point")).alias("dataset"))).alias("bucket"))
    return jx.step_points(docs, P)


@query(
    "a07_intraday_values",
    f"SELECT event_id % 4 AS person, date_trunc('second', ts) AS ts, CASE WHEN event_type = 'view' THEN CAST({KEY} AS DOUBLE) WHEN event_type <> 'error' THEN value END AS value FROM events",
)
def intraday(spark, sf):
    text = (
        F.when(F.col("event_type") == "view", F.format_string('{"bpm": %d}', "k"))
        .when(F.col("event_type") == "error", "n/a")
        .otherwise(F.col("value").cast("string"))
    )
    return jx.intraday_values(events(spark, sf).select("person", F.date_format("ts", "MM/dd/yy HH:mm:ss").alias("dateTime"), text.alias("value")), P)


@query(
    "a10_timeline_entries",
    f"""SELECT event_id % 4 AS person, CASE WHEN event_type = 'view' THEN 'place ' || user_id ELSE 'Journey' END AS location, ts AS start_ts, ts + INTERVAL 10 MINUTE AS end_ts, round({KEY} / 10.0::DOUBLE, 6) AS lat, CASE WHEN event_type <> 'view' THEN value END AS distance FROM events""",
)
def timeline(spark, sf):
    span = F.struct(F.col("ts").alias("startTimestamp"), (F.col("ts") + F.expr("interval 10 minutes")).alias("endTimestamp"))
    e7, lon = (F.col("k") * 1_000_000).alias("latitudeE7"), F.lit(0).cast("long").alias("longitudeE7")
    is_place = F.col("event_type") == "view"
    place = F.struct(
        F.struct(F.format_string("place %d", "user_id").alias("name"), e7, lon).alias("location"),
        span.alias("duration"),
        F.lit("SINGLE_PLACE").alias("placeVisitType"),
        F.struct(F.lit(None).cast("double").alias("distanceMeters")).alias("simplifiedRawPath"),
    )
    move = F.struct(
        span.alias("duration"),
        F.col("value").alias("distance"),
        F.lit("WALKING").alias("activityType"),
        F.lit("HIGH").alias("confidence"),
        F.struct(F.lit(0.0).alias("distanceMeters"), F.lit("WALK").alias("travelMode"), F.lit(1.0).alias("confidence")).alias("waypointPath"),
        F.struct(e7, lon).alias("startLocation"),
    )
    item = F.struct(F.when(is_place, place).alias("placeVisit"), F.when(~is_place, move).alias("activitySegment"))
    docs = events(spark, sf).select("person", F.array(item).alias("timelineObjects"))
    return jx.timeline_entries(docs, P).select("person", "location", "start_ts", "end_ts", r("lat").alias("lat"), "distance")


@query(
    "a11_tracker_days",
    """SELECT l_linenumber % 3 AS person, CAST(l_shipdate AS DATE) AS day, CAST(sum(l_quantity) * 100 AS BIGINT) AS calories, count(*) * 1000 AS steps, count(*) + 0.5::DOUBLE AS distance FROM lineitem GROUP BY 1, 2""",
)
def tracker(spark, sf):
    li = table(spark, sf, "lineitem")
    days = li.groupBy((F.col("l_linenumber") % 3).alias("person"), F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    blank = F.lit("0")
    cells = days.select(
        "person",
        F.date_format("d", "dd-MM-yyyy").alias("date"),
        F.format_number(F.col("q") * 100, 0).alias("calories"),
        F.format_number(F.col("n") * 1000, 0).alias("steps"),
        F.regexp_replace((F.col("n") + 0.5).cast("string"), r"\.", ",").alias("distance"),
        *[blank.alias(c) for c in ("floors", "sedentary", "light", "fair", "very", "activity_calories")],
    )
    return cx.tracker_days(cells, P).select("person", "day", "calories", "steps", "distance")


@query("a12_walking_days", f"SELECT event_id % 4 AS person, CAST(ts AS DATE) AS day, CAST(arg_max({KEY}, event_id) AS DOUBLE) AS steps FROM events WHERE event_type = 'view' GROUP BY 1, 2")
def walking(spark, sf):
    activity = F.when(F.col("event_type") == "view", "walking").otherwise("transport")
    cells = events(spark, sf).select("person", F.to_date("ts").alias("day"), activity.alias("activity"), F.col("k").cast("string").alias("steps"), "event_id")
    return cx.walking_days(cells, ["event_id"], P)


@query("a13_daily_column", "SELECT o_custkey % 4 AS person, CAST(o_orderdate AS DATE) AS day, CASE WHEN count(*) % 4 = 0 THEN 0 ELSE count(*) END::DOUBLE AS steps FROM orders GROUP BY 1, 2")
def column(spark, sf):
    days = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 4).alias("person"), F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    cells = days.select("person", F.col("d").cast("string").alias("date"), F.when(F.col("n") % 4 == 0, "").otherwise(F.col("n").cast("string")).alias("v"))
    return cx.daily_column(cells, "date", "v", keys=P)


@query("a14_minute_totals", f"SELECT event_id % 4 AS person, CAST(ts AS DATE) AS day, CAST(sum({KEY}) FILTER (event_type <> 'error') AS DOUBLE) AS steps, CAST(count(*) * 2 AS DOUBLE) AS calories FROM events GROUP BY 1, 2")
def minutes(spark, sf):
    steps = F.when(F.col("event_type") == "error", "").otherwise(F.col("k").cast("string"))
    cells = events(spark, sf).select("person", F.date_format("ts", "yyyy-MM-dd HH:mm'Z'").alias("date"), steps.alias("steps"), F.lit("2").alias("calories"))
    return cx.minute_totals(cells, keys=P)


def _use(spark, sf, kinds):
    machine = F.col("user_id") % 3 + 1
    fmt = F.when(machine == 1, F.date_format("ts", "dd/MM/yyyy HH:mm")).otherwise(F.date_format("ts", "M/d/yyyy HH:mm"))
    name = F.when(F.col("event_type").isin(*kinds), "Active").otherwise("Away")
    length = F.concat(F.floor(F.col("k") / 60).cast("string"), F.lit(":"), F.lpad((F.col("k") % 60).cast("string"), 2, "0"))
    return events(spark, sf).select("person", machine.alias("machine"), name.alias("name"), fmt.alias("start"), length.alias("duration"))


@query(
    "a15_computer_minutes",
    f"""SELECT event_id % 4 AS person, CAST(ts AS DATE) AS day, {', '.join(f"CAST(coalesce(sum({KEY}) FILTER (user_id % 3 = {m - 1}), 0) AS BIGINT) AS computer_{m}" for m in (1, 2, 3))}, CAST(sum({KEY}) AS BIGINT) AS computer_total
FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2""",
)
def computer(spark, sf):
    return cx.computer_minutes(_use(spark, sf, ["view", "click"]), [1, 2, 3], keys=P)


@query(
    "a16_screen_delta",
    f"""WITH a AS (SELECT event_id % 4 AS person, CAST(ts AS DATE) AS day, CAST(sum({KEY}) AS BIGINT) AS t FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2), b AS (SELECT event_id % 4 AS person, CAST(ts AS DATE) AS day, CAST(sum({KEY}) AS BIGINT) AS t FROM events WHERE event_type = 'error' GROUP BY 1, 2)
SELECT person, day, a.t - coalesce(b.t, 0) AS delta FROM a LEFT JOIN b USING (person, day)""",
)
def screen(spark, sf):
    active = cx.computer_minutes(_use(spark, sf, ["view", "click"]), [1, 2, 3], keys=P)
    blank = cx.computer_minutes(_use(spark, sf, ["error"]), [1, 2, 3], keys=P)
    return cx.screen_delta(active, blank, P).select("person", "day", "delta")


@query("a17_blank_screen_lines", "SELECT event_id, 'Blank Screen Saver,' || user_id AS value FROM events WHERE event_type = 'error'")
def blank_lines(spark, sf):
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("Blank Screen Saver,"), "user_id")).otherwise(F.concat(F.lit("Editor,"), "user_id"))
    return cx.blank_screen_lines(events(spark, sf).select("event_id", text.alias("value")))


@query(
    "a18_key_counts",
    f"""WITH p AS (SELECT event_id % 4 AS person, CAST(ts AS DATE) AS day, user_id % 2 AS m, arg_max({KEY} * 10, event_id) AS keys, arg_max({KEY}, event_id) AS clicks FROM events GROUP BY 1, 2, 3)
SELECT person, day, CAST(coalesce(sum(keys + clicks) FILTER (m = 0), 0) AS DOUBLE) AS machine_0, CAST(coalesce(sum(keys + clicks) FILTER (m = 1), 0) AS DOUBLE) AS machine_1, CAST(sum(keys) AS DOUBLE) AS keys, CAST(sum(clicks) AS DOUBLE) AS clicks, CAST(sum(keys + clicks) AS DOUBLE) AS total FROM p GROUP BY 1, 2""",
)
def keys(spark, sf):
    cells = events(spark, sf).select(
        "person", F.date_format("ts", "yyyy-MM-dd").alias("date"), (F.col("user_id") % 2).alias("machine"),
        (F.col("k") * 10).cast("string").alias("keys"), F.col("k").cast("string").alias("clicks"), "event_id",
    )
    return cx.key_counts(cells, [0, 1], ["event_id"], P)


@query(
    "a19_carry_dates",
    "SELECT event_id, CAST(ts AS DATE) AS day FROM events",
)
def carry(spark, sf):
    # a log in event order that writes the day once, when it changes
    chunk = F.floor(F.col("event_id") / 1000).cast("long")
    ev = ordered.scan(events(spark, sf), ["user_id"], ["event_id"], chunk, before={"p": "ts"})

    def part(fn):
        first = F.col("p").isNull() | (F.to_date("p") != F.to_date("ts"))
        return F.when(first, fn("ts").cast("string")).otherwise("")

    cells = ev.select("user_id", "event_id", part(F.year).alias("year"), part(F.month).alias("month"), part(F.dayofmonth).alias("day_of_month"))
    return ml.carry_dates(cells, ["event_id"], ["user_id"], 1000).select("event_id", "day")


REGIONS = {"view": "knee", "click": "arm"}


@query(
    "a20_pain_columns",
    """SELECT event_id % 4 AS person, CAST(ts AS DATE) AS day, arg_max(value, event_id) FILTER (event_type = 'view') AS knee, arg_max(value, event_id) FILTER (event_type = 'click') AS arm, arg_max(value, event_id) FILTER (event_type NOT IN ('view', 'click')) AS other FROM events GROUP BY 1, 2""",
)
def pain(spark, sf):
    rows = events(spark, sf).select("person", F.to_date("ts").alias("day"), "event_type", F.col("value").cast("string").alias("v"), "event_id")
    return ml.pain_columns(rows, "event_type", "v", REGIONS, "other", ["event_id"], P)


@query(
    "a21_named_pain_days",
    """WITH w AS (SELECT event_id % 4 AS person, date_trunc('hour', ts) AS h, arg_min(value, event_id) FILTER (event_type = 'view') AS v, arg_min(value, event_id) FILTER (event_type = 'click') AS c FROM events GROUP BY 1, 2)
SELECT person, CAST(h AS DATE) - 1 AS day, round(avg(v) + 1e-7, 5) AS kneepain, round(avg(c) + 1e-7, 5) AS armpain FROM w GROUP BY 1, 2""",
)
def named(spark, sf):
    name = F.when(F.col("event_type") == "view", "Knee Pain").when(F.col("event_type") == "click", "Arm Pain")
    rows = events(spark, sf).select("person", F.date_trunc("hour", "ts").alias("ts"), name.alias("name"), F.col("value").alias("intensity"), "event_id")
    out = cx.named_pain_days(rows, ["Knee Pain", "Arm Pain"], ["event_id"], shift_days=1, keys=P)
    return out.select("person", "day", r(F.col("kneepain") + 1e-7, 5).alias("kneepain"), r(F.col("armpain") + 1e-7, 5).alias("armpain"))


@query(
    "a22_sport_flags",
    f"""SELECT event_id % 4 AS person, CAST(ts AS DATE) AS day, CAST(max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS DOUBLE) AS climbing, CAST(max(CASE WHEN event_type = 'click' AND user_id = 8 THEN 1 ELSE 0 END) AS DOUBLE) AS surfing,
  CAST(sum(CASE WHEN event_type = 'view' AND {KEY} % 2 = 0 THEN {KEY} ELSE 0 END) AS DOUBLE) AS climbing_height FROM events GROUP BY 1, 2""",
)
def sport(spark, sf):
    label = F.when(F.col("event_type") == "view", "Climbing").when((F.col("event_type") == "click") & (F.col("user_id") == 8), "Surfing").otherwise("Rest")
    cell = F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).otherwise("?")
    rows = events(spark, sf).select("person", F.to_date("ts").alias("day"), label.alias("label"), cell.alias("height"))
    return ml.sport_flags(rows, "label", {"Climbing": "climbing", "Surfing": "surfing"}, {"climbing_height": ("Climbing", "height")}, P)


@query(
    "a23_eye_activities",
    f"SELECT event_id % 4 AS person, CAST(ts AS DATE) AS day, CAST(arg_max({KEY} * 2, event_id) AS DOUBLE) AS eye_total, CAST(arg_max({KEY} + 1, event_id) AS DOUBLE) AS driving, CAST(0 AS DOUBLE) AS scooter FROM events GROUP BY 1, 2",
)
def eyes(spark, sf):
    k = F.col("k").cast("string")
    rows = events(spark, sf).select("person", F.to_date("ts").alias("day"), k.alias("c1"), k.alias("c2"), F.lit("").alias("c3"), F.lit(None).cast("string").alias("c4"), (F.col("k") + 1).cast("string").alias("c5"), "event_id")
    return ml.eye_activities(rows, ["c1", "c2", "c3", "c4"], "c5", ["c3", "c4"], ["event_id"], P)


@query(
    "a24_mood_days",
    f"""WITH s AS (SELECT event_id % 4 AS person, CAST(ts AS DATE) AS day, event_id, CASE event_type WHEN 'view' THEN 9 WHEN 'click' THEN 7 WHEN 'error' THEN 3 ELSE 5.5 END + CASE {KEY} % 3 WHEN 0 THEN 0.33 WHEN 1 THEN -0.33 ELSE 0 END AS s FROM events)
SELECT person, day, CAST(arg_max(s, event_id) AS DOUBLE) AS mood FROM s GROUP BY 1, 2""",
)
def mood(spark, sf):
    label = ex.lookup("event_type", {"view": "Really Good", "click": "Fine", "error": "Depressed"}, "hm")
    mark = F.when(F.col("k") % 3 == 0, "+").when(F.col("k") % 3 == 1, "-").otherwise("")
    rows = events(spark, sf).select("person", F.to_date("ts").alias("day"), label.alias("label"), mark.alias("mark"), "event_id")
    return ml.mood_days(rows, ex.mood_score("label", "mark"), ["event_id"], P)


@query(
    "a24_mood_words",
    "SELECT event_id, CASE event_type WHEN 'view' THEN 8 WHEN 'click' THEN 5 WHEN 'error' THEN 1 END AS mood FROM events",
)
def mood_words(spark, sf):
    label = ex.lookup("event_type", {"view": "Really Good", "click": "Variable but mostly good", "error": "Depressed"}, "hm")
    return events(spark, sf).select("event_id", ex.lookup(label, vocab.MOOD_1_TO_8).alias("mood"))


@query(
    "a27_complaint_days",
    "SELECT event_id % 4 AS person, CAST(ts AS DATE) AS day, max(value) FILTER (event_type = 'view') AS headache, max(value) FILTER (event_type = 'click') AS fatigue FROM events GROUP BY 1, 2",
)
def complaints(spark, sf):
    top = events(spark, sf).groupBy("person", F.to_date("ts").alias("d"), "event_type").agg(F.max("value").alias("v"))
    cells = top.select("person", F.col("d").cast("string").alias("date"), F.col("event_type").alias("name"), F.col("v").cast("string").alias("intensity"))
    return cx.complaint_days(cells, {"view": "headache", "click": "fatigue"}, P)


@query(
    "a26_stored_gain",
    f"""WITH d AS (SELECT event_id % 4 AS person, CAST(ts AS DATE) AS day, max({KEY}) AS k FROM events GROUP BY 1, 2)
SELECT person, day, CAST(CASE WHEN day(day) % 2 = 0 THEN k ELSE 1 END AS DOUBLE) AS cycling, CAST(CASE WHEN day(day) % 2 = 0 AND k % 3 = 0 THEN k ELSE 2 END AS DOUBLE) AS walking FROM d""",
)
def stored(spark, sf):
    days = events(spark, sf).groupBy("person", F.to_date("ts").alias("day")).agg(F.max("k").cast("double").alias("k"))
    data = days.select("person", "day", F.lit(1.0).alias("cycling"), F.lit(2.0).alias("walking"))
    kept = days.where(F.dayofmonth("day") % 2 == 0)
    text = F.col("k").cast("string")
    cells = kept.select("person", F.col("day").cast("string").alias("day"), text.alias("cycling"), F.when(F.col("k") % 3 == 0, text).otherwise("-").alias("walking"))
    saved = cx.stored_days(cells, ["cycling", "walking"], P)
    return cal.update_from(cal.combine_first(data, saved, [*P, "day"]), saved, [*P, "day"])


@query(
    "a30_phone_days",
    f"SELECT person, day, CAST(sum({KEY}) AS BIGINT) AS minutes FROM (SELECT event_id % 4 AS person, CAST(ts AS DATE) AS day, max(CAST(ts AS DATE)) OVER (PARTITION BY event_id % 4) AS last, props FROM events WHERE event_type <> 'error') WHERE day < last GROUP BY 1, 2",
)
def phone(spark, sf):
    clock = F.format_string("%02d:%02d:30", F.floor(F.col("k") / 60), F.col("k") % 60)
    date = F.when(F.col("event_type") == "error", "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    rows = events(spark, sf).withColumn("u", F.concat(F.lit("export"), "person"))
    body = rows.select("person", F.col("u").alias("_file"), F.lit(1).alias("_block"), F.col("event_id").alias("_line"), F.concat_ws(",", date, clock).alias("value"))
    top = rows.groupBy("person", "u").agg(F.lit('"Date","Usage time"').alias("value")).select("person", F.col("u").alias("_file"), F.lit(0).alias("_block"), F.lit(0).cast("long").alias("_line"), "value")
    return cx.phone_days(body.unionByName(top), P)


@query("a02_track_points", f"SELECT user_id % 3 AS person, 'track ' || user_id AS file, ts AS time, {KEY} / 8.0::DOUBLE AS lon, {KEY} / 16.0::DOUBLE AS lat, CASE WHEN event_type <> 'error' THEN value END AS elevation FROM events")
def points(spark, sf):
    raw = events(spark, sf).select(
        (F.col("user_id") % 3).alias("person"), F.concat(F.lit("track "), "user_id").alias("file"), F.col("ts").alias("time"),
        (F.col("k") / 8.0).alias("_lon"), (F.col("k") / 16.0).alias("_lat"), F.when(F.col("event_type") != "error", F.col("value")).alias("ele"),
    )
    found = tr.track_points(raw, P)
    return found.where(F.col("lat_lon.lat").eqNullSafe(F.col("lat"))).drop("lat_lon")


@query(
    "a05_last_files",
    "SELECT user_id % 3 AS person, max('/data/person' || (user_id % 3) || '/' || event_type || '-' || lpad(event_id::VARCHAR, 8, '0') || '.json') AS path FROM events WHERE event_type IN ('view', 'click') AND event_id % 2 = 0 GROUP BY 1",
)
def last_files(spark, sf):
    name = F.concat(F.lit("/data/person"), (F.col("user_id") % 3).cast("string"), F.lit("/"), "event_type", F.lit("-"), F.lpad(F.col("event_id").cast("string"), 8, "0"), F.when(F.col("event_id") % 2 == 0, ".json").otherwise(".csv"))
    found = files.matching(events(spark, sf).select(name.alias("path")), ".json", "ie").unionByName(files.matching(events(spark, sf).select(name.alias("path")), ".json", "click-"))
    keyed = found.withColumn("person", files.person_in_path(r"/person(\d+)/", "path").cast("long"))
    return files.last_file(keyed, P)


@query("a06_api_steps", f"SELECT event_id % 4 AS person, CAST(ts AS DATE) AS day, CASE WHEN event_type <> 'error' THEN CAST({KEY} AS DOUBLE) END AS steps FROM events")
def api(spark, sf):
    text = F.when(F.col("event_type") == "error", "none").otherwise(F.col("k").cast("string"))
    item = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("dateTime"), text.alias("value"))
    docs = events(spark, sf).groupBy("person", F.to_date("ts").alias("d")).agg(F.collect_list(item).alias("activities-steps"))
    return jx.api_steps(docs, P)


@query("a08_device_summaries", f"SELECT event_id % 4 AS person, CAST(ts AS DATE) AS day, CAST(sum({KEY}) AS DOUBLE) AS calories, CAST(count(*) AS DOUBLE) AS steps, max(value) AS distance FROM events GROUP BY 1, 2")
def summaries(spark, sf):
    raw = events(spark, sf).groupBy("person", F.date_format("ts", "yyyy-MM-dd").alias("calendarDate")).agg(
        F.sum("k").cast("double").alias("totalKilocalories"), F.count(F.lit(1)).cast("double").alias("totalSteps"), F.max("value").alias("totalDistanceMeters")
    )
    return jx.device_summaries(raw, P)


@query("a09_device_activities", f"SELECT event_id % 4 AS person, event_type AS sport, value AS distance, date_trunc('milliseconds', ts) AS start_ts FROM events")
def exported(spark, sf):
    item = F.struct(F.col("event_type").alias("sportType"), F.col("value").alias("distance"), F.floor(F.unix_micros("ts") / 1000).cast("double").alias("startTimeLocal"))
    docs = events(spark, sf).groupBy("person", F.to_date("ts").alias("d")).agg(F.collect_list(item).alias("summarizedActivitiesExport"))
    return jx.device_activities(docs, P).select("person", F.col("sportType").alias("sport"), "distance", "start_ts")


@query(
    "a25_altitude_traces",
    f"""WITH n AS (SELECT event_id % 4 AS person, CAST(ts AS DATE) AS day, event_id, {KEY} * 200 AS z, row_number() OVER (PARTITION BY event_id % 4, CAST(ts AS DATE) ORDER BY event_id) AS n FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY person, day ORDER BY event_id DESC) AS b FROM n WHERE n > 6 AND z > 1 AND z < 10000),
d AS (SELECT person, day, z - lag(z) OVER (PARTITION BY person, day ORDER BY event_id) AS d FROM g WHERE b > 2)
SELECT person, day, CAST(coalesce(sum(greatest(d, 0)) FILTER (d IS NOT NULL), 0) AS DOUBLE) AS gain FROM d GROUP BY 1, 2""",
)
def traces(spark, sf):
    ev = events(spark, sf).withColumn("day", F.to_date("ts"))
    value = F.concat(F.repeat(F.lit("x,"), 10), (F.col("k") * 200).cast("string"), F.lit(",y"))
    lines = ev.select("person", "day", F.concat_ws("|", "person", "day").alias("_file"), F.lit(0).alias("_block"), F.col("event_id").alias("_line"), value.alias("value"))
    return tr.altitude_traces(lines, 6, 11, P)


@query("a28_diary", "SELECT event_id % 4 AS person, CAST(ts AS DATE) AS day, 'note ' || lower(event_type) AS text FROM events")
def diary(spark, sf):
    cells = events(spark, sf).select("person", F.concat(F.lit("Note "), F.upper("event_type")).alias("text"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"))
    return cx.diary(cells, P)


@query("a29_taps", "SELECT event_id % 4 AS person, date_trunc('second', ts) AS ts, event_type AS label FROM events WHERE event_type <> 'error'")
def tap_log(spark, sf):
    stamp = F.when(F.col("event_type") == "error", "timestamp").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    cells = events(spark, sf).select("person", stamp.alias("timestamp"), F.lit("x").alias("cat1"), F.col("event_type").alias("cat2"))
    return cx.taps(cells, P)


@query("a32_manual_fill", f"SELECT event_id % 4 AS person, CAST(ts AS DATE) AS day, CAST(sum({KEY}) AS DOUBLE) AS steps, CASE WHEN count(*) % 2 = 0 THEN CAST(count(*) AS DOUBLE) END AS pain FROM events GROUP BY 1, 2")
def manual_fill(spark, sf):
    days = events(spark, sf).groupBy("person", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum("k").cast("string").alias("steps"), F.count(F.lit(1)).alias("n"))
    cells = days.select("person", "day", "steps", F.when(F.col("n") % 2 == 0, F.col("n").cast("string")).otherwise("?").alias("pain"))
    heads = days.select("person").distinct().select("person", F.lit("day").alias("day"), F.lit("steps").alias("steps"), F.lit("pain").alias("pain"))
    return cx.stored_days(cells.unionByName(heads), ["steps", "pain"], P)


@query(
    "a33_log_table",
    f"""SELECT user_id, CAST(ts AS DATE) AS day, CAST(arg_min(CASE WHEN event_type = 'error' THEN 0 ELSE {KEY} END, event_id) AS DOUBLE) AS amount, CAST(epoch(date_trunc('minute', min(ts))) AS BIGINT) AS start_time, CAST(epoch(date_trunc('minute', min(ts))) AS BIGINT) + 86400 AS end_time FROM events GROUP BY 1, 2""",
)
def log_table(spark, sf):
    amount = F.when(F.col("event_type") == "error", " ").otherwise(F.col("k").cast("string"))
    text = F.date_format("ts", "dd/MM/yyyy HH:mm")
    cells = events(spark, sf).select("user_id", F.to_date("ts").alias("day"), amount.alias("amount"), text.alias("from"), "event_id")
    out = ml.load_log_table(
        cells, ["user_id", "day"], ["event_id"], ["amount"],
        start=("from", "dd/MM/yyyy HH:mm"), end=("from", "dd/MM/yyyy HH:mm"), day_shift={"end_time": 1},
    )
    return out.select("user_id", "day", "amount", "start_time", "end_time")


@query(
    "a34_shift_by_id",
    "SELECT event_id, CASE WHEN event_id BETWEEN 0 AND 2000 THEN ts + INTERVAL 2 HOUR WHEN event_id BETWEEN 2001 AND 5000 THEN ts - INTERVAL 90 MINUTE ELSE ts END AS ts FROM events",
)
def shift(spark, sf):
    return ml.shift_by_id(events(spark, sf), "event_id", "ts", [(0, 2000, 2.0), (2001, 5000, -1.5)]).select("event_id", "ts")


@query("sink_export_slice", "SELECT CAST(ts AS DATE) AS day, max(value) FILTER (event_type = 'view') AS a, max(value) FILTER (event_type = 'click' AND user_id < 20) AS b FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1 HAVING a IS NOT NULL OR b IS NOT NULL")
def export(spark, sf):
    v = F.col("value")
    days = events(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(
        F.max(F.when(F.col("event_type") == "view", v)).alias("a"),
        F.max(F.when((F.col("event_type") == "click") & (F.col("user_id") < 20), v)).alias("b"),
    )
    return sinks.export_slice(days, "2024-01-05", "2024-01-20", ["a", "b"])
