"""Queries for the scalar expressions."""

from pyspark.sql import functions as F

from dayweave.functions import expressions as ex
from dayweave.functions import vocab
from dayweave.operators import calendar as cal
from dayweave.operators import scaling
from dayweave.plans.base import DAILY, DEVICES, SPARSE, daily, devices, r, sparse_daily, table
from dayweave.plans.registry import query

# Keyword map that matches the generated documents, in matching order.
TEXT_TOPICS = {
    "license": ["license", "copyright"],
    "contact": ["@", "http"],
    "cookie": ["cookie", "subscribe"],
    "the": [" the "],
    "la": [" la ", " le "],
}


def _sql_topics(col):
    parts = []
    for name, words in TEXT_TOPICS.items():
        cond = " OR ".join(f"contains({col}, '{w}')" for w in words)
        parts.append(f"CASE WHEN {cond} THEN '{name}' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


ACTIVITY = {"view": "walking", "click": "cycling", "purchase": "swimming", "signup": "rock_climbing"}


@query(
    "c01_pain_recode",
    f"""WITH {SPARSE}, x AS (SELECT entity, day, round(pain / 400, 1) + 1.5 AS p FROM sparse)
SELECT entity, day, p, CASE WHEN p < 2.5 THEN 1.0 WHEN p < 3 THEN 2.0 WHEN p < 3.3 THEN 4.0 WHEN p = 3.3 THEN 7.0
  WHEN p <= 3.5 THEN 8.0 WHEN p IS NOT NULL THEN 10.0 END::DOUBLE AS effect, CASE WHEN p > 3.5 THEN 3.5 ELSE p END AS capped FROM x""",
)
def pain_recode(spark, sf):
    df = sparse_daily(spark, sf).select("entity", "day", (F.round(F.col("pain") / 400, 1) + 1.5).alias("p"))
    return df.select("*", ex.pain_recode("p").alias("effect"), ex.cap("p", 3.5).alias("capped"))


@query(
    "c02_row_max",
    f"WITH {SPARSE} SELECT entity, day, round(greatest(a * 100, pain), 6) AS worst FROM sparse",
)
def row_max(spark, sf):
    df = sparse_daily(spark, sf).withColumn("a", F.col("a") * 100)
    return df.select("entity", "day", r(ex.row_max(["a", "pain"])).alias("worst"))


@query(
    "c03_row_mean_and_max",
    f"WITH {DAILY} SELECT entity, day, round((a + b + pain) / 3, 6) AS mean3, round(greatest(a, b, pain), 6) AS max3 FROM daily",
)
def mean_and_max(spark, sf):
    cols = ["a", "b", "pain"]
    return daily(spark, sf).select("entity", "day", r(ex.mean_of(cols)).alias("mean3"), r(ex.row_max(cols)).alias("max3"))


@query(
    "c04_corrected_steps",
    f"""WITH {DEVICES} SELECT entity, day, greatest(main - 37 * (lines % 5) - lines - 3, 0) AS steps FROM devices""",
)
def steps(spark, sf):
    df = devices(spark, sf).withColumn("swim", F.lit(3.0))
    return df.select("entity", "day", ex.corrected_steps("main", F.col("lines") % 5, "lines", "swim").alias("steps"))


@query(
    "c05_active_calories",
    """SELECT event_id, round((value - 20) / 4.19002, 6) AS kcal, round(value - 2039.0::DOUBLE / 1440.0::DOUBLE * CAST(json_extract_string(props, '$.k') AS BIGINT), 6) AS net,
  round(3.3::DOUBLE * CAST(json_extract_string(props, '$.k') AS BIGINT), 6) AS jump FROM events""",
)
def calories(spark, sf):
    ev = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return ev.select(
        "event_id",
        r(ex.active_calories("value", F.lit(20.0))).alias("kcal"),
        r(ex.active_calories_from_minutes("value", "k")).alias("net"),
        r(ex.jump_calories("k")).alias("jump"),
    )


_ROUTED = """CASE WHEN sport IN ('cycling', 'swimming') THEN sport
    WHEN sport IN ('other', 'rock_climbing', 'bouldering', 'climbing', 'generic') THEN
      CASE WHEN contains(lower(name), 'cliff jumping') THEN 'cliff' WHEN contains(lower(name), 'backcountry skiing') THEN 'ski' ELSE 'climbing' END
    ELSE 'none' END"""


@query(
    "c06_activity_routing",
    f"""WITH e AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'cycling' WHEN 'click' THEN 'generic' WHEN 'purchase' THEN 'walking' ELSE
   CASE WHEN user_id % 2 = 0 THEN 'swimming' ELSE 'climbing' END END AS sport,
  CASE user_id % 3 WHEN 0 THEN 'Cliff Jumping day' WHEN 1 THEN 'Backcountry Skiing' END AS name FROM events)
SELECT {_ROUTED} AS bucket, count(*) AS n FROM e GROUP BY 1""",
)
def routing(spark, sf):
    ev = table(spark, sf, "events").select(
        ex.lookup("event_type", {"view": "cycling", "click": "generic", "purchase": "walking"}, "fitness_equipment").alias("sport"),
        F.when(F.col("user_id") % 2 == 0, "swimming").otherwise("climbing").alias("sub_sport"),
        F.when(F.col("user_id") % 3 == 0, "Cliff Jumping day").when(F.col("user_id") % 3 == 1, "Backcountry Skiing").alias("name"),
    )
    return ev.groupBy(ex.activity_bucket("sport", "sub_sport", "name").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "c07_region_calories",
    """WITH x AS (SELECT user_id AS entity, CAST(ts AS DATE) AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / 100 AS total,
  coalesce(CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'view') AS BIGINT), 0) / 100 AS swim,
  coalesce(CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'click') AS BIGINT), 0) / 100 AS climb,
  coalesce(CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'error') AS BIGINT), 0) / 100 AS cyc,
  coalesce(CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'signup') AS BIGINT), 0) / 100 AS cliff FROM events GROUP BY 1, 2)
SELECT entity, day, round(total - swim - 0.75 * climb + 0.5 * cliff - 0.25 * cyc, 6) AS knee, round(swim + 0.75 * climb + 0.1 * cyc + 0.5 * cliff + 0.25 * cyc, 6) AS arm FROM x""",
)
def regions(spark, sf):
    cents = F.round(F.col("value") * 100).cast("long")

    def part(kind):
        return F.coalesce(F.sum(F.when(F.col("event_type") == kind, cents)), F.lit(0)) / F.lit(100.0)

    x = table(spark, sf, "events").groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("day")).agg(
        (F.sum(cents) / F.lit(100.0)).alias("total"),
        part("view").alias("swim"),
        part("click").alias("climb"),
        part("error").alias("cyc"),
        part("signup").alias("cliff"),
    )
    return x.select(
        "entity",
        "day",
        r(ex.knee_calories("total", "swim", "climb", "cliff", "cyc")).alias("knee"),
        r(ex.arm_calories("swim", "climb", "cyc", "cliff", "cyc")).alias("arm"),
    )


@query(
    "c08_saturate",
    "SELECT event_id, round(least(value / 250, 1), 6) AS level, round(least(value / 250, 1) - 2, 6) AS shifted FROM events",
)
def saturate(spark, sf):
    x = ex.saturate("value")
    return table(spark, sf, "events").select("event_id", r(x).alias("level"), r(x - 2).alias("shifted"))


@query("c09_unit_scaling", "SELECT event_id, round(value * (300.0::DOUBLE / 14000.0::DOUBLE), 6) AS a, round(value * 0.3::DOUBLE, 6) AS b FROM events")
def units(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", r(ex.rescale("value", 300, 14000)).alias("a"), r(ex.rescale("value", 300, 1000)).alias("b")
    )


@query(
    "c10_split_between",
    """SELECT event_id, CASE WHEN user_id % 2 = 1 AND user_id % 3 = 1 THEN value / 2 WHEN user_id % 2 = 1 THEN value ELSE 0 END AS surf,
  CASE WHEN user_id % 2 = 1 AND user_id % 3 = 1 THEN value / 2 WHEN user_id % 3 = 1 THEN value ELSE 0 END AS swim FROM events""",
)
def split(spark, sf):
    ev = table(spark, sf, "events")
    surf, swim = ex.split_between("value", F.col("user_id") % 2, (F.col("user_id") % 3 == 1).cast("int"))
    return ev.select("event_id", surf.alias("surf"), swim.alias("swim"))


@query(
    "c11_time_parts",
    """SELECT event_id, hour(ts) * 60 + minute(ts) AS minutes, date_trunc('second', ts) AS from_s,
  date_trunc('milliseconds', ts) AS from_ms, ts AS from_ns FROM events""",
)
def time_parts(spark, sf):
    ev = table(spark, sf, "events")
    us = F.unix_micros("ts")
    return ev.select(
        "event_id",
        ex.clock_to_minutes(F.date_format("ts", "HH:mm:ss")).alias("minutes"),
        ex.epoch_to_timestamp(F.floor(us / 1_000_000), "s").alias("from_s"),
        ex.epoch_to_timestamp(F.floor(us / 1000), "ms").alias("from_ms"),
        ex.epoch_to_timestamp(us * 1000, "ns").alias("from_ns"),
    )


@query(
    "c12_local_time",
    """SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE (CASE WHEN user_id % 2 = 0 THEN 'Europe/Paris' ELSE 'America/New_York' END) AS local FROM events""",
)
def local_time(spark, sf):
    zone = F.when(F.col("user_id") % 2 == 0, "Europe/Paris").otherwise("America/New_York")
    return table(spark, sf, "events").select("event_id", ex.local_time("ts", zone).alias("local"))


@query("c13_round_to_second", "SELECT event_id, date_trunc('second', ts + INTERVAL 500 MILLISECOND) AS ts FROM events")
def to_second(spark, sf):
    return table(spark, sf, "events").select("event_id", ex.round_to_second("ts").alias("ts"))


@query(
    "c14_text_categories",
    f"""WITH x AS (SELECT doc_id AS id, lower(text) AS t FROM documents)
SELECT id, array_to_string({_sql_topics('t')}, '|') AS topics, {_sql_topics('t')}[-1] AS last_topic FROM x""",
)
def text_categories(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("t"))
    found = docs.select("id", ex.categories("t", TEXT_TOPICS).alias("hits"))
    return found.select(
        "id", F.concat_ws("|", "hits").alias("topics"), F.try_element_at("hits", F.lit(-1)).alias("last_topic")
    )


@query(
    "c15_ordinal_rating",
    f"""WITH x AS (SELECT conv_id, turn, lower(text) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(t, 'not great') OR contains(t, 'blah') OR contains(t, 'not a great') THEN 0
  WHEN contains(t, 'up and down') THEN 1
  WHEN contains(t, 'average') OR contains(t, 'ok') THEN 2
  WHEN contains(t, 'pretty good') OR contains(t, 'reasonably good') THEN 3
  WHEN contains(t, 'good') THEN 4 WHEN contains(t, 'awesome') OR contains(t, 'great') THEN 5 END AS code FROM x""",
)
def ordinal(spark, sf):
    rating = ex.last_category(F.lower("text"), vocab.RATING_WORDS)
    return table(spark, sf, "conversations").select("conv_id", "turn", ex.lookup(rating, vocab.RATING_ORDINAL).alias("code"))


@query(
    "c16_one_hot",
    f"""WITH x AS (SELECT doc_id AS id, {_sql_topics('lower(text)')} AS t FROM documents)
SELECT id, {', '.join(f"len(list_filter(t, lambda v: v = '{n}')) AS has_{n}" for n in TEXT_TOPICS)} FROM x""",
)
def one_hot(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    docs = docs.select("id", ex.categories("text", TEXT_TOPICS).alias("t"))
    return docs.select("id", *ex.one_hot("t", list(TEXT_TOPICS), "has_"))


@query(
    "c17_motion_ratios",
    """WITH x AS (SELECT l_orderkey AS ok, l_linenumber AS ln, CASE WHEN l_tax > 0.02 THEN l_extendedprice END AS d1, CASE WHEN l_tax > 0 THEN l_extendedprice * 1.1 END AS d2,
  l_quantity AS steps, l_discount * 100 AS secs FROM lineitem)
SELECT ok, ln, coalesce(d1, d2) / nullif(steps, 0) AS step_length, steps / nullif(secs, 0) AS step_rate,
  coalesce(d1, d2) / nullif(secs, 0) AS speed, 60 * steps / nullif(secs, 0) AS per_min, (d2 - d1) / nullif(d1, 0) AS gap FROM x""",
)
def motion(spark, sf):
    x = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("ln"),
        F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice")).alias("d1"),
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice") * 1.1).alias("d2"),
        F.col("l_quantity").alias("steps"),
        (F.col("l_discount") * 100).alias("secs"),
    )
    d = ex.first_known("d1", "d2")
    return x.select(
        "ok",
        "ln",
        ex.ratio(d, "steps").alias("step_length"),
        ex.ratio("steps", "secs").alias("step_rate"),
        ex.ratio(d, "secs").alias("speed"),
        ex.ratio(F.col("steps") * 60, "secs").alias("per_min"),
        ex.disagreement("d2", "d1").alias("gap"),
    )


@query(
    "c18_change",
    f"""WITH {DAILY} SELECT entity, day, round(b - lag(b) OVER w, 6) AS change, round(b / nullif(lag(b) OVER w, 0) - 1, 6) AS pct FROM daily WINDOW w AS (PARTITION BY entity ORDER BY day)""",
)
def change(spark, sf):
    out = scaling.changes(daily(spark, sf), ["entity"], ["b"])
    return out.select("entity", "day", r("b_change").alias("change"), r("b_pct_change").alias("pct"))


@query(
    "c19_drop_unusable",
    f"WITH {DAILY} SELECT entity, day, a, round(b, 6) AS b FROM daily WHERE a <> 0 AND b <> 0",
)
def usable(spark, sf):
    return daily(spark, sf).where(ex.is_usable("a", "b")).select("entity", "day", "a", r("b").alias("b"))


@query(
    "c20_fill_with_mean",
    f"""WITH {SPARSE} SELECT entity, day, round(coalesce(pain, avg(pain) OVER (PARTITION BY entity)), 6) AS pain, coalesce(a, 0) AS a FROM sparse""",
)
def fill_mean(spark, sf):
    out = scaling.fill_with_mean(sparse_daily(spark, sf), ["entity"], ["pain"]).fillna({"a": 0.0})
    return out.select("entity", "day", r("pain").alias("pain"), "a")


@query(
    "c21_date_from_parts",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders",
)
def date_parts(spark, sf):
    o = table(spark, sf, "orders")
    parts = [F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), F.dayofmonth("o_orderdate").cast("string")]
    return o.select("o_orderkey", ex.date_from_parts(*parts).alias("day"))


@query(
    "c22_interval_from_parts",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('minute', ts) END AS start_ts,
  CASE WHEN event_type <> 'error' THEN date_trunc('minute', ts) + to_minutes(CAST(json_extract_string(props, '$.k') AS BIGINT)) END AS end_ts FROM events""",
)
def interval_parts(spark, sf):
    ev = table(spark, sf, "events")
    clock = F.when(F.col("event_type") == "error", "taplog").otherwise(F.date_format("ts", "HH:mm"))
    start, end = ex.interval_from_parts(F.date_format("ts", "yyyy-MM-dd"), clock, F.get_json_object("props", "$.k"))
    return ev.select("event_id", start.alias("start_ts"), end.alias("end_ts"))


@query(
    "c23_effort_level",
    "SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 6 ELSE 0 END AS level FROM part",
)
def effort(spark, sf):
    words = F.array(*[F.lit(w) for w in [*vocab.EFFORT_LEVELS, "none"]])
    word = F.element_at(words, F.col("p_size") % 7 + 1)
    return table(spark, sf, "part").select("p_partkey", ex.lookup(word, vocab.EFFORT_LEVELS, 0).alias("level"))


@query(
    "c24_recode_labels",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'Ski' WHEN 'click' THEN 'Ski' WHEN 'error' THEN 'Cycling' ELSE event_type END AS label FROM events""",
)
def recode(spark, sf):
    tap = ex.recode("event_type", {"view": "Alpi Ski", "click": "Down Ski", "error": "Mt Bike"})
    return table(spark, sf, "events").select("event_id", ex.recode(tap, vocab.TAP_RECODE).alias("label"))
