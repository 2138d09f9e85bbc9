"""Queries for the heart load."""

from pyspark.sql import functions as F

from dayweave.functions import vocab
from dayweave.operators import heart as ht
from dayweave.operators import intervals as iv
from dayweave.plans.base import DAILY, SAMPLES, VISITS, daily, r, samples, table, visits
from dayweave.plans.registry import query

K = ["entity"]
ACTIVITY = {0: "walking", 1: "cycling", 2: "swimming", 3: "Resort skiing"}


def beats(spark, sf):
    """Heart-rate-like samples: value + 60, whole beats."""
    return samples(spark, sf).withColumn("hr", F.floor(F.col("value") + 60).cast("double"))


BEATS = f"{SAMPLES}, beats AS (SELECT *, floor(value + 60)::DOUBLE AS hr FROM samples)"


@query("k01_active_rate", f"WITH {BEATS} SELECT sample_id, greatest(hr - 70, 0) AS active FROM beats")
def k01(spark, sf):
    return beats(spark, sf).select("sample_id", ht.active_rate("hr", 70).alias("active"))


@query("k02_band_rate", f"WITH {BEATS} SELECT sample_id, least(greatest(hr - 70, 0), 40) AS zone1, greatest(hr - 110, 0) AS zone2 FROM beats")
def k02(spark, sf):
    return beats(spark, sf).select("sample_id", ht.band_rate("hr", 70, 110).alias("zone1"), ht.band_rate("hr", 110).alias("zone2"))


@query("k03_power_load", f"WITH {BEATS} SELECT sample_id, pow(greatest(hr - 70, 0), 2) AS load FROM beats")
def k03(spark, sf):
    return beats(spark, sf).select("sample_id", ht.power_load(ht.active_rate("hr", 70), 2).alias("load"))


CARRY = """RECURSIVE {base}, nb AS (SELECT entity, sample_id, ts, greatest(hr - {thr}, 0) AS v, row_number() OVER (PARTITION BY entity ORDER BY ts, sample_id) AS k FROM beats),
oc AS (SELECT entity, k, sample_id, ts, v AS c FROM nb WHERE k = 1 UNION ALL SELECT n.entity, n.k, n.sample_id, n.ts, n.v + CASE WHEN 0.5 * o.c > 1 THEN 0.5 * o.c ELSE 0 END FROM oc o JOIN nb n ON n.entity = o.entity AND n.k = o.k + 1)"""


@query("k04_overflow_carry", f"WITH {CARRY.format(base=BEATS, thr=110)} SELECT sample_id, round(c, 6) AS carried FROM oc")
def k04(spark, sf):
    x = beats(spark, sf).withColumn("load", ht.active_rate("hr", 110)).select("entity", "ts", "sample_id", "load")
    return ht.overflow_carry(x, K, "load", 0.5).select("sample_id", r("load_carried").alias("carried"))


@query("k05_second_cutoff", f"WITH {BEATS} SELECT sample_id, CASE WHEN hr - 50 < 50 THEN 0 ELSE hr - 50 END AS load FROM beats")
def k05(spark, sf):
    return beats(spark, sf).select("sample_id", ht.second_cutoff("hr", 50).alias("load"))


_SHARES = "CASE interval_id % 4 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} ELSE {3} END"
LOW = _SHARES.format(*[vocab.HEART_SHARES[vocab.DEVICE_ACTIVITY_CLASS[a]][0] for a in ACTIVITY.values()])
HIGH = _SHARES.format(*[vocab.HEART_SHARES[vocab.DEVICE_ACTIVITY_CLASS[a]][1] for a in ACTIVITY.values()])
NAME = _SHARES.format(*[f"'{a}'" for a in ACTIVITY.values()])
PAINTED = f"""{BEATS}, {VISITS}, act AS (SELECT entity, interval_id, start_ts, end_ts, {NAME} AS sport, {LOW}::DOUBLE AS lo, {HIGH}::DOUBLE AS hi FROM visits),
pt AS (SELECT b.entity, b.sample_id, b.ts, b.hr, arg_max(lo, (sport, interval_id)) AS lo, arg_max(hi, (sport, interval_id)) AS hi FROM beats b LEFT JOIN act a ON a.entity = b.entity AND b.ts BETWEEN a.start_ts AND a.end_ts GROUP BY 1, 2, 3, 4),
bl AS (SELECT entity, sample_id, ts, greatest(hr - 70, 0) * coalesce(lo, 1) AS low_body, greatest(hr - 70, 0) * coalesce(hi, 0) AS high_body FROM pt)"""


def activities(spark, sf):
    names = F.array(*[F.lit(a) for a in ACTIVITY.values()])
    act = visits(spark, sf).withColumn("sport", F.element_at(names, (F.col("interval_id") % 4 + 1).cast("int")))
    return ht.activity_shares(act, "sport", vocab.DEVICE_ACTIVITY_CLASS, 1)


def painted(spark, sf):
    x = beats(spark, sf).withColumn("active", ht.active_rate("hr", 70))
    return ht.body_load(x, activities(spark, sf), K, "sample_id", "active", "sport", "interval_id")


@query("k06_daily_body_load", f"""WITH {PAINTED}, {DAILY}, days AS (SELECT DISTINCT user_id AS entity, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view'),
s AS (SELECT entity, CAST(ts AS DATE) AS day, round(sum(low_body), 4) AS low_body, round(sum(high_body), 4) AS high_body FROM bl GROUP BY 1, 2) SELECT entity, day, low_body, high_body FROM days LEFT JOIN s USING (entity, day)""")
def k06(spark, sf):
    days = table(spark, sf, "events").where(F.col("event_type") == "view").select(F.col("user_id").alias("entity"), F.to_date("ts").alias("day")).distinct()
    out = ht.daily_loads(painted(spark, sf), K, ["low_body", "high_body"], master=days)
    return out.select("entity", "day", r("low_body", 4).alias("low_body"), r("high_body", 4).alias("high_body"))


_OVER = ", ".join(f"n.{c} + CASE WHEN 0.5 * o.{c} > 1 THEN 0.5 * o.{c} ELSE 0 END" for c in ("l1", "h1", "l2", "h2"))
_CUT = "sum(CASE WHEN {0} - 50 < 50 THEN 0 ELSE {0} - 50 END)"


@query(
    "k07_load_options",
    f"""WITH RECURSIVE {PAINTED},
sh AS (SELECT entity, ts, row_number() OVER (PARTITION BY entity ORDER BY ts, sample_id) AS k, greatest(hr - 110, 0) AS a0, greatest(hr - 70, 0) AS a1, coalesce(lo, 1) AS lo, coalesce(hi, 0) AS hi FROM pt),
nb AS MATERIALIZED (SELECT entity, k, ts, a0, a0 * lo AS l0, a0 * hi AS h0, a1, a1 * lo AS l1, a1 * hi AS h1, a1 * a1 AS a2, pow(a1 * lo, 2) AS l2, pow(a1 * hi, 2) AS h2 FROM sh),
oc(entity, k, ts, l1, h1, l2, h2) AS (SELECT entity, k, ts, l1, h1, l2, h2 FROM nb WHERE k = 1 UNION ALL SELECT n.entity, n.k, n.ts, {_OVER} FROM oc o JOIN nb n ON n.entity = o.entity AND n.k = o.k + 1),
z AS (SELECT entity, CAST(ts AS DATE) AS day, sum(a0) AS a0, sum(l0) AS l0, sum(h0) AS h0, sum(a1) AS a1, sum(a2) AS a2 FROM nb GROUP BY 1, 2),
o AS (SELECT entity, CAST(ts AS DATE) AS day, {_CUT.format('l1')} AS l1, {_CUT.format('h1')} AS h1, sum(l2) AS l2, sum(h2) AS h2 FROM oc GROUP BY 1, 2),
sp AS (SELECT entity, CAST(lo + CAST(i AS INTEGER) AS DATE) AS day FROM (SELECT entity, min(day) AS lo, max(day) AS hi FROM z GROUP BY 1), (SELECT unnest(range(0, 400)) AS i) WHERE lo + CAST(i AS INTEGER) <= hi),
al AS (SELECT entity, day, 'zone2' AS option, a0 AS active, l0 AS low_body, h0 AS high_body FROM sp LEFT JOIN z USING (entity, day)
  UNION ALL SELECT entity, day, 'overflow_cutoff', a1, l1, h1 FROM sp LEFT JOIN z USING (entity, day) LEFT JOIN o USING (entity, day)
  UNION ALL SELECT entity, day, 'power2_overflow', a2, l2, h2 FROM sp LEFT JOIN z USING (entity, day) LEFT JOIN o USING (entity, day))
SELECT entity, day, option, round(coalesce(active, 0) + 1e-7, 4) AS active, round(coalesce(low_body, 0) + 1e-7, 4) AS low_body, round(coalesce(high_body, 0) + 1e-7, 4) AS high_body FROM al""",
)
def k07(spark, sf):
    x = beats(spark, sf).select("entity", "ts", "sample_id", "hr")
    x = iv.paint_samples(x, activities(spark, sf), K, "sample_id", ["low_share", "high_share"], ["feed", "sport", "interval_id"], 1800)
    out = ht.load_options(x, K, "hr")
    return out.select("entity", "day", "option", *[r(F.col(c) + 1e-7, 4).alias(c) for c in ("active", "low_body", "high_body")])


@query(
    "k08_extended_export",
    f"""WITH {DAILY}, sl AS (SELECT entity, day, a * 10 AS score FROM daily WHERE a >= 2), su AS (SELECT entity, day, 50 + a AS rhr FROM daily WHERE a >= 1 AND day > DATE '1995-02-01')
SELECT entity, day, a AS steps, coalesce(last_value(score IGNORE NULLS) OVER w, first_value(score IGNORE NULLS) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS "sleepScore",
  coalesce(last_value(rhr IGNORE NULLS) OVER w, first_value(rhr IGNORE NULLS) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS "restingHeartRate"
FROM daily LEFT JOIN sl USING (entity, day) LEFT JOIN su USING (entity, day) WINDOW w AS (PARTITION BY entity ORDER BY day)""",
)
def k08(spark, sf):
    base = daily(spark, sf).select("entity", "day", "a")
    sleep = base.where(F.col("a") >= 2).select("entity", "day", (F.col("a") * 10).alias("score"))
    summary = base.where((F.col("a") >= 1) & (F.col("day") > "1995-02-01")).select("entity", "day", (F.col("a") + 50).alias("rhr"))
    return ht.extended_export(base, sleep, summary, K, ["a"], ["score", "rhr"], {"a": "steps", "score": "sleepScore", "rhr": "restingHeartRate"})
