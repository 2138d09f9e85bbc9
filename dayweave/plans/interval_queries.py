"""Queries for the time joins."""

from pyspark.sql import functions as F

from dayweave.operators import intervals as iv
from dayweave.plans.base import DAILY, ORDER_DAYS, SAMPLES, STAYS, VISITS, daily, order_days, r, samples, stays, table, visits
from dayweave.plans.registry import query

K = ["entity"]
HITS = "samples s JOIN {iv} i ON s.entity = i.entity AND s.ts {lo} i.start_ts AND s.ts {hi} i.end_ts"


def left_hits(source, lo, hi):
    return f"{source} i LEFT JOIN samples s ON s.entity = i.entity AND s.ts {lo} i.start_ts AND s.ts {hi} i.end_ts"


@query(
    "f01_prorate_in_intervals",
    f"""WITH {SAMPLES}, {VISITS}, own AS (SELECT entity, ts, value, lead(ts) OVER (PARTITION BY entity ORDER BY ts, sample_id) AS nx FROM samples)
SELECT v.entity, v.interval_id, round(sum(value * (epoch_us(least(end_ts, nx)) - epoch_us(greatest(start_ts, ts))) / (epoch_us(nx) - epoch_us(ts))), 3) AS total
FROM visits v LEFT JOIN own o ON o.entity = v.entity AND o.ts < v.end_ts AND o.nx > v.start_ts GROUP BY 1, 2""",
)
def prorate(spark, sf):
    out = iv.prorate_in_intervals(visits(spark, sf), samples(spark, sf), K)
    return out.select("entity", "interval_id", r("total", 3).alias("total"))


@query(
    "f02_count_rounded",
    f"""WITH {SAMPLES}, {VISITS}, rv AS (SELECT entity, interval_id, date_trunc('second', start_ts + INTERVAL 500 MILLISECOND) AS start_ts, date_trunc('second', end_ts + INTERVAL 500 MILLISECOND) AS end_ts FROM visits)
SELECT i.entity, i.interval_id, round(sum(s.value), 4) AS total FROM {left_hits('rv', '>=', '<')} GROUP BY 1, 2""",
)
def rounded(spark, sf):
    out = iv.count_rounded(visits(spark, sf), samples(spark, sf), K)
    return out.select("entity", "interval_id", r("total", 4).alias("total"))


@query(
    "f03_overlap_labels",
    f"""WITH {VISITS}, {STAYS}, h AS (SELECT v.entity, v.interval_id, t.label, t.interval_id AS seq,
   (epoch_us(least(v.end_ts, t.end_ts)) - epoch_us(greatest(v.start_ts, t.start_ts))) / (epoch_us(v.end_ts) - epoch_us(v.start_ts)) AS share
  FROM visits v JOIN stays t ON t.entity = v.entity AND v.start_ts < t.end_ts AND v.end_ts >= t.start_ts),
g AS (SELECT entity, interval_id, arg_max(label, seq) AS tap_label, arg_min(share, seq) AS tap_share FROM h GROUP BY 1, 2)
SELECT v.entity, v.interval_id, tap_label, round(tap_share, 6) AS tap_share FROM visits v LEFT JOIN g USING (entity, interval_id)""",
)
def overlap(spark, sf):
    taps = stays(spark, sf).withColumn("seq", F.col("interval_id"))
    out = iv.overlap_labels(visits(spark, sf), taps, K)
    return out.select("entity", "interval_id", "tap_label", r("tap_share").alias("tap_share"))


@query(
    "f04_mean_in_intervals",
    f"WITH {SAMPLES}, {VISITS} SELECT i.entity, i.interval_id, round(avg(s.value), 4) AS mean FROM {left_hits('visits', '>', '<=')} GROUP BY 1, 2",
)
def mean_hr(spark, sf):
    out = iv.aggregate_in_intervals(visits(spark, sf), samples(spark, sf), K, start_inclusive=False, end_inclusive=True)
    return out.select("entity", "interval_id", r("mean", 4).alias("mean"))


@query(
    "f05_paint_samples",
    f"""WITH {SAMPLES}, {VISITS} SELECT s.entity, s.sample_id, arg_max(i.weight, (i.weight, i.interval_id)) AS weight
FROM samples s LEFT JOIN visits i ON s.entity = i.entity AND s.ts BETWEEN i.start_ts AND i.end_ts GROUP BY 1, 2""",
)
def paint(spark, sf):
    out = iv.paint_samples(samples(spark, sf), visits(spark, sf), K, "sample_id", ["weight"], ["weight", "interval_id"])
    return out.select("entity", "sample_id", "weight")


@query(
    "f06_override_in_intervals",
    f"""WITH {SAMPLES}, {VISITS} SELECT s.entity, s.sample_id, CASE WHEN EXISTS (SELECT 1 FROM visits i WHERE i.entity = s.entity AND s.ts BETWEEN i.start_ts AND i.end_ts) THEN 90.0 ELSE s.value END::DOUBLE AS value FROM samples s""",
)
def override(spark, sf):
    out = iv.override_in_intervals(samples(spark, sf), visits(spark, sf), K, "sample_id", "value", 90.0)
    return out.select("entity", "sample_id", "value")


@query(
    "f07_sum_in_intervals",
    f"WITH {SAMPLES}, {VISITS} SELECT i.entity, i.interval_id, count(s.value) AS n, round(sum(s.value), 4) AS total FROM {left_hits('visits', '>=', '<=')} GROUP BY 1, 2",
)
def sums(spark, sf):
    out = iv.aggregate_in_intervals(visits(spark, sf), samples(spark, sf), K, end_inclusive=True)
    return out.select("entity", "interval_id", "n", r("total", 4).alias("total"))


@query(
    "f08_greedy_next_match",
    """WITH RECURSIVE v AS (SELECT user_id AS entity, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'view'),
c AS (SELECT user_id AS entity, ts, event_id FROM events WHERE event_type = 'click'),
rec AS (SELECT entity, CAST(0 AS BIGINT) AS k, TIMESTAMP '1970-01-01' AS last_ts, CAST(NULL AS TIMESTAMP) AS hit, CAST(NULL AS BIGINT) AS view_id FROM (SELECT DISTINCT entity FROM v)
  UNION ALL SELECT r.entity, v.k, coalesce(min(c.ts), any_value(r.last_ts)), min(c.ts), any_value(v.event_id)
  FROM rec r JOIN v ON v.entity = r.entity AND v.k = r.k + 1 LEFT JOIN c ON c.entity = r.entity AND c.ts > v.ts AND c.ts > r.last_ts AND c.ts < v.ts + INTERVAL 24 HOUR GROUP BY r.entity, v.k)
SELECT rec.entity, view_id, c.event_id AS click_id FROM rec JOIN c ON c.entity = rec.entity AND c.ts = rec.hit""",
)
def greedy(spark, sf):
    ev = table(spark, sf, "events").withColumn("entity", F.col("user_id"))
    views = ev.where(F.col("event_type") == "view").select("entity", "ts", F.col("event_id").alias("view_id"))
    clicks = ev.where(F.col("event_type") == "click").select("entity", "ts", F.col("event_id").alias("click_id"))
    return iv.greedy_next_match(views, clicks, K, "view_id", "click_id")


@query(
    "f09_ordinal_join",
    """WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_type, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY ts, event_id) - 1 AS k FROM events)
SELECT a.user_id, a.day, a.k AS activity_n, a.event_id AS view_id, b.event_id AS click_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.day = b.day AND a.k = b.k AND a.event_type = 'view' AND b.event_type = 'click'""",
)
def ordinal(spark, sf):
    ev = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    a = ev.where(F.col("event_type") == "view").select("user_id", "day", "ts", F.col("event_id").alias("view_id"))
    b = ev.where(F.col("event_type") == "click").select("user_id", "day", F.col("ts").alias("ts2"), F.col("event_id").alias("click_id"))
    out = iv.ordinal_join(a, b, ["user_id", "day"], ["ts", "view_id"], ["ts2", "click_id"])
    return out.select("user_id", "day", F.col("activity_n").cast("long").alias("activity_n"), "view_id", "click_id")


@query(
    "f10_drop_days_with_repeats",
    """WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_type, lead(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = event_type AS same FROM events)
SELECT event_id, user_id, day, event_type FROM e QUALIFY NOT coalesce(bool_or(same) OVER (PARTITION BY user_id, day), false)""",
)
def repeats(spark, sf):
    ev = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    out = iv.drop_days_with_repeats(ev, ["user_id"], "day", ["ts", "event_id"], "event_type")
    return out.select("event_id", "user_id", "day", "event_type")


@query(
    "f11_lag_pairs",
    f"""WITH {DAILY}, l AS (SELECT unnest([-10, -5, 0, 1, 7]) AS lag)
SELECT x.entity, l.lag, count(*) AS n, round(sum(x.a * y.a), 4) AS cross_sum FROM daily x, l JOIN daily y ON y.entity = x.entity AND y.day = x.day + CAST(l.lag AS INTEGER) GROUP BY 1, 2""",
)
def lag_pairs(spark, sf):
    out = iv.lag_pairs(daily(spark, sf), K, "a", "a", [-10, -5, 0, 1, 7])
    return out.groupBy("entity", "lag").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("x") * F.col("y")), 4).alias("cross_sum"))


@query(
    "f12_events_before",
    f"""WITH {DAILY}, {ORDER_DAYS.replace('order_days AS', 'od AS')}, ev AS (SELECT entity, day FROM od WHERE n >= 3)
SELECT d.entity, d.day, CASE WHEN d.day - DATE '1995-01-01' >= 30 THEN (SELECT count(*) FROM ev WHERE ev.entity = d.entity AND ev.day BETWEEN d.day - 30 AND d.day - 1) END AS num_events FROM daily d""",
)
def events_before(spark, sf):
    ev = order_days(spark, sf).where(F.col("n") >= 3).select("entity", "day")
    return iv.events_before(daily(spark, sf).select("entity", "day"), ev, K, "1995-01-01")


@query(
    "f14_step_points",
    f"""WITH {STAYS} SELECT entity, interval_id, p.step, p.t, p.level FROM (SELECT entity, interval_id, unnest([
  {{'step': 0, 't': CAST(epoch(date_trunc('second', start_ts)) AS BIGINT) - 1, 'level': 0.0::DOUBLE}}, {{'step': 1, 't': CAST(epoch(date_trunc('second', start_ts)) AS BIGINT), 'level': 2.0::DOUBLE}},
  {{'step': 2, 't': CAST(epoch(date_trunc('second', end_ts)) AS BIGINT), 'level': 2.0::DOUBLE}}, {{'step': 3, 't': CAST(epoch(date_trunc('second', end_ts)) AS BIGINT) + 1, 'level': 0.0::DOUBLE}}]) AS p FROM stays)""",
)
def steps(spark, sf):
    s = stays(spark, sf).withColumns({"start_s": F.unix_seconds("start_ts"), "end_s": F.unix_seconds("end_ts"), "v": F.lit(2.0)})
    return iv.step_points(s, ["entity", "interval_id"], "v")
