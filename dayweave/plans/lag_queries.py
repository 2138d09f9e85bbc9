"""Queries for the lagged correlations."""

from pyspark.sql import functions as F

from dayweave.operators import lagcorr as lc
from dayweave.plans.base import DAILY, daily, r, sql_t_p
from dayweave.plans.registry import query
from dayweave.plans.rolling_queries import full

K = ["entity"]
CURVE = ["entity", "pain", "driver"]
LONG = f"""{DAILY}, lng AS MATERIALIZED (SELECT entity, day, pos, 'a' AS driver, a AS x, pain AS y FROM daily UNION ALL SELECT entity, day, pos, 'b', b, pain FROM daily)"""


def cross_sql(lo, hi):
    return f"""{LONG}, cc AS MATERIALIZED (SELECT q.entity, 'pain' AS pain, q.driver, CAST(k AS INTEGER) AS lag, CASE WHEN count(*) >= 6 THEN corr(q.y, p.x) END AS corr
FROM lng q, (SELECT unnest(range({lo}, {hi + 1})) AS k) JOIN lng p ON p.entity = q.entity AND p.driver = q.driver AND p.pos = q.pos - k GROUP BY 1, 2, 3, 4)"""


def curves(spark, sf):
    return lc.cross_correlation(daily(spark, sf), K, ["a", "b"], ["pain"])


@query("i01_cross_correlation", f"WITH {cross_sql(-50, 50)} SELECT entity, pain, driver, lag, round(corr, 6) AS corr FROM cc")
def i01(spark, sf):
    return curves(spark, sf).withColumn("corr", r("corr"))


SLIDE = f"""{DAILY}, rl AS (SELECT entity, day, pos, {full('a', 7)} AS a, {full('pain', 7)} AS pain FROM daily),
ws AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM daily)::TIMESTAMP, (SELECT max(day) FROM daily)::TIMESTAMP - INTERVAL 6 MONTH, INTERVAL 2 MONTH)) AS DATE) AS w_start),
wr AS MATERIALIZED (SELECT entity, w_start, day, a, pain FROM rl JOIN ws ON day >= w_start AND day < CAST(w_start + INTERVAL 6 MONTH AS DATE) WHERE a IS NOT NULL AND pain IS NOT NULL),
wc AS MATERIALIZED (SELECT q.entity, q.w_start, CAST(k AS INTEGER) AS lag, CASE WHEN count(*) >= 6 THEN corr(q.pain, p.a) END AS corr
  FROM wr q, (SELECT unnest(range(-50, 51)) AS k) JOIN wr p ON p.entity = q.entity AND p.w_start = q.w_start AND p.day = q.day - CAST(k AS INTEGER) GROUP BY 1, 2, 3),
wi AS (SELECT entity, w_start, sum(a) AS integral FROM wr GROUP BY 1, 2)"""


def slides(spark, sf):
    return lc.windowed_cross_correlation(daily(spark, sf), K, ["a"], ["pain"])


@query("i02_sliding_windows", f"WITH {SLIDE} SELECT entity, w_start, lag, round(corr, 6) AS corr, round(integral, 4) AS integral FROM wc JOIN wi USING (entity, w_start)")
def i02(spark, sf):
    return slides(spark, sf).select("entity", "w_start", "lag", r("corr").alias("corr"), r("integral", 4).alias("integral"))


@query("i03_best_lag", f"WITH {cross_sql(-50, 50)} SELECT entity, pain, driver, arg_max(lag, (corr, -lag)) AS best_lag, round(max(corr), 6) AS best_corr FROM cc GROUP BY 1, 2, 3")
def i03(spark, sf):
    return lc.best_lag(curves(spark, sf), CURVE).withColumn("best_corr", r("best_corr"))


MEASURES = f"""{SLIDE}, tn AS (SELECT *, (corr > lag(corr) OVER w AND corr > lead(corr) OVER w) OR (corr < lag(corr) OVER w AND corr < lead(corr) OVER w) AS turn FROM wc WINDOW w AS (PARTITION BY entity, w_start ORDER BY lag)),
ms0 AS (SELECT entity, w_start, max(lag) FILTER (turn AND lag < 0) AS ll, arg_max(corr, lag) FILTER (turn AND lag < 0) AS lv, min(lag) FILTER (turn AND lag >= 0) AS rl, arg_min(corr, lag) FILTER (turn AND lag >= 0) AS rv,
  sum(corr) FILTER (lag BETWEEN -30 AND -1) - 0.5 * sum(corr) FILTER (lag IN (-30, -1)) AS before, sum(corr) FILTER (lag BETWEEN 1 AND 30) - 0.5 * sum(corr) FILTER (lag IN (1, 30)) AS after, max(corr) FILTER (lag > 0) AS peak FROM tn GROUP BY 1, 2),
ms AS (SELECT entity, w_start, before, after, peak, CASE WHEN ll IS NULL OR rl IS NULL THEN 0 WHEN lv > rv THEN -rl / (rl - ll) WHEN lv < rv THEN -ll / (rl - ll) ELSE 0 END AS local_measure FROM ms0)"""


@query("i04_curve_measures", f"WITH {MEASURES} SELECT entity, w_start, round(local_measure, 6) + 0.0 AS local_measure, round(after - before, 5) AS balance, round(after, 5) AS after, round(peak, 6) AS peak FROM ms")
def i04(spark, sf):
    out = lc.curve_measures(slides(spark, sf), ["entity", "w_start"])
    return out.select("entity", "w_start", r("local_measure").alias("local_measure"), r("balance", 5).alias("balance"), r("after", 5).alias("after"), r("peak").alias("peak"))


def _buckets_sql():
    parts = []
    for x in ("a", "b", "pain"):
        for y in ("a", "b", "pain"):
            if x == y:
                continue
            for name, ks in lc.LAG_BUCKETS.items():
                total = " + ".join(f"coalesce(lead({y}, {k}) OVER w, 0)" for k in ks)
                count = " + ".join(f"(lead({y}, {k}) OVER w IS NOT NULL)::INT" for k in ks)
                parts.append(f"SELECT entity, '{x}' AS first, '{y}' AS second, '{name}' AS bucket, {x} AS x, ({total}) / nullif({count}, 0) AS y FROM daily WINDOW w AS (PARTITION BY entity ORDER BY pos)")
    return " UNION ALL ".join(parts)


BUCKETS = f"""{DAILY}, bp AS ({_buckets_sql()}),
bc AS MATERIALIZED (SELECT entity, first, second, bucket, corr(x, y) AS r, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n FROM bp GROUP BY 1, 2, 3, 4),
bt AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM bc)"""


def buckets(spark, sf, with_p=True):
    return lc.bucket_correlations(daily(spark, sf), K, ["a", "b", "pain"], with_p=with_p)


@query("i05_bucket_correlations", f"WITH {BUCKETS} SELECT entity, first, second, bucket, n, round(r, 6) AS r, round({sql_t_p('t', '(n - 2.0::DOUBLE)')}, 6) + 0.0 AS p_value FROM bt")
def i05(spark, sf):
    return buckets(spark, sf).select("entity", "first", "second", "bucket", "n", r("r").alias("r"), r("p_value").alias("p_value"))


@query(
    "i06_extreme_pain_pairs",
    f"""WITH {BUCKETS}, p AS (SELECT *, {sql_t_p('t', '(n - 2.0::DOUBLE)')} AS p FROM bt WHERE second = 'pain' AND first <> 'pain')
SELECT entity, first, second, bucket, round(r, 6) AS r FROM p WHERE p < 0.05 AND r <> 0 QUALIFY row_number() OVER (PARTITION BY entity, first, second, sign(r) ORDER BY abs(r) DESC, bucket) = 1""",
)
def i06(spark, sf):
    out = lc.extreme_pain_pairs(buckets(spark, sf), K, ["pain"])
    return out.select("entity", "first", "second", "bucket", r("r").alias("r"))


@query(
    "i07_group_report",
    f"""WITH {MEASURES}, j AS (SELECT ms.entity, w_start, local_measure, integral FROM ms JOIN wi USING (entity, w_start)), g AS (SELECT unnest(['Walking', 'All']) AS "group")
SELECT j.entity, w_start, "group", round(local_measure, 6) + 0.0 AS local_measure, round(10 + (integral - min(integral) OVER v) / (max(integral) OVER v - min(integral) OVER v) * 90, 5) AS size FROM j, g WINDOW v AS (PARTITION BY j.entity, "group")""",
)
def i07(spark, sf):
    flow = slides(spark, sf)
    keys = ["entity", "w_start", "pain", "driver", "integral"]
    out = lc.group_report(lc.curve_measures(flow, keys), K, {"Walking": ["a"], "Cycling": ["b"], "All": ["a", "b"]})
    return out.select("entity", "w_start", "group", r("local_measure").alias("local_measure"), r("size", 5).alias("size"))


@query(
    "i08_smoothed_pair_test",
    f"""WITH {DAILY}, m AS (SELECT entity, day, {full('a', 31)} AS x, {full('b', 31)} AS y FROM daily),
k AS (SELECT 'all' AS part, * FROM m WHERE x <> 0 AND y <> 0 AND NOT day BETWEEN DATE '1997-01-01' AND DATE '1997-03-31' UNION ALL
  SELECT 'recent', * FROM m WHERE x <> 0 AND y <> 0 AND NOT day BETWEEN DATE '1997-01-01' AND DATE '1997-03-31' AND day >= DATE '2000-06-01')
SELECT part, entity, count(*) AS n, round(corr(x, y), 6) AS r FROM k GROUP BY 1, 2""",
)
def i08(spark, sf):
    gap = ("1997-01-01", "1997-03-31")
    every = lc.smoothed_pair_test(daily(spark, sf), K, "a", "b", exclude=gap).withColumn("part", F.lit("all"))
    recent = lc.smoothed_pair_test(daily(spark, sf), K, "a", "b", exclude=gap, since="2000-06-01").withColumn("part", F.lit("recent"))
    return every.unionByName(recent).select("part", "entity", "n", r("r").alias("r"))
