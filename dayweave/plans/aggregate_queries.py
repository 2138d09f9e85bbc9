"""Queries for the aggregation operators."""

from pyspark.sql import functions as F

from dayweave.operators import aggregates as ag
from dayweave.operators import calendar as cal
from dayweave.operators import scaling as sc
from dayweave.operators.ordered import time_bucket
from dayweave.plans.base import DAILY, DEVICES, SPARSE, daily, devices, r, sparse_daily, table
from dayweave.plans.registry import query


def events(spark, sf):
    return table(spark, sf, "events").withColumn("entity", F.col("user_id")).withColumn("day", F.to_date("ts"))


@query(
    "d01_class_totals",
    "SELECT user_id AS entity, CAST(ts AS DATE) AS day, event_type, round(sum(value), 4) AS value FROM events GROUP BY 1, 2, 3",
)
def class_totals(spark, sf):
    out = ag.class_totals(events(spark, sf), ["entity", "day"], "event_type", "value")
    return out.withColumn("value", r("value", 4))


@query(
    "d02_epoch_day_totals",
    """SELECT user_id AS entity, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day_number, round(sum(value), 4) AS value,
  CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1, 2""",
)
def epoch_days(spark, sf):
    ev = events(spark, sf).withColumn("t", F.unix_seconds("ts")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return ag.epoch_day_totals(ev, ["entity"], "t", ["value", "k"]).withColumn("value", r("value", 4))


@query(
    "d03_fetch_labels",
    "SELECT event_id, event_type, ts, value FROM events WHERE (event_type = 'view' OR event_type = 'error') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'",
)
def fetch(spark, sf):
    return ag.fetch_labels(events(spark, sf), ["view", "error"], "2024-01-05", "2024-01-20", "event_type").select("event_id", "event_type", "ts", "value")


@query(
    "d04_minmax",
    f"WITH {SPARSE} SELECT entity, day, round((pain - min(pain) OVER w) / (max(pain) OVER w - min(pain) OVER w), 6) AS pain, round((a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w), 6) AS a FROM sparse WINDOW w AS (PARTITION BY entity)",
)
def minmax(spark, sf):
    out = sc.minmax_columns(sparse_daily(spark, sf), ["entity"], ["pain", "a"])
    return out.select("entity", "day", r("pain").alias("pain"), r("a").alias("a"))


@query("d05_divide_by_max", f"WITH {DAILY} SELECT entity, day, a / max(a) OVER (PARTITION BY entity) AS a FROM daily")
def by_max(spark, sf):
    return sc.divide_by_max(daily(spark, sf), ["entity"], ["a"]).select("entity", "day", "a")


@query("d06_median_ratio", f"WITH {DEVICES} SELECT entity, round(median(main / other) FILTER (other <> 0 AND main <> 0), 6) AS ratio FROM devices GROUP BY 1")
def median_ratio(spark, sf):
    return ag.median_ratio(devices(spark, sf), ["entity"], "main", "other").withColumn("ratio", r("ratio"))


@query(
    "d07_mean_ratio",
    f"WITH {DEVICES} SELECT entity, round(avg(main / nullif(other, 0)) FILTER (day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'), 6) AS ratio FROM devices GROUP BY 1",
)
def mean_ratio(spark, sf):
    return ag.mean_ratio(devices(spark, sf), ["entity"], "main", "other", "1996-01-01", "1998-12-31").withColumn("ratio", r("ratio"))


@query(
    "d08_tame_outliers",
    f"WITH {DAILY}, z AS (SELECT entity, day, a, abs((a - avg(a) OVER w) / stddev_pop(a) OVER w) AS z FROM daily WINDOW w AS (PARTITION BY entity)) SELECT entity, day, round(CASE WHEN z > 2.5 THEN a / 3 ELSE a END, 6) AS a FROM z",
)
def outliers(spark, sf):
    return sc.tame_outliers(daily(spark, sf), ["entity"], ["a"], limit=2.5).select("entity", "day", r("a").alias("a"))


@query(
    "d09_elevation_gain",
    """WITH x AS (SELECT user_id AS entity, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
SELECT entity, round(coalesce(sum(greatest(d, 0)) FILTER (d IS NOT NULL), 0), 4) AS gain, round(coalesce(sum(greatest(-d, 0)) FILTER (d IS NOT NULL), 0), 4) AS loss FROM x GROUP BY 1""",
)
def gain(spark, sf):
    out = ag.elevation_gain(events(spark, sf), ["entity"], ["ts", "event_id"], "value", time_bucket("ts", 86400))
    return out.select("entity", r("gain", 4).alias("gain"), r("loss", 4).alias("loss"))


@query(
    "d10_backfill_period_mean",
    f"""WITH {DAILY} SELECT entity, day, round(CASE WHEN day < DATE '1996-01-01' THEN avg(b) FILTER (day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31') OVER (PARTITION BY entity) ELSE b END, 6) AS b FROM daily""",
)
def backfill(spark, sf):
    out = ag.backfill_with_period_mean(daily(spark, sf), ["entity"], "b", ("1997-01-01", "1997-12-31"), "1996-01-01")
    return out.select("entity", "day", r("b").alias("b"))


@query(
    "d11_impute_by_median_ratio",
    f"""WITH {DEVICES}, x AS (SELECT entity, day, CASE WHEN day(day) % 7 = 0 THEN NULL ELSE main END AS km, other FROM devices)
SELECT entity, day, round(coalesce(km, median(CASE WHEN km <> 0 THEN km / nullif(other, 0) END) OVER (PARTITION BY entity) * other), 5) AS km FROM x""",
)
def impute_km(spark, sf):
    x = devices(spark, sf).withColumn("km", F.when(F.dayofmonth("day") % 7 != 0, F.col("main")))
    return ag.impute_by_median_ratio(x, ["entity"], "km", "other", where_zero=False).select("entity", "day", r("km", 5).alias("km"))


@query(
    "d12_impute_truncated",
    f"""WITH {DEVICES}, x AS (SELECT entity, day, CASE WHEN day(day) % 7 = 0 THEN 0 ELSE main END AS steps, other FROM devices)
SELECT entity, day, CASE WHEN steps = 0 THEN floor(median(CASE WHEN steps <> 0 THEN steps / nullif(other, 0) END) OVER (PARTITION BY entity) * other) ELSE steps END AS steps FROM x""",
)
def impute_rides(spark, sf):
    x = devices(spark, sf).withColumn("steps", F.when(F.dayofmonth("day") % 7 != 0, F.col("main")).otherwise(0.0))
    return ag.impute_by_median_ratio(x, ["entity"], "steps", "other", truncate=True).select("entity", "day", "steps")


@query(
    "d13_impute_by_mean_ratio",
    f"""WITH {DEVICES}, x AS (SELECT entity, day, CASE WHEN day(day) % 7 = 0 THEN 0 ELSE main END AS clicks, other FROM devices)
SELECT entity, day, round(CASE WHEN clicks = 0 AND other <> 0 THEN avg(CASE WHEN clicks <> 0 AND other <> 0 THEN clicks / other END) OVER (PARTITION BY entity) * other ELSE clicks END, 5) AS clicks FROM x""",
)
def impute_clicks(spark, sf):
    x = devices(spark, sf).withColumn("clicks", F.when(F.dayofmonth("day") % 7 != 0, F.col("main")).otherwise(0.0))
    return ag.impute_by_mean_ratio(x, ["entity"], "clicks", "other").select("entity", "day", r("clicks", 5).alias("clicks"))


@query(
    "d14_max_of_feeds",
    """WITH x AS (SELECT user_id AS entity, CAST(ts AS DATE) AS day, sum(value) FILTER (event_type = 'view') AS f1, sum(value) FILTER (event_type = 'click') AS f2 FROM events GROUP BY 1, 2)
SELECT entity, day, round(greatest(coalesce(f1, 0), coalesce(f2, 0)), 4) AS best FROM x""",
)
def max_feeds(spark, sf):
    x = events(spark, sf).groupBy("entity", "day").agg(
        F.sum(F.when(F.col("event_type") == "view", F.col("value"))).alias("f1"),
        F.sum(F.when(F.col("event_type") == "click", F.col("value"))).alias("f2"),
    )
    zero = F.lit(0.0)
    return x.select("entity", "day", r(F.greatest(F.coalesce("f1", zero), F.coalesce("f2", zero)), 4).alias("best"))


@query(
    "d15_column_profile",
    """SELECT 'l_tax' AS "column", count(*) AS rows, round(100.0 * count(*) FILTER (l_tax <> 0) / count(*), 6) AS nonzero_pct, round(100.0 * count(DISTINCT l_tax) / count(*), 6) AS unique_pct FROM lineitem
UNION ALL SELECT 'l_quantity', count(*), round(100.0 * count(*) FILTER (l_quantity <> 0) / count(*), 6), round(100.0 * count(DISTINCT l_quantity) / count(*), 6) FROM lineitem""",
)
def profile(spark, sf):
    out = ag.column_profile(table(spark, sf, "lineitem"), ["l_tax", "l_quantity"])
    return out.select("column", "rows", r("nonzero_pct").alias("nonzero_pct"), r("unique_pct").alias("unique_pct"))


@query("d16_yearly_means", f"WITH {DAILY} SELECT entity, CAST(year(day) AS INTEGER) AS year, round(avg(a), 6) AS a, round(avg(b), 6) AS b FROM daily GROUP BY 1, 2")
def yearly(spark, sf):
    out = ag.yearly_means(daily(spark, sf), ["entity"], ["a", "b"])
    return out.select("entity", "year", r("a").alias("a"), r("b").alias("b"))


@query(
    "d17_confusion_counts",
    """SELECT l_returnflag AS truth, count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O" FROM lineitem WHERE l_discount > 0.05 GROUP BY 1""",
)
def confusion(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "truth")
    return ag.confusion_counts(li, "truth", "l_linestatus", ["F", "O"], "l_discount", 0.05)


@query(
    "d18_binned_summary",
    """WITH t AS (SELECT l_returnflag AS flag, max(l_quantity) AS top FROM lineitem GROUP BY 1),
x AS (SELECT l_returnflag AS flag, CAST(floor(l_quantity / (top / 10)) AS INTEGER) AS bin, l_extendedprice / 131071.0 AS y FROM lineitem JOIN t ON l_returnflag = flag)
SELECT flag, bin, count(*) AS n_values, round(quantile_cont(y, 0.25), 6) AS p25, round(quantile_cont(y, 0.5), 6) AS p50, round(quantile_cont(y, 0.75), 6) AS p75, round(stddev_pop(y), 6) AS sd FROM x WHERE bin < 10 GROUP BY 1, 2""",
)
def binned(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity", (F.col("l_extendedprice") / 131071.0).alias("y"))
    out = ag.binned_summary(li, ["flag"], "l_quantity", "y")
    return out.select("flag", "bin", "n_values", *[r(c).alias(c) for c in ("p25", "p50", "p75", "sd")])


@query(
    "d18_histogram_2d",
    """WITH x AS (SELECT l_returnflag AS flag, l_quantity AS q, l_extendedprice - 20000 AS y FROM lineitem),
t AS (SELECT flag, max(abs(q)) AS tx, max(abs(y)) AS ty FROM x GROUP BY 1)
SELECT flag, CAST(least(floor(q * 10 / tx), 9) AS INTEGER) AS x_bin, CAST(least(floor((y + ty) * 10 / (ty * 2)), 9) AS INTEGER) AS y_bin, count(*) AS n FROM x JOIN t USING (flag) GROUP BY 1, 2, 3""",
)
def histogram(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity", (F.col("l_extendedprice") - 20000).alias("y"))
    return ag.histogram_2d(li, ["flag"], "l_quantity", "y")


@query(
    "d19_linear_fit",
    f"WITH {DEVICES} SELECT entity, round(regr_slope(main, other), 6) AS slope, round(regr_intercept(main, other), 6) AS intercept, round(regr_r2(main, other), 6) AS r2, count(*) AS n FROM devices GROUP BY 1",
)
def fit(spark, sf):
    out = ag.linear_fit(devices(spark, sf), ["entity"], "main", "other")
    return out.select("entity", *[r(c).alias(c) for c in ("slope", "intercept", "r2")], "n")


@query(
    "d20_harmonise_by_regression",
    f"""WITH {DEVICES}, f AS (SELECT entity, regr_slope(main, other) AS s, regr_intercept(main, other) AS i FROM devices WHERE day BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' GROUP BY 1)
SELECT entity, day, round(CASE WHEN day BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' THEN (i + s * other + main) / 2 ELSE 0 END, 5) AS steps FROM devices JOIN f USING (entity)""",
)
def harmonise(spark, sf):
    x = devices(spark, sf).withColumn("steps", F.lit(0.0))
    out = ag.harmonise_by_regression(x, ["entity"], "main", "other", "steps", "1997-01-01", "1999-12-31")
    return out.select("entity", "day", r("steps", 5).alias("steps"))


@query(
    "d21_correlation_matrix",
    f"""WITH {DAILY} SELECT entity, 'a' AS first, 'b' AS second, round(corr(a, b), 6) AS corr FROM daily GROUP BY 1
UNION ALL SELECT entity, 'a', 'pain', round(corr(a, pain), 6) FROM daily GROUP BY 1 UNION ALL SELECT entity, 'b', 'pain', round(corr(b, pain), 6) FROM daily GROUP BY 1""",
)
def matrix(spark, sf):
    return ag.correlation_matrix(daily(spark, sf), ["entity"], ["a", "b", "pain"]).withColumn("corr", r("corr"))


@query(
    "d21_correlations_with",
    f"""WITH {DAILY} SELECT entity, 'a' AS variable, round(corr(pain, a), 6) AS corr FROM daily GROUP BY 1 UNION ALL SELECT entity, 'b', round(corr(pain, b), 6) FROM daily GROUP BY 1""",
)
def with_target(spark, sf):
    return ag.correlations_with(daily(spark, sf), ["entity"], "pain", ["a", "b"]).withColumn("corr", r("corr"))


@query(
    "d22_ordered_list",
    """SELECT user_id AS entity, CAST(ts AS DATE) AS day, array_to_string(list(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) ORDER BY ts, event_id), ',') AS cents FROM events GROUP BY 1, 2""",
)
def ordered_list(spark, sf):
    ev = events(spark, sf).withColumn("cents", F.round(F.col("value") * 100).cast("long").cast("string"))
    out = ag.ordered_list(ev, ["entity", "day"], ["ts", "event_id"], "cents", "cents")
    return out.withColumn("cents", F.concat_ws(",", "cents"))


@query(
    "d23_day_matrix",
    """WITH w AS (SELECT user_id AS entity, CAST(ts AS DATE) AS day, round(coalesce(sum(value) FILTER (event_type = 'view'), 0), 4) AS view,
  round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 4) AS click FROM events GROUP BY 1, 2)
SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY entity ORDER BY day) > 2 AND row_number() OVER (PARTITION BY entity ORDER BY day DESC) > 2""",
)
def day_matrix(spark, sf):
    out = ag.day_matrix(events(spark, sf), ["entity"], "event_type", "value", ["view", "click"])
    return out.select("entity", "day", r("view", 4).alias("view"), r("click", 4).alias("click"))


@query("d24_mean_and_max", "SELECT user_id AS entity, CAST(ts AS DATE) AS day, round(avg(value), 5) AS mean, max(value) AS max FROM events GROUP BY 1, 2")
def mean_max(spark, sf):
    return ag.mean_and_max(events(spark, sf), ["entity", "day"], "value").withColumn("mean", r("mean", 5))
