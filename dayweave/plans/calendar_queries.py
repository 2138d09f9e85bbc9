"""Queries for the calendar and alignment operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from dayweave.operators import calendar as cal
from dayweave.plans.base import DAILY, DEVICES, ORDER_DAYS, SPARSE, daily, devices, order_days, r, sparse_daily, table
from dayweave.plans.registry import query

NEXT_ID = "row_number() OVER (PARTITION BY entity ORDER BY day)"


@query(
    "b01_calendar_spine",
    f"""WITH {ORDER_DAYS}
SELECT entity, CAST(DATE '1995-01-01' + CAST(i AS INTEGER) AS DATE) AS day, CAST(0 AS DOUBLE) AS steps
FROM (SELECT DISTINCT entity FROM order_days), (SELECT unnest(range(0, 2320)) AS i)""",
)
def spine(spark, sf):
    who = order_days(spark, sf).select("entity").distinct()
    return cal.calendar_spine(who, ["entity"], "1995-01-01", periods=2320, defaults={"steps": 0.0})


@query("b01_fill_calendar", f"WITH {SPARSE} SELECT entity, day, a, round(pain, 6) AS pain FROM sparse")
def fill(spark, sf):
    return sparse_daily(spark, sf).select("entity", "day", "a", r("pain").alias("pain"))


@query(
    "b02_complete_days",
    """SELECT user_id AS entity, CAST(ts AS DATE) AS day, round(sum(value), 4) AS total FROM events e
WHERE CAST(ts AS DATE) < (SELECT max(CAST(ts AS DATE)) FROM events x WHERE x.user_id = e.user_id) GROUP BY 1, 2""",
)
def complete(spark, sf):
    ev = table(spark, sf, "events")
    days = ev.groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("day")).agg(
        r(F.sum("value"), 4).alias("total")
    )
    return cal.complete_days(days, ["entity"])


def _two_feeds(spark, sf):
    dev = devices(spark, sf)
    first = dev.where(F.dayofmonth("day") <= 20).select(
        "entity", "day", "main", F.when(F.dayofmonth("day") % 3 != 0, F.col("other")).alias("other")
    )
    second = dev.where(F.dayofmonth("day") >= 10).select(
        "entity", "day", "other", F.col("lines").cast("double").alias("lines")
    )
    return first, second.withColumn("other", F.col("other") + 1000)


FEEDS = f"""{DEVICES},
feed1 AS (SELECT entity, day, main, CASE WHEN day(day) % 3 <> 0 THEN other END AS other FROM devices WHERE day(day) <= 20),
feed2 AS (SELECT entity, day, other + 1000 AS other, CAST(lines AS DOUBLE) AS lines FROM devices WHERE day(day) >= 10)"""


@query(
    "b03_update",
    f"""WITH {FEEDS} SELECT entity, day, main, round(coalesce(n.other, o.other), 5) AS other
FROM feed1 o LEFT JOIN feed2 n USING (entity, day)""",
)
def update(spark, sf):
    a, b = _two_feeds(spark, sf)
    return cal.update_from(a, b, ["entity", "day"]).withColumn("other", r("other", 5))


@query(
    "b04_combine_first",
    f"""WITH {FEEDS} SELECT entity, day, main, round(coalesce(o.other, n.other), 5) AS other, lines
FROM feed1 o FULL JOIN feed2 n USING (entity, day)""",
)
def combine(spark, sf):
    a, b = _two_feeds(spark, sf)
    return cal.combine_first(a, b, ["entity", "day"]).withColumn("other", r("other", 5))


@query(
    "b05_assign_last",
    """SELECT user_id AS entity, CAST(ts AS DATE) AS day, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""",
)
def assign(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.to_date("ts").alias("day"), "value", "event_id")
    return cal.assign_last(ev, ["entity", "day"], ["value"], ["event_id"])


@query(
    "b06_accumulate",
    f"""WITH {DAILY}, extra AS (SELECT o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS day, count(*) AS k
  FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT d.entity, d.day, a + coalesce(k, 0) AS a FROM daily d LEFT JOIN extra e USING (entity, day)""",
)
def accumulate(spark, sf):
    extra = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("day"), F.lit(1.0).alias("a")
    )
    return cal.accumulate(daily(spark, sf).select("entity", "day", "a"), extra, ["entity", "day"], ["a"])


@query(
    "b07_resample_daily",
    """WITH base AS (SELECT user_id AS entity, CAST(ts AS DATE) AS day, sum(value) AS s, avg(value) AS m FROM events GROUP BY 1, 2),
span AS (SELECT entity, min(day) AS lo, max(day) AS hi FROM base GROUP BY 1),
spine AS (SELECT entity, CAST(lo + CAST(i AS INTEGER) AS DATE) AS day FROM span, (SELECT unnest(range(0, 400)) AS i) WHERE lo + CAST(i AS INTEGER) <= hi)
SELECT entity, day, round(coalesce(s, 0), 4) AS total, round(m, 4) AS mean FROM spine LEFT JOIN base USING (entity, day)""",
)
def resample(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("entity"), "ts", F.col("value").alias("total"), F.col("value").alias("mean")
    )
    out = cal.resample_daily(ev, ["entity"], "ts", {"total": "sum", "mean": "mean"})
    return out.select("entity", "day", r("total", 4).alias("total"), r("mean", 4).alias("mean"))


@query(
    "b08_subset_period",
    f"WITH {DAILY} SELECT entity, day, a FROM daily WHERE day BETWEEN DATE '1996-02-01' AND DATE '1997-03-31'",
)
def subset(spark, sf):
    return cal.subset_period(daily(spark, sf), "1996-02-01", "1997-03-31").select("entity", "day", "a")


@query(
    "b09_tidy_columns",
    "SELECT o_orderkey AS id, o_orderdate AS orderday, o_orderstatus AS status FROM orders",
)
def tidy(spark, sf):
    orders = table(spark, sf, "orders").withColumnsRenamed({"o_orderdate": "Order Day", "o_orderstatus": "Status"})
    return cal.tidy_columns(orders, ["o_orderkey", "Order Day", "Status"], {"o_orderkey": "id"})


@query(
    "b10_join_daily",
    f"""WITH {DAILY}, {DEVICES}, dd AS (SELECT day, sum(main) AS steps FROM devices GROUP BY 1)
SELECT entity, day, a, steps FROM daily LEFT JOIN dd USING (day)""",
)
def join_daily(spark, sf):
    steps = devices(spark, sf).groupBy("day").agg(F.sum("main").alias("steps"))
    return cal.join_daily(daily(spark, sf).select("entity", "day", "a"), steps, ["day"])


@query(
    "b11_merge_metrics",
    """SELECT user_id AS entity, CAST(ts AS DATE) AS day,
  CAST(count(CASE WHEN event_type='view' THEN 1 END) AS BIGINT) + 0 AS view_n,
  count(CASE WHEN event_type='click' THEN 1 END) AS click_n,
  count(CASE WHEN event_type='error' THEN 1 END) AS error_n,
  count(CASE WHEN event_type='signup' THEN 1 END) AS signup_n
FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2""",
)
def merge(spark, sf):
    ev = table(spark, sf, "events")

    def one(kind):
        return (
            ev.where(F.col("event_type") == kind)
            .groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("day"))
            .agg(F.count(F.lit(1)).alias("value"))
        )

    names = ["view", "click", "error", "signup"]
    out = cal.merge_metrics({f"{n}_n": one(n) for n in names}, ["entity", "day"])
    return out.fillna(0)


@query(
    "b12_concat_rows",
    f"""WITH {FEEDS} SELECT entity, day, main, NULL AS lines FROM feed1 UNION ALL SELECT entity, day, NULL, lines FROM feed2""",
)
def concat_rows(spark, sf):
    a, b = _two_feeds(spark, sf)
    return cal.concat_rows(a.select("entity", "day", "main"), b.select("entity", "day", "lines"))


@query(
    "b13_concat_columns",
    """WITH g AS (SELECT CAST(ts AS DATE) AS day, user_id AS entity, event_type, count(*) AS n FROM events GROUP BY ALL),
keys AS (SELECT DISTINCT entity, day FROM g WHERE event_type IN ('view', 'click', 'signup'))
SELECT entity, day, v.n AS walking, c.n AS cycling, s.n AS running FROM keys
LEFT JOIN (SELECT * FROM g WHERE event_type='view') v USING (entity, day)
LEFT JOIN (SELECT * FROM g WHERE event_type='click') c USING (entity, day)
LEFT JOIN (SELECT * FROM g WHERE event_type='signup') s USING (entity, day)""",
)
def concat_columns(spark, sf):
    ev = table(spark, sf, "events")

    def one(kind, name):
        return (
            ev.where(F.col("event_type") == kind)
            .groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("day"))
            .agg(F.count(F.lit(1)).alias(name))
        )

    parts = [one("view", "walking"), one("click", "cycling"), one("signup", "running")]
    return cal.concat_columns(parts, ["entity", "day"])


@query(
    "b14_drop_listed_days",
    f"""WITH {DAILY} SELECT entity, day, a FROM daily d
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE CAST(l_shipdate AS DATE) = d.day AND l_quantity = 50 AND l_returnflag = 'N')
  AND EXISTS (SELECT 1 FROM lineitem WHERE CAST(l_shipdate AS DATE) = d.day AND l_returnflag = 'R')""",
)
def members(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    bad = li.where((F.col("l_quantity") == 50) & (F.col("l_returnflag") == "N")).select("day")
    good = li.where(F.col("l_returnflag") == "R").select("day")
    days = daily(spark, sf).select("entity", "day", "a")
    return cal.keep_members(cal.drop_members(days, bad, ["day"]), good, ["day"])


@query("b15_distinct", "SELECT DISTINCT user_id AS entity, event_type FROM events")
def distinct(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("entity"), "event_type").dropDuplicates()


@query(
    "b16_pivot_first",
    """SELECT user_id AS entity, CAST(ts AS DATE) AS day,
  arg_min(value, event_id) FILTER (event_type = 'view') AS view,
  arg_min(value, event_id) FILTER (event_type = 'click') AS click,
  arg_min(value, event_id) FILTER (event_type = 'error') AS error FROM events GROUP BY 1, 2""",
)
def pivot_first(spark, sf):
    ev = table(spark, sf, "events").withColumn("entity", F.col("user_id")).withColumn("day", F.to_date("ts"))
    return cal.pivot_first(ev, ["entity", "day"], "event_type", "value", ["view", "click", "error"], ["event_id"])


@query(
    "b17_pivot_day_numbers",
    f"""WITH {ORDER_DAYS}, x AS (SELECT *, {NEXT_ID} AS k FROM order_days)
SELECT entity, CAST((k - 1) // 2 AS BIGINT) AS event, max(CASE WHEN k % 2 = 1 THEN n END) AS n_0, max(CASE WHEN k % 2 = 0 THEN n END) AS n_1,
  max(CASE WHEN k % 2 = 1 THEN day END) AS day_0, max(CASE WHEN k % 2 = 0 THEN day END) AS day_1 FROM x GROUP BY 1, 2""",
)
def pivot_days(spark, sf):
    w = Window.partitionBy("entity").orderBy("day")
    x = order_days(spark, sf).withColumn("k", F.row_number().over(w) - 1)
    x = x.withColumn("event", F.floor(F.col("k") / 2)).withColumn("num", F.col("k") % 2 + 1)
    return cal.pivot_day_numbers(x, ["entity"], "event", "num", ["n", "day"])


@query(
    "b18_manual_fill",
    f"""WITH {FEEDS} SELECT entity, day, round(o.other, 5) AS other, round(coalesce(o.other, n.other), 5) AS "other_manualFill"
FROM feed1 o LEFT JOIN feed2 n USING (entity, day)""",
)
def manual(spark, sf):
    a, b = _two_feeds(spark, sf)
    out = cal.manual_fill(a, b, ["entity", "day"], ["other"])
    return out.select("entity", "day", r("other", 5).alias("other"), r("other_manualFill", 5).alias("other_manualFill"))


@query(
    "b19_latest_per_day",
    """SELECT user_id AS entity, CAST(ts AS DATE) AS day, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) = 1""",
)
def latest(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("entity"), F.to_date("ts").alias("day"), "event_id", "event_type", "value"
    )
    return cal.latest_per_day(ev, ["entity", "day"], "event_id")


@query(
    "b20_keep_max",
    "SELECT user_id AS entity, date_trunc('hour', ts) AS ts, max(value) AS value FROM events GROUP BY 1, 2",
)
def keep_max(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.date_trunc("hour", "ts").alias("ts"), "value")
    return cal.keep_max(ev, ["entity", "ts"], "value")


@query(
    "b21_columns_within",
    f"""WITH {SPARSE} SELECT * FROM (
SELECT 'a' AS "column", count(*) FILTER (a IS NULL) AS missing, count(*) FILTER (a = 0) AS zero FROM sparse UNION ALL
SELECT 'pain', count(*) FILTER (pain IS NULL), count(*) FILTER (pain = 0) FROM sparse) WHERE missing <= 14000""",
)
def columns_within(spark, sf):
    return cal.missing_counts(sparse_daily(spark, sf), ["a", "pain"]).where(F.col("missing") <= 14000)


@query(
    "b22_patches",
    f"""WITH {DAILY} SELECT entity, day,
  CASE WHEN day BETWEEN DATE '1996-05-01' AND DATE '1996-05-10' THEN 7.0
       WHEN day BETWEEN DATE '1997-05-01' AND DATE '1997-05-10' THEN a + 0.5 ELSE a END AS a,
  round(CASE WHEN day = DATE '1998-10-07' THEN lag(pain) OVER (PARTITION BY entity ORDER BY day) ELSE pain END, 6) AS pain FROM daily""",
)
def patches(spark, sf):
    rules = [
        ("1996-05-01", "1996-05-10", "a", "set", 7.0),
        ("1997-05-01", "1997-05-10", "a", "add", 0.5),
        ("1998-10-07", "1998-10-07", "pain", "copy_prev", None),
    ]
    out = cal.apply_patches(daily(spark, sf), ["entity"], rules)
    return out.select("entity", "day", "a", r("pain").alias("pain"))


@query(
    "b23_split_period",
    f"""WITH {DAILY} SELECT entity, CASE WHEN day < DATE '1999-01-01' THEN 'before' ELSE 'from' END AS period, sum(a) AS a, count(*) AS days FROM daily GROUP BY 1, 2""",
)
def split(spark, sf):
    out = cal.split_period(daily(spark, sf), "1999-01-01")
    return out.groupBy("entity", "period").agg(F.sum("a").alias("a"), F.count(F.lit(1)).alias("days"))


@query(
    "b24_weekly_mean",
    f"""WITH {SPARSE}, x AS (SELECT entity, day, a, coalesce(a, 0) + coalesce(pain, 0) AS t, (a IS NOT NULL)::INT + (pain IS NOT NULL)::INT AS k FROM sparse)
SELECT entity, CAST(date_trunc('week', day) AS DATE) + 6 AS week_end, round(avg(a), 6) AS a, round(avg(t / nullif(k, 0)), 6) AS both_mean FROM x GROUP BY 1, 2""",
)
def weekly(spark, sf):
    df = sparse_daily(spark, sf).withColumn("both_mean", cal.row_mean(["a", "pain"]))
    out = cal.weekly_mean(df, ["entity"], ["a", "both_mean"])
    return out.select("entity", "week_end", r("a").alias("a"), r("both_mean").alias("both_mean"))
