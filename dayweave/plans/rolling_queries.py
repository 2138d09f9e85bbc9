"""Queries for the rolling and recursive transforms."""

from pyspark.sql import functions as F

from dayweave.operators import intervals as iv
from dayweave.operators import rolling as ro
from dayweave.operators import scaling as sc
from dayweave.operators.ordered import time_bucket
from dayweave.plans.base import DAILY, SPARSE, daily, order_days, ORDER_DAYS, r, sparse_daily, table
from dayweave.plans.registry import query

K = ["entity"]
W = "PARTITION BY entity ORDER BY day"
SCALED = f"""{DAILY},
scaled AS (SELECT entity, day, pos, (a - min(a) OVER v) / (max(a) OVER v - min(a) OVER v) AS a,
  (b - min(b) OVER v) / (max(b) OVER v - min(b) OVER v) AS b,
  (pain - min(pain) OVER v) / (max(pain) OVER v - min(pain) OVER v) AS pain FROM daily WINDOW v AS (PARTITION BY entity))"""


def full(col, n, agg="avg", lo=None, hi="CURRENT ROW"):
    lo = f"{n - 1} PRECEDING" if lo is None else lo
    over = f"OVER ({W} ROWS BETWEEN {lo} AND {hi})"
    return f"CASE WHEN count({col}) {over} = {n} THEN {agg}({col}) {over} END"


def scaled(spark, sf):
    return sc.minmax_columns(daily(spark, sf), K, ["a", "b", "pain"])


@query("e01_rolling_mean", f"""WITH {SCALED} SELECT entity, day, round(a, 6) AS a, round({full('a', 7)}, 6) AS "a_RollingMean" FROM scaled""")
def rolling_mean(spark, sf):
    out = ro.rolling_mean_columns(daily(spark, sf), K, ["a"], 7)
    return out.select("entity", "day", r("a").alias("a"), r("a_RollingMean").alias("a_RollingMean"))


@query(
    "e02_relative_median",
    f"""WITH {DAILY} SELECT entity, day, round(({full('a', 5, 'median')}) / nullif({full('a', 15, 'median')}, 0), 6) AS rel FROM daily""",
)
def relative(spark, sf):
    out = ro.relative_median_columns(daily(spark, sf), K, ["a"], 5, 15)
    return out.select("entity", "day", r("a_relative_5_15").alias("rel"))


@query("e03_centred_mean", f"""WITH {SPARSE} SELECT entity, day, round({full('pain', 3, 'avg', '1 PRECEDING', '1 FOLLOWING')}, 6) AS pain FROM sparse""")
def centred(spark, sf):
    return sparse_daily(spark, sf).select("entity", "day", r(ro.centred_mean("pain", K, 3)).alias("pain"))


@query(
    "e04_centred_mean_partial",
    f"""WITH {SPARSE}, t AS (SELECT entity, day, avg(pain) OVER ({W} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS m FROM sparse)
SELECT entity, day, round(coalesce(lead(m, 7) OVER ({W}), 0), 6) AS pain FROM t""",
)
def centred_partial(spark, sf):
    return sparse_daily(spark, sf).select("entity", "day", r(ro.centred_mean_partial("pain", K, 15)).alias("pain"))


@query("e05_centred_median", f"""WITH {SCALED} SELECT entity, day, round({full('b', 15, 'median', '7 PRECEDING', '7 FOLLOWING')}, 6) AS b FROM scaled""")
def centred_median(spark, sf):
    return scaled(spark, sf).select("entity", "day", r(ro.centred_median("b", K, 15)).alias("b"))


def minmax_sql(source, col, back, ahead, digits=6):
    """Oracle of the sliced MinMax, written with array-free windows."""
    return f"""masked AS (SELECT entity, day, pos, {col} AS x, CASE WHEN lead(1) OVER ({W}) IS NOT NULL THEN {col} END AS m,
  CASE WHEN pos >= {back} THEN lag({col}, {back}) OVER ({W}) ELSE first_value({col}) OVER ({W}) END AS f FROM {source}),
rawmm AS (SELECT entity, day, pos, CASE WHEN f IS NOT NULL THEN (x - min(m) OVER fr) / nullif(max(m) OVER fr - min(m) OVER fr, 0) END AS v
  FROM masked WINDOW fr AS ({W} ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING)),
mm AS (SELECT entity, day, pos, coalesce(last_value(v IGNORE NULLS) OVER ({W}), 0) AS v FROM rawmm)"""


@query("e06_rolling_minmax", f"""WITH {SPARSE}, {minmax_sql('sparse', 'pain', 8, 6)} SELECT entity, day, round(v, 6) AS pain FROM mm""")
def rolling_minmax(spark, sf):
    out = ro.rolling_minmax(sparse_daily(spark, sf), K, "pain", 15, "mm")
    return out.select("entity", "day", r("mm").alias("pain"))


@query("e07_rolling_minmax_shifted", f"""WITH {SPARSE}, {minmax_sql('sparse', 'pain', 35, 14)} SELECT entity, day, round(v, 6) AS pain FROM mm""")
def minmax_shifted(spark, sf):
    out = ro.rolling_minmax_shifted(sparse_daily(spark, sf), K, "pain", 50, 15, "mm")
    return out.select("entity", "day", r("mm").alias("pain"))


@query(
    "e08_trailing_minmax_days",
    f"""WITH {ORDER_DAYS}, x AS (SELECT entity, day, CAST(cents AS DOUBLE) / n / 131071.0 AS p FROM order_days)
SELECT entity, day, round(coalesce((p - min(p) OVER w) / nullif(max(p) OVER w - min(p) OVER w, 0), 0), 6) AS level FROM x
WINDOW w AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 179 DAY PRECEDING AND CURRENT ROW)""",
)
def trailing_days(spark, sf):
    x = order_days(spark, sf).withColumn("p", F.col("cents").cast("double") / F.col("n") / 131071.0)
    return x.select("entity", "day", r(ro.trailing_minmax_days("p", K)).alias("level"))


@query(
    "e09_relative_minmax",
    f"""WITH {DAILY}, l AS (SELECT entity, day, pos, b, min(b) OVER w AS lo, max(b) OVER w AS hi FROM daily WINDOW w AS ({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
h AS (SELECT entity, lo AS hlo, hi AS hhi FROM l WHERE pos = 30)
SELECT entity, day, round(CASE WHEN pos >= 29 THEN (b - lo) / nullif(hi - lo, 0) ELSE (b - hlo) / nullif(hhi - hlo, 0) END, 6) AS b FROM l JOIN h USING (entity)""",
)
def relative_minmax(spark, sf):
    return ro.relative_minmax_column(daily(spark, sf), K, "b", 30, "rel").select("entity", "day", r("rel").alias("b"))


@query(
    "e10_ewm_adjusted",
    f"""WITH {DAILY} SELECT x.entity, x.day, round(sum(y.a * pow(1 - 2.0::DOUBLE / 22, x.pos - y.pos)) / sum(pow(1 - 2.0::DOUBLE / 22, x.pos - y.pos)), 6) AS a
FROM daily x JOIN daily y ON x.entity = y.entity AND y.pos <= x.pos GROUP BY 1, 2""",
)
def ewm(spark, sf):
    out = ro.ewm_mean(daily(spark, sf).select("entity", "day", "a"), K, ["a"], span=21)
    return out.select("entity", "day", r("a_ewm").alias("a"))


@query(
    "e11_ewm_recursive",
    f"""WITH {DAILY} SELECT x.entity, x.day, round(sum(y.a * pow(0.5, (x.pos - y.pos) / 10.0::DOUBLE) * CASE WHEN y.pos = 0 THEN 1 ELSE 1 - pow(0.5, 0.1::DOUBLE) END), 6) AS a
FROM daily x JOIN daily y ON x.entity = y.entity AND y.pos <= x.pos GROUP BY 1, 2""",
)
def ewm_recursive(spark, sf):
    out = ro.ewm_mean(daily(spark, sf).select("entity", "day", "a"), K, ["a"], halflife=10, adjust=False)
    return out.select("entity", "day", r("a_ewm").alias("a"))


@query(
    "e12_trailing_means",
    f"""WITH {DAILY} SELECT entity, day, {', '.join(f"round({full('a', n)}, 6) AS m{n}" for n in (7, 14, 31, 90))} FROM daily""",
)
def trailing(spark, sf):
    means = [r(ro.trailing_mean("a", K, n)).alias(f"m{n}") for n in (7, 14, 31, 90)]
    return daily(spark, sf).select("entity", "day", *means)


@query(
    "e13_insult_intensity",
    f"""WITH {SCALED}, i AS (SELECT entity, day, pos, CASE WHEN pos < 7 THEN 0 ELSE avg(a) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS i FROM scaled)
SELECT entity, day, round(i, 6) AS intensity, round(i - CASE WHEN pos < 15 THEN 0 ELSE min(i) OVER ({W} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) END, 6) AS rise FROM i""",
)
def insult(spark, sf):
    out = ro.insult_intensity(daily(spark, sf), K, ["a"], 7, 15)
    return out.select("entity", "day", r("aInsultIntensity").alias("intensity"), r("aMaxInsultDiff").alias("rise"))


@query(
    "e14_above_with_neighbour",
    f"""WITH {DAILY} SELECT entity, day, CASE WHEN lag(a) OVER w IS NOT NULL AND lead(a) OVER w IS NOT NULL AND a >= 2 AND (lag(a) OVER w >= 2 OR lead(a) OVER w >= 2) THEN 1.0 ELSE 0.0 END::DOUBLE AS flag FROM daily WINDOW w AS ({W})""",
)
def neighbour(spark, sf):
    return daily(spark, sf).select("entity", "day", ro.above_with_neighbour("a", K, 2.0).alias("flag"))


@query(
    "e15_above_row_limit",
    f"""WITH {DAILY} SELECT entity, day, CASE WHEN lag(1) OVER w IS NULL OR lead(1) OVER w IS NULL THEN a WHEN a * 150 >= pain THEN 1.0 ELSE 0.0 END::DOUBLE AS flag FROM daily WINDOW w AS ({W})""",
)
def row_limit(spark, sf):
    df = daily(spark, sf).withColumn("limit", F.col("pain") / 150)
    df = df.withColumn("scaled", F.col("a") * 150)
    flag = ro.above_row_limit("scaled", "pain", K)
    edge_fixed = F.when(F.col("flag").isin(0.0, 1.0), F.col("flag")).otherwise(F.col("a"))
    return df.select("entity", "day", "a", flag.alias("flag")).select("entity", "day", edge_fixed.alias("flag"))


def _prev_mean(c, n):
    return f"CASE WHEN pos < {n} THEN avg({c}) FILTER (pos < {n - 1}) OVER (PARTITION BY entity) ELSE avg({c}) OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"


@query(
    "e16_acute_chronic_load",
    f"""WITH {SCALED}, m AS (SELECT entity, day, pos, {_prev_mean('a', 7)} AS a1, {_prev_mean('a', 14)} AS a2, {_prev_mean('a', 60)} AS c, {_prev_mean('pain', 60)} AS s FROM scaled),
d AS (SELECT entity, day, pos, CASE WHEN a1 - c < 0 THEN 0 ELSE (a1 - c) / nullif(c / nullif(s, 0), 0) END AS d1, CASE WHEN a2 - c < 0 THEN 0 ELSE (a2 - c) / nullif(c / nullif(s, 0), 0) END AS d2 FROM m),
d2 AS (SELECT entity, day, d1, CASE WHEN pos = 0 THEN lead(d2) OVER ({W}) ELSE d2 END AS d2 FROM d),
x AS (SELECT *, max(d1) OVER (PARTITION BY entity) AS m1, max(d2) OVER (PARTITION BY entity) AS m2 FROM d2)
SELECT entity, day, round(greatest(CASE WHEN m2 > m1 THEN d1 ELSE d1 * (m2 / m1) END, CASE WHEN m2 > m1 THEN d2 * (m1 / m2) ELSE d2 END), 6) AS load FROM x""",
)
def acute(spark, sf):
    out = ro.acute_chronic_load(scaled(spark, sf), K, "a", "pain", 7, 14, 60)
    return out.select("entity", "day", r("load_excess").alias("load"))


@query("e17_add_low_level", f"WITH {SCALED} SELECT entity, day, round((a + 0.1) / 1.1, 6) AS a FROM scaled")
def low_level(spark, sf):
    from dayweave.functions.expressions import add_low_level

    return scaled(spark, sf).select("entity", "day", r(add_low_level("a", 0.1)).alias("a"))


@query(
    "e18_forward_fill",
    f"""WITH {SPARSE} SELECT entity, day, coalesce(last_value(pain IGNORE NULLS) OVER ({W}), first_value(pain IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS pain FROM sparse""",
)
def forward(spark, sf):
    return sparse_daily(spark, sf).select("entity", "day", ro.forward_fill("pain", K).alias("pain"))


@query(
    "e19_fill_zeros_with_neighbours",
    f"""WITH {DAILY}, z AS (SELECT entity, pos, b, row_number() OVER ({W}) AS rk FROM daily WHERE b <> 0),
k AS (SELECT d.entity, d.day, d.pos, d.b, (SELECT count(*) FROM z WHERE z.entity = d.entity AND z.pos < d.pos) AS k FROM daily d)
SELECT k.entity, k.day, round(CASE WHEN k.b <> 0 THEN k.b ELSE coalesce((SELECT median(z.b) FROM z WHERE z.entity = k.entity AND z.rk > k.k - 10 AND z.rk <= k.k + 10), 0) END, 6) AS b FROM k""",
)
def zeros(spark, sf):
    out = ro.fill_zeros_with_neighbours(daily(spark, sf), K, "b")
    return out.select("entity", "day", r("b").alias("b"))


@query(
    "e20_extend_with_recent_mean",
    f"""WITH {DAILY}, t AS (SELECT entity, avg(b) AS b FROM (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY entity ORDER BY day DESC) <= 7) GROUP BY 1)
SELECT entity, day, round(b, 6) AS b FROM daily UNION ALL
SELECT entity, CAST(hi + CAST(i AS INTEGER) AS DATE), round(b, 6) FROM t, span, (SELECT unnest(range(1, 400)) AS i) WHERE hi + CAST(i AS INTEGER) <= DATE '2001-09-30'""",
)
def extend(spark, sf):
    out = ro.extend_with_recent_mean(daily(spark, sf).select("entity", "day", "b"), K, "b", "2001-09-30")
    return out.select("entity", "day", r("b").alias("b"))


@query(
    "e21_number_in_group",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS activity_n FROM events",
)
def number(spark, sf):
    ev = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return ro.number_in_group(ev, ["user_id", "day"], ["ts", "event_id"], time_bucket("ts", 3600)).select("event_id", F.col("activity_n").cast("long"))


@query(
    "e22_intervals_from_events",
    "SELECT event_id, ts AS start_ts, lead(ts) OVER w AS end_ts, lead(event_type) OVER w AS next_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def from_events(spark, sf):
    out = iv.intervals_from_events(table(spark, sf, "events"), ["user_id"], "ts", "event_id", ["event_type"])
    return out.select("event_id", "start_ts", "end_ts", F.col("event_type_next").alias("next_type"))


@query(
    "e23_consecutive_days",
    f"""WITH {ORDER_DAYS}, g AS (SELECT entity, day, CASE WHEN day - lag(day) OVER ({W}) > 1 THEN 1 ELSE 0 END AS gap FROM order_days),
e AS (SELECT entity, day, CAST(sum(gap) OVER ({W}) AS BIGINT) AS event_num FROM g)
SELECT entity, day, event_num, row_number() OVER (PARTITION BY entity, event_num ORDER BY day) AS day_num FROM e""",
)
def consecutive(spark, sf):
    out = ro.consecutive_days(order_days(spark, sf).select("entity", "day"), K)
    return out.select("entity", "day", "event_num", F.col("day_num").cast("long").alias("day_num"))


@query("e24_difference", f"WITH {DAILY} SELECT entity, day, b - lag(b, 15) OVER ({W}) AS b FROM daily")
def difference(spark, sf):
    return daily(spark, sf).select("entity", "day", ro.difference("b", K, 15).alias("b"))


@query(
    "e25_weighted_strain",
    f"""WITH {SCALED}, s AS (SELECT entity, day, 1.0 * a + 0.15 * b AS s FROM scaled)
SELECT entity, day, round((s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w), 6) AS strain FROM s WINDOW w AS (PARTITION BY entity)""",
)
def strain(spark, sf):
    s = scaled(spark, sf).withColumn("s", sc.weighted_strain({"a": 1.0, "b": 0.15}))
    return sc.minmax_columns(s, K, ["s"]).select("entity", "day", r("s").alias("strain"))


def _mm(c):
    return f"({c} - min({c}) OVER v) / (max({c}) OVER v - min({c}) OVER v)"


@query(
    "e26_region_strain",
    f"""WITH {DAILY}, s AS (SELECT *, a / 3.0::DOUBLE + b / 7.0::DOUBLE AS strain FROM daily),
m AS (SELECT entity, day, {full('strain', 14)} AS sm, {full('pain', 14)} AS pm FROM s),
n AS (SELECT entity, day, {_mm('sm')} AS ss, {_mm('pm')} AS ps FROM m WINDOW v AS (PARTITION BY entity))
SELECT entity, day, round(coalesce(ss, avg(ss) OVER v), 6) AS strain, round(coalesce(ps, avg(ps) OVER v), 6) AS pain FROM n WINDOW v AS (PARTITION BY entity)""",
)
def region(spark, sf):
    out = ro.region_strain(daily(spark, sf), K, {"a": 3.0, "b": 7.0}, "pain")
    return out.select("entity", "day", r("strain_scaled").alias("strain"), r("pain_scaled").alias("pain"))


@query(
    "e27_region_stress_formula",
    f"""WITH {SCALED}, s AS (SELECT entity, day, 0.2 * a + 2.8 * b + 0.5 * pain AS arm, {full('a', 90)} AS am FROM scaled),
m AS (SELECT entity, day, {full('arm', 90)} AS arm, am FROM s)
SELECT entity, day, round({_mm('arm')}, 6) AS arm, round({_mm('am')}, 6) AS a FROM m WINDOW v AS (PARTITION BY entity)""",
)
def stress(spark, sf):
    s = scaled(spark, sf).withColumn("arm", sc.weighted_strain({"a": 0.2, "b": 2.8, "pain": 0.5}))
    s = s.withColumns({"arm": ro.trailing_mean("arm", K, 90), "am": ro.trailing_mean("a", K, 90)})
    out = sc.minmax_columns(s, K, ["arm", "am"])
    return out.select("entity", "day", r("arm").alias("arm"), r("am").alias("a"))


@query("e28_tune_factors")
def tune(spark, sf):
    return ro.tune_factors(daily(spark, sf), K, {"a": 100.0, "b": 200.0}, "pain")


@query(
    "e29_repair_low_values",
    f"""WITH RECURSIVE {DAILY}, rep AS (
  SELECT entity, pos, day, a AS m0, b AS s0, CAST(NULL AS DOUBLE) AS m1, CAST(NULL AS DOUBLE) AS s1, CAST(NULL AS DOUBLE) AS m2, CAST(NULL AS DOUBLE) AS s2 FROM daily WHERE pos = 0
  UNION ALL
  SELECT d.entity, d.pos, d.day, CASE WHEN d.a < 1 AND d.pos >= 3 THEN (r.m2 + r.m1 + r.m0) / 3 ELSE d.a END, CASE WHEN d.a < 1 AND d.pos >= 3 THEN (r.s2 + r.s1 + r.s0) / 3 ELSE d.b END, r.m0, r.s0, r.m1, r.s1
  FROM rep r JOIN daily d ON d.entity = r.entity AND d.pos = r.pos + 1)
SELECT entity, day, round(m0, 6) AS a, round(s0, 6) AS b FROM rep""",
)
def repair(spark, sf):
    out = ro.repair_low_values(daily(spark, sf).select("entity", "day", "a", "b"), K, "a", "b", limit=1.0)
    return out.select("entity", "day", r("a_repaired").alias("a"), r("b_repaired").alias("b"))
