"""Queries for the significance tests and weighted summaries."""

from pyspark.sql import functions as F

from dayweave.operators import peaks as pk
from dayweave.operators import stats as st
from dayweave.plans.base import DAILY, daily, r, sql_normal_p, sql_t_p, table
from dayweave.plans.peak_queries import K, RATES, Chain
from dayweave.plans.registry import query


@query(
    "h01_poisson_test",
    f"""WITH c AS (SELECT o_orderpriority AS entity, count(*) FILTER (o_orderstatus = 'F') AS n1, 100.0::DOUBLE AS e1, count(*) FILTER (o_orderstatus = 'O') AS n2, 104.0::DOUBLE AS e2 FROM orders GROUP BY 1),
z AS (SELECT *, (n1 - n2 * (e1 / e2)) / sqrt((n1 + n2) * (e1 / e2)) AS z FROM c)
SELECT entity, n1, n2, round(z, 6) AS z, round({sql_normal_p('z')}, 6) AS p_value, round((n2 / e2) / (n1 / e1), 6) AS ratio FROM z""",
)
def poisson(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("entity")).agg(
        F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n1"),
        F.lit(100.0).alias("e1"),
        F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("n2"),
        F.lit(104.0).alias("e2"),
    )
    out = st.poisson_test(c, "n1", "e1", "n2", "e2")
    return out.select("entity", "n1", "n2", r("z").alias("z"), r("p_value").alias("p_value"), r("ratio").alias("ratio"))


@query(
    "h02_cycle_rate_tests",
    f"""WITH {RATES}, z AS (SELECT *, (n_desc - n_asc * (e_desc / e_asc)) / nullif(sqrt((n_desc + n_asc) * (e_desc / e_asc)), 0) AS z FROM rt)
SELECT entity, range_id, round(z, 6) AS z, round({sql_normal_p('z')}, 6) AS p_value FROM z""",
)
def cycle_rates(spark, sf):
    c = Chain(spark, sf)
    out = st.cycle_rate_tests(c.scores, pk.cycle_days(c.pain, K), K)
    return out.select("entity", "range_id", r("z").alias("z"), r("p_value").alias("p_value"))


@query(
    "h03_two_sample_t",
    f"""WITH m AS (SELECT o_orderpriority AS entity, count(*) FILTER (o_orderstatus = 'F') AS n1, count(*) FILTER (o_orderstatus = 'O') AS n2,
  avg(o_totalprice / 1000) FILTER (o_orderstatus = 'F') AS m1, avg(o_totalprice / 1000) FILTER (o_orderstatus = 'O') AS m2,
  var_samp(o_totalprice / 1000) FILTER (o_orderstatus = 'F') AS v1, var_samp(o_totalprice / 1000) FILTER (o_orderstatus = 'O') AS v2 FROM orders GROUP BY 1),
t AS (SELECT entity, n1 + n2 - 2.0::DOUBLE AS sd, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS s_t,
  (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS w_t, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS wd FROM m)
SELECT entity, round(s_t, 6) AS student_t, round({sql_t_p('s_t', 'sd')}, 6) AS student_p, round(w_t, 6) AS welch_t, round({sql_t_p('w_t', 'wd')}, 6) AS welch_p FROM t""",
)
def t_tests(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("entity"), "o_orderstatus", (F.col("o_totalprice") / 1000).alias("v"))
    student = st.two_sample_t(o, K, "o_orderstatus", "v", "F", "O").select("entity", r("t").alias("student_t"), r("p_value").alias("student_p"))
    welch = st.two_sample_t(o, K, "o_orderstatus", "v", "F", "O", equal_var=False).select("entity", r("t").alias("welch_t"), r("p_value").alias("welch_p"))
    return student.join(welch, "entity")


@query(
    "h04_pearson_test",
    f"""WITH {DAILY}, c AS (SELECT entity, corr(a, pain) AS r, count(*) AS n FROM daily GROUP BY 1), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c)
SELECT entity, n, round(r, 6) AS r, round(t, 5) AS t, round({sql_t_p('t', '(n - 2.0::DOUBLE)')}, 6) + 0.0 AS p_value FROM t""",
)
def pearson(spark, sf):
    out = st.pearson_test(daily(spark, sf), K, "a", "pain")
    return out.select("entity", "n", r("r").alias("r"), r("t", 5).alias("t"), r("p_value").alias("p_value"))


@query(
    "h05_partial_correlation",
    f"""WITH {DAILY}, c AS (SELECT entity, corr(a, b) AS ab, corr(a, pain) AS ap, corr(b, pain) AS bp FROM daily GROUP BY 1),
x AS (SELECT entity, 'pain' AS target, 'a' AS variable, CASE WHEN abs(ab) >= 0.2 THEN 1 ELSE 0 END AS controls, CASE WHEN abs(ab) >= 0.2 THEN (ap - ab * bp) / sqrt((1 - ab * ab) * (1 - bp * bp)) ELSE ap END AS r FROM c
 UNION ALL SELECT entity, 'pain', 'b', CASE WHEN abs(ab) >= 0.2 THEN 1 ELSE 0 END, CASE WHEN abs(ab) >= 0.2 THEN (bp - ab * ap) / sqrt((1 - ab * ab) * (1 - ap * ap)) ELSE bp END FROM c)
SELECT entity, target, variable, controls, round(r, 6) AS partial_r FROM x WHERE abs(r) >= 0.01""",
)
def partial(spark, sf):
    out = st.partial_correlations(daily(spark, sf), K, ["pain"], ["a", "b", "pain"])
    return out.withColumn("partial_r", r("partial_r"))


def _points(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("entity"),
        (F.col("value") % 1 * 0.9 - 0.3).alias("x"),
        (k / 50 - 0.9).alias("y"),
        (F.col("user_id") % 7 + 1).cast("double").alias("w"),
    )


POINTS = """pts AS (SELECT event_type AS entity, value % 1 * 0.9 - 0.3 AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50 - 0.9::DOUBLE AS y, CAST(user_id % 7 + 1 AS DOUBLE) AS w FROM events)"""


@query(
    "h06_weighted_summary",
    f"""WITH {POINTS}, s AS (SELECT entity, count(*) AS n, sum(w * sin(pi() * x)) / sum(w) AS s, sum(w * cos(pi() * x)) / sum(w) AS c, sum(w * y) / sum(w) AS my, sum(w * y * y) / sum(w) AS yy FROM pts GROUP BY 1),
t AS (SELECT entity, n, atan2(s, c) / pi() AS mx, sqrt(-2 * ln(sqrt(s * s + c * c))) / pi() AS sx, my, sqrt(yy - my * my) AS sy FROM s),
d AS (SELECT *, sqrt(pow(mx / sx, 2) + pow(my / sy, 2)) AS m FROM t)
SELECT entity, n, round(mx, 6) AS mean_x, round(sx, 6) AS sd_x, round(my, 6) AS mean_y, round(sy, 6) AS sd_y, round(m, 6) AS mahalanobis, round(exp(-m * m / 2), 6) AS p_mahalanobis FROM d""",
)
def weighted(spark, sf):
    out = st.weighted_summary(_points(spark, sf), K, "x", "y", "w")
    return out.select("entity", "n", *[r(c).alias(c) for c in ("mean_x", "sd_x", "mean_y", "sd_y", "mahalanobis", "p_mahalanobis")])


@query(
    "h07_mahalanobis",
    f"""WITH {POINTS}, s AS (SELECT entity, sum(w * sin(pi() * x)) / sum(w) AS s, sum(w * cos(pi() * x)) / sum(w) AS c, sum(w * y) / sum(w) AS my, sum(w * y * y) / sum(w) AS yy FROM pts GROUP BY 1),
d AS (SELECT entity, sqrt(pow(atan2(s, c) / sqrt(-2 * ln(sqrt(s * s + c * c))), 2) + pow(my, 2) / (yy - my * my)) AS m FROM s)
SELECT entity, round(m, 4) AS mahalanobis, round(exp(-m * m / 2), 6) AS p_mahalanobis FROM d""",
)
def mahalanobis(spark, sf):
    out = st.weighted_summary(_points(spark, sf), K, "x", "y", "w")
    return out.select("entity", r("mahalanobis", 4).alias("mahalanobis"), r("p_mahalanobis").alias("p_mahalanobis"))


@query(
    "h08_hotelling_test",
    f"""WITH {POINTS}, m AS (SELECT entity, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS cxy FROM pts GROUP BY 1),
t AS (SELECT entity, n, n * (mx * mx * vy - 2 * mx * my * cxy + my * my * vx) / (vx * vy - cxy * cxy) AS t2 FROM m), f AS (SELECT *, (n - 2) * t2 / (2 * (n - 1)) AS f FROM t)
SELECT entity, n, round(t2, 3) AS t2, round(f, 4) AS f, round(pow(1 + 2 * f / (n - 2), -(n - 2) / 2.0::DOUBLE), 6) AS p_hotelling FROM f""",
)
def hotelling(spark, sf):
    out = st.hotelling_test(_points(spark, sf), K, "x", "y")
    return out.select("entity", "n", r("t2", 3).alias("t2"), r("f", 4).alias("f"), r("p_hotelling").alias("p_hotelling"))


@query(
    "h09_significant_rows",
    f"""WITH c AS (SELECT user_id AS entity, count(*) FILTER (event_type = 'view') AS n1, count(*) FILTER (event_type = 'click') AS n2 FROM events GROUP BY 1),
z AS (SELECT *, (n1 - n2) / nullif(sqrt(n1 + n2), 0) AS z FROM c), p AS (SELECT *, {sql_normal_p('z')} AS p FROM z)
SELECT entity, n1, n2, round(p, 6) AS p_value FROM p WHERE p <= 0.05""",
)
def significant(spark, sf):
    c = table(spark, sf, "events").groupBy(F.col("user_id").alias("entity")).agg(
        F.count(F.when(F.col("event_type") == "view", 1)).alias("n1"),
        F.count(F.when(F.col("event_type") == "click", 1)).alias("n2"),
        F.lit(1.0).alias("e"),
    )
    out = st.significant_rows(st.poisson_test(c, "n1", "e", "n2", "e"), ["p_value"], ["entity", "p_value"])
    return out.select("entity", "n1", "n2", r("p_value").alias("p_value"))
