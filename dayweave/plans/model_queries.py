"""Queries for events and models."""

from pyspark.sql import functions as F

from dayweave.operators import events as ev
from dayweave.operators import models as md
from dayweave.plans.base import DAILY, daily, r, sql_normal_p
from dayweave.plans import registry
from dayweave.plans.registry import query

K = ["entity"]
W = "PARTITION BY entity ORDER BY day"
SPIKE = 2.0
START = "1995-01-01"

SPIKES = f"""{DAILY}, chg AS (SELECT entity, day, a - lag(a) OVER ({W}) AS change FROM daily),
hot AS (SELECT *, day - lag(day) OVER ({W}) AS gap FROM chg WHERE change > {SPIKE}), spk AS MATERIALIZED (SELECT entity, day, gap FROM hot WHERE gap > 2),
dro AS (SELECT *, day - lag(day) OVER ({W}) AS gap FROM chg WHERE change < 0), drp AS (SELECT entity, day, gap FROM dro WHERE gap > 0),
pd AS MATERIALIZED (SELECT DISTINCT entity, day - k AS day FROM spk, (SELECT unnest([0, 1])::INTEGER AS k))"""

CALM = f"""{SPIKES}, cs AS (SELECT d.entity, d.day, coalesce((SELECT min(p.day) FROM pd p WHERE p.entity = d.entity AND p.day >= d.day), (SELECT max(day) + 1 FROM daily)) AS stop FROM drp d),
cr AS (SELECT entity, day + 3 AS lo, CAST(floor((stop - day - 3) / 2) AS INTEGER) AS pairs FROM cs WHERE stop - day - 3 >= 2),
cm AS MATERIALIZED (SELECT DISTINCT entity, lo + CAST(k AS INTEGER) AS day FROM cr, (SELECT unnest(range(0, 400)) AS k) WHERE k < 2 * pairs)"""


@query("m01_pain_events", f"WITH {SPIKES} SELECT 'spike' AS kind, entity, day, CAST(gap AS INTEGER) AS days_before FROM spk UNION ALL SELECT 'drop', entity, day, CAST(gap AS INTEGER) FROM drp")
def m01(spark, sf):
    d = daily(spark, sf)
    spikes = ev.pain_events(d, K, "a", True, SPIKE).withColumn("kind", F.lit("spike"))
    drops = ev.pain_events(d, K, "a", False).withColumn("kind", F.lit("drop"))
    return spikes.unionByName(drops).select("kind", "entity", "day", "days_before")


@query("m02_calm_days", f"WITH {CALM} SELECT entity, day, 'calm' AS kind FROM cm UNION ALL SELECT entity, day, 'pain' FROM pd")
def m02(spark, sf):
    d = daily(spark, sf)
    pain = ev.pain_days(ev.pain_events(d, K, "a", True, SPIKE), K)
    last = d.groupBy("entity").agg(F.max("day").alias("last_day"))
    calm = ev.calm_days(ev.pain_events(d, K, "a", False), pain, last, K, 3)
    return calm.withColumn("kind", F.lit("calm")).unionByName(pain.withColumn("kind", F.lit("pain")))




@query(
    "m03_event_matrix",
    f"""WITH {CALM}, hg AS (SELECT d.entity, d.day, d.a, d.b, CASE WHEN d.day - lag(d.day) OVER (PARTITION BY d.entity ORDER BY d.day) > 1 THEN 1 ELSE 0 END AS g FROM daily d JOIN pd USING (entity, day)),
he AS (SELECT *, sum(g) OVER ({W}) AS en FROM hg), hn AS (SELECT *, row_number() OVER (PARTITION BY entity, en ORDER BY day) AS dn FROM he),
ce AS (SELECT d.entity, d.day, d.a, d.b, row_number() OVER (PARTITION BY d.entity ORDER BY d.day) - 1 AS k FROM daily d JOIN cm USING (entity, day)),
al AS (SELECT entity, en AS event_num, dn, day, a, b, 1 AS pain FROM hn UNION ALL SELECT entity, k // 2 + 1, k % 2 + 1, day, a, b, 0 FROM ce),
pv AS (SELECT entity, pain, event_num, max(day) FILTER (dn = 1) AS day_0, max(day) FILTER (dn = 2) AS day_1, max(a) FILTER (dn = 1) AS a_0, max(a) FILTER (dn = 2) AS a_1, max(b) FILTER (dn = 1) AS b_0, max(b) FILTER (dn = 2) AS b_1 FROM al GROUP BY 1, 2, 3)
SELECT entity, CAST(pain AS INTEGER) AS pain, CAST(event_num AS BIGINT) AS event_num, day_0, day_1, a_0, a_1, b_0, b_1, CASE WHEN day_1 - DATE '{START}' >= 30 THEN (SELECT count(*) FROM spk WHERE spk.entity = pv.entity AND spk.day BETWEEN day_1 - 30 AND day_1 - 1) END AS num_pain_events FROM pv""",
)
def m03(spark, sf):
    return ev.event_matrix(daily(spark, sf), K, "a", ["a", "b"], START, 3, 30, SPIKE).withColumn("event_num", F.col("event_num").cast("long"))


@query(
    "m03_changed_events",
    f"""WITH m AS ({registry.ORACLES["m03_event_matrix"]}), same AS (SELECT entity, day_1 AS d FROM m WHERE a_0 = a_1),
kept AS (SELECT * FROM m WHERE a_0 <> a_1 AND NOT EXISTS (SELECT 1 FROM same s WHERE s.entity = m.entity AND m.day_1 BETWEEN s.d + 1 AND s.d + 29))
SELECT entity, event_num, a_1 - a_0 AS pain_change, b_0, b_1, num_pain_events FROM kept WHERE b_0 IS NOT NULL AND b_1 IS NOT NULL AND num_pain_events IS NOT NULL AND day_0 IS NOT NULL""",
)
def m03_changed(spark, sf):
    """Events without those that follow an unchanged one, as a regression frame."""
    matrix = ev.event_matrix(daily(spark, sf), K, "a", ["a", "b"], START, 3, 30, SPIKE).withColumn("event_num", F.col("event_num").cast("long"))
    frame = ev.model_frame(ev.drop_unchanged(matrix, K, "a"), regression_on="a", drop_fields=["day"])
    return frame.select("entity", "event_num", "pain_change", "b_0", "b_1", "num_pain_events")


def frame(spark, sf):
    return ev.event_matrix(daily(spark, sf), K, "pain", ["a", "b"], START, 3, 30, 0.5)


FEATURES = ["a_0", "b_0", "a_1", "b_1", "num_pain_events"]


@query("m04_forest_importances")
def m04(spark, sf):
    """Importances of the best forest of a 2 x 3 grid under 5 folds, its confusion counts, and every cell's accuracy."""
    _model, confusion, importances, scores = md.train_forest(frame(spark, sf), FEATURES, trees=(10, 20), depths=(3, 5, 7), folds=5)
    parts = importances.select(F.lit("importance").alias("kind"), "variable", F.col("importance").alias("value"))
    parts = parts.unionByName(confusion.select(F.lit("confusion").alias("kind"), F.concat_ws("|", F.col("label").cast("int"), F.col("prediction").cast("int")).alias("variable"), F.col("n").cast("double").alias("value")))
    return parts.unionByName(scores.select(F.lit("accuracy").alias("kind"), F.concat_ws("|", "trees", "depth").alias("variable"), F.col("accuracy").alias("value")))


@query("m05_shadow_selection")
def m05(spark, sf):
    """Ends when every feature is decided; a feature that wins about half its rounds stays tentative after 40."""
    return md.shadow_selection(frame(spark, sf), FEATURES, max_rounds=40, trees=10, together=8)


@query(
    "m06_vif_elimination",
    f"""WITH {DAILY}, g AS (SELECT entity, sum(a * a) AS aa, sum(a * b) AS ab, sum(a * pain) AS ap, sum(b * b) AS bb, sum(b * pain) AS bp, sum(pain * pain) AS pp FROM daily GROUP BY 1),
d AS (SELECT *, aa * (bb * pp - bp * bp) - ab * (ab * pp - bp * ap) + ap * (ab * bp - bb * ap) AS det FROM g),
v AS (SELECT entity, unnest([{{'k': 1, 'n': 'a', 'v': aa * (bb * pp - bp * bp) / det}}, {{'k': 2, 'n': 'b', 'v': bb * (aa * pp - ap * ap) / det}}, {{'k': 3, 'n': 'pain', 'v': pp * (aa * bb - ab * ab) / det}}]) AS x FROM d),
w AS (SELECT entity, arg_max(x.n, x.v) AS worst, max(x.v) AS mx FROM v GROUP BY 1),
u AS (SELECT w.*, CASE worst WHEN 'a' THEN bb * pp / (bb * pp - bp * bp) WHEN 'b' THEN aa * pp / (aa * pp - ap * ap) ELSE aa * bb / (aa * bb - ab * ab) END AS v2 FROM w JOIN g USING (entity)),
f AS (SELECT v.entity, x.n AS n, x.v AS v1, worst, mx, v2, min(x.k) FILTER (x.n <> worst) OVER (PARTITION BY v.entity) = x.k AS is_first FROM v JOIN u USING (entity))
SELECT entity, n AS variable, round(CASE WHEN mx <= 5 OR n = worst THEN v1 WHEN v2 <= 5 OR is_first THEN v2 ELSE 1 END, 6) AS vif, mx <= 5 OR (n <> worst AND (v2 <= 5 OR NOT is_first)) AS kept FROM f""",
)
def m06(spark, sf):
    return md.vif_elimination(daily(spark, sf), K, ["a", "b", "pain"]).withColumn("vif", r("vif"))


@query(
    "m07_granger_one_lag",
    f"""WITH {DAILY}, l AS (SELECT entity, a AS y1, lag(a) OVER ({W}) AS y1l, pain AS y2, lag(pain) OVER ({W}) AS y2l FROM daily),
c AS (SELECT entity, count(*) AS n, corr(y1, y2l) AS yx, corr(y1, y1l) AS yy, corr(y2l, y1l) AS xy, corr(y2, y1l) AS zx, corr(y2, y2l) AS zz FROM l WHERE y1l IS NOT NULL GROUP BY 1),
t AS (SELECT entity, 'a' AS effect, 'pain' AS cause, n, pow((yx - yy * xy) / sqrt((1 - yy * yy) * (1 - xy * xy)), 2) AS r2 FROM c UNION ALL
  SELECT entity, 'pain', 'a', n, pow((zx - zz * xy) / sqrt((1 - zz * zz) * (1 - xy * xy)), 2) FROM c),
who AS (SELECT DISTINCT entity FROM daily), p AS (SELECT entity, effect, cause, {sql_normal_p('sqrt(n * r2 / (1 - r2))')} AS p FROM t)
SELECT entity, effect, cause, round(p, 6) + 0.0 AS min_p FROM p UNION ALL SELECT entity, 'a', 'a', 1.0 FROM who UNION ALL SELECT entity, 'pain', 'pain', 1.0 FROM who""",
)
def m07_one(spark, sf):
    out = md.granger_matrix(daily(spark, sf), K, ["a", "pain"], max_lag=1)
    return out.select("entity", "effect", "cause", r("min_p").alias("min_p"))


@query(
    "m08_unit_root_no_lags",
    f"""WITH {DAILY}, l AS (SELECT entity, lag(a) OVER ({W}) AS x, a - lag(a) OVER ({W}) AS d FROM daily),
s AS (SELECT entity, count(*) AS n, regr_slope(d, x) AS b, regr_sxx(d, x) AS sxx, regr_syy(d, x) AS syy FROM l WHERE x IS NOT NULL GROUP BY 1)
SELECT entity, 'a' AS variable, n, 0 AS lags, round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 5) AS statistic FROM s""",
)
def m08_plain(spark, sf):
    out = md.unit_root_test(daily(spark, sf), K, ["a"], max_lag=0)
    return out.select("entity", "variable", "n", "lags", r("statistic", 5).alias("statistic"))


@query(
    "m09_var_order_one",
    f"""WITH {DAILY}, l AS (SELECT entity, a AS y, lag(a) OVER ({W}) AS x FROM daily), s AS (SELECT entity, count(*) AS n, regr_syy(y, x) * (1 - regr_r2(y, x)) AS ssr FROM l WHERE x IS NOT NULL GROUP BY 1)
SELECT entity, 1 AS "order", round(ln(ssr / n) + 2.0::DOUBLE / n * 2, 6) AS aic, true AS best FROM s""",
)
def m09_one(spark, sf):
    return md.var_order(daily(spark, sf), K, ["a"], max_lag=1).withColumn("aic", r("aic"))


@query("m07_granger_matrix")
def m07(spark, sf):
    return md.granger_matrix(daily(spark, sf), K, ["a", "b", "pain"], max_lag=12)


@query("m08_unit_root_test")
def m08(spark, sf):
    return md.unit_root_test(daily(spark, sf), K, ["a", "pain"], max_lag=12)


@query("m09_var_order")
def m09_order(spark, sf):
    return md.var_order(daily(spark, sf), K, ["a", "pain"], max_lag=12)


@query(
    "m09_var_coefficients",
    f"""WITH {DAILY}, t AS (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY entity ORDER BY day DESC) > 300),
l AS (SELECT entity, a AS y, lag(a) OVER ({W}) AS x FROM t), f AS (SELECT entity, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM l WHERE x IS NOT NULL GROUP BY 1)
SELECT entity, 'a' AS equation, 'const' AS term, 0 AS lag, round(i, 6) AS coefficient FROM f UNION ALL SELECT entity, 'a', 'a', 1, round(s, 6) FROM f""",
)
def m09(spark, sf):
    return md.var_coefficients(daily(spark, sf), K, ["a"], lags=1).withColumn("coefficient", r("coefficient"))
