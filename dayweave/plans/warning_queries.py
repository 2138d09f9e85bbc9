"""Queries for the warning signs."""

from pyspark.sql import functions as F

from dayweave.operators import warnings as wn
from dayweave.plans.base import r
from dayweave.plans.peak_queries import SMOOTH, W, series
from dayweave.plans.registry import query

K = ["entity"]
HEAD = 90
ALL = f"""{SMOOTH},
d1 AS (SELECT entity, pos, strain, pain, CASE WHEN pos > {HEAD} THEN strain - lag(strain) OVER ({W}) END AS diff, pos >= {HEAD} AND lead(1) OVER ({W}) IS NOT NULL AS ok FROM ser),
d2 AS (SELECT *, max(pos) FILTER (ok AND diff >= 0.02) OVER ({W}) AS lastup FROM d1),
d3 AS (SELECT *, CASE WHEN diff >= 0.02 THEN 0.48 WHEN ok AND pos - lastup <= 10 THEN 0.4 ELSE 0 END::DOUBLE AS rise, CASE WHEN strain >= 0.6 THEN 0.52 WHEN strain >= 0.4 THEN 0.25 ELSE 0 END::DOUBLE AS band FROM d2),
d4 AS (SELECT *, CASE WHEN ok AND rise >= 0.4 THEN 0.600001 ELSE 0 END::DOUBLE AS warning, CASE WHEN ok AND rise >= 0.4 AND band = 0.52 THEN 0.600001 WHEN ok AND rise >= 0.4 AND band = 0.25 THEN 0.6 ELSE 0 END::DOUBLE AS warning2 FROM d3),
d5 AS (SELECT *, warning >= 0.6 AND coalesce(lag(warning) OVER ({W}), 0) < 0.6 AS beg FROM d4),
d6 AS MATERIALIZED (SELECT *, CASE WHEN pos >= {HEAD} THEN pos - coalesce(max(pos) FILTER (beg) OVER ({W}), {HEAD}) + 1 END AS days_since, CASE WHEN pos >= {HEAD} THEN 1 + count(*) FILTER (beg) OVER ({W}) END AS sequence,
  CASE WHEN pos >= {HEAD} THEN pain - avg(pain) OVER ({W} ROWS BETWEEN {HEAD // 2} PRECEDING AND CURRENT ROW) END AS pain_shift FROM d5)"""
KEPT = f"""{ALL}, e1 AS (SELECT * FROM d6 WHERE pos >= {HEAD}), e2 AS (SELECT *, CASE WHEN days_since <> lag(days_since) OVER ({W}) + 1 THEN pos END AS edge FROM e1),
e3 AS MATERIALIZED (SELECT * FROM (SELECT *, min(edge) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM e2) WHERE nx IS NULL OR nx - pos > 20)"""


def warned(spark, sf, rise_only=True):
    return wn.all_warnings(series(spark, sf), K, HEAD, rise_only)


@query("j01_strain_change", f"WITH {ALL} SELECT entity, pos, round(diff, 6) AS strain_diff FROM d6")
def j01(spark, sf):
    return wn.strain_change(series(spark, sf), K, HEAD).select("entity", F.col("pos").cast("long"), r("strain_diff").alias("strain_diff"))


@query("j02_rise_flags", f"WITH {ALL} SELECT entity, pos, rise FROM d6")
def j02(spark, sf):
    return warned(spark, sf).select("entity", F.col("pos").cast("long"), "rise")


@query("j03_level_bands", f"WITH {ALL} SELECT entity, band, count(*) AS n FROM d6 GROUP BY 1, 2")
def j03(spark, sf):
    return wn.level_bands(series(spark, sf)).groupBy("entity", "band").agg(F.count(F.lit(1)).alias("n"))


@query("j04_final_warning", f"WITH {ALL} SELECT entity, pos, warning, warning2 FROM d6")
def j04(spark, sf):
    out = wn.level_bands(wn.rise_flags(wn.strain_change(series(spark, sf), K, HEAD), K, HEAD))
    out = wn.final_warning(out, K, HEAD, rise_only=False).withColumnRenamed("warning", "warning2")
    return wn.final_warning(out, K, HEAD).select("entity", F.col("pos").cast("long"), "warning", "warning2")


@query("j05_warning_sequences", f"WITH {ALL} SELECT entity, pos, days_since, sequence FROM d6")
def j05(spark, sf):
    return warned(spark, sf).select("entity", *[F.col(c).cast("long").alias(c) for c in ("pos", "days_since", "sequence")])


@query("j06_pain_against_recent", f"WITH {ALL} SELECT entity, pos, round(pain_shift, 4) + 0.0 AS pain_shift FROM d6")
def j06(spark, sf):
    return warned(spark, sf).select("entity", F.col("pos").cast("long"), r("pain_shift", 4).alias("pain_shift"))


@query(
    "j07_warning_days",
    f"""WITH {ALL}, t AS (SELECT entity, pos, days_since, warning, max(warning) OVER ({W} ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS top, lead(1) OVER ({W}) AS more FROM d6)
SELECT entity, pos, CASE WHEN top = 0.600001 THEN 'big' ELSE 'small' END AS size FROM t WHERE days_since = 1 AND pos > {HEAD} AND more IS NOT NULL""",
)
def j07(spark, sf):
    return wn.warning_days(warned(spark, sf), K, HEAD).select("entity", F.col("pos").cast("long"), "size")


@query("j08_without_run_up", f"WITH {KEPT} SELECT entity, pos FROM e3")
def j08(spark, sf):
    return wn.without_run_up(warned(spark, sf), K, HEAD).select("entity", F.col("pos").cast("long"))


@query(
    "j09_sequence_traces",
    f"""WITH {KEPT}, n AS (SELECT *, row_number() OVER (PARTITION BY entity, sequence ORDER BY pos DESC) AS k FROM e3)
SELECT entity, sequence, count(*) AS n_days, round(min(pain_shift) FILTER (k > 1 AND k <= 20), 6) AS min_pain FROM n GROUP BY 1, 2""",
)
def j09(spark, sf):
    out = wn.sequence_traces(wn.without_run_up(warned(spark, sf), K, HEAD), K)
    return out.select("entity", F.col("sequence").cast("long").alias("sequence"), "n_days", r("min_pain").alias("min_pain"))


@query(
    "j10_outcome_by_days",
    f"""WITH {ALL}, t AS (SELECT entity, max(days_since) AS top FROM d6 GROUP BY 1), b AS (SELECT d6.entity, CAST(floor(days_since / (top / 10)) AS INTEGER) AS bin, pain_shift FROM d6 JOIN t USING (entity) WHERE pain_shift IS NOT NULL)
SELECT entity, bin, count(*) AS n_values, round(quantile_cont(pain_shift, 0.25), 6) AS p25, round(quantile_cont(pain_shift, 0.5), 6) AS p50, round(quantile_cont(pain_shift, 0.75), 6) AS p75, round(stddev_pop(pain_shift), 6) AS sd FROM b WHERE bin < 10 GROUP BY 1, 2""",
)
def j10(spark, sf):
    out = wn.outcome_by_days(warned(spark, sf), K)
    return out.select("entity", "bin", "n_values", *[r(c).alias(c) for c in ("p25", "p50", "p75", "sd")])
