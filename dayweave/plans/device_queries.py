"""Queries for the device harmonisation."""

from pyspark.sql import functions as F

from dayweave.operators import harmonise as hm
from dayweave.operators import intervals as iv
from dayweave.plans.base import DEVICES, SAMPLES, SPARSE, STAYS, devices, r, samples, sparse_daily, stays, table
from dayweave.plans.registry import query

K = ["entity"]
P = ("1996-01-01", "1998-12-31")
IN = "day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"


def holed(spark, sf):
    """The device pair with main almost zero on some days."""
    gap = F.dayofmonth("day") % 5 == 0
    return devices(spark, sf).withColumn("main", F.when(gap, F.lit(1.0)).otherwise(F.col("main"))).withColumn("steps", F.lit(0.0))


HOLED = f"{DEVICES}, holed AS (SELECT entity, day, CASE WHEN day(day) % 5 = 0 THEN 1.0 ELSE main END AS main, other FROM devices)"


def ratio_sql(main, other, cond, name, source="holed"):
    return f"""{name} AS (SELECT entity, median(CASE WHEN {main} <> 0 AND {other} <> 0 THEN {main} / {other} END) FILTER ({cond}) AS q, median({main}) FILTER ({cond}) / 15 AS low FROM {source} GROUP BY 1)"""


def repaired(main, other):
    return f"CASE WHEN {main} < low AND {other} <> 0 THEN q * {other} ELSE {main} END"


@query(
    "l01_zero_repair",
    f"WITH {HOLED}, {ratio_sql('main', 'other', IN, 'q')} SELECT entity, day, round(CASE WHEN {IN} THEN {repaired('main', 'other')} ELSE 0 END, 5) AS steps, round(q, 6) AS ratio FROM holed JOIN q USING (entity)",
)
def l01(spark, sf):
    out = hm.zero_repair(holed(spark, sf), K, "main", "other", "steps", P, keep_ratio="ratio")
    return out.select("entity", "day", r("steps", 5).alias("steps"), r("ratio").alias("ratio"))


@query("l02_predict_from_other", f"WITH {HOLED} SELECT entity, day, CASE WHEN {IN} THEN 0.25::DOUBLE * other ELSE 0 END AS steps FROM holed")
def l02(spark, sf):
    return hm.predict_from_other(holed(spark, sf), "other", "steps", P, 0.25).select("entity", "day", "steps")


@query("l03_copy_period", f"WITH {HOLED} SELECT entity, day, CASE WHEN {IN} THEN main ELSE 0 END AS steps FROM holed")
def l03(spark, sf):
    return hm.copy_period(holed(spark, sf), "main", "steps", P).select("entity", "day", "steps")


@query(
    "l04_period_plan",
    f"""WITH {HOLED}, {ratio_sql('main', 'other', "day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'", 'q')}
SELECT entity, day, round(CASE WHEN day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' THEN {repaired('main', 'other')} WHEN day BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' THEN q * other WHEN day >= DATE '1998-01-01' THEN main ELSE 0 END, 5) AS steps FROM holed JOIN q USING (entity)""",
)
def l04(spark, sf):
    plan = [
        ("repair", ("1997-01-01", "1997-12-31"), "main", "other", "steps"),
        ("predict", ("1995-01-01", "1996-12-31"), None, "other", "steps"),
        ("copy", ("1998-01-01", "2010-01-01"), "main", None, "steps"),
    ]
    return hm.apply_plan(holed(spark, sf), K, plan).select("entity", "day", r("steps", 5).alias("steps"))


@query(
    "l05_cross_repair",
    f"""WITH {HOLED}, {ratio_sql('main', 'other', IN, 'q')}, {ratio_sql('other', 'main', IN, 'p')}
SELECT h.entity, h.day, round(CASE WHEN {IN} THEN CASE WHEN main < q.low AND other <> 0 THEN q.q * other ELSE main END ELSE main END, 5) AS clicks, round(CASE WHEN {IN} THEN CASE WHEN other < p.low AND main <> 0 THEN p.q * main ELSE other END ELSE other END, 5) AS minutes
FROM holed h JOIN q ON q.entity = h.entity JOIN p ON p.entity = h.entity""",
)
def l05(spark, sf):
    out = hm.cross_repair(holed(spark, sf), K, "main", "other", P)
    return out.select("entity", "day", r("main_corrected", 5).alias("clicks"), r("other_corrected", 5).alias("minutes"))


@query(
    "l06_merge_calories",
    f"""WITH {DEVICES}, m AS (SELECT entity, day, CASE WHEN day >= DATE '2000-01-01' THEN other * 600 WHEN day <= DATE '1996-12-31' THEN main * 8 ELSE main * 9 + lines * 20 END AS c FROM devices),
f AS (SELECT entity, day, CASE WHEN c < 1800 THEN 2200 ELSE c END AS c, CASE WHEN day <= DATE '1996-12-31' OR day >= DATE '2000-01-01' THEN 1.05::DOUBLE ELSE 1 END AS k FROM m)
SELECT entity, day, round(c * k, 5) AS calories, round(CASE WHEN count(c) OVER w = 31 THEN avg(c) OVER w END * k, 4) AS calories_mean FROM f WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 30 PRECEDING AND CURRENT ROW)""",
)
def l06(spark, sf):
    x = devices(spark, sf).withColumns({"base": F.col("main") * 9, "first": F.col("main") * 8, "recent": F.col("other") * 600})
    out = hm.merge_calories(x, K, "base", "first", "recent", "1996-12-31", "2000-01-01", add=F.col("lines") * 20)
    return out.select("entity", "day", r("calories", 5).alias("calories"), r("calories_mean", 4).alias("calories_mean"))


RIDES = f"""{SAMPLES}, {STAYS}, rd AS (SELECT entity, start_ts, end_ts FROM stays WHERE start_ts <= TIMESTAMP '2024-01-15'
  UNION ALL SELECT user_id, ts, ts + to_microseconds(CAST(CASE WHEN value > 126 THEN 108e8::DOUBLE ELSE CAST(round(value * 100) AS BIGINT) * 1e6::DOUBLE END AS BIGINT)) FROM events WHERE event_type = 'purchase' AND ts > TIMESTAMP '2024-01-15')"""


def rides(spark, sf):
    device = table(spark, sf, "events").where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("entity"), F.col("ts").alias("start_ts"), (F.round(F.col("value") * 100) * 1000).cast("long").alias("duration_ms")
    )
    return hm.ride_intervals(stays(spark, sf), device, K, "2024-01-15")


@query(
    "l07_ride_steps",
    f"""WITH {RIDES}, st AS (SELECT rd.entity, rd.start_ts, rd.end_ts, coalesce(sum(value), 0) AS steps FROM rd LEFT JOIN samples s ON s.entity = rd.entity AND s.ts > rd.start_ts AND s.ts < rd.end_ts GROUP BY 1, 2, 3),
mi AS (SELECT *, (epoch_us(end_ts) - epoch_us(start_ts)) / 60e6::DOUBLE AS minutes FROM st)
SELECT entity, start_ts, round(minutes, 5) AS minutes, round(steps, 4) AS steps, round(CASE WHEN steps = 0 THEN floor(median(CASE WHEN steps <> 0 THEN steps / minutes END) OVER (PARTITION BY entity) * minutes) ELSE steps END, 4) AS corrected FROM mi""",
)
def l07(spark, sf):
    rows = rides(spark, sf).withColumn("interval_id", F.struct("start_ts", "end_ts"))
    sums = iv.aggregate_in_intervals(rows, samples(spark, sf), K, start_inclusive=False)
    steps = F.when(F.col("n") > 0, F.round("total", 2)).otherwise(F.lit(0.0))
    rows = rows.join(sums, ["entity", "interval_id"]).withColumn("steps", steps)
    out = hm.ride_steps(rows, K)
    return out.select("entity", "start_ts", r("minutes", 5).alias("minutes"), r("steps", 4).alias("steps"), r("steps_corrected", 4).alias("corrected"))


@query(
    "l08_prepare_sources",
    f"""WITH {SPARSE}, f AS (SELECT entity, day, pos, a, coalesce(pain, CASE WHEN pos > 0 AND lead(1, 7) OVER (PARTITION BY entity ORDER BY pos) IS NOT NULL THEN avg(pain) OVER (PARTITION BY entity ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) END) AS pain, a * 0.5 + pos % 4 AS a2 FROM sparse)
SELECT entity, day, round(pain / max(pain) OVER v, 6) AS pain, round(greatest(a / max(a) OVER v, a2 / max(a2) OVER v), 6) AS steps FROM f WINDOW v AS (PARTITION BY entity)""",
)
def l08(spark, sf):
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("entity").orderBy("day")) - 1
    x = sparse_daily(spark, sf).withColumn("_p", pos).withColumn("a2", F.col("a") * 0.5 + F.col("_p") % 4)
    out = hm.prepare_sources(x, K, "pain", {"steps": ["a", "a2"]})
    return out.select("entity", "day", r("pain").alias("pain"), r("steps").alias("steps"))
