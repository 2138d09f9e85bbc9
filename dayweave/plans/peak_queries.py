"""Queries for smoothing, extrema, cycle scores and what follows from them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayweave.operators import aggregates as ag
from dayweave.operators import peaks as pk
from dayweave.operators import stats as st
from dayweave.operators.ordered import attach
from dayweave.plans.base import DAILY, daily, r, sql_normal_p
from dayweave.plans.registry import query
from dayweave.plans.rolling_queries import SCALED, minmax_sql
from dayweave.session import cut_lineage

K = ["entity"]
W = "PARTITION BY entity ORDER BY pos"
MEAN, RESCALE, MEDIAN, PROM, WIDTH = 15, 90, 7, 0.075, 5.0
STRESS = {"a": 1.0, "b": 0.5}


def series(spark, sf) -> DataFrame:
    return pk.smooth(daily(spark, sf), K, STRESS, "pain", MEAN, RESCALE, MEDIAN, digits=9)


def extrema(spark, sf) -> DataFrame:
    return pk.find_extrema(series(spark, sf), K, ["pain", "strain"], PROM, WIDTH)


class Chain:
    """The shared steps of the peak queries on one set of tables."""

    def __init__(self, spark, sf):
        self.series = series(spark, sf)
        # a few rows per series, read by every later step: computed once
        found = pk.find_extrema(self.series, K, ["pain", "strain"], PROM, WIDTH).persist()
        self.pain = pk.alternate(pk.of_series(found, "pain"), K)
        self.strain = pk.of_series(found, "strain")
        self.peaks = pk.of_series(found, "strain", "max")

    @property
    def scores(self):
        return pk.cycle_scores(self.pain, self.peaks, K)


# --- oracle texts ----------------------------------------------------------------

def centred(col, n, agg):
    lo, hi = n - 1 - n // 2, n // 2
    over = f"OVER ({W} ROWS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING)"
    return f"CASE WHEN count({col}) {over} = {n} THEN {agg}({col}) {over} END"


def mm(col, out):
    return f"CASE WHEN {col} IS NOT NULL THEN coalesce(({col} - min({col}) OVER v) / nullif(max({col}) OVER v - min({col}) OVER v, 0), 0) END AS {out}"


def rescale_sql(name, source, col, mean, back):
    """Sliced MinMax of one column with its own CTE names."""
    text = minmax_sql(source, col, back - mean, mean - 1).replace("ORDER BY day", "ORDER BY pos")
    return text.replace("masked", f"masked_{name}").replace("rawmm", f"rawmm_{name}").replace("mm AS", f"mm_{name} AS")


def chain_sql(mean, rescale, median, prominence, width):
    """Oracle CTE texts of every step for one parameter set."""
    smooth = f"""{SCALED},
st0 AS (SELECT entity, day, pos, 1.0::DOUBLE * a + 0.5::DOUBLE * b AS s, pain AS p FROM scaled),
st1 AS (SELECT entity, day, pos, {mm('s', 's')}, {mm('p', 'p')} FROM st0 WINDOW v AS (PARTITION BY entity)),
st2 AS (SELECT entity, day, pos, s AS s_raw, p AS p_raw, {centred('s', mean, 'avg')} AS s, {centred('p', mean, 'avg')} AS p FROM st1),
st3 AS (SELECT entity, day, pos, s_raw, p_raw, {mm('s', 's')}, {mm('p', 'p')} FROM st2 WINDOW v AS (PARTITION BY entity)),
{rescale_sql('s', 'st3', 's', mean, rescale)},
{rescale_sql('p', 'st3', 'p', mean, rescale)},
st4 AS (SELECT x.entity, x.day, x.pos, s_raw, p_raw, mm_s.v AS s, mm_p.v AS p FROM st3 x JOIN mm_s USING (entity, pos) JOIN mm_p USING (entity, pos)),
ser AS MATERIALIZED (SELECT entity, day, pos, s_raw, p_raw, round({centred('s', median, 'median')}, 9) + 0.0 AS strain, round({centred('p', median, 'median')}, 9) + 0.0 AS pain FROM st4)"""

    extrema = f"""{smooth},
long AS MATERIALIZED (SELECT entity, 'pain' AS series, 'max' AS kind, pos, pain AS x FROM ser UNION ALL SELECT entity, 'pain', 'min', pos, -pain FROM ser
  UNION ALL SELECT entity, 'strain', 'max', pos, strain FROM ser UNION ALL SELECT entity, 'strain', 'min', pos, -strain FROM ser),
brk AS (SELECT *, CASE WHEN x IS DISTINCT FROM lag(x) OVER (PARTITION BY entity, series, kind ORDER BY pos) THEN 1 ELSE 0 END AS nw FROM long),
rid AS (SELECT *, sum(nw) OVER (PARTITION BY entity, series, kind ORDER BY pos) AS run FROM brk),
runs AS (SELECT entity, series, kind, run, min(pos) AS l, max(pos) AS h, any_value(x) AS x FROM rid GROUP BY 1, 2, 3, 4),
cand AS MATERIALIZED (SELECT entity, series, kind, (l + h) // 2 AS p, x AS xp FROM (SELECT *, lag(x) OVER w AS xl, lead(x) OVER w AS xr FROM runs WINDOW w AS (PARTITION BY entity, series, kind ORDER BY run)) WHERE xl < x AND xr < x),
bnd AS MATERIALIZED (SELECT c.entity, c.series, c.kind, c.p, c.xp,
   coalesce(max(s.pos) FILTER (s.pos < c.p AND (s.x > c.xp OR s.x IS NULL)), -1) AS lb,
   coalesce(min(s.pos) FILTER (s.pos > c.p AND (s.x > c.xp OR s.x IS NULL)), 1000000) AS rb
  FROM cand c JOIN long s ON s.entity = c.entity AND s.series = c.series AND s.kind = c.kind GROUP BY ALL),
low AS (SELECT b.entity, b.series, b.kind, b.p, b.xp, b.lb, b.rb, min(s.x) FILTER (s.pos <= b.p) AS lm, min(s.x) FILTER (s.pos >= b.p) AS rm
  FROM bnd b JOIN long s ON s.entity = b.entity AND s.series = b.series AND s.kind = b.kind AND s.pos > b.lb AND s.pos < b.rb GROUP BY ALL),
prom AS MATERIALIZED (SELECT *, xp - greatest(lm, rm) AS prom, xp - 0.5 * (xp - greatest(lm, rm)) AS h FROM low WHERE xp - greatest(lm, rm) >= {prominence}),
base AS (SELECT b.*, max(s.pos) FILTER (s.pos <= b.p AND s.x = b.lm) AS li, min(s.pos) FILTER (s.pos >= b.p AND s.x = b.rm) AS ri
  FROM (SELECT p2.* FROM prom p2) b JOIN long s ON s.entity = b.entity AND s.series = b.series AND s.kind = b.kind AND s.pos > b.lb AND s.pos < b.rb GROUP BY ALL),
cross_at AS (SELECT b.*, coalesce(max(s.pos) FILTER (s.pos <= b.p AND s.x <= b.h), b.li) AS lc, coalesce(min(s.pos) FILTER (s.pos >= b.p AND s.x <= b.h), b.ri) AS rc
  FROM base b JOIN long s ON s.entity = b.entity AND s.series = b.series AND s.kind = b.kind AND s.pos BETWEEN b.li AND b.ri GROUP BY b.entity, b.series, b.kind, b.p, b.xp, b.lb, b.rb, b.lm, b.rm, b.prom, b.h, b.li, b.ri),
wid AS (SELECT c.*, c.lc + CASE WHEN l0.x < c.h THEN (c.h - l0.x) / (l1.x - l0.x) ELSE 0 END AS lip, c.rc - CASE WHEN r0.x < c.h THEN (c.h - r0.x) / (r1.x - r0.x) ELSE 0 END AS rip
  FROM cross_at c
  JOIN long l0 ON l0.entity = c.entity AND l0.series = c.series AND l0.kind = c.kind AND l0.pos = c.lc
  LEFT JOIN long l1 ON l1.entity = c.entity AND l1.series = c.series AND l1.kind = c.kind AND l1.pos = c.lc + 1
  JOIN long r0 ON r0.entity = c.entity AND r0.series = c.series AND r0.kind = c.kind AND r0.pos = c.rc
  LEFT JOIN long r1 ON r1.entity = c.entity AND r1.series = c.series AND r1.kind = c.kind AND r1.pos = c.rc - 1),
ext AS MATERIALIZED (SELECT entity, series, kind, CAST(p AS INTEGER) AS pos, CASE WHEN kind = 'max' THEN xp ELSE -xp END AS value FROM wid WHERE rip - lip >= {width})"""

    clean = f"""{extrema},
pe AS MATERIALIZED (SELECT entity, kind, pos, value FROM (SELECT *, lag(kind) OVER ({W}) AS pk FROM ext WHERE series = 'pain') WHERE pk IS NULL OR pk <> kind)"""

    scores = f"""{clean},
pairs AS (SELECT entity, kind AS ka, pos AS a, lead(kind) OVER ({W}) AS kb, lead(pos) OVER ({W}) AS b FROM pe),
sp AS (SELECT entity, pos AS m, value FROM ext WHERE series = 'strain' AND kind = 'max'),
hit AS (SELECT sp.entity, m, value, arg_min(ka, a) AS ka, arg_min(b, a) AS b, min(a) AS a FROM sp LEFT JOIN pairs ON pairs.entity = sp.entity AND m BETWEEN a AND b GROUP BY 1, 2, 3),
mx AS (SELECT *, CASE WHEN ka = 'max' THEN a ELSE b END AS mxp FROM hit),
sc AS MATERIALIZED (SELECT entity, m AS pos, value, a AS seg_from, b AS seg_to,
  CASE WHEN m >= mxp THEN (SELECT (m - min(q.pos)) / (min(q.pos) - mxp) FROM pe q WHERE q.entity = mx.entity AND q.kind = 'min' AND q.pos >= mxp AND q.pos >= m)
       WHEN m < mxp THEN (SELECT (m - max(q.pos)) / (mxp - max(q.pos)) FROM pe q WHERE q.entity = mx.entity AND q.kind = 'min' AND q.pos <= mxp AND q.pos <= m) END + 0.0 AS score FROM mx)"""

    days = f"""mg AS (SELECT entity, pos, pos - (SELECT max(q.pos) FROM pe q WHERE q.entity = e.entity AND q.kind = 'min' AND q.pos < e.pos) AS up,
   (SELECT min(q.pos) FROM pe q WHERE q.entity = e.entity AND q.kind = 'min' AND q.pos > e.pos) - pos AS down FROM pe e WHERE kind = 'max'),
cd AS (SELECT entity, CAST(coalesce(list_sum((list(up ORDER BY pos) FILTER (up IS NOT NULL))[2:-2]), 0) AS DOUBLE) AS asc_days,
  CAST(coalesce(list_sum((list(down ORDER BY pos) FILTER (down IS NOT NULL))[2:-2]), 0) AS DOUBLE) AS desc_days FROM mg GROUP BY 1)"""
    rates = f"""{scores}, {days},
cnt AS (SELECT cd.entity, asc_days, desc_days, count(*) FILTER (score >= -1 AND score < 0) AS d1, count(*) FILTER (score >= 0 AND score <= 1) AS a1, count(*) FILTER (score >= -0.8 AND score < 0) AS d2,
   count(*) FILTER (score < -0.8 OR score >= 0) AS a2, count(*) FILTER (score >= -1 AND score < 0.2) AS d3, count(*) FILTER (score >= 0.2 AND score <= 1) AS a3 FROM cd LEFT JOIN sc USING (entity) GROUP BY 1, 2, 3),
rt AS (SELECT entity, 1 AS range_id, d1 AS n_desc, desc_days AS e_desc, a1 AS n_asc, asc_days AS e_asc FROM cnt
  UNION ALL SELECT entity, 2, d2, 0.8::DOUBLE * desc_days, a2, asc_days + 0.2::DOUBLE * desc_days FROM cnt UNION ALL SELECT entity, 3, d3, desc_days + asc_days * 0.2::DOUBLE, a3, asc_days * 0.8::DOUBLE FROM cnt)"""
    return smooth, extrema, clean, scores, days, rates


SMOOTH, EXTREMA, CLEAN, SCORES, DAYS, RATES = chain_sql(MEAN, RESCALE, MEDIAN, PROM, WIDTH)


# --- queries ------------------------------------------------------------------------

@query("g01_smooth", f"WITH {SMOOTH} SELECT entity, day, pos, strain, pain, round(s_raw, 6) AS strain_raw FROM ser")
def g01(spark, sf):
    return series(spark, sf).select("entity", "day", F.col("pos").cast("long"), "strain", "pain", r("strain_raw").alias("strain_raw"))


@query("g02_extrema", f"WITH {EXTREMA} SELECT entity, series, kind, pos, value FROM ext")
def g02(spark, sf):
    return extrema(spark, sf)


@query("g03_alternate", f"WITH {CLEAN} SELECT entity, kind, pos, value FROM pe")
def g03(spark, sf):
    return Chain(spark, sf).pain.select("entity", "kind", "pos", "value")


@query(
    "g04_extremum_columns",
    f"""WITH {SCORES}, near AS (SELECT entity, pos, max(v) AS maxstrain FROM (SELECT entity, pos, value AS v FROM sc WHERE score IS NOT NULL UNION ALL SELECT entity, pos - 1, 0 FROM sc WHERE score IS NOT NULL UNION ALL SELECT entity, pos + 1, 0 FROM sc WHERE score IS NOT NULL) GROUP BY 1, 2)
SELECT s.entity, s.day, x.value AS max, n.value AS min, maxstrain FROM ser s LEFT JOIN pe x ON x.entity = s.entity AND x.pos = s.pos AND x.kind = 'max'
LEFT JOIN pe n ON n.entity = s.entity AND n.pos = s.pos AND n.kind = 'min' LEFT JOIN near ON near.entity = s.entity AND near.pos = s.pos""",
)
def g04(spark, sf):
    c = Chain(spark, sf)
    out = pk.extremum_columns(c.series, c.pain, c.scores, K)
    return out.select("entity", "day", "max", "min", "maxstrain")


@query("g05_cycle_scores", f"WITH {SCORES} SELECT entity, pos, seg_from, seg_to, round(score, 6) AS score FROM sc")
def g05(spark, sf):
    return Chain(spark, sf).scores.select("entity", "pos", "seg_from", "seg_to", r("score").alias("score"))


@query(
    "g06_pain_slope",
    f"""WITH {SCORES}, sl AS (SELECT entity, pos, CASE WHEN lead(1) OVER ({W}) IS NULL THEN 0 ELSE lead(pain) OVER ({W}) - pain END AS slope FROM ser)
SELECT sc.entity, sc.pos, round(slope, 6) AS slope FROM sc JOIN sl USING (entity, pos)""",
)
def g06(spark, sf):
    c = Chain(spark, sf)
    return pk.pain_slope(c.series, c.peaks, K).select("entity", "pos", r("slope").alias("slope"))


@query("g07_cycle_days", f"WITH {CLEAN}, {DAYS} SELECT entity, asc_days, desc_days FROM cd")
def g07(spark, sf):
    return pk.cycle_days(Chain(spark, sf).pain, K)


AMPS = f"""amp0 AS (SELECT entity, pos, value, (SELECT max(q.pos) FROM pe q WHERE q.entity = e.entity AND q.kind = 'min' AND q.pos <= e.pos) AS mp FROM pe e WHERE kind = 'max'),
amp1 AS (SELECT a.entity, a.pos, a.mp, a.value - q.value AS pain_amp FROM amp0 a JOIN pe q ON q.entity = a.entity AND q.pos = a.mp),
amp2 AS (SELECT a.entity, a.pos, a.pain_amp, arg_max(s.m, (s.value, -s.m)) AS m, arg_max(s.value, (s.value, -s.m)) AS v FROM amp1 a LEFT JOIN (SELECT entity, pos AS m, value FROM ext WHERE series = 'strain' AND kind = 'max') s ON s.entity = a.entity AND s.m BETWEEN a.mp - 3 AND a.pos + 2 GROUP BY 1, 2, 3),
amp AS (SELECT entity, pos, pain_amp, CASE WHEN m IS NULL THEN 0 ELSE v - (SELECT arg_max(q.value, q.pos) FROM ext q WHERE q.entity = amp2.entity AND q.series = 'strain' AND q.kind = 'min' AND q.pos <= amp2.m) END AS strain_amp FROM amp2)"""


def amps(c):
    return pk.amplitudes(c.pain, c.strain, K, before=3, after=2)


@query("g08_amplitudes", f"WITH {CLEAN}, {AMPS} SELECT entity, pos, round(pain_amp, 6) AS pain_amp, round(strain_amp, 6) AS strain_amp FROM amp WHERE strain_amp IS NOT NULL")
def g08(spark, sf):
    out = amps(Chain(spark, sf))
    return out.select("entity", "pos", r("pain_amp").alias("pain_amp"), r("strain_amp").alias("strain_amp"))


@query(
    "g09_split_by_strain",
    f"""WITH {CLEAN}, {AMPS} SELECT entity, CASE WHEN strain_amp = 0 THEN 'without' ELSE 'with' END AS "group", count(*) AS n, round(avg(pain_amp), 6) AS mean_amp FROM amp WHERE strain_amp IS NOT NULL GROUP BY 1, 2""",
)
def g09(spark, sf):
    out = pk.split_by_strain(amps(Chain(spark, sf)))
    return out.groupBy("entity", "group").agg(F.count(F.lit(1)).alias("n"), r(F.avg("pain_amp")).alias("mean_amp"))


@query(
    "g10_pooled_regions",
    f"""WITH {SCORES}, {DAYS} SELECT (SELECT count(score) FROM sc) AS scores, (SELECT sum(asc_days) FROM cd WHERE entity <> '5-LOW') AS asc_days, (SELECT sum(desc_days) FROM cd WHERE entity <> '5-LOW') AS desc_days""",
)
def g10(spark, sf):
    c = Chain(spark, sf)
    scores, days = pk.pool_regions(c.scores, pk.cycle_days(c.pain, K), [], "entity", ["5-LOW"])
    counted = scores.agg(F.count("score").alias("scores"))
    return attach(counted, [], days)


@query(
    "g11_smooth_both_ends",
    f"""WITH {SCALED}, t0 AS (SELECT entity, day, pos, 1.0::DOUBLE * a + 0.5::DOUBLE * b AS s FROM scaled),
t1 AS (SELECT entity, pos, avg(s) OVER ({W} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS m FROM t0),
t2 AS (SELECT entity, pos, coalesce(lead(m, 7) OVER ({W}), 0) AS s FROM t1),
{rescale_sql('s', 't2', 's', 15, 90).replace('SELECT entity, day, pos', 'SELECT entity, pos')},
t3 AS (SELECT entity, pos, median(v) OVER ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m FROM mm_s),
t4 AS (SELECT entity, pos, coalesce(lead(m, 3) OVER ({W}), 0) AS s FROM t3)
SELECT entity, pos, round({mm('s', 'x').replace(' AS x', '')}, 6) AS strain FROM t4 WINDOW v AS (PARTITION BY entity)""",
)
def g11(spark, sf):
    out = pk.smooth_both_ends(daily(spark, sf), K, STRESS, "pain", 15, 90, 7)
    return out.select("entity", F.col("pos").cast("long"), r("strain").alias("strain"))


@query(
    "g12_segment_masks",
    f"""WITH {CLEAN}, m AS (SELECT s.entity, s.day, s.pain, p.kind AS k, last_value(p.kind IGNORE NULLS) OVER (PARTITION BY s.entity ORDER BY s.pos) AS l,
  first_value(p.kind IGNORE NULLS) OVER (PARTITION BY s.entity ORDER BY s.pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM ser s LEFT JOIN pe p ON p.entity = s.entity AND p.pos = s.pos)
SELECT entity, day, (CASE WHEN l IS NOT NULL AND a IS NOT NULL AND (k IS NOT NULL OR l = 'min') THEN pain END) AS pain_ascending, (CASE WHEN l IS NOT NULL AND a IS NOT NULL AND (k IS NOT NULL OR l = 'max') THEN pain END) AS pain_descending FROM m""",
)
def g12(spark, sf):
    c = Chain(spark, sf)
    out = pk.segment_masks(c.series, c.pain, K)
    return out.select("entity", "day", "pain_ascending", "pain_descending")


ZOOM = f"""zw AS (SELECT entity, pos AS window_pos, score, greatest(seg_from - 14, 0) AS lo, seg_to + 14 AS hi FROM sc WHERE score >= 0 OR score < -0.8),
zr AS (SELECT z.entity, z.window_pos, z.score, s.pos, strain, pain, s_raw, p_raw FROM zw z JOIN ser s ON s.entity = z.entity AND s.pos BETWEEN lo AND hi),
zoom AS MATERIALIZED (SELECT entity, window_pos, score, pos, {mm('strain', 'strain')}, {mm('pain', 'pain')}, {mm('s_raw', 's_raw')}, {mm('p_raw', 'p_raw')} FROM zr WINDOW v AS (PARTITION BY entity, window_pos))"""


@query(
    "g13_zoom_windows",
    f"WITH {SCORES}, {ZOOM} SELECT entity, window_pos, pos, round(strain, 6) AS strain, round(pain, 6) AS pain, round(p_raw, 6) AS pain_raw FROM zoom",
)
def g13(spark, sf):
    c = Chain(spark, sf)
    out = pk.zoom_windows(c.series, c.scores, K)
    return out.select("entity", "window_pos", F.col("pos").cast("long"), r("strain").alias("strain"), r("pain").alias("pain"), r("pain_raw").alias("pain_raw"))


@query(
    "g14_descending_rises",
    f"""WITH {SCORES}, de AS (SELECT entity, a AS seg_from, b AS seg_to FROM pairs WHERE ka = 'max' AND b IS NOT NULL),
sg AS (SELECT entity, 'without' AS grp, seg_from AS window_pos, seg_from, seg_to FROM de WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.entity = de.entity AND m BETWEEN seg_from AND seg_to)
  UNION ALL SELECT entity, 'with', pos, seg_from, seg_to FROM sc WHERE score BETWEEN -0.8 AND -0.2),
sr AS (SELECT sg.entity, grp, window_pos, s.pos, pain FROM sg JOIN ser s ON s.entity = sg.entity AND s.pos BETWEEN seg_from AND seg_to),
sm AS (SELECT entity, grp, window_pos, pos, {mm('pain', 'pain')} FROM sr WINDOW v AS (PARTITION BY entity, grp, window_pos)),
sd AS (SELECT *, pain - lag(pain) OVER (PARTITION BY entity, grp, window_pos ORDER BY pos) AS d FROM sm)
SELECT entity, grp AS "group", window_pos, round(max(d), 6) AS max_rise FROM sd GROUP BY 1, 2, 3""",
)
def g14(spark, sf):
    c = Chain(spark, sf)
    out = pk.descending_rises(c.series, c.pain, c.scores, K)
    return out.select("entity", "group", "window_pos", r("max_rise").alias("max_rise"))


@query(
    "g15_buildup_metrics",
    f"""WITH RECURSIVE {SCORES}, {ZOOM},
zi AS (SELECT z.entity, z.window_pos, z.score, z.pos, s_raw, p_raw, z.pos - min(z.pos) OVER v AS i, count(*) OVER v AS n, x.pos IS NOT NULL AS top FROM zoom z LEFT JOIN pe x ON x.entity = z.entity AND x.pos = z.pos AND x.kind = 'max' WINDOW v AS (PARTITION BY z.entity, z.window_pos)),
zm AS (SELECT *, min(i) FILTER (top) OVER (PARTITION BY entity, window_pos) AS m FROM zi),
zl AS MATERIALIZED (SELECT *, median(p_raw) FILTER (i >= m - 3 AND i <= CASE WHEN m + 1 < n THEN m ELSE m - 1 END) OVER (PARTITION BY entity, window_pos) AS level FROM zm),
walk AS (SELECT entity, window_pos, i, 0 AS gap, i AS start FROM zl WHERE i = m
  UNION ALL SELECT w.entity, w.window_pos, nx.i, CASE WHEN nx.p_raw < nx.level THEN w.gap + 1 ELSE 0 END, CASE WHEN cu.p_raw >= cu.level THEN w.i ELSE w.start END
  FROM walk w JOIN zl cu ON cu.entity = w.entity AND cu.window_pos = w.window_pos AND cu.i = w.i JOIN zl nx ON nx.entity = w.entity AND nx.window_pos = w.window_pos AND nx.i = w.i - 1
  WHERE w.i > 0 AND (cu.p_raw >= cu.level OR w.gap < 2)),
st AS (SELECT entity, window_pos, arg_min(start, i) AS start FROM walk GROUP BY 1, 2)
SELECT z.entity, z.window_pos, st.start, round(max(level), 6) AS level, round(max(s_raw) FILTER (i >= st.start - 5 AND i < CASE WHEN st.start + 2 < n THEN st.start + 2 ELSE st.start END), 6) AS trigger, st.start - max(i) FILTER (z.pos = z.window_pos) AS delay
FROM zl z JOIN st ON st.entity = z.entity AND st.window_pos = z.window_pos GROUP BY 1, 2, 3""",
)
def g15(spark, sf):
    c = Chain(spark, sf)
    out = pk.buildup_metrics(pk.zoom_windows(c.series, c.scores, K), c.pain, K)
    return out.select(
        "entity", "window_pos", F.col("start").cast("long"), r("level").alias("level"), r("trigger").alias("trigger"), F.col("delay").cast("long")
    )


@query(
    "g16_score_histogram",
    f"""WITH {SCORES}, {DAYS}, ob AS (SELECT entity, CAST(least(floor((score + 1) * 5), 9) AS INTEGER) AS bin, count(*) AS n FROM sc WHERE score IS NOT NULL GROUP BY 1, 2),
tt AS (SELECT entity, sum(n) AS t FROM ob GROUP BY 1)
SELECT cd.entity, CAST(g.bin AS INTEGER) AS bin, coalesce(ob.n, 0) AS observed, round(t * CASE WHEN g.bin < 5 THEN desc_days ELSE asc_days END / (asc_days + desc_days) / 5, 6) AS expected
FROM cd JOIN tt USING (entity), (SELECT unnest(range(0, 10)) AS bin) g LEFT JOIN ob ON ob.entity = cd.entity AND ob.bin = g.bin""",
)
def g16(spark, sf):
    c = Chain(spark, sf)
    out = pk.score_histogram(c.scores, pk.cycle_days(c.pain, K), K)
    return out.withColumn("expected", r("expected"))


# The grids of the two parameter studies (fixed values): 4 x 3 x 3 x 3 x 3 sets, and 3 x 3 x 5 x 4 with one window for mean and median.
SEARCH = ([(m, b, k) for m in (15, 30, 45, 90) for b in (90, 180, 360) for k in (15, 30, 90)], [(p, w) for p in (0.05, 0.1, 0.2) for w in (7, 15, 30)])
CONSISTENCY = ([(m, b, m) for m in (7, 15, 21) for b in (180, 270, 360)], [(p, w) for p in (0.03, 0.05, 0.075, 0.1, 0.15) for w in (3, 5, 10, 15)])


def sweep(days: DataFrame, filters, thresholds) -> DataFrame:
    """Cycle rate tests for every parameter set and entity, in one plan.

    A series is smoothed and measured once per filter; thresholds only choose
    among its few extrema.
    """
    grid = pk.smooth_grid(days, K, STRESS, "pain", filters, digits=9)
    measured = pk.measure_extrema(grid.select("entity", "filter_id", "pos", "strain", "pain"), ["entity", "filter_id"], ["pain", "strain"])
    # a few rows per series, read by every later step: written once
    found = cut_lineage(pk.extrema_by_thresholds(measured, thresholds))
    keys = ["entity", "filter_id", "min_prominence", "min_width"]
    pain = pk.alternate(pk.of_series(found, "pain"), keys)
    scores = pk.cycle_scores(pain, pk.of_series(found, "strain", "max"), keys)
    return st.cycle_rate_tests(scores, pk.cycle_days(pain, keys), keys)


def sweep_sql(filters, thresholds):
    """Oracle of a sweep: extrema are measured per filter, then every set becomes an entity of its own for the rest of the chain."""
    smooth = [chain_sql(*f, 0, 0)[0] for f in filters]
    series = " UNION ALL ".join(f"SELECT * FROM (WITH {text} SELECT entity || '|{i}' AS entity, day, pos, s_raw, p_raw, strain, pain FROM ser)" for i, text in enumerate(smooth))
    chain = chain_sql(*filters[0], 0, 0)[-1]
    after = chain[chain.index("long AS MATERIALIZED") :]
    head, tail = after.split("ext AS MATERIALIZED", 1)
    values = ", ".join(f"({p}::DOUBLE, {float(w)}::DOUBLE)" for p, w in thresholds)
    sets = f"""sets(mp, mw) AS (VALUES {values}),
ext AS MATERIALIZED (SELECT entity || '|' || mp || '|' || mw AS entity, series, kind, CAST(p AS INTEGER) AS pos, CASE WHEN kind = 'max' THEN xp ELSE -xp END AS value FROM wid, sets WHERE prom >= mp AND rip - lip >= mw)"""
    return f"""ser AS MATERIALIZED ({series}),
{head}{sets}{tail[tail.index("),") + 1 :]},
sw AS MATERIALIZED (SELECT split_part(entity, '|', 1) AS entity, CAST(split_part(entity, '|', 2) AS INTEGER) AS filter_id, CAST(split_part(entity, '|', 3) AS DOUBLE) AS min_prominence, CAST(split_part(entity, '|', 4) AS DOUBLE) AS min_width,
  range_id, n_desc, n_asc, (n_desc - n_asc * (e_desc / nullif(e_asc, 0))) / nullif(sqrt((n_desc + n_asc) * (e_desc / nullif(e_asc, 0))), 0) AS z, (n_asc / nullif(e_asc, 0)) / nullif(n_desc / nullif(e_desc, 0), 0) AS ratio FROM rt)"""


@query(
    "g17_parameter_sweep",
    f"WITH {sweep_sql(*SEARCH)} SELECT entity, filter_id, min_prominence, min_width, range_id, n_desc, n_asc, round(z, 6) AS z, round(ratio, 6) AS ratio, round({sql_normal_p('z')}, 6) AS p_value FROM sw",
)
def g17(spark, sf):
    out = sweep(daily(spark, sf), *SEARCH)
    return out.select(
        "entity", "filter_id", "min_prominence", "min_width", "range_id", "n_desc", "n_asc", r("z").alias("z"), r("ratio").alias("ratio"), r("p_value").alias("p_value")
    )


@query(
    "g18_consistency_summary",
    f"""WITH {sweep_sql(*CONSISTENCY)}, pv AS (SELECT *, {sql_normal_p('z')} <= 0.05 AS sig FROM sw)
SELECT entity, range_id, count(*) AS sets, round(avg(CASE WHEN ratio > 1 THEN 1 ELSE 0 END), 6) AS above, round(avg(sig::INT) FILTER (ratio >= 1), 6) AS significant_above, round(avg(sig::INT) FILTER (ratio < 1), 6) AS significant_below FROM pv GROUP BY 1, 2""",
)
def g18(spark, sf):
    out = pk.consistency_summary(sweep(daily(spark, sf), *CONSISTENCY), ["entity", "range_id"])
    return out.select("entity", "range_id", "sets", *[r(c).alias(c) for c in ("above", "significant_above", "significant_below")])


@query(
    "g19_best_shift",
    f"""WITH {SCALED}, l AS (SELECT unnest(range(0, 120)) AS s), x AS (SELECT p.entity, s, avg(greatest(p.pain - q.a, 0)) AS u FROM scaled p, l JOIN scaled q ON q.entity = p.entity AND q.pos = p.pos - s WHERE p.pain >= 0.8 GROUP BY 1, 2)
SELECT entity, CAST(s AS INTEGER) AS shift, round(u, 6) AS uncovered FROM x""",
)
def g19(spark, sf):
    from dayweave.plans.rolling_queries import scaled

    out = pk.best_shift(scaled(spark, sf), K, "a", "pain")
    return out.select("entity", "shift", r("uncovered").alias("uncovered"))


@query(
    "g20_additive_model",
    f"""WITH {SCALED}, e AS (SELECT entity, pos, (pain + 0.1) / 1.1 AS x, 1.0 * ((a + 0.1) / 1.1) + 0.5 * ((b + 0.1) / 1.1) AS y FROM scaled),
m AS (SELECT entity, pos, CASE WHEN pos < 6 THEN x ELSE avg(x) OVER f END AS x, CASE WHEN pos < 6 THEN y ELSE avg(y) OVER f END AS y FROM e WINDOW f AS ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
n AS MATERIALIZED (SELECT entity, pos, {mm('x', 'x')}, {mm('y', 'y')}, count(*) OVER v AS n FROM m WINDOW v AS (PARTITION BY entity)),
c AS (SELECT p.entity, k, sum(p.x * q.y) AS cross_v, corr(p.x, q.y) AS r FROM n p, (SELECT unnest(range(0, 15)) AS k) JOIN n q ON q.entity = p.entity AND q.pos = (p.pos - k + p.n) % p.n GROUP BY 1, 2)
SELECT entity, CAST(arg_max(k, cross_v) AS INTEGER) AS shift, round(max(cross_v), 4) AS "cross", round(max(r) FILTER (k = 0), 6) AS r_before, round(arg_max(r, cross_v), 6) AS r_after FROM c GROUP BY 1""",
)
def g20(spark, sf):
    out = pk.additive_model(daily(spark, sf), K, {"a": 1.0, "b": 0.5}, "pain")
    return out.select("entity", "shift", r("cross", 4).alias("cross"), r("r_before").alias("r_before"), r("r_after").alias("r_after"))


@query("g21_reload_scores", f"WITH {SCORES} SELECT entity, pos, CASE WHEN score * 1.5 BETWEEN -1 AND 1 THEN round(score * 1.5, 6) ELSE 1 END::DOUBLE AS score FROM sc WHERE score IS NOT NULL")
def g21(spark, sf):
    stored = Chain(spark, sf).scores.withColumn("score", F.col("score") * 1.5)
    return pk.reload_scores(stored).select("entity", "pos", r("score").alias("score"))


@query("d19_amplitude_regression", f"WITH {CLEAN}, {AMPS} SELECT entity, count(*) AS n, round(regr_slope(pain_amp, strain_amp), 5) AS slope, round(regr_r2(pain_amp, strain_amp), 5) AS r2 FROM amp WHERE strain_amp IS NOT NULL GROUP BY 1")
def amp_fit(spark, sf):
    out = ag.linear_fit(amps(Chain(spark, sf)), K, "pain_amp", "strain_amp")
    return out.select("entity", "n", r("slope", 5).alias("slope"), r("r2", 5).alias("r2"))


@query(
    "flagship_cycle_rates",
    f"""WITH {RATES} SELECT entity, range_id, n_desc, round(e_desc, 4) AS e_desc, n_asc, round(e_asc, 4) AS e_asc,
  round((n_desc - n_asc * (e_desc / e_asc)) / nullif(sqrt((n_desc + n_asc) * (e_desc / e_asc)), 0), 6) AS z, round((n_asc / e_asc) / nullif(n_desc / e_desc, 0), 6) AS ratio FROM rt""",
)
def flagship(spark, sf):
    c = Chain(spark, sf)
    out = st.cycle_rate_tests(c.scores, pk.cycle_days(c.pain, K), K, with_p=False)
    return out.select("entity", "range_id", "n_desc", r("e_desc", 4).alias("e_desc"), "n_asc", r("e_asc", 4).alias("e_asc"), r("z").alias("z"), r("ratio").alias("ratio"))
