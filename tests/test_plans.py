"""Physical plans: shuffles, pruning, joins and hot keys."""

import datetime as dt

from pyspark.sql import functions as F

from dayweave.operators import harmonise as hm
from dayweave.operators import intervals as iv
from dayweave.operators import peaks as pk
from dayweave.plans import load_queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_smoothing_grid_shuffles_once(series):
    grid = pk.smooth_grid(series, ["entity"], {"a": 1.0, "b": 0.5}, "pain", [(m, b, k) for m in (7, 9) for b in (0, 60) for k in (5, 7)])
    assert plan(grid).count("Exchange hashpartitioning") == 1


def test_sweep_measures_each_series_once(series):
    """More thresholds add no shuffle, no join and no reading of a series."""
    filters = [(m, b, k) for m in (7, 9) for b in (0, 60) for k in (5, 7)]
    grid = pk.smooth_grid(series, ["entity"], {"a": 1.0, "b": 0.5}, "pain", filters).select("entity", "filter_id", "pos", "strain", "pain")
    measured = pk.measure_extrema(grid, ["entity", "filter_id"], ["pain", "strain"])
    for sets in ([(0.05, 2.0)], [(p / 100, w) for p in range(1, 10) for w in range(1, 10)]):
        text = plan(pk.extrema_by_thresholds(measured, sets))
        assert text.count("FlatMapGroupsInPandas") == 1 and text.count("Exchange hashpartitioning") == 2 and "Join" not in text


def test_device_plan_shuffles_once(series):
    steps = [
        ("repair", ("2020-03-01", "2020-06-30"), "a", "b", "steps"),
        ("predict", ("2020-01-01", "2020-02-28"), None, "b", "steps"),
        ("copy", ("2020-07-01", "2021-12-31"), "a", None, "steps"),
    ]
    out = hm.apply_plan(series.withColumn("steps", F.lit(0.0)), ["entity"], steps)
    assert plan(out).count("Exchange hashpartitioning") == 1


def test_scans_read_only_needed_columns(spark):
    queries, _ = load_queries()
    text = plan(queries["b01_fill_calendar"](spark, SF))
    reads = [line for line in text.split("\n") if "ReadSchema" in line]
    assert reads and all("o_custkey" not in line and "o_orderstatus" not in line for line in reads)


def test_no_nested_loops_over_tables(spark):
    queries, _ = load_queries()
    for name in ("f01_prorate_in_intervals", "f03_overlap_labels", "f05_paint_samples", "f07_sum_in_intervals", "i01_cross_correlation"):
        text = plan(queries[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_load_options_paint_and_carry_once(spark):
    """Keys pass as a stream, not as Python groups; painting feeds one shuffle that maps and carry share; no gap filling repeats them."""
    queries, _ = load_queries()
    df = queries["k07_load_options"](spark, SF)
    text = plan(df)
    assert "FlatMapGroupsInPandas" not in text
    assert text.count("MapInPandas carry") == text.count("MapInPandas enter") == text.count("MapInPandas summarise") == 1
    df.collect()
    assert any("ReusedExchange" in line and "REPARTITION_BY_NUM" in line for line in plan(df).split("\n"))


def test_hot_entity_equals_brute_force(spark):
    """A third of the rows on one key, narrow buckets, overlapping intervals."""
    t0 = dt.datetime(2022, 1, 1)
    samples = [("hot" if i % 3 == 0 else f"e{i % 50}", t0 + dt.timedelta(seconds=37 * i), float(i % 11), i) for i in range(3000)]
    spans = [("hot" if i % 2 == 0 else f"e{i % 50}", i, t0 + dt.timedelta(seconds=401 * i), t0 + dt.timedelta(seconds=401 * i + 2000 + 97 * (i % 9))) for i in range(200)]
    s = spark.createDataFrame(samples, "entity string, ts timestamp, value double, sample_id long")
    v = spark.createDataFrame(spans, "entity string, interval_id long, start_ts timestamp, end_ts timestamp")
    want_sum, want_paint = {}, {}
    for e, i, a, b in spans:
        inside = [x for k, t, x, _ in samples if k == e and a <= t < b]
        want_sum[i] = round(sum(inside), 6) if inside else None
    for e, t, _x, sid in samples:
        cover = [i for k, i, a, b in spans if k == e and a <= t <= b]
        want_paint[sid] = max(cover) if cover else None
    for seconds in (300, 7200):
        got = iv.aggregate_in_intervals(v, s, ["entity"], bucket_seconds=seconds).collect()
        assert {r["interval_id"]: None if r["total"] is None else round(r["total"], 6) for r in got} == want_sum
        painted = iv.paint_samples(s, v.withColumn("p", F.col("interval_id")), ["entity"], "sample_id", ["p"], ["interval_id"], seconds).collect()
        assert {r["sample_id"]: r["p"] for r in painted} == want_paint
