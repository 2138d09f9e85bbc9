"""Operators against independent pandas / numpy versions on seeded data."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from dayweave.functions import pvalues as pv
from dayweave.operators import calendar as cal
from dayweave.operators import heart as ht
from dayweave.operators import intervals as iv
from dayweave.operators import lagcorr as lc
from dayweave.operators import models as md
from dayweave.operators import ordered
from dayweave.operators import peaks as pk
from dayweave.operators import rolling as ro
from dayweave.operators import stats as st
from dayweave.operators import warnings as wn

K = ["entity"]


def collect(df, entity, *cols):
    pdf = df.where(F.col("entity") == entity).orderBy("pos").toPandas()
    return [pdf[c].to_numpy(dtype=float) for c in cols]


def same(got, want):
    np.testing.assert_allclose(got, want, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("n", [2, 7, 15])
def test_centred_windows(series, days, n):
    out = series.withColumns(
        {
            "m": ro.centred_mean("pain", K, n),
            "d": ro.centred_median("pain", K, n),
            "p": ro.centred_mean_partial("pain", K, n),
        }
    ).cache()
    for e in ("ann", "bob"):
        x = days[days.entity == e].pain.reset_index(drop=True)
        m, d, p = collect(out, e, "m", "d", "p")
        same(m, x.rolling(n).mean().shift(int(-n / 2)))
        same(d, x.rolling(n).median().shift(int(-n / 2)))
        same(p, x.rolling(n, min_periods=1).mean().shift(int(-n / 2)).fillna(0))
    out.unpersist()


def sliced_minmax(x, lo, hi):
    """Slice [i+lo, i+hi) clipped, end at most n-1; undefined repeats the last."""
    n, out = len(x), []
    for i in range(n):
        part = x[max(0, math.trunc(i + lo)) : min(math.trunc(i + hi) if i + hi < n else n - 1, n - 1) if i + hi < n else n - 1]
        low = np.nan if np.isnan(part[0]) else np.nanmin(part)
        high = np.nan if np.isnan(part[0]) else np.nanmax(part)
        v = (x[i] - low) / (high - low) if high != low else np.nan
        out.append(v if np.isfinite(v) else (out[-1] if out else 0.0))
    return np.array(out)


@pytest.mark.parametrize("n,m", [(50, 15), (21, 4)])
def test_rolling_minmax(series, days, n, m):
    shifted = ro.rolling_minmax_shifted(series, K, "pain", n, m, "s")
    centred = ro.rolling_minmax(series, K, "pain", n, "c")
    for e in ("ann", "bob"):
        x = days[days.entity == e].pain.to_numpy()
        same(collect(shifted, e, "s")[0], sliced_minmax(x, -n + m, m))
        same(collect(centred, e, "c")[0], sliced_minmax(x, -n / 2, n / 2))


def test_extrema_flat_tops_and_gaps():
    x = np.array([0, 1, 1, 0, 2, np.nan, 3, 0, 5, 5, 5, 0], dtype=float)
    assert pk._plateau_maxima(x).tolist() == [1, 9]
    # the neighbour of a gap is no maximum; prominence stops at the gap
    assert pk.prominent_maxima(x, 1.5, 0).tolist() == [9]
    assert pk.prominent_maxima(np.array([0.0, 1, 0]), 0.5, 0).tolist() == [1]
    assert pk.prominent_maxima(np.array([0.0, 1, 0]), 0.5, 1.5).tolist() == []


def scanned_maxima(x, prominence, width):
    """Every flank scanned from its peak."""
    kept = []
    for p in pk._plateau_maxima(x):
        lows, ends = [], []
        for step in (-1, 1):
            side = x[p::step]
            stop = np.flatnonzero(~(side <= x[p]))
            side = side[: stop[0]] if len(stop) else side
            lows.append(side.min())
        prom = x[p] - max(lows)
        height = x[p] - 0.5 * prom
        for step in (-1, 1):
            k = next(k for k in range(1, len(x)) if not x[p + step * k] > height)
            at = p + step * k
            ends.append(at - step * (height - x[at]) / (x[at - step] - x[at]) if x[at] < height else float(at))
        if prom >= prominence and ends[1] - ends[0] >= width:
            kept.append(p)
    return kept


def test_measured_maxima_against_scans():
    rng = np.random.default_rng(11)
    for k in range(60):
        x = np.round(rng.normal(0, 1, 80).cumsum() if k % 2 else rng.integers(0, 4, 80).astype(float), 1)
        x[rng.random(80) < 0.03 * (k % 3)] = np.nan
        for prominence, width in ((0, 0), (0.5, 2), (2, 5)):
            assert pk.prominent_maxima(x, prominence, width).tolist() == scanned_maxima(x, prominence, width)
    # a rising saw: every flank reaches to the start, which a scan per peak would read again and again
    saw = np.arange(200_000) / 2.0
    saw[1::2] += 2.0
    at, prominence, _ = pk.measured_maxima(saw)
    assert len(at) == 99_999 and set(prominence) == {1.5}
    for empty in (np.array([]), np.array([1.0]), np.full(5, np.nan), np.ones(4)):
        assert len(pk.measured_maxima(empty)[0]) == 0


def test_thresholds_choose_among_measured_extrema(series):
    smooth = pk.smooth(series.fillna({"pain": 2.0}), K, {"a": 1.0, "b": 0.3}, "pain", 7, 60, 5, digits=9)
    sets = [(0.0, 0.0), (0.05, 2.0), (0.2, 8.0), (2.0, 1.0)]
    several = pk.extrema_by_thresholds(pk.measure_extrema(smooth, K, ["pain", "strain"]), sets)
    for p, w in sets:
        got = several.where((F.col("min_prominence") == p) & (F.col("min_width") == w)).drop("min_prominence", "min_width")
        want = pk.find_extrema(smooth, K, ["pain", "strain"], p, w)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_alternation_and_scores(spark):
    ext = spark.createDataFrame(
        [("p", "max", 5, 1.0), ("p", "max", 8, 1.0), ("p", "min", 10, 0.0), ("p", "max", 20, 1.0), ("p", "min", 30, 0.0)],
        "entity string, kind string, pos int, value double",
    )
    clean = pk.alternate(ext, K)
    assert [r["pos"] for r in clean.orderBy("pos").collect()] == [5, 10, 20, 30]
    peaks = spark.createDataFrame([("p", i, 1.0) for i in (2, 5, 7, 10, 15, 20, 26, 30, 33)], "entity string, pos int, value double")
    got = {r["pos"]: r["score"] for r in pk.cycle_scores(clean, peaks, K).collect()}
    want = {2: None, 5: -1.0, 7: -0.6, 10: 0.0, 15: 0.5, 20: -1.0, 26: -0.4, 30: 0.0, 33: None}
    assert {k: None if v is None else round(v, 9) for k, v in got.items()} == want
    days = pk.cycle_days(clean, K).first()
    assert (days["asc_days"], days["desc_days"]) == (0.0, 0.0)


def test_interval_totals_conserve(spark):
    rng = np.random.default_rng(3)
    t0 = dt.datetime(2021, 1, 1)
    ts = sorted(rng.choice(5 * 86400, 300, replace=False).tolist())
    samples = spark.createDataFrame([("p", t0 + dt.timedelta(seconds=int(s)), float(i % 9), i) for i, s in enumerate(ts)], "entity string, ts timestamp, value double, sample_id long")
    cuts = [ts[0], *sorted(rng.choice(np.arange(ts[0] + 1, ts[-1]), 40, replace=False).tolist()), ts[-1]]
    tiles = spark.createDataFrame(
        [("p", i, t0 + dt.timedelta(seconds=int(a)), t0 + dt.timedelta(seconds=int(b))) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))],
        "entity string, interval_id long, start_ts timestamp, end_ts timestamp",
    )
    owned = sum(float(i % 9) for i in range(len(ts) - 1))
    for seconds in (3600, 86400):
        got = iv.prorate_in_intervals(tiles, samples, K, bucket_seconds=seconds).agg(F.sum("total")).first()[0]
        assert abs(got - owned) < 1e-6
    outside = spark.createDataFrame(
        [("p", 1, t0 - dt.timedelta(days=2), t0 + dt.timedelta(seconds=ts[0])), ("p", 2, t0 + dt.timedelta(seconds=ts[-1]), t0 + dt.timedelta(days=9))],
        tiles.schema,
    )
    assert [r["total"] for r in iv.prorate_in_intervals(outside, samples, K).collect()] == [None, None]


def test_interval_totals_hold_only_what_lies_inside(spark):
    """A huge or infinite sample before an interval leaves it alone; long and nested intervals use wide blocks."""
    t0 = dt.datetime(2021, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    values = [float("inf"), 1e17, 0.1, 0.2, *[float(i % 7) for i in range(4, 4000)]]
    samples = spark.createDataFrame([("p", at(600 * i), v, i) for i, v in enumerate(values)], "entity string, ts timestamp, value double, sample_id long")
    spans = [(1, 1200, 2400), (2, 2400, 600 * 3999), *[(i, 600 * 7 * i, 600 * (7 * i + 40) + 300) for i in range(3, 500)], (600, 5000, 4000), (601, 2400, None)]
    rows = [("p", i, at(a), None if b is None else at(b)) for i, a, b in spans]
    intervals = spark.createDataFrame(rows, "entity string, interval_id long, start_ts timestamp, end_ts timestamp")
    whole = {r["interval_id"]: r for r in iv.aggregate_in_intervals(intervals, samples, K).collect()}
    shared = {r["interval_id"]: r["total"] for r in iv.prorate_in_intervals(intervals, samples, K).collect()}
    assert len(whole) == len(shared) == len(spans)
    for i, a, b in spans:
        inside = [v for k, v in enumerate(values) if b is not None and a <= 600 * k < b]
        parts = [v * max(0, min(b, 600 * k + 600) - max(a, 600 * k)) / 600 for k, v in enumerate(values[:-1]) if k > 1] if inside else None
        assert whole[i]["n"] == len(inside)
        assert whole[i]["total"] == (pytest.approx(sum(inside), abs=1e-9) if inside else None)
        out = not inside or b > 600 * 3999
        assert shared[i] == (None if out else pytest.approx(sum(parts), abs=1e-9))


def carried(v, factor):
    out = v.astype(float).copy()
    for i in range(1, len(out)):
        if factor * out[i - 1] > 1:
            out[i] += factor * out[i - 1]
    return out


def test_overflow_against_loop(spark):
    rng = np.random.default_rng(5)
    t0 = dt.datetime(2021, 1, 1)
    # sparse, dense without any gap, and with missing loads
    series = {"sparse": np.where(rng.random(800) < 0.25, np.round(rng.gamma(2, 30, 800)), 0.0), "dense": rng.integers(0, 4, 2000) + rng.random(2000), "holes": rng.integers(0, 90, 300) * 1.0}
    series["holes"][rng.random(300) < 0.1] = np.nan
    rows = [(k, t0 + dt.timedelta(minutes=7 * i), i, None if np.isnan(x) else float(x), float(i % 5), "x") for k, v in series.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "entity string, ts timestamp, sample_id long, load double, other double, _entry_9 string")
    for seconds in (600, 3600, 86_400, 10**8):
        out = ht.overflow_carry(df, K, {"load": 0.6, "other": 0.5}, bucket_seconds=seconds).withColumn("task", F.spark_partition_id()).toPandas().sort_values("sample_id")
        for k, v in series.items():
            same(out[out.entity == k]["load_carried"], carried(v, 0.6))
            same(out[out.entity == k]["other_carried"], carried(np.arange(len(v)) % 5, 0.5))
        if seconds == 3600:
            assert out[out.entity == "dense"].task.nunique() > 1
    assert ht.overflow_carry(df.limit(0), K, "load", 0.5).count() == 0
    with pytest.raises(ValueError):
        ht.overflow_carry(df, K, "load", 1.0)


def test_overflow_across_small_frames(spark):
    """Keys, days and Arrow frames that end at different rows."""
    rng = np.random.default_rng(9)
    t0 = dt.datetime(2021, 1, 1)
    rows = []
    for key in range(150):
        at = np.sort(rng.choice(6 * 86_400, int(rng.integers(1, 30)), replace=False)).tolist()
        rows += [(key, t0 + dt.timedelta(seconds=s), i, float(rng.integers(0, 9))) for i, s in enumerate(at)]
    df = spark.createDataFrame(rows, "entity long, ts timestamp, sample_id long, load double")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for n in ("1", "3", "10000"):
            spark.conf.set(size, n)
            out = ht.overflow_carry(df, K, "load", 0.5).toPandas().sort_values(["entity", "sample_id"])
            assert len(out) == len(rows)
            for _, part in out.groupby("entity"):
                same(part["load_carried"], carried(part["load"].to_numpy(), 0.5))
            alone = ht.overflow_carry(df.where("entity = 3").drop("entity"), [], "load", 0.5).toPandas().sort_values("sample_id")
            same(alone["load_carried"], out[out.entity == 3]["load_carried"])
    finally:
        spark.conf.set(size, before)


def test_days_between_rows(spark):
    """Each key gets its own first to last day; rows without a key or day fill nothing, doubled days stay."""
    day = lambda d: None if d is None else dt.date(2021, 1, d)
    rows = [("a", 3, 1.0), ("a", 6, None), ("b", 9, 2.0), ("b", 9, 3.0), ("b", 11, 4.0), ("c", None, 5.0), (None, 1, 6.0), (None, 2, 7.0)]
    df = spark.createDataFrame([(k, day(d), v) for k, d, v in rows], "entity string, day date, v double")
    out = cal.fill_calendar(df, K, "day", {"v": 0.0}, shared_range=False)
    got = sorted((str(r["entity"]), r["day"].day, r["v"]) for r in out.collect())
    assert out.columns == ["entity", "day", "v"]
    assert got == [("None", 1, 0.0), ("None", 2, 0.0), ("a", 3, 1.0), ("a", 4, 0.0), ("a", 5, 0.0), ("a", 6, 0.0), ("b", 9, 2.0), ("b", 9, 3.0), ("b", 10, 0.0), ("b", 11, 4.0)]


@settings(max_examples=150, deadline=None)
@given(st_.lists(st_.one_of(st_.floats(0, 4), st_.sampled_from([0.0, 1.0, 2.0, 50.0, float("nan")])), max_size=25), st_.floats(0, 20), st_.sampled_from([0.3, 0.5, 0.9]))
def test_spill_map_is_the_run(values, share, factor):
    m = ht.SpillMap(values, factor)
    run = share
    for v in values:
        run = ht._step(v, run, factor)
    near = any(abs(share - t) < 1e-9 * max(1, abs(t)) for t in m.limits if np.isfinite(t))
    assert near or ht.SpillMap.apply(m.limits, m.ends, m.base, m.slope, share) == pytest.approx(run, rel=1e-12, abs=1e-12)


def test_load_options_share_a_shuffle(spark):
    t0 = dt.datetime(2021, 1, 1)
    rows = [("p", t0 + dt.timedelta(hours=i), i, 60.0 + 7 * (i % 13), None if i % 3 else 0.25, None if i % 3 else 0.75) for i in range(60)]
    df = spark.createDataFrame(rows, "entity string, ts timestamp, sample_id long, hr double, low_share double, high_share double")
    got = {(str(r.day), r.option): r for r in ht.load_options(df, K, "hr").collect()}
    for o in ht.LOAD_OPTIONS:
        active = np.array([max(0.0, r[3] - o["threshold"]) for r in rows])
        for name, share in (("low_body", [1.0 if r[4] is None else r[4] for r in rows]), ("high_body", [r[5] or 0.0 for r in rows])):
            load = (active * share) ** (o["exponent"] or 1)
            load = carried(load, o["factor"]) if o["factor"] else load
            load = np.where(load - o["threshold2"] < o["threshold2"], 0, load - o["threshold2"]) if o["threshold2"] else load
            for k in range(3):
                assert got[f"2021-01-0{k + 1}", o["option"]][name] == pytest.approx(load[24 * k : 24 * k + 24].sum())


def queued(lefts, rights, limit):
    """A queue of waiting left events, read in the order of time."""
    rows = sorted([(t, 0, str(i), i) for t, i in rights] + [(t, 1, str(i), i) for t, i in lefts])
    waiting, used, out = [], None, []
    for t, side, _, i in rows:
        if side:
            waiting.append((t, i))
            continue
        waiting = [w for w in waiting if t - w[0] < limit]
        if waiting and t != used:
            out.append((waiting.pop(0)[1], i))
            used = t
    return out


def test_greedy_matching_against_a_queue(spark):
    rng = np.random.default_rng(8)
    t0 = dt.datetime(2021, 1, 1)
    lefts, rights, want = [], [], []
    # no gap at all, few rights, many rights, ties at one second
    for k, (n, m, span) in {"dense": (900, 900, 900_000), "left": (200, 20, 400_000), "right": (20, 200, 400_000), "ties": (60, 80, 60), "none": (5, 0, 10_000)}.items():
        a = [(int(t), 1000 + i) for i, t in enumerate(rng.integers(0, span, n))]
        b = [(int(t), 5000 + i) for i, t in enumerate(rng.integers(0, span, m))]
        lefts += [(k, t0 + dt.timedelta(seconds=t), i, "x") for t, i in a] + [(k, None, 1, "x")]
        rights += [(k, t0 + dt.timedelta(seconds=t), i, 1) for t, i in b] + [(k, None, 2, 1)]
        want += [(k, *p) for p in queued(a, b, 7200)]
    left = spark.createDataFrame(lefts, "entity string, ts timestamp, left_id long, _left string")
    right = spark.createDataFrame(rights, "entity string, ts timestamp, right_id long, _arrived int")
    for seconds in (900, 50_000, 10**8):
        got = iv.greedy_next_match(left, right, K, "left_id", "right_id", hours=2.0, bucket_seconds=seconds)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert iv.greedy_next_match(left.limit(0), right, K, "left_id", "right_id").count() == 0


@settings(max_examples=200, deadline=None)
@given(st_.lists(st_.tuples(st_.integers(0, 9), st_.integers(0, 9)), min_size=1, max_size=12), st_.integers(0, 9))
def test_queue_steps_compose(steps, n):
    add, low, high, run = 0, -iv.FAR, iv.FAR, n
    for expired, more in steps:
        arrived = expired + more
        run = min(max(run, expired) + 1, arrived)
        add, low, high = add + 1, max(low, expired) + 1, min(max(high, expired) + 1, arrived)
    assert min(max(n + add, low), high) == run


def test_time_tree_against_brute_force(spark):
    rng = np.random.default_rng(21)
    t0 = dt.datetime(2021, 3, 1)
    at = lambda s: t0 + dt.timedelta(seconds=int(s))
    # one entity holds most rows; spans of seconds to months, empty, reversed, open and with a wrong year
    spans = []
    for i in range(150):
        a = int(rng.integers(0, 5_000_000))
        spans.append(("hot" if i % 3 else "b", i, a, a + int(rng.choice([0, 1, 900, 40_000, 2_600_000])), int(rng.integers(0, 6))))
    spans += [("hot", 900, 70, 60, 99), ("hot", 901, -1_600_000_000, 4_000_000, -1)]
    points = [("hot" if i % 4 else "b", i, int(t)) for i, t in enumerate(rng.integers(0, 5_000_000, 400))] + [("c", 999, 5)]
    v = spark.createDataFrame([(e, i, at(a), at(b), p, f"l{p}") for e, i, a, b, p in spans] + [("hot", 950, None, at(9), 50, "n")], "entity string, interval_id long, start_ts timestamp, end_ts timestamp, p long, label string")
    s = spark.createDataFrame([(e, i, at(t), 1.0) for e, i, t in points], "entity string, sample_id long, ts timestamp, value double")
    over = {i: [x for x in spans if x[0] == e and x[2] <= t <= x[3]] for e, i, t in points}
    ids = spark.createDataFrame([(e, i, at(a), at(a + int(rng.choice([0, 50, 500_000])))) for e, i, a, _, _ in spans[:60]], "entity string, interval_id long, start_ts timestamp, end_ts timestamp")
    taps = v.withColumn("seq", F.col("interval_id"))
    rows = [(r.entity, r.interval_id, (r.start_ts - t0).total_seconds(), (r.end_ts - t0).total_seconds()) for r in ids.collect()]
    for seconds in (60, 1800, 10**7):
        painted = iv.paint_samples(s, v, K, "sample_id", ["label"], ["p", "interval_id"], seconds).collect()
        assert {r.sample_id: r.label for r in painted} == {i: f"l{max(o, key=lambda x: (x[4], x[1]))[4]}" if o else None for i, o in over.items()}
        found = {r.interval_id: (r.tap_label, r.tap_share) for r in iv.overlap_labels(ids, taps, K, bucket_seconds=seconds).collect()}
        for e, i, a, b in rows:
            hit = [x for x in spans if x[0] == e and x[2] <= x[3] and a < x[3] and b >= x[2]]
            label, share = found[i]
            assert (share is None) == (not hit or a == b)
            assert label == (f"l{max(hit, key=lambda x: x[1])[4]}" if hit else None)
            if hit and b > a:
                first = min(hit, key=lambda x: x[1])
                assert share == pytest.approx((min(b, first[3]) - max(a, first[2])) / (b - a))
        longest = iv._blocks(v, K, F.unix_micros("start_ts"), F.unix_micros("end_ts"), seconds, "interval_id").groupBy("interval_id").count().agg(F.max("count")).first()[0]
        assert longest < 100
    month = v.where("interval_id = 0").withColumn("end_ts", F.expr("start_ts + interval 31 days"))
    assert iv._blocks(month, K, F.unix_micros("start_ts"), F.unix_micros("end_ts"), 1800).count() < 50
    assert iv.paint_samples(s, v.limit(0), K, "sample_id", ["label"], ["p"]).where("label IS NULL").count() == len(points)
    assert iv.overlap_labels(ids, taps.limit(0), K).count() == 60


def test_two_level_scan(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"k": "hot", "i": np.arange(500), "v": np.where(rng.random(500) < 0.3, rng.integers(0, 9, 500), np.nan)})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k string, i long, v double")
    out = ordered.scan(df, ["k"], ["i"], F.floor(F.col("i") / 37).cast("long"), sums={"s": "v"}, lasts={"l": "v"}, before={"b": "v"}, after={"a": "v"})
    got = out.orderBy("i").toPandas()
    same(got["s"].astype(float), pdf.v.fillna(0).cumsum())
    same(got["l"].astype(float), pdf.v.ffill())
    same(got["b"].astype(float), pdf.v.ffill().shift(1))
    same(got["a"].astype(float), pdf.v.bfill().shift(-1))


def test_permutation_and_sequential_verdicts(spark):
    for n in (1, 2, 5, 64, 65, 1000):
        places = [r.p for r in spark.range(n).select(md.permuted(F.col("id"), n, F.lit(7)).alias("p")).collect()]
        assert sorted(places) == list(range(n))
        other = [r.p for r in spark.range(n).select(md.permuted(F.col("id"), n, F.lit(8)).alias("p")).collect()]
        assert n < 64 or (other != places and places != list(range(n)) and abs(np.corrcoef(places, range(n))[0, 1]) < 0.4)
    assert md.sequential_verdict(3, 3, 5) is None
    assert md.sequential_verdict(15, 15, 5) == "confirmed" and md.sequential_verdict(0, 15, 5) == "rejected"
    assert all(md.sequential_verdict(k // 2, k, 5) is None for k in range(1, 200))


def test_shadow_selection_finds_what_was_planted(spark):
    rng = np.random.default_rng(31)
    rows = [(float(x), float(rng.normal()), float(rng.integers(0, 3)), int(x + 0.05 * rng.normal() > 0)) for x in rng.normal(0, 1, 300)]
    df = spark.createDataFrame(rows, "strong double, noise double, level double, pain int")
    got = {r.variable: r for r in md.shadow_selection(df, ["strong", "noise", "level"], max_rounds=60, trees=5, depth=3, together=10).collect()}
    assert got["strong"].verdict == "confirmed" and got["strong"].hits == got["strong"].rounds
    assert got["noise"].verdict != "confirmed" and got["level"].verdict != "confirmed"
    assert md.shadow_selection(df.limit(0), ["strong"]).first().verdict == "tentative"


def test_exact_quantiles(spark):
    rng = np.random.default_rng(12)
    groups = {"ties": rng.integers(0, 9, 3000) * 1.0, "wide": np.exp(rng.normal(0, 40, 5000)), "few": rng.normal(0, 1, 7), "one": np.array([3.0]), "same": np.full(900, 2.5), "none": np.array([np.nan])}
    rows = [(k, None if np.isnan(x) else float(x), 1) for k, v in groups.items() for x in v] + [("ties", None, 1)] * 5
    df = spark.createDataFrame(rows, "k string, v double, _q int")
    probs = {"low": 0.0, "q": 0.25, "m": 0.5, "u": 0.9, "high": 1.0}
    for accuracy in (100, 500, 10_000):
        got = {r.k: r for r in ordered.exact_quantiles(df, ["k"], "v", probs, {"rows": F.count(F.lit(1))}, accuracy).collect()}
        for k, v in groups.items():
            if k == "none":
                assert got[k]["m"] is None and got[k]["n_values"] == 0 and got[k]["rows"] == 1
            else:
                np.testing.assert_allclose([got[k][n] for n in probs], np.quantile(v, list(probs.values())), rtol=1e-12)
        every = np.concatenate([v for k, v in groups.items() if k != "none"])
        total = ordered.exact_quantiles(df, [], "v", probs, accuracy=accuracy).first()
        np.testing.assert_allclose([total[n] for n in probs], np.quantile(every, list(probs.values())), rtol=1e-12)


def test_p_values(spark):
    t = (np.arange(200_000) + 0.5) * 0.3 / 200_000
    area = float((t**1.5 / np.sqrt(1 - t)).sum() * 0.3 / 200_000)
    beta = math.gamma(2.5) * math.gamma(0.5) / math.gamma(3.0)
    assert abs(pv.beta_regularised(2.5, 0.5, 0.3) - area / beta) < 1e-8
    for n, t, want in ((10, 2.228, 0.05), (5, 2.571, 0.05), (30, 2.750, 0.01)):
        assert abs(pv.beta_regularised(n / 2, 0.5, n / (n + t * t)) - want) < 5e-5
    for k, x, want in ((1, 3.841, 0.05), (12, 21.026, 0.05), (6, 16.812, 0.01)):
        assert abs(pv.gamma_upper(k / 2, x / 2) - want) < 5e-5
    df = spark.createDataFrame([(1.959964, 12.0), (None, 3.0)], "z double, n double")
    rows = df.select(pv.normal_two_sided(F.col("z")).alias("p"), pv.chi2_upper(F.col("z"), F.col("n")).alias("c")).collect()
    assert abs(rows[0]["p"] - 0.05) < 1e-6 and rows[1]["p"] is None


def test_partial_correlation_against_least_squares(series, days):
    cols = ["a", "b", "pain"]
    out = st.partial_correlations(series, K, ["pain"], cols, keep=0.0).toPandas()
    for e in ("ann", "bob"):
        d = days[days.entity == e][cols].dropna()
        row = out[(out.entity == e) & (out.variable == "a")].iloc[0]
        linked = abs(d.a.corr(d.b)) >= 0.2
        x = np.column_stack([np.ones(len(d)), d.b]) if linked else np.ones((len(d), 1))
        res = [v - x @ np.linalg.lstsq(x, v, rcond=None)[0] for v in (d.a.to_numpy(), d.pain.to_numpy())]
        assert abs(row.partial_r - np.corrcoef(*res)[0, 1]) < 1e-9


def test_cross_correlation_short_series(spark, days):
    d = days[(days.entity == "ann") & (days.pos < 20)]
    df = spark.createDataFrame(d)
    out = lc.cross_correlation(df, K, ["a"], ["b"], range(-30, 31)).orderBy("lag").toPandas()
    assert out.lag.tolist() == list(range(-30, 31))
    for lag, corr in zip(out.lag, out["corr"]):
        x = d.a.reset_index(drop=True).shift(lag)
        ok = x.notna()
        want = d.b.reset_index(drop=True)[ok].corr(x[ok]) if ok.sum() > 5 else np.nan
        assert (np.isnan(want) and pd.isna(corr)) or abs(corr - want) < 1e-9


def test_warning_flags_against_loop(spark):
    rng = np.random.default_rng(1)
    n, head = 200, 30
    s = np.cumsum(rng.normal(0, 0.012, n))
    df = spark.createDataFrame([("p", i, float(v), float(v)) for i, v in enumerate(s)], "entity string, pos int, strain double, pain double")
    got = wn.all_warnings(df, K, head).orderBy("pos").toPandas()
    diff = np.r_[np.nan, np.diff(s)]
    diff[: head + 1] = np.nan
    rise = np.where(diff >= 0.02, 0.48, 0.0)
    count = 0
    for i in range(head, n - 1):
        if rise[i] == 0.48:
            count = 10
        elif count:
            rise[i], count = 0.4, count - 1
    same(got["rise"].astype(float), rise)
    warn = np.array([0.600001 if head <= i < n - 1 and rise[i] >= 0.4 else 0.0 for i in range(n)])
    same(got["warning"].astype(float), warn)
    since, seq, alert, cur = [], [], 0, 0
    number = 1
    for i in range(head, n):
        cur += 1
        if warn[i] >= 0.6:
            if not alert:
                cur, number = 1, number + 1
            alert = 1
        else:
            alert = 0
        since.append(cur)
        seq.append(number)
    assert got["days_since"][head:].astype(int).tolist() == since
    assert got["sequence"][head:].astype(int).tolist() == seq


def test_buildup_against_loop(spark):
    rng = np.random.default_rng(4)
    windows, rows, tops = 25, [], []
    want = {}
    for w in range(windows):
        n = int(rng.integers(20, 60))
        pain, strain = np.round(rng.random(n), 2), np.round(rng.random(n), 2)
        top, peak = int(rng.integers(4, n)), int(rng.integers(0, n))
        level = np.median(pain[max(top - 3, 0) : top + 1 if top + 1 < n else top])
        gap, pos, start = 0, top, top
        while pos > 0 and (pain[pos] >= level or gap < 2):
            if pain[pos] >= level:
                start = pos
            pos -= 1
            gap = gap + 1 if pain[pos] < level else 0
        end = start + 2 if start + 2 < n else start
        part = strain[max(start - 5, 0) : end]
        want[w] = (start, round(float(level), 9), round(float(part.max()), 9) if len(part) else None, start - peak)
        base = 1000 * w
        rows += [("p", base + peak, 0.5, base + i, 0.0, 0.0, float(strain[i]), float(pain[i])) for i in range(n)]
        tops.append(("p", "max", base + top, 1.0))
    zoom = spark.createDataFrame(rows, "entity string, window_pos int, score double, pos int, strain double, pain double, strain_raw double, pain_raw double")
    ext = spark.createDataFrame(tops, "entity string, kind string, pos int, value double")
    got = {
        r["window_pos"] // 1000: (r["start"], round(r["level"], 9), None if r["trigger"] is None else round(r["trigger"], 9), r["delay"])
        for r in pk.buildup_metrics(zoom, ext, K).collect()
    }
    assert got == want
    kept = pk.plausible_buildups(pk.buildup_metrics(zoom, ext, K)).count()
    assert kept == sum(t is not None and -5 <= d < 28 and s > 1 for s, _, t, d in want.values())


def test_sweep_equals_single_runs(series):
    keys = ["entity", "filter_id"]
    grid = pk.smooth_grid(series.fillna({"pain": 2.0}), K, {"a": 1.0, "b": 0.3}, "pain", [(7, 60, 5), (9, 0, 3)], digits=9)
    for i, (m, b, k) in enumerate([(7, 60, 5), (9, 0, 3)]):
        one = pk.smooth(series.fillna({"pain": 2.0}), K, {"a": 1.0, "b": 0.3}, "pain", m, b, k, digits=9)
        left = grid.where(F.col("filter_id") == i).drop("filter_id")
        assert left.exceptAll(one.select(left.columns)).count() == 0
    found = pk.find_extrema(grid, keys, ["pain", "strain"], 0.05, 2.0)
    clean = pk.alternate(pk.of_series(found, "pain"), keys)
    scores = pk.cycle_scores(clean, pk.of_series(found, "strain", "max"), keys)
    assert scores.where(~F.col("score").between(-1, 1)).count() == 0


def test_linear_models_against_numpy(series, days):
    d = days[days.entity == "ann"]
    x = d[["a", "b"]].to_numpy()

    def ssr(y, cols):
        beta = np.linalg.lstsq(cols, y, rcond=None)[0]
        return float(((y - cols @ beta) ** 2).sum())

    best = 1.0
    for n in range(1, 5):
        y = x[n:, 0]
        own = np.column_stack([np.ones(len(y))] + [x[n - k : len(x) - k, 0] for k in range(1, n + 1)])
        full = np.column_stack([own] + [x[n - k : len(x) - k, 1] for k in range(1, n + 1)])
        small, big = ssr(y, own), ssr(y, full)
        best = min(best, pv.gamma_upper(n / 2, len(y) * (small - big) / big / 2))
    got = md.granger_matrix(series, K, ["a", "b"], max_lag=4)
    got = got.where("entity = 'ann' and effect = 'a' and cause = 'b'").first()["min_p"]
    assert abs(got - best) < 1e-6

    n = 3
    y = x[n:]
    design = np.column_stack([np.ones(len(y))] + [x[n - k : len(x) - k] for k in range(1, n + 1)])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    coef = md.var_coefficients(series, K, ["a", "b"], lags=n, hold_out=0).where("entity = 'ann' and equation = 'a'")
    rows = {(r["term"], r["lag"]): r["coefficient"] for r in coef.collect()}
    same([rows["const", 0], rows["a", 1], rows["b", 1], rows["a", 3]], [beta[0, 0], beta[1, 0], beta[2, 0], beta[5, 0]])

    vif = md.vif_elimination(series, K, ["a", "b"], limit=1e9).where("entity = 'ann' and variable = 'a'").first()["vif"]
    r2 = 1 - ssr(x[:, 0], x[:, [1]]) / (x[:, 0] ** 2).sum()
    assert abs(vif - 1 / (1 - r2)) < 1e-6


def test_vif_ties_drop_the_first_column(spark):
    """Two columns inflate each other alike, so the last bits of their sums must not choose."""
    rng = np.random.default_rng(17)
    rows = []
    for key in range(40):
        base = rng.random(30) * 50 + 100
        a, b = base + rng.random(30), (base + rng.random(30)) * 7e4
        rows += [(key, float(p), float(q), float(p / 3 + q / 7e4 + rng.random())) for p, q in zip(a, b, strict=True)]
    df = spark.createDataFrame(rows, "entity int, a double, b double, c double")
    two = md.vif_elimination(df, K, ["a", "b"]).toPandas()
    assert set(two[~two.kept].variable) == {"a"} and len(two) == 80
    assert (md.vif_elimination(df, K, ["b", "a"]).where("NOT kept").toPandas().variable == "b").all()
    three = md.vif_elimination(df, K, ["a", "b", "c"]).toPandas()
    assert (three[three.kept].groupby("entity").variable.max() == three[three.kept].groupby("entity").variable.min()).all()
    for _, got in three.groupby("entity"):
        first = got.loc[got.vif.idxmax(), "variable"]
        assert list(got[~got.kept].variable) == [first, min({"a", "b", "c"} - {first})]


def test_unit_root(series, days):
    y = days[days.entity == "ann"].a.to_numpy()
    d = np.diff(y)
    design = np.column_stack([y[:-1], np.ones(len(d))])
    beta, *_ = np.linalg.lstsq(design, d, rcond=None)
    res = d - design @ beta
    se = math.sqrt(res @ res / (len(d) - 2) * np.linalg.inv(design.T @ design)[0, 0])
    got = md.unit_root_test(series, K, ["a"], max_lag=0).where("entity = 'ann'").first()
    assert abs(got["statistic"] - beta[0] / se) < 1e-8 and got["lags"] == 0
    # published 5% and 1% critical values of the constant-only case
    assert abs(md._adf_p(-2.86154) - 0.05) < 2e-3 and abs(md._adf_p(-3.43035) - 0.01) < 1e-3


def test_weight_tuning_never_loses(series):
    out = ro.tune_factors(series.fillna({"pain": 2.0}), K, {"a": 100.0, "b": 50.0}, "pain", steps=50)
    for row in out.collect():
        assert row["corr_after"] >= row["corr_before"] - 1e-9


def test_level_does_not_change_linear_models(spark, series):
    """Tests and orders of shifted series agree with those of the plain ones."""
    from dayweave.operators import models, stats
    from pyspark.sql import functions as F

    base = series.select("entity", "day", "a", "b").dropna()
    seen = {}
    for level in (0.0, 1e5, 1e7):
        df = base.withColumns({c: F.col(c) + level for c in ("a", "b")})
        adf = {(r.entity, r.variable): (r.statistic, r.lags) for r in models.unit_root_test(df, ["entity"], ["a", "b"], 2).collect()}
        granger = {(r.entity, r.effect, r.cause): r.min_p for r in models.granger_matrix(df, ["entity"], ["a", "b"], 2).collect()}
        order = {(r.entity, r.order): r.aic for r in models.var_order(df, ["entity"], ["a", "b"], 3).collect()}
        slope = {(r.entity, r.equation, r.term, r.lag): r.coefficient for r in models.var_coefficients(df, ["entity"], ["a", "b"], 2, 50).collect() if r.term != "const"}
        spread = {r.entity: r.sd_y for r in stats.weighted_summary(df.withColumns({"x": (F.col("a") - level) / 50, "w": F.lit(2.0)}), ["entity"], "x", "b", "w").collect()}
        for name, found in (("adf", adf), ("granger", granger), ("order", order), ("slope", slope), ("spread", spread)):
            want = seen.setdefault(name, found)
            assert found.keys() == want.keys()
            for k, v in found.items():
                for x, y in zip(v if isinstance(v, tuple) else (v,), want[k] if isinstance(want[k], tuple) else (want[k],), strict=True):
                    assert abs(x - y) <= 1e-6 * max(1.0, abs(y)), (name, k, level, x, y)
