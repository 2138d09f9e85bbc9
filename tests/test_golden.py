"""Small hand-made frames with known results."""

import datetime as dt

from pyspark.sql import functions as F

from dayweave.functions import expressions as ex
from dayweave.operators import aggregates as ag
from dayweave.operators import calendar as cal
from dayweave.operators import harmonise as hm
from dayweave.operators import rolling as ro
from dayweave.operators.ordered import time_bucket

D = [dt.date(2020, 7, i) for i in (1, 2, 3, 4)]
K = ["entity"]


def frame(spark, **cols):
    names = list(cols)
    rows = [("p", d, *[cols[c][i] for c in names]) for i, d in enumerate(D)]
    schema = "entity string, day date, " + ", ".join(f"{c} double" for c in names)
    return spark.createDataFrame(rows, schema)


def column(df, name, order="day"):
    return [r[name] for r in df.orderBy(order).collect()]


def near(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None) == (w is None) and (g is None or abs(g - w) < 1e-6), (got, want)


def base(spark):
    return frame(spark, col1=[1.0] * 4, col2=[3.0] * 4, col3=[1.0, 2.0, 3.0, 2.0], steps=[0.0] * 4)


def test_subset_period(spark):
    df = base(spark)
    assert cal.subset_period(df, "2020-07-01", "2020-07-01").count() == 1
    assert cal.subset_period(df, "2020-07-01", "2020-07-02").count() == 2
    assert cal.subset_period(df, "2020-07-02", "2020-07-01").count() == 0


def test_copy_period(spark):
    df = base(spark)
    near(column(hm.copy_period(df, "col1", "steps", ("2020-07-01", "2020-07-01")), "steps"), [1, 0, 0, 0])
    near(column(hm.copy_period(df, "col1", "steps", ("2020-07-01", "2020-07-02")), "steps"), [1, 1, 0, 0])
    near(column(hm.copy_period(df, "col1", "steps", ("2020-07-02", "2020-07-01")), "steps"), [0, 0, 0, 0])


def test_regression_adjustment_without_variance(spark):
    one = ag.harmonise_by_regression(base(spark), K, "col2", "col1", "steps", "2020-07-01", "2020-07-01")
    near(column(one, "steps"), [3, 0, 0, 0])
    two = ag.harmonise_by_regression(base(spark), K, "col2", "col1", "steps", "2020-07-01", "2020-07-02")
    near(column(two, "steps"), [3, 3, 0, 0])


def test_rolling_mean_columns(spark):
    out = ro.rolling_mean_columns(base(spark), K, ["col1", "col3"], 2)
    near(column(out, "col1"), [0, 0, 0, 0])
    near(column(out, "col1_RollingMean"), [None, 0, 0, 0])
    near(column(out, "col3"), [0, 0.5, 1, 0.5])
    near(column(out, "col3_RollingMean"), [None, 0.25, 0.75, 0.75])


def test_relative_median(spark):
    rows = [("p", dt.date(2020, 7, 1) + dt.timedelta(i), 3.0, float(i + 1), 0.0) for i in range(10)]
    df = spark.createDataFrame(rows, "entity string, day date, c double, up double, z double")
    out = ro.relative_median_columns(df, K, ["c", "up", "z"], 2, 4)
    near(column(out, "c_relative_2_4"), [None] * 3 + [1.0] * 7)
    want = [None, None, None, 1.4, 1.285714, 1.222222, 1.181818, 1.153846, 1.133333, 1.117647]
    got = column(out, "up_relative_2_4")
    assert all((g is None and w is None) or abs(g - w) < 1e-5 for g, w in zip(got, want))
    near(column(out, "z_relative_2_4"), [None] * 10)


def test_elevation_gain(spark):
    heights = {"a": [0, -5, 10, 5, 10, 10, -10, 10], "b": [1]}
    rows = [(k, dt.datetime(2020, 1, 1, 0, i), float(h)) for k, hs in heights.items() for i, h in enumerate(hs)]
    df = spark.createDataFrame(rows, "track string, ts timestamp, h double")
    for seconds in (60, 120, 86400):
        out = {r["track"]: r["gain"] for r in ag.elevation_gain(df, ["track"], ["ts"], "h", time_bucket("ts", seconds)).collect()}
        assert out == {"a": 40.0, "b": 0.0}
    assert ag.elevation_gain(df.where("false"), ["track"], ["ts"], "h", time_bucket("ts", 60)).count() == 0


def test_manual_fill(spark):
    a = frame(spark, A=[None, None, 1.0, 3.0])
    b = frame(spark, A=[0.0, None, None, 2.0])
    near(column(cal.manual_fill(a, b, ["entity", "day"], ["A"]), "A_manualFill"), [0, None, 1, 3])


def test_pain_recode(spark):
    values = [1.0, 2.4, 2.5, 2.9, 3.0, 3.3, 3.4, 3.5, 4.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p double")
    got = column(df.withColumn("e", ex.pain_recode("p")), "e", "i")
    assert got == [1.0, 1.0, 2.0, 2.0, 4.0, 7.0, 8.0, 8.0, 10.0, None]


def test_update_and_combine(spark):
    old, new = frame(spark, x=[1.0, None, 3.0, None]), frame(spark, x=[9.0, 8.0, None, None])
    near(column(cal.update_from(old, new, ["entity", "day"]), "x"), [9, 8, 3, None])
    near(column(cal.combine_first(old, new, ["entity", "day"]), "x"), [1, 8, 3, None])


def test_calendar_spine(spark):
    who = spark.createDataFrame([("p",), ("q",)], "entity string")
    out = cal.calendar_spine(who, K, "2020-02-27", periods=4, defaults={"x": 0.0, "y": None})
    assert out.count() == 8
    assert out.agg(F.max("day")).first()[0] == dt.date(2020, 3, 1)
    assert out.where("y is not null").count() == 0


def test_categories(spark):
    df = spark.createDataFrame([("a good day with yoga and friends",), ("quiet",), ("",)], "t string")
    from dayweave.functions import vocab

    rows = df.select(
        "t",
        ex.categories("t", vocab.ACTIVITY_WORDS).alias("c"),
        ex.last_category("t", vocab.RATING_WORDS).alias("r"),
    ).collect()
    assert rows[0]["c"] == ["excercise", "social"] and rows[0]["r"] == "good"
    assert rows[1]["c"] == ["rest"] and rows[1]["r"] is None
    assert rows[2]["c"] == []
