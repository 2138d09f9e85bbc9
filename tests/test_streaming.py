"""Streaming results equal the batch results on the finished days."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from dayweave.operators import warnings as wn
from dayweave.streaming.rollup import daily_rollup
from dayweave.streaming.warning_state import WarningProcessor, warning_stream


def run(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_rollup_emits_complete_days(spark, tmp_path):
    t0 = dt.datetime(2021, 3, 1)
    rows = [("p", t0 + dt.timedelta(hours=5 * i), float(i)) for i in range(40)]
    schema = "entity string, ts timestamp, value double"
    df = spark.createDataFrame(rows, schema)
    for i, day in enumerate(range(0, 40, 10)):
        part = df.where((F.col("value") >= day) & (F.col("value") < day + 10))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = daily_rollup(stream, ["entity"], {"value": "sum"}, lateness="0 seconds")
    run(out.writeStream.outputMode("append").format("memory").queryName("rollup").option("checkpointLocation", str(tmp_path / "cp")).start())
    got = {r["day"]: r["value"] for r in spark.table("rollup").collect()}
    want = {r["d"]: r["v"] for r in df.groupBy(F.to_date("ts").alias("d")).agg(F.sum("value").alias("v")).collect()}
    last = max(want)
    assert last not in got and got == {d: v for d, v in want.items() if d < last}


def test_warning_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    n, head = 120, 20
    schema = "entity string, pos long, strain double, pain double"
    rows = [(e, i, float(v), float(v)) for e in ("ann", "bob") for i, v in enumerate(np.cumsum(rng.normal(0, 0.012, n)))]
    df = spark.createDataFrame(rows, schema)
    for lo in range(0, n, 30):
        df.where((F.col("pos") >= lo) & (F.col("pos") < lo + 30)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = warning_stream(stream.select("entity", "pos", "strain"), head)
    run(out.writeStream.outputMode("append").format("memory").queryName("warned").option("checkpointLocation", str(tmp_path / "cp")).start())
    cols = ["entity", "pos", "rise", "warning", "days_since", "sequence"]
    assert spark.table("warned").where("late").count() == 0
    got = spark.table("warned").select(cols).orderBy("entity", "pos").toPandas()
    want = wn.all_warnings(df, ["entity"], head).where(F.col("pos") < n - 1).select(cols).orderBy("entity", "pos").toPandas()
    assert len(got) == len(want) == 2 * (n - 1)
    for c in cols[1:]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), equal_nan=True)


def test_late_days_wait_and_too_late_ones_are_counted(spark, tmp_path):
    """Days shuffled within four positions over many batches, two of them later than that."""
    rng = np.random.default_rng(4)
    n, head = 80, 10
    schema = "entity string, pos long, strain double"
    strain = np.round(np.cumsum(rng.normal(0, 0.015, n)), 4)
    held = {30, 55}
    order = sorted((i for i in range(n) if i not in held), key=lambda i: i + rng.uniform(0, 3.9))
    order = [*order[:45], 30, *order[45:], 55, 55]
    for k, lo in enumerate(range(0, len(order), 9)):
        rows = [("ann", i, float(strain[i]), k) for i in order[lo : lo + 9]]
        spark.createDataFrame(rows, schema + ", batch int").drop("batch").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = warning_stream(stream, head, lateness=5)
    run(out.writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).start())
    found = spark.table("late")
    late = [(r.pos, r.n_late, r.rise) for r in found.where("late").orderBy("n_late").collect()]
    assert late == [(30, 1, None), (55, 2, None), (55, 3, None)]
    cols = ["pos", "rise", "warning", "days_since", "sequence"]
    got = found.where("NOT late").select(cols).orderBy("pos").toPandas()
    # the chain over all days but those that came too late
    kept = [("ann", i, float(strain[i]), 0.0) for i in range(n) if i not in held]
    assert got["pos"].tolist() == [i for i in range(n) if i not in held][: len(got)] and len(got) >= n - 2 - 7
    state = WarningProcessor(head, wn.RISE_LIMIT, wn.COOL_DOWN, 0)
    judged, want = [-1, None, None, 0, False, 0, 1], []
    for _, pos, x, _ in kept:
        if judged[0] >= 0:
            done, judged = state._judge(judged)
            want.append(done)
        judged = [pos, x, judged[1], *judged[3:]]
    for c, column in zip(cols, zip(*want[: len(got)], strict=True), strict=True):
        np.testing.assert_allclose(got[c].astype(float), np.array([np.nan if v is None else v for v in column], dtype=float), equal_nan=True)
