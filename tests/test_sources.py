"""Readers and sinks on small files written by the tests."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from dayweave.operators import calendar as cal
from dayweave.sources import csv_exports as cx
from dayweave.sources import files as fl
from dayweave.sources import json_exports as jx
from dayweave.sources import manual_logs as ml
from dayweave.sources import sinks
from dayweave.sources import tracks as tr

D = dt.date


def test_activities(spark, tmp_path):
    point = "<Trackpoint><Time>2020-05-01T08:00:0{i}Z</Time>{alt}</Trackpoint>"
    alts = [100.0, 95.0, 110.0, 105.0]
    points = "".join(point.format(i=i, alt=f"<AltitudeMeters>{a}</AltitudeMeters>") for i, a in enumerate(alts))
    lap = '<Lap StartTime="2020-05-01T08:00:00Z"><Calories>12.7</Calories><Track>{p}</Track></Lap>'
    doc = '<TrainingCenterDatabase><Activities><Activity Sport="Running"><Id>2020-05-01T08:00:00Z</Id>{laps}</Activity></Activities></TrainingCenterDatabase>'
    (tmp_path / "a.tcx").write_text(doc.format(laps=lap.format(p=points) + lap.format(p="")))
    (tmp_path / "b.tcx").write_text(doc.format(laps=lap.format(p=point.format(i=1, alt=""))))
    (tmp_path / "c.txt").write_text("not an activity")
    rows = {r["calories"]: r for r in tr.read_activities(spark, str(tmp_path)).collect()}
    assert rows[25]["elevation_gain"] == 15.0 and rows[25]["elevation_loss"] == 10.0
    assert rows[12]["elevation_gain"] is None and rows[12]["day"] == D(2020, 5, 1)
    total = tr.daily_activities(tr.read_activities(spark, str(tmp_path))).first()
    assert (total["elevation_gain"], total["calories"]) == (15.0, 37)
    found = fl.find_files(spark, str(tmp_path), ".tcx", "a")
    assert fl.last_file(found).first()["path"].endswith("a.tcx")


def test_gpx_tracks(spark, tmp_path):
    seg = "".join(
        f'<trkpt lat="45.{i}" lon="6.{i}"><ele>{e}</ele><time>2020-05-02T09:0{i}:00Z</time></trkpt>'
        for i, e in enumerate([0, -5, 10, 5, 10, 10, -10, 10])
    )
    (tmp_path / "t.gpx").write_text(f"<gpx><trk><trkseg>{seg}</trkseg></trk></gpx>")
    points = tr.read_track_points(spark, str(tmp_path / "t.gpx"))
    assert points.count() == 8
    gain = tr.track_gains(points, 120).first()
    assert gain["elevation_gain"] == 40.0
    day = tr.daily_track_gain(tr.track_gains(points)).first()
    assert (day["day"], day["elevation_gain"]) == (D(2020, 5, 2), 40.0)


def test_altitude_trace(spark, tmp_path):
    heights = ["0", "100", "110", "105", "99999", "120", "500", "900"]
    lines = ["head"] * 6 + [",".join(["x"] * 10 + [h]) for h in heights]
    (tmp_path / "trace_20200510.txt").write_text("\n".join(lines))
    row = tr.read_altitude_traces(spark, str(tmp_path)).first()
    assert row["day"] == D(2020, 5, 10) and row["gain"] == 25.0


def test_json_exports(spark, tmp_path):
    ns = 1_588_320_000 * 10**9
    points = [{"startTimeNanos": str(ns + i * 10**9), "endTimeNanos": str(ns + (i + 1) * 10**9), "value": [{"intVal": 10 * i}]} for i in range(3)]
    (tmp_path / "fit.json").write_text(json.dumps({"bucket": [{"dataset": [{"point": points}]}, {"dataset": [{"point": []}]}]}, indent=1))
    steps = jx.read_step_points(spark, str(tmp_path / "fit.json"))
    assert steps.agg(F.sum("steps")).first()[0] == 30
    assert steps.agg(F.min("start_ts")).first()[0] == dt.datetime(2020, 5, 1, 8, 0)

    (tmp_path / "api.json").write_text(json.dumps({"activities-steps": [{"dateTime": "2020-05-01", "value": "321"}, {"dateTime": "x", "value": "y"}]}))
    rows = jx.read_api_steps(spark, str(tmp_path / "api.json")).collect()
    assert (rows[0]["day"], rows[0]["steps"]) == (D(2020, 5, 1), 321.0) and rows[1]["steps"] is None

    (tmp_path / "heart-1.json").write_text(json.dumps([{"dateTime": "05/01/20 10:00:00", "value": {"bpm": 61, "confidence": 1}}]))
    (tmp_path / "heart-2.json").write_text(json.dumps([{"dateTime": "05/02/20 10:00:05", "value": "7.5"}]))
    (tmp_path / "other-1.json").write_text(json.dumps([{"dateTime": "05/02/20 10:00:05", "value": "1"}]))
    got = jx.read_intraday(spark, str(tmp_path), "heart").orderBy("ts").collect()
    assert [r["value"] for r in got] == [61.0, 7.5]

    (tmp_path / "UDSFile_1.json").write_text(json.dumps([{"calendarDate": "2020-05-01", "totalKilocalories": 2100.0, "totalSteps": 9000, "totalDistanceMeters": 7000}]))
    assert jx.read_device_summaries(spark, str(tmp_path)).first()["steps"] == 9000.0

    for i in (1, 2):
        (tmp_path / f"sum_{i}.json").write_text(json.dumps([{"summarizedActivitiesExport": [{"activityType": "cycling", "calories": 900.0, "bmrCalories": 100.0, "startTimeLocal": 1588320000000.0}]}]))
    acts = jx.read_device_activities(spark, str(tmp_path / "sum_*.json")).collect()
    assert len(acts) == 2 and acts[0]["start_ts"] == dt.datetime(2020, 5, 1, 8, 0)

    span = {"startTimestamp": "2020-07-01T10:00:00Z", "endTimestamp": "2020-07-01T11:00:00Z"}
    timeline = {"timelineObjects": [
        {"placeVisit": {"location": {"name": "home", "latitudeE7": 451234567, "longitudeE7": 61234567}, "duration": span, "placeVisitType": "SINGLE_PLACE"}},
        {"activitySegment": {"duration": span, "distance": 1200, "activityType": "WALKING", "startLocation": {"latitudeE7": 450000000, "longitudeE7": 60000000}}},
    ]}
    (tmp_path / "tl.json").write_text(json.dumps(timeline))
    rows = {r["location"]: r for r in jx.read_timeline(spark, str(tmp_path / "tl.json"), "Europe/Paris").collect()}
    assert abs(rows["home"]["lat"] - 45.1234567) < 1e-9 and rows["Journey"]["distance"] == 1200.0
    assert rows["home"]["start_local"] == dt.datetime(2020, 7, 1, 12, 0)


def test_csv_exports(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Activities\nDate,Calories\n01-05-2020,"2,345","12,000","8,5",3,700,1,2,3,900\n')
    row = cx.read_tracker_days(spark, str(tmp_path / "t.csv")).first()
    assert (row["day"], row["calories"], row["steps"], row["distance"]) == (D(2020, 5, 1), 2345, 12000, 8.5)

    (tmp_path / "moves_20200503.csv").write_text("walking,100\ncycling,5\nwalking,250\n")
    row = cx.read_walking_days(spark, str(tmp_path / "moves_20200503.csv"), ["activity", "steps"]).first()
    assert (row["day"], row["steps"]) == (D(2020, 5, 3), 250.0)

    (tmp_path / "phone.csv").write_text('"export"\n"of","x"\n"Date","Usage time"\n"2020-05-01","01:30:59"\n"bad","00:10:00"\n"2020-05-01","00:10:00"\n"2020-05-02","09:00:00"\n')
    rows = cx.read_phone_days(spark, str(tmp_path / "phone.csv")).collect()
    assert [(r["day"], r["minutes"]) for r in rows] == [(D(2020, 5, 1), 100)]

    (tmp_path / "d.csv").write_text("A Good Day,2020-05-01\n")
    assert cx.read_diary(spark, str(tmp_path / "d.csv")).first()["text"] == "a good day"
    for i in (1, 2):
        (tmp_path / f"tap{i}.csv").write_text(f"2020-05-01T08:0{i}:00+02:00,x,Ski\nhead,b,c\n")
    taps = cx.read_taps(spark, [str(tmp_path / "tap1.csv"), str(tmp_path / "tap2.csv")])
    assert taps.count() == 2 and taps.agg(F.min("ts")).first()[0] == dt.datetime(2020, 5, 1, 6, 1)

    (tmp_path / "gain.csv").write_text("date,cycling,walking\n2020-05-01,3.5,\n")
    stored = cx.read_stored_gain(spark, str(tmp_path / "gain.csv"), ["cycling", "walking"])
    base = spark.createDataFrame([(D(2020, 5, 1), None, 1.0), (D(2020, 5, 2), None, 2.0)], "day date, cycling double, walking double")
    merged = cal.update_from(cal.combine_first(base, stored, ["day"]), stored, ["day"]).orderBy("day").collect()
    assert (merged[0]["cycling"], merged[0]["walking"], merged[1]["walking"]) == (3.5, 1.0, 2.0)

    lines = fl.read_lines(spark, str(tmp_path / "phone.csv"))
    assert cx.blank_screen_lines(lines, "00:10", keep_header=True).count() == 3


def test_duplicate_complaint_is_an_error(spark):
    cells = spark.createDataFrame([("2020-05-01", "h", "1"), ("2020-05-01", "h", "2")], "date string, name string, intensity string")
    with pytest.raises(Exception, match="duplicate complaint"):
        cx.complaint_days(cells, {"h": "headache"}).collect()


def test_hierarchical_dates(spark, tmp_path):
    text = "2020,5,1,knee,3\n,,,arm,2\n,,2,knee,4\n,,,knee,5\n,6,1,toe,1\n"
    (tmp_path / "pain.csv").write_text(text)
    cells = fl.read_cells(spark, str(tmp_path / "pain.csv"), ["year", "month", "day_of_month", "place", "value"])
    dated = ml.carry_dates(cells)
    assert [r["day"] for r in dated.orderBy("_line").collect()] == [D(2020, 5, 1)] * 2 + [D(2020, 5, 2)] * 2 + [D(2020, 6, 1)]
    wide = {r["day"]: r for r in ml.pain_columns(dated, "place", "value", {"knee": "kneePain", "arm": "armPain"}, "otherPain").collect()}
    assert wide[D(2020, 5, 1)]["armPain"] == 2.0 and wide[D(2020, 5, 2)]["kneePain"] == 5.0
    assert wide[D(2020, 6, 1)]["otherPain"] == 1.0


def test_carried_dates_across_file_blocks(spark, tmp_path):
    lines = ["2020,5,1,knee,3"] + [",,,arm,2"] * 4000 + [",,2,knee,4"] + [",,,arm,9"] * 4000
    (tmp_path / "long.csv").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        cells = fl.read_cells(spark, str(tmp_path / "long.csv"), ["year", "month", "day_of_month", "place", "value"])
        assert cells.rdd.getNumPartitions() > 3
        got = {r["day"]: r["count"] for r in ml.carry_dates(cells).groupBy("day").count().collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {D(2020, 5, 1): 4001, D(2020, 5, 2): 4001}


def test_log_table_and_sinks(spark, tmp_path):
    cells = spark.createDataFrame(
        [("a", "1", "01/05/2020 10:00", 1), ("a", "2", "01/05/2020 11:00", 2), ("b", " ", "bad", 3)],
        "id string, n string, t string, line int",
    )
    rows = {r["id"]: r for r in ml.load_log_table(cells, ["id"], ["line"], ["n"], start=("t", "dd/MM/yyyy HH:mm")).collect()}
    assert rows["a"]["n"] == 1.0 and rows["a"]["start_time"] == 1588327200 and rows["b"]["start_time"] == 0
    days = spark.createDataFrame([("p", D(2020, 5, i), float(i) if i % 2 else None) for i in range(1, 6)], "entity string, day date, x double")
    sliced = sinks.export_slice(days, "2020-05-02", "2020-05-05", ["x"])
    assert [r["x"] for r in sliced.orderBy("day").collect()] == [3.0, 5.0]
    sinks.write_stage(days, str(tmp_path / "stage"))
    assert spark.read.parquet(str(tmp_path / "stage")).where("entity = 'p'").count() == 5
    sinks.write_result(sliced, str(tmp_path / "result"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "result")).count() == 2


def test_two_people_in_one_folder(spark, tmp_path):
    """Each reader finds in the path whose file it reads; days and carried values of two people stay apart."""
    who = r"/(ann|bob)/"
    gpx = '<gpx><trk><trkseg><trkpt lat="1" lon="2"><ele>{0}</ele><time>2020-05-03T10:00:00Z</time></trkpt><trkpt lat="1" lon="2"><ele>{1}</ele><time>2020-05-03T10:01:00Z</time></trkpt></trkseg></trk></gpx>'
    for n, name in ((1, "ann"), (3, "bob")):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "tracker.csv").write_text(f'Date,Calories\n"03-05-2020","{n},000","{n * 10}","2,5","0","0","0","0","0","0"\n')
        (folder / "moves_20200503.csv").write_text(f"walking,{n}00\ntransport,9\nwalking,{n}50\n")
        (folder / "phone.csv").write_text(f'head\n"Date","Usage time"\n2020-05-03,00:0{n}:30\n2020-05-0{3 + n},00:09:00\n2020-05-0{4 + n},00:01:00\n')
        (folder / "gain.csv").write_text(f"day,cycling\n2020-05-03,{n}.5\n")
        (folder / "diary.csv").write_text(f"Note {name},2020-05-03\n")
        (folder / "tap.csv").write_text(f"timestamp,a,b\n2020-05-03 10:00:00,x,{name}\n")
        (folder / "fit.json").write_text('{"activities-steps": [{"dateTime": "2020-05-03", "value": "%d"}]}' % n)
        (folder / "heart-1.json").write_text('[{"dateTime": "05/03/20 10:00:00", "value": {"bpm": %d}}]' % (60 + n))
        (folder / "UDSFile_1.json").write_text('[{"calendarDate": "2020-05-03", "totalSteps": %d}]' % (n * 1000))
        (folder / "track.gpx").write_text(gpx.format(10, 10 + n))
        (folder / "alt_20200503.txt").write_text("h\n" * 6 + "".join(f"{'x,' * 10}{100 + n * k}\n" for k in range(5)))
    both = f"{tmp_path}/*"

    def by_person(df, *cols):
        return {r.person: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}

    assert by_person(cx.read_tracker_days(spark, f"{both}/tracker.csv", who), "calories", "steps") == {"ann": (1000, 10), "bob": (3000, 30)}
    assert by_person(cx.read_walking_days(spark, f"{both}/moves_*.csv", ["activity", "steps"], who), "steps") == {"ann": 150.0, "bob": 350.0}
    phone = cx.read_phone_days(spark, f"{both}/phone.csv", who).collect()
    assert sorted((r.person, str(r.day), r.minutes) for r in phone) == [("ann", "2020-05-03", 1), ("ann", "2020-05-04", 9), ("bob", "2020-05-03", 3), ("bob", "2020-05-06", 9)]
    assert by_person(cx.read_stored_gain(spark, f"{both}/gain.csv", ["cycling"], who), "cycling") == {"ann": 1.5, "bob": 3.5}
    assert by_person(cx.read_diary(spark, f"{both}/diary.csv", who), "text") == {"ann": "note ann", "bob": "note bob"}
    assert by_person(cx.read_taps(spark, [f"{both}/tap.csv"], who), "label") == {"ann": "ann", "bob": "bob"}
    assert by_person(jx.read_api_steps(spark, f"{both}/fit.json", who), "steps") == {"ann": 1.0, "bob": 3.0}
    assert by_person(jx.read_intraday(spark, both, "heart", who), "value") == {"ann": 61.0, "bob": 63.0}
    assert by_person(jx.read_device_summaries(spark, both, who), "steps") == {"ann": 1000.0, "bob": 3000.0}
    points = tr.read_track_points(spark, f"{both}/track.gpx", who)
    daily = tr.daily_track_gain(tr.track_gains(points, keys=["person"]), ["person"])
    assert by_person(daily, "elevation_gain") == {"ann": 1.0, "bob": 3.0}
    assert by_person(tr.read_altitude_traces(spark, f"{both}/alt_*.txt", person=who), "gain") == {"ann": 2.0, "bob": 6.0}
    assert cx.read_diary(spark, f"{both}/diary.csv", r"/(carl)/").where("person IS NULL").count() == 2
    found = fl.last_file(fl.find_files(spark, str(tmp_path), ".csv", "t").withColumn("person", fl.person_in_path(who, "path")), ["person"])
    assert {r.person: r.path.rpartition("/")[2] for r in found.collect()} == {"ann": "tracker.csv", "bob": "tracker.csv"}
