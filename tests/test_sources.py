"""Readers on small files of each format, and the whole ingest."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chronolith.functions import schema
from chronolith.plans import cli, ingest
from chronolith.sources import dispatch, flat_csv, inventory, nested_json, subject_dir, xml_export

XML = """<?xml version="1.0" encoding="UTF-8"?>
<HealthData locale="en">
 <Record type="HKQuantityTypeIdentifierStepCount" sourceName="Bo&#8217;s Apple Watch" unit="count" creationDate="2020-01-01 10:00:00 -0400" startDate="2020-01-01 09:00:00 -0400" endDate="2020-01-01 09:10:00 -0400" value="12" device="&lt;x&gt;"/>
 <Record type='HKCategoryTypeIdentifierSleepAnalysis' sourceName='Some App' creationDate='2020-01-01 10:00:00 -0400' startDate='2020-01-01 01:00:00 -0400' endDate='2020-01-01 02:00:00 -0400' value='HKCategoryValueSleepAnalysisAsleepCore'><MetadataEntry key="k" value="v"/></Record>
 <Correlation type="x" sourceName="Pair" creationDate="2020-01-01 10:00:00 -0400" startDate="2020-01-01 09:00:00 -0400" endDate="2020-01-01 09:00:00 -0400">
  <Record type="HKQuantityTypeIdentifierHeartRate" sourceName="iPhone" unit="count/min" creationDate="2020-01-01 10:00:00 -0400" startDate="2020-01-01 09:00:00 -0400" endDate="2020-01-01 09:00:00 -0400" value="60"/>
 </Correlation>
 <Record type="HKQuantityTypeIdentifierHeartRate" sourceName="iPhone" unit="count/min" creationDate="2020-01-01 10:00:00 -0400" startDate="2020-01-01 09:00:00 -0400" endDate="2020-01-01 09:00:00 -0400" value="60"/>
 <Workout workoutActivityType="w" sourceName="Strava"/>
</HealthData>
"""
CSV = "type,sourceName,sourceVersion,unit,m_creationDate,m_creationTime,m_creationTime_am_pm,m_creationTimeZone,m_startDate,m_startTime,m_startTime_am_pm,m_startTimeZone,m_endDate,m_endTime,m_endTime_am_pm,m_endTimeZone,value,device\n"
CSV_ROWS = "StepCount,iPhone,1,count,2020-01-01,10:00:00,AM,+0530,2020-01-01,12:05:00,AM,+0530,2020-01-01,12:10:00,AM,+0530,12,d\nSleepAnalysis,Anna’s Apple Watch,1,,2020-01-01,10:00:00,AM,+0530,2020-01-01,1:00:00,AM,+0530,2020-01-01,2:00:00,AM,+0530,AsleepCore,d\n"


@pytest.fixture
def root(tmp_path):
    (tmp_path / "ours").mkdir()
    (tmp_path / "ours/a.xml").write_text(XML)
    (tmp_path / "ours/b.csv").write_text(CSV + CSV_ROWS + CSV)
    doc = {"metadata": 7, "Steps": {"records": {"data": [{"type": "StepCount", "source_name": "Thing", "unit": "count", "value": 5, "creation_date": "2020-01-01T10:00:00Z", "start_date": "2020-01-01T09:00:00+03:00", "end_date": "2020-01-01T09:01:00+03:00"}]}, "sources": ["x"]}, "Sleep": {"records": {"data": [{"type": "SleepAnalysis", "source_name": "Aggregated", "unit": "hours", "value": 7.5, "creation_date": "2020-01-01T10:00:00Z", "start_date": "2020-01-01T09:00:00Z", "end_date": "2020-01-01T09:01:00Z"}]}}, "Odd": [1]}
    (tmp_path / "ours/c.json").write_text(json.dumps(doc))
    p = tmp_path / "pmdata/p01"
    for d in ("fitbit", "pmsys", "googledocs"):
        (p / d).mkdir(parents=True)
    put = lambda f, x: (p / f).write_text(json.dumps(x))
    put("fitbit/steps.json", [{"dateTime": "2020-01-01 02:30:00", "value": "7"}])
    put("fitbit/distance.json", [{"dateTime": "2020-01-01 02:30:00", "value": "250"}])
    put("fitbit/heart_rate.json", [{"dateTime": "2020-01-01 02:30:05", "value": {"bpm": 61, "confidence": 3}}])
    put("fitbit/resting_heart_rate.json", [{"dateTime": "2020-01-01 00:00:00", "value": {"date": "x", "value": 0.0, "error": 0.0}}, {"dateTime": "2020-01-02 00:00:00", "value": {"date": "x", "value": 55.5, "error": 1.0}}])
    put("fitbit/moderately_active_minutes.json", [{"dateTime": "2020-01-01 00:00:00", "value": "70"}])
    put("fitbit/very_active_minutes.json", [{"dateTime": "2020-01-01 00:00:00", "value": "60"}])
    put("fitbit/sleep.json", [{"logId": 1, "levels": {"data": [{"dateTime": "2020-01-01T01:00:00.000", "level": "rem", "seconds": 600}, {"dateTime": "2020-01-01T02:00:00.000", "level": "unknown", "seconds": 60}], "shortData": [{"dateTime": "2020-01-01T01:00:00.000", "level": "wake", "seconds": 30}]}}])
    (p / "fitbit/sleep_score.csv").write_text("timestamp,sleep_log_entry_id,overall_score,restlessness\n2020-01-01T07:00:00Z,1,80,0.07\n")
    (p / "pmsys/wellness.csv").write_text("effective_time_frame,fatigue,mood,readiness,sleep_duration_h\n2020-01-01T08:00:00.000Z,0,3,0,7\n")
    (p / "pmsys/srpe.csv").write_text("end_date_time,activity_names,perceived_exertion,duration_min\n2020-01-01T09:00:00.000Z,['run'],6,45\n")
    (p / "pmsys/injury.csv").write_text("effective_time_frame,injuries\n2020-01-01T09:00:00.000Z,{}\n2020-01-02T09:00:00.000Z,\"{'knee': 'minor', 'head': 'major'}\"\n")
    (p / "googledocs/reporting.csv").write_text("date,timestamp,meals,weight,glasses_of_fluid,alcohol_consumed\n02/01/2020,x,y,80.5,3,No\n03/01/2020,x,y,,3,No\n")
    return tmp_path


def test_xml(spark, root):
    rows = xml_export.read(spark, str(root / "ours/a.xml"), "subject_x").collect()
    assert len(rows) == 3
    steps = next(r for r in rows if r.metric.endswith("StepCount"))
    assert steps.source_type == "wearable" and steps.value_num == 12 and steps.start_local == dt.datetime(2020, 1, 1, 9)
    sleep = next(r for r in rows if r.value_str)
    assert sleep.value_num is None and sleep.unit is None and sleep.source_type == "unknown"
    assert {r.source_name for r in xml_export.source_names(spark, str(root / "ours/a.xml")).collect()} == {"Bo’s Apple Watch", "Some App", "iPhone", "Pair", "Strava"}


def test_empty_xml(spark, tmp_path):
    (tmp_path / "e.xml").write_text("<HealthData><Workout sourceName='x'/></HealthData>")
    with pytest.raises(xml_export.EmptyExportError):
        xml_export.read(spark, str(tmp_path / "e.xml"), "subject_x")


def test_csv(spark, root):
    rows = flat_csv.read(spark, str(root / "ours/b.csv"), "subject_x").collect()
    assert len(rows) == 2
    steps = next(r for r in rows if r.value_num == 12)
    assert steps.start_local == dt.datetime(2020, 1, 1, 0, 5) and steps.metric == "HKQuantityTypeIdentifierStepCount" and steps.source_type == "phone"
    assert next(r for r in rows if r.value_str).value_str == "HKCategoryValueSleepAnalysisAsleepCore"
    (root / "bad.csv").write_text("type,value\nx,1\n")
    with pytest.raises(flat_csv.MissingColumnsError):
        flat_csv.read(spark, str(root / "bad.csv"), "subject_x")


def test_json(spark, root):
    rows = {r.metric: r for r in nested_json.read(spark, str(root / "ours/c.json"), "subject_x").collect()}
    assert set(rows) == {"HKQuantityTypeIdentifierStepCount", "SleepDurationDaily"}
    assert rows["SleepDurationDaily"].value_num == 7.5 and rows["SleepDurationDaily"].source_type == "derived"
    assert rows["HKQuantityTypeIdentifierStepCount"].start_local == dt.datetime(2020, 1, 1, 9)


def test_directory(spark, root):
    rows = ingest.prepare(spark, str(root / "pmdata/p01"), "subject_x").collect()
    by = {}
    for r in rows:
        by.setdefault(r.metric.replace("HKQuantityTypeIdentifier", ""), []).append(r)
    assert by["DistanceWalkingRunning"][0].value_num == 2.5 and by["DistanceWalkingRunning"][0].unit == "m"
    assert by["AppleExerciseTime"][0].value_num == 130 * 60 and len(by["AppleExerciseTime"]) == 1
    assert [r.value_num for r in by["RestingHeartRate"]] == [55.5]
    assert [r.value_str for r in by["HKCategoryTypeIdentifierSleepAnalysis"]] == ["HKCategoryValueSleepAnalysisAsleepREM"]
    assert "Fatigue" not in by and by["Readiness"][0].value_num == 0
    assert sorted(r.value_num for r in by["InjuryCount"]) == [0, 2]
    assert by["PerceivedExertion"][0].start_local == dt.datetime(2020, 1, 1, 8, 15)
    assert [r.value_num for r in by["BodyMass"]] == [80.5] and by["BodyMass"][0].start_local == dt.datetime(2020, 1, 2)
    assert by["StepCount"][0].start_local == dt.datetime(2020, 1, 1, 2, 30) and by["HeartRate"][0].value_num == 61


def test_empty_directory(spark, tmp_path):
    with pytest.raises(subject_dir.EmptyDirectoryError):
        subject_dir.read(spark, str(tmp_path), "subject_x")


def test_dispatch(root):
    assert dispatch.source_format(root) == "pmdata" and dispatch.source_format("x.XML") == "apple_xml"
    with pytest.raises(ValueError, match="reader"):
        dispatch.source_format("x.txt")
    assert [p.name for p in dispatch.find_inputs(root)] == ["a.xml", "b.csv", "c.json", "p01"]


def test_parse_and_scan(spark, root, tmp_path):
    stubs = tmp_path / "stubs"
    assert cli.main(["scan", str(root), str(stubs)]) == 0
    assert "a.xml" in (stubs / "subjects.toml").read_text()
    (root / "identity.toml").write_text('[subjects]\n"ours/a.xml" = "subject_a"\n"ours/b.csv" = "subject_b"\n"pmdata/p01" = "subject_p"\n')
    done = ingest.parse(spark, str(root), str(tmp_path / "out"), str(root / "identity.toml"))
    assert done["ours/a.xml"] == done["ours/b.csv"] == done["pmdata/p01"] == "written" and "subject" in done["ours/c.json"]
    out = spark.read.parquet(str(tmp_path / "out"))
    assert set(out.columns) == set(schema.COLUMNS) and {r.subject_id for r in out.select("subject_id").distinct().collect()} == {"subject_a", "subject_b", "subject_p"}


def test_scan_lists_every_name(spark, tmp_path, monkeypatch):
    (tmp_path / "in/ours").mkdir(parents=True)
    (tmp_path / "in/ours/a.xml").write_text("<HealthData/>")
    monkeypatch.setitem(dispatch.SOURCE_NAMES, "apple_xml", lambda spark, path: spark.range(601).selectExpr("concat('gadget ', id) AS source_name"))
    assert len(ingest.scan(spark, str(tmp_path / "in"), str(tmp_path / "stubs"))["ours/a.xml"]) == 601


def test_inventory(spark, root):
    assert inventory.files(spark, str(root / "ours")).count() == 3


def test_probes_of_files(spark, tmp_path):
    folder = tmp_path / "p01" / "fitbit"
    folder.mkdir(parents=True)
    stamp = lambda i: (dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i)).strftime("%Y-%m-%d %H:%M:%S")
    lines = [f'{{"dateTime": "{stamp(i)}", "value": "{i % 10}"}}' for i in range(20_000)]
    (folder / "steps.json").write_text("[\n" + ",\n".join(lines) + "\n]")
    (folder / "heart_rate.json").write_text(f'[{{"dateTime": "{stamp(0)}", "value": {{"bpm": 60}}}}, {{"dateTime": "2020-01-01 00:00:05", "value": {{"bpm": 61}}}}]')
    (folder / "sleep.json").write_text('[{"logId": 1, "levels": {"data": [{"dateTime": "2020-01-01T22:00:00"}, {"dateTime": "2020-01-01T22:00:30"}]}}]')
    (folder / "empty.json").write_text("[]")
    (folder / "score.csv").write_text("timestamp,score\n2020-01-02,5\n,6\n2020-01-04,7\n")
    (folder / "bare.json").write_text('[{"dateTime": "2020-01-01 00:00:00"}, {"dateTime": "2020-01-01 00:00:07", "value": "\\"dateTime\\": \\"x\\""}]')
    (folder / "notes.txt").write_text("no")
    rows = {r.stream: r for r in inventory.probe(spark, str(tmp_path)).collect()}
    assert set(rows) == {"steps", "heart_rate", "sleep", "empty", "bare", "score"} and {r.source for r in rows.values()} == {"fitbit"}
    assert [(rows[n].family, rows[n].grain) for n in ("steps", "heart_rate", "sleep", "bare")] == [("scalar", "1min"), ("nested", "5s"), ("session", None), ("nested", "7s")]
    assert (rows["steps"].first, rows["steps"].last, rows["steps"].rows) == (stamp(0), stamp(19_999), None) and abs(rows["steps"].records - 20_000) < 20
    assert json.loads(rows["steps"].element) == {"dateTime": stamp(0), "value": "0"}
    assert (rows["heart_rate"].records, rows["sleep"].records, rows["bare"].last) == (2, 1, "2020-01-01 00:00:07")
    assert (rows["sleep"].first, rows["sleep"].last) == ("2020-01-01T22:00:00", "2020-01-01T22:00:30")
    assert tuple(rows["empty"])[5:] == (None,) * 7
    assert (rows["score"].rows, rows["score"].first, rows["score"].last, rows["score"].ext) == (3, "2020-01-02", "2020-01-04", "csv")
    assert [r.stream for r in inventory.probe(spark, [str(folder / "score.csv")]).collect()] == ["score"]
    assert inventory.probe(spark, str(folder / "notes.txt")).collect() == []
    (tmp_path / "report.json").write_text('{\n "days": 3,\n "scores": [{"name": "a", "mae": 0.5}]\n}')
    (r,) = inventory.report(spark, str(tmp_path / "report.json")).collect()
    assert r.days == 3 and r.scores[0].mae == 0.5


def test_parts_of_a_second_stay(spark):
    rows = [("2020-01-01T22:10:30.125", dt.datetime(2020, 1, 1, 22, 10, 30, 125000)), ("2020-01-01T22:10:30", dt.datetime(2020, 1, 1, 22, 10, 30)), ("2020-01-01 22:10:30", None), ("2020-01-01", None), (None, None)]
    got = spark.createDataFrame(rows, "x string, want timestamp_ntz").select("want", subject_dir._fine_clock(F.col("x")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_probes_of_many_ranges(spark, tmp_path, monkeypatch):
    """Windows all over a file whose records grow; tasks stop reading once they have seen enough."""
    monkeypatch.setattr(inventory, "RANGE", 60_000)
    rows = [{"dateTime": f"2020-01-01 {i // 3600:02}:{i // 60 % 60:02}:{i % 60:02}", "value": {"bpm": "9" * (1 + i // 200), "}": '"'}} for i in range(12_000)]
    (tmp_path / "hr.json").write_text(json.dumps(rows))
    (r,) = inventory.probe(spark, str(tmp_path / "hr.json"), window=6000).collect()
    assert (r.first, r.last, r.family, r.grain) == (rows[0]["dateTime"], rows[-1]["dateTime"], "nested", "1s") and abs(r.records - 12_000) < 600
