"""Schema, time stamps, units, names and validation on known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronolith.functions import identity, schema, timestamps, units, vocabulary
from chronolith.operators import validate
from chronolith.sources import sinks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("text", "minutes"), [("+0530", 330), ("-08:00", -480), ("Z", 0), ("+0000", 0), ("0530", None), ("+5", None), ("+ab:cd", None), (None, None)])
def test_offsets(spark, text, minutes):
    assert one(spark, timestamps.offset_minutes(F.lit(text).cast("string")))[0] == minutes


def test_three_encodings_agree(spark):
    want = (dt.datetime(2017, 1, 27, 20, 9, 39), dt.datetime(2017, 1, 27, 16, 9, 39))
    pairs = [timestamps.spaced(F.lit("2017-01-27 16:09:39 -0400")), timestamps.split_12h(F.lit("2017-01-27"), F.lit("4:09:39"), F.lit("PM"), F.lit("-0400")), timestamps.iso(F.lit("2017-01-27T16:09:39.500-04:00"))]
    for utc, local in pairs:
        assert tuple(one(spark, utc.cast("timestamp_ntz").alias("u"), local.alias("l"))) == want


@pytest.mark.parametrize(("half", "hour"), [("AM", 0), ("PM", 12)])
def test_twelve_oclock(spark, half, hour):
    _, local = timestamps.split_12h(F.lit("2020-02-29"), F.lit("12:05:00"), F.lit(half), F.lit("+0000"))
    assert one(spark, local)[0].hour == hour


def test_bad_offset_keeps_the_wall_clock(spark):
    utc, local = timestamps.spaced(F.lit("2017-01-27 16:09:39 oops"))
    assert tuple(one(spark, utc.alias("u"), local.alias("l"))) == (None, dt.datetime(2017, 1, 27, 16, 9, 39))


@pytest.mark.parametrize(("text", "number", "word"), [("12", 12.0, None), (" 7.5 ", 7.5, None), ("1d", None, "1d"), ("-.5e1", -5.0, None), ("Asleep", None, "Asleep"), (" ", None, None), ("", None, None), (None, None, None)])
def test_split_value(spark, text, number, word):
    n, w = schema.split_value(F.lit(text).cast("string"))
    assert tuple(one(spark, n.alias("n"), w.alias("w"))) == (number, word)


def test_conform_names_columns(spark):
    with pytest.raises(schema.SchemaError, match="unit"):
        schema.conform(schema.empty(spark).drop("unit"))
    with pytest.raises(schema.SchemaError, match="extra"):
        schema.conform(schema.empty(spark).withColumn("extra", F.lit(1)))
    assert schema.conform(schema.empty(spark).select(*reversed(schema.COLUMNS))).columns == schema.COLUMNS


def test_units(spark):
    df = spark.createDataFrame([("mi", 2.0), ("%", 0.5), (None, 1.0)], "unit string, value_num double")
    assert [tuple(r) for r in units.canonicalize(df).collect()] == [("m", 2 * 1609.344), ("fraction", 0.5), (None, 1.0)]
    for bad in ("", "mmHg"):
        with pytest.raises(units.UnknownUnitError):
            units.canonicalize(spark.createDataFrame([(bad, 1.0)], "unit string, value_num double"))


@pytest.mark.parametrize(("name", "kind"), [("Anna’s Apple Watch", "wearable"), ("iPhone (12)", "phone"), ("ZOMBIES, run!", "app"), ("Ｗithings", "scale"), ("  ", "unknown"), (None, "unknown"), ("gadget", "unknown")])
def test_classify(name, kind):
    assert identity.classify(name)[0] == kind


def test_overrides_come_first_and_unmatched_is_told():
    assert identity.classify("My iPhone", {"my  iphone": "manual"}) == ("manual", True)
    assert identity.classify("gadget") == ("unknown", False)


def test_catalogue():
    rules = [v[2] for v in vocabulary.CATALOGUE.values()]
    assert len(rules) == 81
    assert {r: rules.count(r) for r in set(rules)} == {"mean": 41, "sum": 31, "count": 4, "skip": 3, "duration": 2}
    assert len(vocabulary.in_domain("nutrition")) == 16 and len(vocabulary.subjective()) == 7
    with pytest.raises(KeyError):
        vocabulary.in_domain("moon")
    assert all(v[1] is None or v[1] in {u for u, _ in units.UNITS.values()} for v in vocabulary.CATALOGUE.values())


def canonical(spark, **changes):
    row = {"subject_id": "subject_a", "source_format": "flat_csv", "metric": "HKQuantityTypeIdentifierStepCount", "unit": "count", "value_num": 1.0, "value_str": None, "start_utc": None, "end_utc": None, "created_utc": None, "start_local": None, "end_local": None, "source_type": "phone"} | changes
    return spark.createDataFrame([tuple(row.values())], schema.SCHEMA)


@pytest.mark.parametrize(
    ("changes", "check"),
    [({"value_str": "HKCategoryValueX"}, "both_values"), ({"value_num": None}, "no_value"), ({"metric": None}, "null_metric"), ({"metric": "Wobble"}, "metric"), ({"value_num": None, "value_str": "Awake"}, "value_str"), ({"source_type": "gadget"}, "source_type"), ({"subject_id": "Anna"}, "subject_id"), ({"unit": "Bo’s watch"}, "possessive")],
)
def test_findings(spark, changes, check):
    assert check in {r.check for r in validate.check(canonical(spark, **changes)).collect()}


def test_clean_rows_have_no_findings_and_wrong_columns_only_one(spark):
    assert validate.check(canonical(spark)).collect() == []
    assert [r.check for r in validate.check(canonical(spark).drop("unit")).collect()] == ["schema"]


def test_gate_writes_nothing(spark, tmp_path):
    with pytest.raises(sinks.FindingsError):
        sinks.write_observations(canonical(spark, metric="Wobble"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    sinks.write_observations(canonical(spark), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_stub_is_never_overwritten(tmp_path):
    assert sinks.write_stub(tmp_path / "s.toml", "subjects", ["a/b"], "")
    (tmp_path / "s.toml").write_text('[subjects]\n"a/b" = "subject_x"\n')
    assert not sinks.write_stub(tmp_path / "s.toml", "subjects", ["c"])
    assert identity.load_subject_id(tmp_path / "s.toml", "a/b") == "subject_x"
    with pytest.raises(KeyError):
        identity.load_subject_id(tmp_path / "s.toml", "c")


def test_the_gate_computes_its_input_once_and_publishes_whole_partitions(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = canonical(spark)
    counted = rows.repartition(1).mapInArrow(passing, rows.schema)
    out = str(tmp_path / "out")
    sinks.write_observations(counted, out)
    assert seen.value == rows.count()
    other = canonical(spark, subject_id="subject_other")
    sinks.write_observations(other, out)
    before = sorted(map(str, spark.read.parquet(out).select(*schema.COLUMNS).collect()))
    assert len(before) == 2 * rows.count()
    with pytest.raises(sinks.FindingsError, match="metric"):
        sinks.write_observations(rows.unionByName(canonical(spark, metric="Wobble")), out)
    with pytest.raises(sinks.FindingsError, match="both_values: 1 rows"):
        sinks.write_observations(canonical(spark, value_num=1.0, value_str="HKCategoryValueX"), out)
    with pytest.raises(sinks.FindingsError, match="schema"):
        sinks.write_observations(rows.drop("unit"), out)
    assert sorted(map(str, spark.read.parquet(out).select(*schema.COLUMNS).collect())) == before
    sinks.write_observations(rows.unionByName(rows), out)  # its own partition only
    assert spark.read.parquet(out).count() == 3 * rows.count()
    assert not [p for p in tmp_path.rglob("_*") if p.is_dir()]


def test_units_that_are_not_named_are_counted(spark):
    df = spark.createDataFrame([(f"u{i:02}", 1.0) for i in range(25)], "unit string, value_num double")
    with pytest.raises(units.UnknownUnitError, match="u19'\\] and 5 more"):
        units.canonicalize(df)
