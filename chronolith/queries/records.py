"""Queries over observations: schema, time stamps, units, names, validation, readers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.functions import identity, schema, timestamps, units, vocabulary
from chronolith.operators import relational, validate
from chronolith.queries.base import obs, observations, rounded, table
from chronolith.sources import flat_csv, inventory, nested_json, subject_dir, xml_export

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """A new path in the folder all executors share, deleted when the driver ends; in local mode, where none may be set,
    in one of our own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or os.environ.get("CHRONOLITH_SCRATCH")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set; executors would write to folders of their own")
        base = os.environ["CHRONOLITH_SCRATCH"] = tempfile.mkdtemp(prefix="chronolith-")
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


@query(obs("SELECT subject_id, source_format, metric, unit, value_num, value_str, start_local AS start_utc, end_local AS end_utc, CAST(NULL AS TIMESTAMP) AS created_utc, start_local, end_local, source_type FROM obs"))
def observations_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = observations(spark, sf_dir)
    ntz = {c: F.col(c).cast("timestamp_ntz") for c in ("start_utc", "end_utc", "created_utc")}
    return schema.conform(df).withColumns(ntz)


_TEXTS = "CASE event_id % 6 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN concat('  ', CAST(event_id AS STRING), '.5 ') WHEN 2 THEN 'Asleep' WHEN 3 THEN ' ' WHEN 4 THEN concat(CAST(event_id AS STRING), 'd') END"


@query(f"""WITH v AS (SELECT event_id, trim({_TEXTS.replace('STRING', 'VARCHAR')}) AS t FROM events)
SELECT event_id, TRY_CAST(t AS DOUBLE) AS number, CASE WHEN t <> '' AND TRY_CAST(t AS DOUBLE) IS NULL THEN t END AS word FROM v""")
def split_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, word = schema.split_value(F.expr(_TEXTS))
    return table(spark, sf_dir, "events").select("event_id", number.alias("number"), word.alias("word"))


_OFFSETS = "CASE event_id % 5 WHEN 0 THEN '+0530' WHEN 1 THEN '-08:00' WHEN 2 THEN 'Z' WHEN 3 THEN 'bad' END"


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 330 WHEN 1 THEN -480 WHEN 2 THEN 0 END AS minutes FROM events")
def offset_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", timestamps.offset_minutes(F.expr(_OFFSETS)).alias("minutes"))


_SECOND = "date_trunc('second', ts)"


@query(f"SELECT event_id, {_SECOND} + INTERVAL 4 HOUR AS utc, {_SECOND} AS local FROM events")
def ts_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc, local = timestamps.spaced(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" -0400")))
    return table(spark, sf_dir, "events").select("event_id", utc.cast("timestamp_ntz").alias("utc"), local.alias("local"))


@query(f"SELECT event_id, {_SECOND} - INTERVAL 330 MINUTE AS utc, {_SECOND} AS local FROM events")
def ts_split_12h(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc, local = timestamps.split_12h(F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "hh:mm:ss"), F.date_format("ts", "a"), F.lit("+0530"))
    return table(spark, sf_dir, "events").select("event_id", utc.cast("timestamp_ntz").alias("utc"), local.alias("local"))


@query(f"SELECT event_id, {_SECOND} - INTERVAL 3 HOUR AS utc, {_SECOND} AS local FROM events")
def ts_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc, local = timestamps.iso(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250+03:00")))
    return table(spark, sf_dir, "events").select("event_id", utc.cast("timestamp_ntz").alias("utc"), local.alias("local"))


_UNITS = ["mi", "ft", "lb", "Cal", "%", "min", "ms", "km/hr", "count"]


@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'm' WHEN 1 THEN 'm' WHEN 2 THEN 'kg' WHEN 3 THEN 'kcal' WHEN 4 THEN 'fraction' WHEN 5 THEN 's' WHEN 6 THEN 's' WHEN 7 THEN 'm/s' ELSE 'count' END AS unit,
round(value * CASE event_id % 9 WHEN 0 THEN 1609.344::DOUBLE WHEN 1 THEN 0.3048::DOUBLE WHEN 2 THEN 0.45359237::DOUBLE WHEN 5 THEN 60.0::DOUBLE WHEN 6 THEN 0.001::DOUBLE WHEN 7 THEN 1 / 3.6::DOUBLE ELSE 1.0::DOUBLE END, 6) AS value_num FROM events""")
def units_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in _UNITS]), (F.pmod("event_id", F.lit(9)) + 1).cast("int"))
    return rounded(units.canonicalize(table(spark, sf_dir, "events").select("event_id", unit.alias("unit"), F.col("value").alias("value_num"))))


@query("""WITH m AS (SELECT event_id, ['StepCount', 'SleepAnalysis', 'HKQuantityTypeIdentifierHeartRate', 'Mood'][CAST(event_id % 4 AS INT) + 1] AS n FROM events)
SELECT event_id, CASE WHEN n = 'SleepAnalysis' THEN 'HKCategoryTypeIdentifierSleepAnalysis' WHEN n = 'StepCount' THEN 'HKQuantityTypeIdentifierStepCount' ELSE n END AS metric,
CASE WHEN n = 'SleepAnalysis' THEN 'HKCategoryValueSleepAnalysisAwake' ELSE 'Awake' END AS value, n <> 'Mood' AS healthkit,
CASE n WHEN 'StepCount' THEN 'sum' WHEN 'SleepAnalysis' THEN 'duration' ELSE 'mean' END AS daily_rule,
CASE n WHEN 'SleepAnalysis' THEN 'SleepAnalysis/Awake' WHEN 'HKQuantityTypeIdentifierHeartRate' THEN 'HeartRate/Awake' ELSE n || '/Awake' END AS series FROM m""")
def metric_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in ("StepCount", "SleepAnalysis", "HKQuantityTypeIdentifierHeartRate", "Mood")]), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    df = table(spark, sf_dir, "events").select("event_id", vocabulary.restore_prefix(name).alias("metric"))
    df = df.withColumn("value", vocabulary.restore_value_prefix(F.col("metric"), F.lit("Awake")))
    return df.select("*", vocabulary.is_healthkit(F.col("metric")).alias("healthkit"), vocabulary.rule_of(F.col("metric")).alias("daily_rule"), vocabulary.series_name(F.col("metric"), F.col("value")).alias("series"))


@query(obs("""SELECT domain, n_metrics, CAST(coalesce(n, 0) AS BIGINT) AS n_rows FROM (VALUES ('activity', 9), ('body', 6), ('cardiac', 8), ('energy', 3), ('exposure', 5), ('hygiene', 1), ('mobility', 8), ('nutrition', 16), ('sleep', 6), ('wellbeing', 7), ('workout', 12)) t(domain, n_metrics)
LEFT JOIN (SELECT CASE WHEN metric LIKE '%Sleep%' THEN 'sleep' WHEN metric LIKE '%HeartRate' THEN 'cardiac' ELSE 'activity' END AS domain, count(*) AS n FROM obs GROUP BY 1) USING (domain)"""))
def metric_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's metrics by domain, and the rows recorded of each."""
    known = vocabulary.catalogue(spark)
    recorded = observations(spark, sf_dir).groupBy("metric").agg(F.count("*").alias("n"))
    return known.join(recorded, "metric", "left").groupBy("domain").agg(F.count("*").cast("int").alias("n_metrics"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


@query("SELECT DISTINCT l_returnflag AS unit FROM lineitem")
def unknown_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded units without a conversion, by distinct values."""
    known = F.when(F.pmod("l_orderkey", F.lit(2)) == 0, "kg").otherwise(F.col("l_returnflag"))
    return units.unknown_units(table(spark, sf_dir, "lineitem").select(known.alias("unit")))


_NAMES = ["Anna’s Apple Watch", "  iPhone (12) ", "Withings", "Zombies, Run!", "Health", "", "Some Gadget", "Sleep++", "Zepp (2)"]


@query("SELECT event_id, ['wearable', 'phone', 'scale', 'app', 'manual', 'unknown', 'unknown', 'app', 'wearable'][CAST(event_id % 9 AS INT) + 1] AS source_type FROM events")
def source_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.pmod("event_id", F.lit(9)) + 1).cast("int"))
    return identity.classified(table(spark, sf_dir, "events").select("event_id", name.alias("name")), "name")


@query("SELECT event_id, ['wearable', 'phone', 'scale', 'app', 'manual', 'unknown', 'unknown', 'app', 'wearable'][CAST(event_id % 9 AS INT) + 1] AS source_type FROM events")
def source_classify_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.pmod("event_id", F.lit(9)) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", identity.source_type(name).alias("source_type"))


@query(obs("SELECT CAST(count_if(value_num IS NOT NULL AND value_str IS NOT NULL) AS BIGINT) AS both_values, CAST(count_if(value_num IS NULL AND value_str IS NULL) AS BIGINT) AS no_value, CAST(0 AS BIGINT) AS null_subject_id, CAST(0 AS BIGINT) AS null_source_format, CAST(count_if(metric LIKE '%HeartRate') AS BIGINT) AS null_metric, CAST(0 AS BIGINT) AS null_source_type FROM (SELECT * REPLACE (CASE WHEN source_type = 'app' THEN NULL ELSE value_num END AS value_num) FROM obs)"))
def validate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = observations(spark, sf_dir)
    broken = df.withColumns({"value_num": F.when(F.col("source_type") != "app", F.col("value_num")), "metric": F.when(~F.col("metric").endswith("HeartRate"), F.col("metric"))})
    return validate.value_counts(broken)


@query(obs("SELECT 'source_type' AS \"check\", 'gadget' AS detail UNION ALL SELECT 'metric', 'Wobble' UNION ALL SELECT 'no_value', CAST((SELECT count(*) FROM obs WHERE metric LIKE '%StepCount') AS VARCHAR) || ' rows'"))
def validate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = observations(spark, sf_dir)
    steps = F.col("metric").endswith("StepCount")
    metric = F.when(F.col("metric").endswith("RestingHeartRate"), "Wobble").otherwise(F.col("metric"))
    broken = df.withColumns({"value_num": F.when(~steps, F.col("value_num")), "metric": metric, "source_type": F.when(F.col("source_type") == "app", "gadget").otherwise(F.col("source_type"))})
    return validate.check(broken)


@query("""SELECT 'text' AS "column", text FROM (SELECT DISTINCT text FROM conversations) WHERE regexp_matches(text, '[''’]s\\b') UNION SELECT 'role', role FROM (SELECT DISTINCT role || '''s phone' AS role FROM conversations)""")
def validate_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("text", F.concat("role", F.lit("'s phone")).alias("role"))
    return validate.possessives(c, ("text", "role"))


_RAW = """SELECT CASE event_type WHEN 'signup' THEN 'HKCategoryTypeIdentifierSleepAnalysis' ELSE 'HKQuantityTypeIdentifierHeartRate' END AS metric,
CASE WHEN event_type = 'signup' THEN NULL ELSE 'count/min' END AS unit, CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(event_id AS DOUBLE) END AS value_num,
CASE WHEN event_type = 'signup' THEN 'HKCategoryValueSleepAnalysisAsleepCore' END AS value_str, {utc} AS start_utc, {local} AS start_local,
['wearable', 'phone', 'unknown'][CAST(event_id % 3 AS INT) + 1] AS source_type FROM events"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an export's text fields."""
    e = table(spark, sf_dir, "events")
    asleep = F.col("event_type") == "signup"
    name = F.element_at(F.array(*[F.lit(n) for n in ("Bo’s Apple Watch", "iPhone (3)", "Thing & Co <x>")]), (F.pmod("event_id", F.lit(3)) + 1).cast("int"))
    return e.select("event_id", "ts", asleep.alias("asleep"), name.alias("name"), F.when(asleep, "AsleepCore").otherwise(F.col("event_id").cast("string")).alias("value"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("metric", "unit", "value_num", "value_str", F.col("start_utc").cast("timestamp_ntz").alias("start_utc"), "start_local", "source_type")


@query(_RAW.format(utc=f"{_SECOND} + INTERVAL 4 HOUR", local=_SECOND))
def xml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh record also stands inside a correlation, as exports repeat them."""
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" -0400"))
    kind = F.when(F.col("asleep"), "HKCategoryTypeIdentifierSleepAnalysis").otherwise("HKQuantityTypeIdentifierHeartRate")
    value = F.when(F.col("asleep"), F.concat(F.lit("HKCategoryValueSleepAnalysis"), F.col("value"))).otherwise(F.col("value"))
    fields = {"type": kind, "sourceName": F.col("name"), "unit": F.when(~F.col("asleep"), "count/min"), "value": value, "creationDate": stamp, "startDate": stamp, "endDate": stamp}
    rows = _raw(spark, sf_dir).select("event_id", *[c.alias(f"_{k}") for k, c in fields.items()])
    names = [f"_{k}" for k in fields]
    inside = rows.filter("event_id % 7 = 0").select(F.lit("pair").alias("_type"), F.array(F.struct(*names)).alias("Record"))
    path = scratch(spark)
    xml = lambda df, tag, mode: df.write.format("xml").option("rootTag", "HealthData").option("rowTag", tag).option("attributePrefix", "_").option("declaration", "").mode(mode).save(path)
    xml(rows.select(*names), "Record", "overwrite")
    xml(inside, "Correlation", "append")
    return _shown(xml_export.read(spark, path, "subject_x"))


@query(_RAW.format(utc=f"{_SECOND} - INTERVAL 330 MINUTE", local=_SECOND))
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    stamp = lambda p: [F.date_format("ts", "yyyy-MM-dd").alias(f"m_{p}Date"), F.date_format("ts", "hh:mm:ss").alias(f"m_{p}Time"), F.date_format("ts", "a").alias(f"m_{p}Time_am_pm"), F.lit("+0530").alias(f"m_{p}TimeZone")]
    rows = raw.select(F.when(F.col("asleep"), "SleepAnalysis").otherwise("HeartRate").alias("type"), F.col("name").alias("sourceName"), F.when(~F.col("asleep"), "count/min").alias("unit"), "value", *stamp("start"), *stamp("end"), *stamp("creation"))
    header = spark.createDataFrame([tuple(rows.columns)], ", ".join(f"`{c}` string" for c in rows.columns))
    path = scratch(spark)
    rows.unionByName(header).write.csv(path, header=True)
    return _shown(flat_csv.read(spark, path, "subject_x"))


@query(_RAW.format(utc=f"{_SECOND} - INTERVAL 3 HOUR", local=_SECOND))
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of events by hour in a few documents, each with a metadata section that fits no schema."""
    raw = _raw(spark, sf_dir)
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+03:00"))
    record = F.struct(F.when(F.col("asleep"), "SleepAnalysis").otherwise("HeartRate").alias("type"), F.col("name").alias("source_name"), F.when(~F.col("asleep"), "count/min").alias("unit"), "value", stamp.alias("creation_date"), stamp.alias("start_date"), stamp.alias("end_date"))
    path = scratch(spark)
    section = F.struct(F.struct(F.collect_list(record).alias("data")).alias("records"))
    sections = raw.groupBy(F.pmod("event_id", F.lit(4)).alias("file"), F.hour("ts").alias("hour")).agg(section.alias("s"))
    hours = sections.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("Hour"), "hour"), "s"))).alias("hours"))
    body = F.concat(F.lit('{"metadata": {"records": {"data": [{"type": "none"}]}}, "Odd": [1, {"records": 2}], '), F.substring(F.to_json("hours"), 2, 2**31 - 1))
    hours.select(body.alias("value")).write.text(path)
    return _shown(nested_json.read(spark, path, "subject_x"))


@query(f"""SELECT 'HKQuantityTypeIdentifierAppleExerciseTime' AS metric, 'min' AS unit, sum(m) AS value_num, d AS start_local FROM
(SELECT date_trunc('day', ts) AS d, CAST(event_id % 50 AS DOUBLE) AS m FROM events WHERE event_type IN ('view', 'click')) GROUP BY d""")
def pm_exercise_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    part = lambda kind: e.filter(F.col("event_type") == kind).select(F.date_format("ts", "yyyy-MM-dd 00:00:00").alias("dateTime"), F.pmod("event_id", F.lit(50)).cast("string").alias("value"))
    rows = subject_dir.exercise_minutes(part("view").unionByName(part("click")))
    return subject_dir.canonical(rows, "subject_x").select("metric", "unit", "value_num", "start_local")


@query(f"""SELECT 'HKCategoryValueSleepAnalysis' || ['Awake', 'AsleepCore', 'AsleepREM', 'AsleepUnspecified'][k] AS value_str, {_SECOND} AS start_local,
{_SECOND} + to_seconds(30 * k) AS end_local, {_SECOND} - INTERVAL 1 HOUR AS start_utc FROM events, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE event_type = 'signup'""")
def pm_sleep_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'signup'")
    stage = lambda level, s: F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("dateTime"), F.lit(level).alias("level"), F.lit(float(s)).alias("seconds"))
    logs = e.select(F.struct(F.array(stage("wake", 30), stage("light", 60), stage("rem", 90), stage("restless", 120), stage("unknown", 5)).alias("data")).alias("levels"))
    rows = subject_dir.canonical(subject_dir.sleep(logs), "subject_x")
    return rows.select("value_str", "start_local", "end_local", F.col("start_utc").cast("timestamp_ntz").alias("start_utc"))


@query(f"""SELECT metric, unit, v AS value_num, {_SECOND} AS end_local FROM (
SELECT ts, unnest([{{'metric': 'Fatigue', 'unit': 'score', 'v': CAST(event_id % 4 AS DOUBLE)}}, {{'metric': 'Mood', 'unit': 'score', 'v': CAST(event_id % 3 AS DOUBLE)}}, {{'metric': 'SleepDurationDaily', 'unit': 'hr', 'v': CAST(event_id % 9 AS DOUBLE)}}, {{'metric': 'Readiness', 'unit': 'score', 'v': CAST(event_id % 2 AS DOUBLE)}}], recursive := true) FROM events) WHERE v > 0 OR metric = 'Readiness'""")
def pm_wellness_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    mod = lambda k: F.pmod("event_id", F.lit(k)).cast("string")
    answers = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("effective_time_frame"), mod(4).alias("fatigue"), mod(3).alias("mood"), mod(2).alias("readiness"), mod(9).alias("sleep_duration_h"))
    return subject_dir.canonical(subject_dir.wellness(answers), "subject_x").select("metric", "unit", "value_num", "end_local")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 END AS injuries FROM events")
def injury_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE event_id % 4 WHEN 0 THEN '{}' WHEN 1 THEN \"{'left_knee': 'minor', 'head': 'major'}\" WHEN 2 THEN 'oops' END")
    return table(spark, sf_dir, "events").select("event_id", subject_dir.injury_count(text).alias("injuries"))


@query("SELECT o_orderpriority AS metric, 'PerceivedExertion' AS kind, CAST(count(*) AS BIGINT) AS n, min(o_orderdate - to_seconds(60 * (o_orderkey % 90))) AS first_start FROM orders GROUP BY 1")
def pm_exertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("end_date_time"), F.lit("5").alias("perceived_exertion"), F.pmod("o_orderkey", F.lit(90)).cast("string").alias("duration_min"), "o_orderpriority")
    rows = None
    for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        part = subject_dir.exertion(o.filter(F.col("o_orderpriority") == p)).filter("metric = 'PerceivedExertion'").withColumn("p", F.lit(p))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(F.col("p").alias("metric"), F.col("metric").alias("kind")).agg(F.count("*").alias("n"), F.min("start_local").alias("first_start"))


@query("""WITH e AS (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT event_type, date_diff('second', date_trunc('second', max(ts) FILTER (i = 1)), date_trunc('second', max(ts) FILTER (i = 2))) AS step FROM e GROUP BY 1)
SELECT e.event_type AS stream, 'scalar' AS family, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last,
  any_value(CASE step WHEN 5 THEN '5s' WHEN 60 THEN '1min' WHEN 86400 THEN '1day' ELSE CAST(step AS VARCHAR) || 's' END) AS grain, true AS counted FROM e JOIN s USING (event_type) GROUP BY 1""")
def file_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array a kind of event, in order of time, probed by windows; ``counted``: the estimate is within a tenth."""
    path = scratch(spark)
    kind = Window.partitionBy("event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumns({"i": F.row_number().over(kind), "last": F.lead(F.lit(True)).over(kind).isNull()})
    record = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("dateTime"), F.col("value").cast("string").alias("value")))
    # the bracket that closes an array is in its last row: rows of their own could be written by another task, to a file of their own
    line = F.concat(F.when(F.col("i") == 1, "[").otherwise(","), record, F.when(F.col("last"), "\n]").otherwise(""))
    e.select("event_type", "i", line.alias("value")).sortWithinPartitions("event_type", "i").drop("i").write.partitionBy("event_type").text(path)
    counts = e.groupBy("event_type").agg(F.count("*").alias("n"))
    found = inventory.probe(spark, path, kind="json").withColumn("stream", F.regexp_extract("source", "event_type=(.*)", 1))
    near = F.abs(F.col("records") - F.col("n")) <= F.col("n") / 10
    return found.join(counts, found.stream == counts.event_type).select("stream", "family", "first", "last", "grain", near.alias("counted"))


@query("SELECT min(ts) AS first, max(ts) AS last, CAST(count(*) AS BIGINT) AS rows FROM events")
def record_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.span(table(spark, sf_dir, "events"), "ts")


@query("""WITH s AS (SELECT event_type, date_diff('second', date_trunc('second', ts), date_trunc('second', lead(ts) OVER (PARTITION BY event_type ORDER BY ts))) AS seconds FROM events),
g AS (SELECT event_type, median(seconds) AS seconds FROM s WHERE seconds > 0 GROUP BY 1)
SELECT event_type, seconds, CASE WHEN seconds <= 5 THEN '5s' WHEN seconds <= 60 THEN '1min' WHEN seconds = 86400 THEN '1day' ELSE 'other' END AS grain FROM g""")
def record_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.grain(table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz")), "event_type", "ts")


@query("""WITH have AS (SELECT o_orderpriority AS metric, min(o_orderstatus) AS have_unit FROM orders GROUP BY 1),
m AS (SELECT * FROM (VALUES ('1-URGENT', 'F'), ('2-HIGH', 'X'), ('9-NEW', 'F')) t(metric, unit))
SELECT m.metric, m.unit, have_unit, CASE WHEN have_unit IS NULL THEN 'new metric' WHEN have_unit <> unit THEN 'unit mismatch' ELSE 'more rows' END AS effect FROM m LEFT JOIN have ON m.metric = have.metric""")
def metric_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("metric"), F.col("o_orderstatus").alias("unit"))
    mapping = spark.createDataFrame([("1-URGENT", "F"), ("2-HIGH", "X"), ("9-NEW", "F")], "metric string, unit string")
    return inventory.overlap(mapping, have)


@query(obs("SELECT source_type, metric, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT date) AS BIGINT) AS n_days, round(sum(value_num), 6) AS total FROM obs GROUP BY 1, 2"))
def by_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.by_source(observations(spark, sf_dir)))


@query(obs("SELECT subject_id, source_type, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT date) AS BIGINT) AS n_days, min(start_local) AS first_seen, max(start_local) AS last_seen FROM obs GROUP BY 1, 2"))
def subject_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.subject_coverage(observations(spark, sf_dir))


@query(obs("SELECT subject_id, date, round(sum(value_num), 6) AS total, round(avg(value_num), 6) AS mean, CAST(count(*) AS BIGINT) AS n_rows FROM obs WHERE metric LIKE '%StepCount' GROUP BY 1, 2"))
def per_day_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.per_day(observations(spark, sf_dir), "HKQuantityTypeIdentifierStepCount"))


@query(obs("SELECT metric, unit, CAST(count(*) AS BIGINT) AS n FROM obs GROUP BY 1, 2"))
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("metric", "unit").agg(F.count("*").alias("n"))
