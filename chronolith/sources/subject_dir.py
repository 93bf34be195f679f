"""A participant's directory: time series and sleep logs in JSON, questionnaires in CSV. A missing file is an empty part."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import schema, timestamps, vocabulary
from chronolith.sources import json_split

#: Fixed offset of the clocks, minutes east of UTC.
OFFSET = 60
#: The type of what each folder holds.
FOLDERS = {"fitbit": "wearable", "pmsys": "manual", "googledocs": "manual"}
PART = "metric string, unit string, value string, start_local timestamp_ntz, end_local timestamp_ntz, source_dir string"


class EmptyDirectoryError(ValueError):
    """Nothing in the directory could be read."""


@dataclass(frozen=True)
class Series:
    """One time-series file: what it measures, how long a row lasts, where the value is, whether 0 means missing."""

    file: str
    metric: str
    unit: str
    seconds: int
    pointer: str = "value"
    value_type: str = "string"
    zero_missing: bool = False


#: The time series read.
SERIES = (
    Series("fitbit/steps.json", "StepCount", "count", 60),
    Series("fitbit/distance.json", "DistanceWalkingRunning", "cm", 60),
    Series("fitbit/calories.json", "TotalEnergyBurned", "kcal", 60),
    Series("fitbit/heart_rate.json", "HeartRate", "count/min", 0, "value.bpm", "struct<bpm:string,confidence:string>"),
    Series("fitbit/resting_heart_rate.json", "RestingHeartRate", "count/min", 86400, "value.value", "struct<date:string,value:string,error:string>", True),
    Series("fitbit/sedentary_minutes.json", "SedentaryTime", "min", 86400),
    Series("fitbit/lightly_active_minutes.json", "LightActivityTime", "min", 86400),
)
EXERCISE = ("fitbit/moderately_active_minutes.json", "fitbit/very_active_minutes.json")
#: Questionnaire scales of 1 to 5, 0 for an answer that was skipped.
SCALES = {"fatigue": "Fatigue", "mood": "Mood", "sleep_quality": "SleepQuality", "soreness": "Soreness", "stress": "Stress"}
SLEEP = "logId long, dateOfSleep string, type string, startTime string, endTime string, levels struct<data:array<struct<dateTime:string,level:string,seconds:double>>>"


def _clock(x: Column) -> Column:
    return F.try_to_timestamp(F.substring(F.replace(x, F.lit("T"), F.lit(" ")), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def _fine_clock(x: Column) -> Column:
    """A stamp with a T and, if there, parts of a second; null for any other text."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?$"), x.try_cast("timestamp_ntz"))


def _part(df: DataFrame, metric: Column | str, unit: Column | str, value: Column, start: Column, end: Column, folder: str) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(lit(metric).alias("metric"), lit(unit).cast("string").alias("unit"), value.cast("string").alias("value"), start.alias("start_local"), end.alias("end_local"), F.lit(folder).alias("source_dir"))


def timeseries(df: DataFrame, s: Series) -> DataFrame:
    """Rows of one series from ``dateTime, value``."""
    value = F.col(s.pointer)
    if s.zero_missing:
        df = df.filter(value.try_cast("double") != 0)
    start = _clock(F.col("dateTime"))
    return _part(df, vocabulary.restore_prefix(F.lit(s.metric)), s.unit, value, start, timestamps.plus_seconds(start, F.lit(s.seconds)), "fitbit")


def exercise_minutes(parts: DataFrame) -> DataFrame:
    """Moderate and vigorous minutes summed to one row a day, from ``dateTime, value`` of both files."""
    days = parts.groupBy("dateTime").agg(F.sum(F.col("value").try_cast("double")).alias("value"))
    start = _clock(F.col("dateTime"))
    return _part(days, vocabulary.restore_prefix(F.lit("AppleExerciseTime")), "min", F.col("value"), start, timestamps.plus_seconds(start, F.lit(86400)), "fitbit")


def sleep(df: DataFrame) -> DataFrame:
    """One row a stage; short awakenings are left out, unknown stages dropped."""
    stages = df.select(F.explode_outer("levels.data").alias("d")).filter("d IS NOT NULL").select("d.*")
    stages = stages.withColumn("stage", vocabulary.stage(F.col("level"))).filter("stage IS NOT NULL")
    start = _fine_clock(F.col("dateTime"))
    value = F.concat(F.lit("HKCategoryValueSleepAnalysis"), F.col("stage"))
    return _part(stages, vocabulary.restore_prefix(F.lit("SleepAnalysis")), F.lit(None), value, start, timestamps.plus_seconds(start, F.col("seconds")), "fitbit")


def sleep_score(df: DataFrame) -> DataFrame:
    """Overall score and restlessness; the zone mark behind the time is wrong and ignored."""
    start = _clock(F.col("timestamp"))
    long = df.select("timestamp", F.expr("stack(2, 'SleepScore', 'score', overall_score, 'SleepRestlessness', 'fraction', restlessness) AS (metric, unit, value)")).filter("value IS NOT NULL")
    return _part(long, F.col("metric"), F.col("unit"), F.col("value"), start, start, "fitbit")


def wellness(df: DataFrame) -> DataFrame:
    """Scales (0 is no answer), readiness (0 is one), and hours of sleep over the day before the report."""
    at = _clock(F.col("effective_time_frame"))
    parts = []
    present = [c for c in SCALES if c in df.columns]
    if present:
        long = df.unpivot(["effective_time_frame"], present, "scale", "value").filter(F.col("value").try_cast("double") > 0)
        name = F.create_map(*[F.lit(v) for pair in SCALES.items() for v in pair])[F.col("scale")]
        parts.append(_part(long, name, "score", F.col("value"), at, at, "pmsys"))
    if "readiness" in df.columns:
        parts.append(_part(df.filter("readiness IS NOT NULL"), "Readiness", "score", F.col("readiness"), at, at, "pmsys"))
    if "sleep_duration_h" in df.columns:
        slept = df.filter(F.col("sleep_duration_h").try_cast("double") > 0)
        parts.append(_part(slept, "SleepDurationDaily", "hr", F.col("sleep_duration_h"), timestamps.plus_seconds(at, F.lit(-86400)), at, "pmsys"))
    return _union(df.sparkSession, parts)


def exertion(df: DataFrame) -> DataFrame:
    """Perceived exertion and duration of training; the start is the end less the duration."""
    end = _clock(F.col("end_date_time"))
    start = timestamps.plus_seconds(end, -60 * F.coalesce(F.col("duration_min").try_cast("double"), F.lit(0.0)))
    return _part(df, "PerceivedExertion", "score", F.col("perceived_exertion"), start, end, "pmsys").unionByName(_part(df, "TrainingDuration", "min", F.col("duration_min"), start, end, "pmsys"))


def injury_count(x: Column) -> Column:
    """Entries of a dictionary literal, null for anything else."""
    return F.when(F.trim(x).rlike(r"^\{[\s\S]*\}$"), F.size(F.from_json(F.replace(x, F.lit("'"), F.lit('"')), "map<string,string>"))).cast("int")


def injuries(df: DataFrame) -> DataFrame:
    at = _clock(F.col("effective_time_frame"))
    counted = df.withColumn("n", injury_count(F.col("injuries"))).filter("n IS NOT NULL AND n >= 0")
    return _part(counted, "InjuryCount", "count", F.col("n"), at, at, "pmsys")


def weights(df: DataFrame) -> DataFrame:
    """Body weight of day-first dates; blanks are left out."""
    day = F.try_to_timestamp(F.trim("date"), F.lit("dd/MM/yyyy")).cast("timestamp_ntz")
    return _part(df.filter(F.length(F.trim("weight")) > 0), vocabulary.restore_prefix(F.lit("BodyMass")), "kg", F.col("weight"), day, timestamps.plus_seconds(day, F.lit(86400)), "googledocs")


def _union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    out = spark.createDataFrame([], PART)
    for p in parts:
        out = out.unionByName(p)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: CSV files and what reads them.
TABLES: Mapping[str, Callable[[DataFrame], DataFrame]] = {"fitbit/sleep_score.csv": sleep_score, "pmsys/wellness.csv": wellness, "pmsys/srpe.csv": exertion, "pmsys/injury.csv": injuries, "googledocs/reporting.csv": weights}


def parts(spark: SparkSession, path: str) -> list[DataFrame]:
    """All parts of a directory that are there."""
    json = lambda file, ddl: json_split.elements(spark, f"{path}/{file}").select(F.from_json("text", ddl).alias("r")).select("r.*")
    out = [timeseries(json(s.file, f"dateTime string, value {s.value_type}"), s) for s in SERIES if exists(spark, f"{path}/{s.file}")]
    active = [f for f in EXERCISE if exists(spark, f"{path}/{f}")]
    if active:
        both = json(active[0], "dateTime string, value string")
        for f in active[1:]:
            both = both.unionByName(json(f, "dateTime string, value string"))
        out.append(exercise_minutes(both))
    if exists(spark, f"{path}/fitbit/sleep.json"):
        out.append(sleep(json("fitbit/sleep.json", SLEEP)))
    for file, reader in TABLES.items():
        if exists(spark, f"{path}/{file}"):
            out.append(reader(spark.read.csv(f"{path}/{file}", header=True, inferSchema=False)))
    return out


def canonical(rows: DataFrame, subject_id: str) -> DataFrame:
    """Canonical rows of parts: values split, instants at the fixed offset, type by folder, empty values dropped."""
    value = vocabulary.restore_value_prefix(F.col("metric"), F.col("value"))
    number, word = schema.split_value(value)
    kind = F.create_map(*[F.lit(v) for pair in FOLDERS.items() for v in pair])[F.col("source_dir")]
    none = F.lit(None).cast("timestamp")
    utc = {k: timestamps.to_utc(F.col(f"{k}_local"), F.lit(OFFSET)) for k in ("start", "end")}
    df = rows.select(
        F.lit(subject_id).alias("subject_id"), F.lit("pmdata").alias("source_format"), "metric", "unit", number.alias("value_num"), word.alias("value_str"),
        utc["start"].alias("start_utc"), utc["end"].alias("end_utc"), none.alias("created_utc"), "start_local", "end_local", kind.alias("source_type"),
    )
    return schema.conform(df.filter("value_num IS NOT NULL OR value_str IS NOT NULL"))


def read(spark: SparkSession, path: str, subject_id: str, overrides: Mapping[str, str] | None = None) -> DataFrame:
    found = parts(spark, path)
    if not found:
        raise EmptyDirectoryError(path)
    return canonical(_union(spark, found), subject_id)


def source_names(spark: SparkSession, path: str) -> DataFrame:
    """Folders stand for sources here; there are no names to classify."""
    return spark.createDataFrame([], "source_name string")
