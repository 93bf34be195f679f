"""Tables as the operators take them, for both engines: observations from events, daily series from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.plans.ingest import from_events


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, subjects: int = 5) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"), subjects)


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily features of eight subjects out of orders, with gaps and nulls."""
    o = table(spark, sf_dir, "orders")
    subject = F.concat(F.lit("subject_"), F.pmod("o_custkey", F.lit(8)).cast("string"))
    made = o.groupBy(subject.alias("subject_id"), F.to_date("o_orderdate").alias("date")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("steps"), F.count("*").cast("double").alias("sleep_hours"), F.round(F.max("o_totalprice"), 2).alias("top"), F.round(F.min("o_totalprice"), 2).alias("low"), F.countDistinct("o_orderpriority").cast("double").alias("sedentary_hours"),
    )
    day = F.dayofmonth("date")
    return made.select("subject_id", "date", "steps", F.when(day % 3 != 0, F.col("sleep_hours")).alias("sleep_hours"), F.when(day % 5 != 0, F.col("top")).alias("hr_mean_bpm"), F.col("low").alias("resting_hr_bpm"), "sedentary_hours")


OBS = """obs AS (
  SELECT 'subject_' || CAST(user_id % {k} AS VARCHAR) AS subject_id, 'flat_csv' AS source_format,
    CASE event_type WHEN 'view' THEN 'HKQuantityTypeIdentifierStepCount' WHEN 'click' THEN 'HKQuantityTypeIdentifierDistanceWalkingRunning'
      WHEN 'purchase' THEN 'HKQuantityTypeIdentifierRestingHeartRate' WHEN 'error' THEN 'HKQuantityTypeIdentifierHeartRate'
      ELSE 'HKCategoryTypeIdentifierSleepAnalysis' END AS metric,
    CASE event_type WHEN 'view' THEN 'count' WHEN 'click' THEN 'm' WHEN 'purchase' THEN 'count/min' WHEN 'error' THEN 'count/min' END AS unit,
    CASE WHEN event_type <> 'signup' THEN value END AS value_num,
    CASE WHEN event_type = 'signup' THEN 'HKCategoryValueSleepAnalysis' || ['AsleepCore', 'AsleepREM', 'Awake', 'InBed'][CAST(event_id % 4 AS INT) + 1] END AS value_str,
    ts AS start_local, CASE WHEN event_type = 'signup' THEN ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) ELSE ts END AS end_local,
    ['wearable', 'phone', 'app'][CAST(event_id % 3 AS INT) + 1] AS source_type, CAST(ts AS DATE) AS date
  FROM events)"""
DAYS = """days AS (
  SELECT subject_id, date, steps, CASE WHEN day(date) % 3 <> 0 THEN n END AS sleep_hours, CASE WHEN day(date) % 5 <> 0 THEN top END AS hr_mean_bpm,
    low AS resting_hr_bpm, sedentary_hours
  FROM (SELECT 'subject_' || CAST(o_custkey % 8 AS VARCHAR) AS subject_id, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS steps,
          CAST(count(*) AS DOUBLE) AS n, round(max(o_totalprice), 2) AS top, round(min(o_totalprice), 2) AS low, CAST(count(DISTINCT o_orderpriority) AS DOUBLE) AS sedentary_hours
        FROM orders GROUP BY 1, 2))"""
CAL = """cal AS (
  SELECT g.subject_id, g.date, d.steps, d.sleep_hours, d.hr_mean_bpm, d.resting_hr_bpm, d.sedentary_hours
  FROM (SELECT subject_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM days GROUP BY subject_id) g
  LEFT JOIN days d ON d.subject_id = g.subject_id AND d.date = g.date)"""


def obs(sql: str, k: int = 5) -> str:
    return f"WITH {OBS.format(k=k)} {sql}"


def by_day(sql: str) -> str:
    return f"WITH {DAYS} {sql}"


def on_calendar(sql: str) -> str:
    return f"WITH {DAYS}, {CAL} {sql}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, -0.0 as 0.0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
