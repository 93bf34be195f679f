"""One row per subject and local day."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions import fourier
from chronolith.functions.vocabulary import CATEGORY, QUANTITY
from chronolith.operators.intervals import night_seconds

DAY = ["subject_id", "date"]
HEART_RATE, SLEEP = QUANTITY + "HeartRate", CATEGORY + "SleepAnalysis"


@dataclass(frozen=True)
class Feature:
    name: str
    metric: str
    rule: str
    scale: float = 1.0


#: The scalar features of a day.
SCALARS = (
    Feature("steps", QUANTITY + "StepCount", "sum"),
    Feature("distance_m", QUANTITY + "DistanceWalkingRunning", "sum"),
    Feature("exercise_minutes", QUANTITY + "AppleExerciseTime", "sum", 1 / 60),
    Feature("active_energy_kcal", QUANTITY + "ActiveEnergyBurned", "sum"),
    Feature("total_energy_kcal", "TotalEnergyBurned", "sum"),
    Feature("sedentary_hours", "SedentaryTime", "sum", 1 / 3600),
    Feature("light_activity_hours", "LightActivityTime", "sum", 1 / 3600),
    Feature("resting_hr_bpm", QUANTITY + "RestingHeartRate", "mean"),
    Feature("hrv_sdnn_ms", QUANTITY + "HeartRateVariabilitySDNN", "mean", 1000.0),
    Feature("respiratory_rate", QUANTITY + "RespiratoryRate", "mean"),
    Feature("sleep_score", "SleepScore", "mean"),
    Feature("sleep_restlessness", "SleepRestlessness", "mean"),
    Feature("readiness", "Readiness", "mean"),
)
SLEEP_FEATURES = ("sleep_hours", "sleep_efficiency")
HEART_FEATURES = ("hr_mean_bpm", "hr_std_bpm", "hr_range_bpm", "hr_p10_bpm", "hr_active_mean_bpm", "hr_active_excess_bpm", "hr_daily_cv")
SPECTRAL_FEATURES = ("hr_spectral_entropy", "hr_low_frequency_power")
MODEL_FEATURES = tuple(f.name for f in SCALARS) + SLEEP_FEATURES + HEART_FEATURES + SPECTRAL_FEATURES
CORE_FEATURES = ("steps", "sleep_hours", "hr_mean_bpm")
#: Readings of a day below which quantiles stay empty.
LEAST_READINGS = 10
BINS, LEAST_BINS, LEAST_SPAN_MINUTES, LOW_CYCLES = 96, 48, 720, 6
RADICES = (3, 2, 4, 4)


def keys(observations: DataFrame) -> DataFrame:
    """Every subject and day with a record."""
    return observations.filter("start_local IS NOT NULL").select("subject_id", F.to_date("start_local").alias("date")).distinct()


def scalars(observations: DataFrame) -> DataFrame:
    """All scalar features in one pass over the records."""
    wanted = observations.filter(F.col("metric").isin(*[f.metric for f in SCALARS]) & F.col("value_num").isNotNull() & F.col("start_local").isNotNull())
    made = []
    for f in SCALARS:
        value = F.when(F.col("metric") == f.metric, F.col("value_num"))
        made.append(((F.sum(value) if f.rule == "sum" else F.avg(value)) * F.lit(f.scale)).alias(f.name))
    return wanted.groupBy("subject_id", F.to_date("start_local").alias("date")).agg(*made)


def sleep(observations: DataFrame) -> DataFrame:
    """Hours asleep and efficiency by night.

    Stages count by the union of their intervals, whatever recorded them; time in bed is left out. Efficiency needs time
    awake in the night. A recorded daily total goes before the stages.
    """
    stages = observations.filter(F.col("metric") == SLEEP)
    asleep = stages.filter(F.col("value_str").contains("Asleep"))
    either = stages.filter(F.col("value_str").contains("Asleep") | F.col("value_str").endswith("Awake"))
    a = night_seconds(asleep, ["subject_id"]).withColumnRenamed("seconds", "asleep")
    e = night_seconds(either, ["subject_id"]).withColumnRenamed("seconds", "either")
    both = e.join(a, DAY, "left").withColumn("asleep", F.coalesce("asleep", F.lit(0.0)))
    awake = F.col("either") - F.col("asleep")
    staged = both.select(*DAY, (F.col("asleep") / 3600).alias("staged"), F.when(awake > 0, F.col("asleep") / F.col("either")).alias("sleep_efficiency"))
    totals = observations.filter((F.col("metric") == "SleepDurationDaily") & F.col("value_num").isNotNull() & F.col("start_local").isNotNull())
    rolled = totals.groupBy("subject_id", F.to_date("start_local").alias("date")).agg((F.sum("value_num") / 3600).alias("rolled"))
    return rolled.join(staged, DAY, "full").select(*DAY, F.coalesce("rolled", "staged").alias("sleep_hours"), "sleep_efficiency")


def heart_readings(observations: DataFrame) -> DataFrame:
    hr = observations.filter((F.col("metric") == HEART_RATE) & F.col("value_num").isNotNull() & F.col("start_local").isNotNull())
    return hr.select("subject_id", F.to_date("start_local").alias("date"), "start_local", F.col("value_num").alias("v"))


def heart(observations: DataFrame) -> DataFrame:
    """Mean, spread, range, tenth percentile, and the mean of the upper quarter, by day."""
    day = Window.partitionBy(*DAY)
    readings = heart_readings(observations).withColumn("upper", F.percentile("v", F.lit(0.75)).over(day))
    enough = F.count("*") >= LEAST_READINGS
    out = readings.groupBy(*DAY).agg(
        F.avg("v").alias("hr_mean_bpm"), F.stddev_samp("v").alias("hr_std_bpm"), (F.max("v") - F.min("v")).alias("hr_range_bpm"), F.count("*").alias("hr_samples"),
        F.when(enough, F.percentile("v", F.lit(0.1))).alias("hr_p10_bpm"), F.when(enough, F.avg(F.when(F.col("v") >= F.col("upper"), F.col("v")))).alias("hr_active_mean_bpm"),
    )
    cv = F.when((F.col("hr_samples") >= LEAST_READINGS) & (F.col("hr_mean_bpm") > 0), F.col("hr_std_bpm") / F.col("hr_mean_bpm"))
    return out.withColumns({"hr_active_excess_bpm": F.col("hr_active_mean_bpm") - F.col("hr_p10_bpm"), "hr_daily_cv": cv})


def heart_arrays(observations: DataFrame) -> DataFrame:
    """``subject_id, date, v``: mean heart rate by quarter hour as one array of 96, gaps filled linearly, the day's ends
    held; days dense enough."""
    minute = F.hour("start_local") * 60 + F.minute("start_local") + F.floor(F.second("start_local")) / F.lit(60.0)
    readings = heart_readings(observations).withColumn("minute", minute)
    bins = readings.groupBy(*DAY, F.floor(F.col("minute") / 15).cast("int").alias("bin")).agg(F.avg("v").alias("v"), F.min("minute").alias("first"), F.max("minute").alias("last"))
    held = bins.groupBy(*DAY).agg(F.array_sort(F.collect_list(F.struct("bin", "v"))).alias("b"), (F.max("last") - F.min("first")).alias("span"))  # at most 96 entries
    dense = held.filter((F.size("b") >= LEAST_BINS) & (F.col("span") >= LEAST_SPAN_MINUTES))

    def line(a: Column, b: Column) -> Column:
        return F.transform(F.sequence(a["bin"], b["bin"] - 1), lambda i: a["v"] + (b["v"] - a["v"]) * (i - a["bin"]) / (b["bin"] - a["bin"]))

    b = F.col("b")
    lines = F.transform(F.sequence(F.lit(1), F.size(b) - 1), lambda i: line(F.get(b, i - 1), F.get(b, i)))
    first, last = F.get(b, F.lit(0)), F.get(b, F.size(b) - 1)
    ends = F.array_repeat(first["v"], first["bin"]), F.array_repeat(last["v"], BINS - last["bin"])
    return dense.select(*DAY, F.concat(ends[0], F.flatten(lines), ends[1]).alias("v"))


def heart_bins(observations: DataFrame) -> DataFrame:
    """The quarter hours as rows: 96 a day."""
    return heart_arrays(observations).select(*DAY, F.posexplode("v").alias("bin", "v"))


def heart_spectrum(observations: DataFrame) -> DataFrame:
    """Entropy of a day's spectrum, and the share of its power at six cycles a day or fewer: a mixed radix transform of one
    array a day."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    centred = heart_arrays(observations).withColumn("mean", total(F.col("v")) / BINS).withColumn("v", F.transform("v", lambda v: v - F.col("mean")))
    power = centred.select(*DAY, fourier.powers(F.col("v"), BINS, BINS // 2, RADICES).alias("p")).withColumn("total", total(F.col("p")))
    share = power.filter("total > 0").select(*DAY, F.transform("p", lambda p: p / F.col("total")).alias("q"))
    entropy = -total(F.transform("q", lambda q: q * F.log(q + 1e-12))) / F.lit(math.log(BINS // 2))
    return share.select(*DAY, F.greatest(F.lit(0.0), F.least(F.lit(1.0), entropy)).alias("hr_spectral_entropy"), total(F.slice("q", 1, LOW_CYCLES)).alias("hr_low_frequency_power"))


def completeness(columns: list[str] | tuple[str, ...]) -> Column:
    """The share of columns that are set."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns]) / F.lit(float(len(columns)))


def build(observations: DataFrame) -> DataFrame:
    """All features of every day that has a record, and their completeness."""
    out = keys(observations)
    for part in (scalars(observations), sleep(observations), heart(observations), heart_spectrum(observations)):
        out = out.join(part, DAY, "left")
    return out.withColumn("completeness", completeness(MODEL_FEATURES))
