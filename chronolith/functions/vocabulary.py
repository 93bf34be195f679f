"""Metric names, their prefixes, and the catalogue of domain, unit and daily rule."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifier prefixes.
QUANTITY, CATEGORY, VALUE = "HKQuantityTypeIdentifier", "HKCategoryTypeIdentifier", "HKCategoryValue"
CATEGORY_METRICS = ("SleepAnalysis",)
#: Names of our own, without a prefix.
REGISTERED = (
    "SleepDurationDaily", "TotalEnergyBurned", "SedentaryTime", "LightActivityTime", "SleepScore", "SleepRestlessness", "Fatigue", "Mood",
    "Readiness", "SleepQuality", "Soreness", "Stress", "PerceivedExertion", "TrainingDuration", "InjuryCount",
)
#: Sleep stages of the per-subject logs.
STAGES = {"wake": "Awake", "awake": "Awake", "light": "AsleepCore", "deep": "AsleepDeep", "rem": "AsleepREM", "asleep": "AsleepUnspecified", "restless": "AsleepUnspecified"}
#: Domain, canonical unit, daily rule and names. A name with ``c:`` is a category, with ``*`` stands as it is.
_ROWS = """
activity|count|count|c:AppleStandHour
activity|s|sum|AppleExerciseTime AppleStandTime *LightActivityTime *SedentaryTime
activity|m|sum|DistanceWalkingRunning
activity|count|sum|FlightsClimbed StepCount
activity|kcal/hr·kg|mean|PhysicalEffort
body|fraction|mean|BodyFatPercentage
body|kg|mean|BodyMass LeanBodyMass
body|count|mean|BodyMassIndex
body|m|skip|Height WaistCircumference
cardiac|count/min|mean|HeartRate HeartRateRecoveryOneMinute RespiratoryRate RestingHeartRate WalkingHeartRateAverage
cardiac|s|mean|HeartRateVariabilitySDNN
cardiac|fraction|mean|OxygenSaturation
cardiac|mL/min·kg|mean|VO2Max
energy|kcal|sum|ActiveEnergyBurned BasalEnergyBurned *TotalEnergyBurned
exposure||count|c:AudioExposureEvent c:HeadphoneAudioExposureEvent
exposure|dBASPL|mean|EnvironmentalAudioExposure HeadphoneAudioExposure
exposure|s|sum|TimeInDaylight
hygiene||count|c:ToothbrushingEvent
mobility|fraction|mean|AppleWalkingSteadiness WalkingAsymmetryPercentage WalkingDoubleSupportPercentage
mobility|m|mean|SixMinuteWalkTestDistance WalkingStepLength
mobility|m/s|mean|StairAscentSpeed StairDescentSpeed WalkingSpeed
nutrition|mg|sum|DietaryCalcium DietaryCholesterol DietaryIron DietaryPotassium DietarySodium DietaryVitaminC
nutrition|g|sum|DietaryCarbohydrates DietaryFatMonounsaturated DietaryFatPolyunsaturated DietaryFatSaturated DietaryFatTotal DietaryFiber DietaryProtein DietarySugar
nutrition|kcal|sum|DietaryEnergyConsumed
nutrition|mL|sum|DietaryWater
sleep||duration|c:SleepAnalysis
sleep|s|skip|*HKDataTypeSleepDurationGoal
sleep|s|sum|*SleepDurationDaily
sleep|score|mean|*SleepQuality *SleepScore
sleep|fraction|mean|*SleepRestlessness
wellbeing|score|mean|*Fatigue *Mood *Readiness *Soreness *Stress
wellbeing||duration|c:MindfulSession
wellbeing|count|mean|*InjuryCount
workout|count/min|mean|CyclingCadence
workout|W|mean|CyclingPower RunningPower
workout|m|sum|DistanceCycling DistancePaddleSports
workout|m/s|mean|PaddleSportsSpeed RunningSpeed
workout|s|mean|RunningGroundContactTime
workout|m|mean|RunningStrideLength RunningVerticalOscillation
workout|score|mean|*PerceivedExertion
workout|s|sum|*TrainingDuration
"""
SUBJECTIVE = ("Fatigue", "Mood", "Readiness", "SleepQuality", "Soreness", "Stress", "PerceivedExertion")


def _full(name: str) -> str:
    return name[1:] if name[0] == "*" else CATEGORY + name[2:] if name[:2] == "c:" else QUANTITY + name


#: metric -> (domain, unit or None, daily rule, subjective)
CATALOGUE: dict[str, tuple[str, str | None, str, bool]] = {
    _full(n): (domain, unit or None, rule, n.lstrip("*") in SUBJECTIVE) for domain, unit, rule, names in (r.split("|") for r in _ROWS.strip().split("\n")) for n in names.split()
}


def catalogue(spark: SparkSession) -> DataFrame:
    """The catalogue as a small dimension table (81 rows)."""
    return spark.createDataFrame([(k, *v) for k, v in CATALOGUE.items()], "metric string, domain string, unit string, daily_rule string, subjective boolean")


def in_domain(domain: str) -> list[str]:
    found = sorted(k for k, v in CATALOGUE.items() if v[0] == domain)
    if not found:
        raise KeyError(f"no domain {domain!r}")
    return found


def by_rule(rule: str) -> list[str]:
    return sorted(k for k, v in CATALOGUE.items() if v[2] == rule)


def subjective() -> list[str]:
    return sorted(k for k, v in CATALOGUE.items() if v[3])


def rule_of(metric: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable((k, v[2]) for k, v in CATALOGUE.items())])
    return F.try_element_at(table, metric)


def restore_prefix(x: Column) -> Column:
    """A bare metric name with its identifier prefix; full and registered names pass."""
    return F.when(x.startswith("HK") | x.isin(*REGISTERED), x).when(x.isin(*CATEGORY_METRICS), F.concat(F.lit(CATEGORY), x)).otherwise(F.concat(F.lit(QUANTITY), x))


def restore_value_prefix(metric: Column, value: Column) -> Column:
    """A bare sleep stage with its value prefix; other metrics' values pass."""
    bare = metric.endswith("SleepAnalysis") & ~value.startswith("HK")
    return F.when(bare, F.concat(F.lit(VALUE + "SleepAnalysis"), value)).otherwise(value)


def is_healthkit(x: Column) -> Column:
    return x.startswith("HK")


def short(metric: Column) -> Column:
    """A metric's name without its prefix."""
    return F.regexp_replace(metric, f"^({QUANTITY}|{CATEGORY})", "")


def series_name(metric: Column, value: Column) -> Column:
    """A series: the metric's short name, for categories with the value behind it, its prefix and the metric's name cut
    off. A value that says nothing more is an event."""
    name = short(metric)
    after = lambda x, start: F.when(x.startswith(start), F.substr(x, F.length(start) + 1)).otherwise(x)
    word = after(after(value, F.lit(VALUE)), name)
    return F.when(value.isNull(), name).when(word.isin("", "NotApplicable"), F.concat(name, F.lit("/Event"))).otherwise(F.concat(name, F.lit("/"), word))


def stage(x: Column) -> Column:
    """A log's sleep stage in our words, null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(v) for v in chain.from_iterable(STAGES.items())]), x)
