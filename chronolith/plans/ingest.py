"""Ingest: from export files to validated Parquet."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import identity, schema, units
from chronolith.functions.vocabulary import CATEGORY, QUANTITY
from chronolith.sources import dispatch, sinks


def prepare(spark: SparkSession, path: str, subject_id: str, overrides: Mapping[str, str] | None = None, source_format: str | None = None) -> DataFrame:
    """Canonical rows of one input in canonical units."""
    kind = source_format or dispatch.source_format(path)
    return units.canonicalize(schema.conform(dispatch.READERS[kind](spark, path, subject_id, overrides)))


def parse(spark: SparkSession, root: str, out: str, identity_file: str) -> dict[str, str]:
    """All inputs under ``root``: ``path -> written`` or why not. Findings or a missing identity skip that input only."""
    done = {}
    for path in dispatch.find_inputs(root):
        key = str(path.relative_to(root))
        try:
            subject = identity.load_subject_id(identity_file, key)
            sinks.write_observations(prepare(spark, str(path), subject, identity.load_overrides(identity_file, key)), out)
            done[key] = "written"
        except (KeyError, sinks.FindingsError) as error:
            done[key] = str(error)
    return done


def scan(spark: SparkSession, root: str, stub_dir: str) -> dict[str, list[str]]:
    """Names that nothing classifies, by input, with stubs to fill in; files that exist are left alone."""
    inputs = dispatch.find_inputs(root)
    sinks.write_stub(Path(stub_dir) / "subjects.toml", "subjects", [str(p.relative_to(root)) for p in inputs])
    found = {}
    for p in inputs:
        names = dispatch.SOURCE_NAMES[dispatch.source_format(p)](spark, str(p))
        found[str(p.relative_to(root))] = sorted(r.source_name for r in identity.unmatched(names, "source_name").collect())
    return found


def from_events(events: DataFrame, subjects: int = 5) -> DataFrame:
    """An event stream as observations: views are steps, clicks distance, purchases resting heart rate, errors heart
    rate, and sign-ups intervals of sleep."""
    kind = F.col("event_type")
    metric = F.when(kind == "view", QUANTITY + "StepCount").when(kind == "click", QUANTITY + "DistanceWalkingRunning").when(kind == "purchase", QUANTITY + "RestingHeartRate").when(kind == "error", QUANTITY + "HeartRate").otherwise(CATEGORY + "SleepAnalysis")
    unit = F.when(kind == "view", "count").when(kind == "click", "m").when(kind.isin("purchase", "error"), "count/min")
    asleep = kind == "signup"
    stage = F.element_at(F.array(*[F.lit("HKCategoryValueSleepAnalysis" + s) for s in ("AsleepCore", "AsleepREM", "Awake", "InBed")]), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    end = F.when(asleep, F.col("ts") + F.make_dt_interval(secs=F.floor(F.col("value") * 60).cast("long"))).otherwise(F.col("ts"))
    source = F.element_at(F.array(*[F.lit(s) for s in ("wearable", "phone", "app")]), (F.pmod("event_id", F.lit(3)) + 1).cast("int"))
    rows = events.select(
        F.concat(F.lit("subject_"), F.pmod("user_id", F.lit(subjects)).cast("string")).alias("subject_id"), F.lit("flat_csv").alias("source_format"), metric.alias("metric"), unit.alias("unit"),
        F.when(~asleep, F.col("value")).alias("value_num"), F.when(asleep, stage).alias("value_str"), F.col("ts").cast("timestamp").alias("start_utc"), end.cast("timestamp").alias("end_utc"),
        F.lit(None).cast("timestamp").alias("created_utc"), F.col("ts").alias("start_local"), end.alias("end_local"), source.alias("source_type"),
    )
    return schema.conform(rows)
