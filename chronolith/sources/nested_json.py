"""The nested JSON export: sections by metric, records inside. Records are cut out one by one, by many tasks where a file is
large, so that an odd section spoils no other."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import timestamps, vocabulary
from chronolith.sources import json_split
from chronolith.sources.common import finish

FIELDS = ("type", "source_name", "unit", "value", "creation_date", "start_date", "end_date")
_RECORD = ", ".join(f"{f} string" for f in FIELDS)
PLACE = json_split.Place(("records", "data"), without=("metadata",))


def parsed(texts: DataFrame) -> DataFrame:
    """The fields of records given as ``text``."""
    return texts.select(F.from_json("text", _RECORD).alias("r")).select("r.*")


def records(spark: SparkSession, path: str) -> DataFrame:
    return parsed(json_split.elements(spark, path, PLACE))


def shaped(rows: DataFrame, subject_id: str, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Canonical rows of parsed records; sleep summed to hours has a metric of its own."""
    kind = F.col("type")
    daily = kind.contains("SleepAnalysis") & (F.lower("unit") == "hours")
    metric = F.when(daily, "SleepDurationDaily").otherwise(vocabulary.restore_prefix(kind))
    stamps = {k: timestamps.iso(F.regexp_replace(F.col(c), r"^(\d{4}-\d\d-\d\d) ", "$1T")) for k, c in (("start", "start_date"), ("end", "end_date"), ("created", "creation_date"))}
    named = rows.withColumn("metric", metric).withColumn("value", vocabulary.restore_value_prefix(F.col("metric"), F.col("value")))
    return finish(named, subject_id, "nested_json", stamps, overrides)


def read(spark: SparkSession, path: str, subject_id: str, overrides: Mapping[str, str] | None = None) -> DataFrame:
    return shaped(records(spark, path), subject_id, overrides)


def source_names(spark: SparkSession, path: str) -> DataFrame:
    return records(spark, path).select("source_name").filter("source_name IS NOT NULL").distinct()
