"""The flat CSV export: text columns, 12-hour clocks, header lines repeated in the middle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import timestamps, vocabulary
from chronolith.sources.common import finish

_STAMP = ("Date", "Time", "Time_am_pm", "TimeZone")
REQUIRED = ("type", "sourceName", "unit", "value", *(f"m_start{x}" for x in _STAMP), *(f"m_end{x}" for x in _STAMP), "m_creationDate", "m_creationTime")


class MissingColumnsError(ValueError):
    """The file lacks columns that the reader needs."""


def rows(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, inferSchema=False)
    missing = sorted(set(REQUIRED) - set(df.columns))
    if missing:
        raise MissingColumnsError(f"{path}: {missing}")
    return df.filter("type <> 'type'")


def read(spark: SparkSession, path: str, subject_id: str, overrides: Mapping[str, str] | None = None) -> DataFrame:
    df = rows(spark, path)
    metric = vocabulary.restore_prefix(F.trim("type"))
    value = vocabulary.restore_value_prefix(metric, F.col("value"))
    absent = F.lit(None).cast("string")
    stamps = {
        k: timestamps.split_12h(*[F.col(f"m_{k if k != 'created' else 'creation'}{x}") if f"m_{k if k != 'created' else 'creation'}{x}" in df.columns else absent for x in _STAMP])
        for k in ("start", "end", "created")
    }
    shaped = df.withColumns({"metric": metric, "value": value, "source_name": F.col("sourceName")})
    return finish(shaped, subject_id, "flat_csv", stamps, overrides)


def source_names(spark: SparkSession, path: str) -> DataFrame:
    return rows(spark, path).select(F.col("sourceName").alias("source_name")).filter("source_name IS NOT NULL").distinct()
