"""What the readers share: the last step to canonical rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions import identity, schema


def finish(df: DataFrame, subject_id: str, source_format: str, stamps: Mapping[str, tuple[Column, Column]], overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Canonical rows from ``metric, unit, value, source_name`` and (instant, wall clock) pairs for start, end, created."""
    number, word = schema.split_value(F.col("value"))
    start, end = stamps["start"], stamps["end"]
    created = stamps.get("created", (F.lit(None), F.lit(None)))[0]
    rows = df.select(
        F.lit(subject_id).alias("subject_id"), F.lit(source_format).alias("source_format"), "metric", "unit", number.alias("value_num"), word.alias("value_str"),
        start[0].alias("start_utc"), end[0].alias("end_utc"), created.cast("timestamp").alias("created_utc"), start[1].alias("start_local"), end[1].alias("end_local"), "source_name",
    )
    return schema.conform(identity.classified(rows, "source_name", overrides))
