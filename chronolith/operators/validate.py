"""Checks before a write: one pass for counts, distinct values for the rest. Findings are rows (check, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions import schema, vocabulary

SUBJECT = r"^subject_[0-9a-z_]+$"
POSSESSIVE = r"['’]s\b"
REQUIRED = ("subject_id", "source_format", "metric", "source_type")
BOUNDED = ("subject_id", "metric", "unit", "value_str", "source_type")
TEXT = ("subject_id", "source_format", "metric", "unit", "value_str", "source_type")
MOST = 500
FINDING = "check string, detail string"


def measures() -> list[Column]:
    """Aggregates of rows with both values, with neither, and nulls in required columns."""
    both = F.col("value_num").isNotNull() & F.col("value_str").isNotNull()
    neither = F.col("value_num").isNull() & F.col("value_str").isNull()
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return [count(both).alias("both_values"), count(neither).alias("no_value"), *[count(F.col(c).isNull()).alias(f"null_{c}") for c in REQUIRED]]


def value_counts(df: DataFrame) -> DataFrame:
    """``measures`` as one row."""
    return df.agg(*measures())


def unknown_metrics(df: DataFrame) -> DataFrame:
    """Distinct metrics that are neither prefixed nor registered."""
    return df.select("metric").distinct().filter(~F.col("metric").startswith("HK") & ~F.col("metric").isin(*vocabulary.REGISTERED))


def bare_values(df: DataFrame) -> DataFrame:
    """Distinct category values without their prefix."""
    return df.select("value_str").distinct().filter(~F.col("value_str").startswith(vocabulary.VALUE))


def possessives(df: DataFrame, columns: tuple[str, ...] = TEXT) -> DataFrame:
    """Distinct texts that look like a person's device: ``column, text``."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "text")
    return long.filter(F.col("text").rlike(POSSESSIVE)).distinct()


def crowded(df: DataFrame) -> DataFrame:
    """Columns of closed vocabularies with too many distinct values."""
    counts = df.agg(*[F.countDistinct(c).alias(c) for c in BOUNDED]).unpivot([], list(BOUNDED), "column", "n")
    return counts.filter(F.col("n") > MOST)


def check(df: DataFrame, counted: dict[str, int] | None = None) -> DataFrame:
    """All findings. Wrong columns are the only finding where they are wrong. ``counted``: the ``measures``, if known."""
    spark = df.sparkSession
    if df.columns != schema.COLUMNS:
        return spark.createDataFrame([("schema", f"columns are {df.columns}")], FINDING)
    counts = value_counts(df) if counted is None else spark.createDataFrame([tuple(counted.values())], ", ".join(f"{c} long" for c in counted))
    counted = counts.unpivot([], counts.columns, "check", "n").filter("n > 0").select("check", F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"))
    named = lambda d, name, c: d.select(F.lit(name).alias("check"), F.col(c).alias("detail"))
    parts = [
        named(unknown_metrics(df), "metric", "metric"),
        named(bare_values(df).orderBy("value_str").limit(5), "value_str", "value_str"),
        named(df.select("source_type").distinct().filter(~F.col("source_type").isin(*schema.SOURCE_TYPES)), "source_type", "source_type"),
        named(df.select("source_format").distinct().filter(~F.col("source_format").isin(*schema.SOURCE_FORMATS)), "source_format", "source_format"),
        named(df.select("subject_id").distinct().filter(~F.col("subject_id").rlike(SUBJECT)), "subject_id", "subject_id"),
        named(possessives(df), "possessive", "column"),
        named(crowded(df), "cardinality", "column"),
    ]
    out = counted
    for p in parts:
        out = out.unionByName(p)
    return out
