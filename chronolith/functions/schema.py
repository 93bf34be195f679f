"""The canonical observation table: twelve columns, fixed order, closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The closed vocabularies, in sort order.
SOURCE_FORMATS = ("apple_xml", "flat_csv", "nested_json", "pmdata")
SOURCE_TYPES = ("wearable", "phone", "scale", "app", "manual", "derived", "unknown")

SCHEMA = T.StructType(
    [
        T.StructField("subject_id", T.StringType()),
        T.StructField("source_format", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("value_num", T.DoubleType()),
        T.StructField("value_str", T.StringType()),
        T.StructField("start_utc", T.TimestampType()),
        T.StructField("end_utc", T.TimestampType()),
        T.StructField("created_utc", T.TimestampType()),
        T.StructField("start_local", T.TimestampNTZType()),
        T.StructField("end_local", T.TimestampNTZType()),
        T.StructField("source_type", T.StringType()),
    ]
)
COLUMNS = SCHEMA.names
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|infinity|nan)$"


class SchemaError(ValueError):
    """The input's columns are not the canonical ones."""


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def conform(df: DataFrame) -> DataFrame:
    """The canonical columns in order, cast; an error names missing and surplus columns."""
    missing, surplus = sorted(set(COLUMNS) - set(df.columns)), sorted(set(df.columns) - set(COLUMNS))
    if missing or surplus:
        raise SchemaError(f"missing columns {missing}, surplus columns {surplus}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMA])


def strip(x: Column) -> Column:
    """Unicode white space off both ends (``trim`` knows the space character only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def split_value(x: Column) -> tuple[Column, Column]:
    """A recorded value as (number, text): exactly one is set, neither for a blank."""
    text = strip(x)
    number = F.when(F.lower(text).rlike(NUMBER), text.try_cast("double"))
    word = F.when((F.length(text) > 0) & number.isNull(), text)
    return number, word


def format_order(x: Column) -> Column:
    """Sort key of a source format."""
    return F.array_position(F.array(*[F.lit(v) for v in SOURCE_FORMATS]), x)
