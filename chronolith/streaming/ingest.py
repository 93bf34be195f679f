"""Observations as a stream: validated appends by micro-batch, and windowed rollups with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronolith.functions import schema
from chronolith.sources import sinks


def stream(spark: SparkSession, path: str) -> DataFrame:
    """Canonical Parquet files as they arrive."""
    return spark.readStream.schema(schema.SCHEMA).parquet(path)


def gated_append(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append every micro-batch that validates; a batch with findings stops the stream before it is written."""

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        findings = [(r.check, r.detail) for r in sinks.validate.check(batch).collect()]
        if findings:
            raise sinks.FindingsError(findings)
        batch.write.mode("append").partitionBy("subject_id", "source_format").parquet(out)
        batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollup(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """Daily sums, means and counts by subject and metric; a day closes ``late`` after it ended."""
    day = F.window("start_utc", "1 day")
    values = rows.filter("value_num IS NOT NULL").withWatermark("start_utc", late)
    return values.groupBy("subject_id", "metric", day).agg(F.sum("value_num").alias("total"), F.avg("value_num").alias("mean"), F.count("*").alias("n")).select("subject_id", "metric", F.to_date("window.start").alias("date"), "total", "mean", "n")
