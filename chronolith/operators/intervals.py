"""Interval union and runs of consecutive days, by window functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(df: DataFrame, keys: Sequence[str], start: str = "start_local", end: str = "end_local") -> DataFrame:
    """Overlapping and touching intervals of a key as one: keys, ``start``, ``end``. Rows without both ends are left out.

    Intervals are merged by the day they start on first, so no key meets in one task. How far a key's days reach, a row a
    day, tells which of a day's merged intervals go on from an earlier day: those that start before its reach ends.
    """
    whole = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("__day", F.to_date(start))
    day = [*keys, "__day"]
    ordered = Window.partitionBy(*day).orderBy(start, end)
    reach = F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    flagged = whole.withColumn("__new", F.when(F.col(start) > reach, 1).when(reach.isNull(), 1).otherwise(0))
    island = F.sum("__new").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    local = flagged.withColumn("__island", island).groupBy(*day, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")

    before = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = local.groupBy(*day).agg(F.max(end).alias("__end"), F.max(start).alias("__start")).withColumn("__reach", F.max("__end").over(before))
    fresh = F.when(F.col("__reach").isNull() | (F.col("__start") > F.col("__reach")), F.col("__start"))  # the day's last new start
    days = days.withColumn("__last", F.last(fresh, ignorenulls=True).over(before)).select(*[F.col(k).alias(f"__k_{k}") for k in day], "__reach", "__last")
    same = F.lit(True)
    for k in day:
        same = same & local[k].eqNullSafe(days[f"__k_{k}"])
    first = F.when(F.col(start) <= F.col("__reach"), F.col("__last")).otherwise(F.col(start))
    return local.join(days, same).groupBy(*keys, first.alias("__first")).agg(F.max(end).alias(end)).select(*keys, F.col("__first").alias(start), end)


def seconds(start: Column, end: Column) -> Column:
    """Length in seconds, with fractions."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def covered(df: DataFrame, keys: Sequence[str], start: str = "start_local", end: str = "end_local") -> DataFrame:
    """Seconds that a key's intervals cover."""
    return merged(df, keys, start, end).groupBy(*keys).agg(F.sum(seconds(F.col(start), F.col(end))).alias("seconds"))


def night_seconds(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Covered seconds by night: a merged interval counts whole for the date twelve hours before its start."""
    night = F.to_date(F.col("start_local") - F.expr("INTERVAL 12 HOURS"))
    return merged(df, keys).withColumn("date", night).groupBy(*keys, "date").agg(F.sum(seconds(F.col("start_local"), F.col("end_local"))).alias("seconds"))


def day_runs(df: DataFrame, keys: Sequence[str], day: str = "date") -> DataFrame:
    """Runs of consecutive days by key: ``first, last, days``. A day that comes twice counts once."""
    ordered = Window.partitionBy(*keys).orderBy(day)
    days = df.select(*keys, day).filter(F.col(day).isNotNull()).distinct()
    gap = F.coalesce((F.datediff(day, F.lag(day).over(ordered)) > 1).cast("int"), F.lit(1))
    runs = days.withColumn("__gap", gap).withColumn("__run", F.sum("__gap").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "__run").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("days")).drop("__run")


def longest_run(df: DataFrame, keys: Sequence[str], day: str = "date") -> DataFrame:
    return day_runs(df, keys, day).groupBy(*keys).agg(F.max("days").alias("longest"))
