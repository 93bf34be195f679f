"""Mixing sources to target weights along a curriculum, with DataFrame functions only.

Every source has a weight schedule w(t), linear between knots, for training time t in [0, 1]. The integral of w is the
source's weight; the token budget is shared by these weights, no source above ``max_repeats`` times its size, the excess
reshared until none is above (water filling, closed form). A source's documents stand in a fixed hashed order and are
read cyclically; the demand for its tokens up to time t is target * integral(w, 0..t) / integral(w, 0..1), and a copy of
a document that starts at cumulative token c is placed at the t where that demand reaches c.

Running sums never gather a source in one task: documents are summed in hash buckets of about ``BUCKET`` rows, buckets in
groups of ``FAN``, and only the group totals are summed per source.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import materialize, prepare

#: Knots (t, weight) of one schedule, t from 0 to 1.
Schedule = Sequence[tuple[float, float]]

#: The production curriculum: weights 5, 2 and 1 by source in turn; heavy sources fade, light ones grow.
CURRICULUM: tuple[Schedule, ...] = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 1.0), (1.0, 3.0)), ((0.0, 0.5), (1.0, 1.5)))
BUDGET = 1.5
MAX_REPEATS = 2
BUCKET = 512
FAN = 1024
WORD = r"[^\x20\x09-\x0D]+"


def area(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def inverse(schedule: Schedule, share: Column) -> Column:
    """The time at which a schedule's integral reaches ``share`` (0 to 1) of its whole."""
    whole, done, out = area(schedule), 0.0, F.lit(None).cast("double")
    need = share * F.lit(whole)
    steps = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        rest = F.greatest(need - F.lit(done), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        root = F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + rest * F.lit(2 * slope), F.lit(0.0)))
        steps.append((done, F.lit(t0) + F.when(root > 0, rest * F.lit(2.0) / root).otherwise(F.lit(0.0))))
        done += (t1 - t0) * (w0 + w1) / 2
    for start, time in steps:
        out = F.when(need >= F.lit(start), time).otherwise(out)
    return F.least(out, F.lit(1.0))


def _clean(docs: DataFrame, carry: Sequence[str] | None) -> DataFrame:
    """``row`` (the columns to carry) beside the columns the mix works on; no clash with columns of the input."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select(
        F.struct(*(carry or docs.columns)).alias("row"),
        F.col("doc_id").alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order.alias("order"),
    )


def targets(sizes: DataFrame, schedules: Sequence[Schedule], budget: float, max_repeats: int) -> DataFrame:
    """``src, source_size, target, turn`` from ``src, source_size``: one row a source, a small table."""
    ordered = Window.orderBy((F.col("src") == "").cast("int"), "src")
    turn = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(schedules)))
    weight = F.element_at(F.array(*[F.lit(float(round(area(s), 9))) for s in schedules]), F.col("turn") + 1)
    every = Window.partitionBy(F.lit(1))
    filled = every.orderBy(F.col("cap") / F.col("weight"), "src")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") * F.lit(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        sizes.withColumn("turn", turn)
        .withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(max_repeats))})
        .withColumns({"total": F.sum("source_size").over(every), "weights": F.sum("weight").over(every)})
        .withColumn("level", level)
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("src"), F.col("level")))).over(every)["level"])
        .select("src", "turn", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def mix(docs: DataFrame, schedules: Sequence[Schedule] = CURRICULUM, budget: float = BUDGET, max_repeats: int = MAX_REPEATS, carry: Sequence[str] | None = None) -> DataFrame:
    """``row`` (the input's columns as a struct, or only those of ``carry``: then no text is shuffled), ``size``, ``source_size``, ``target``, ``taken``, ``copies``, ``position``.

    One row per input row. ``taken`` counts the words of the row that the mix takes, repeats included; the copies are
    whole but for the one at which a source's target is reached. ``position`` is the time (0 to 1) at which the first
    copy begins, null if none is taken; a further copy k begins at ``copy_position``.

    Null or empty texts have size 0 and are never taken; a null source is a source of its own, the last in turn; equal
    ids in a source are ordered by size, so repeated rows share what their run is given; an empty table gives no rows.
    """
    placed = _placed(docs, schedules, budget, max_repeats, carry)
    return placed.orderBy(F.coalesce("position", F.lit(2.0)), "order").drop("src", "turn", "before", "id", "order", "bucket", "super")


def _placed(docs: DataFrame, schedules: Sequence[Schedule], budget: float, max_repeats: int, carry: Sequence[str] | None = None) -> DataFrame:
    prepare(docs.sparkSession)
    rows = _clean(docs, carry)
    narrow = materialize(rows if carry else rows.select("src", "size", "order"), "mix-sizes")
    rows = narrow if carry else rows
    buckets = max(1, math.ceil(narrow.count() / BUCKET))
    bucket = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2.0**32)).cast("long")
    level1 = (
        narrow.withColumn("bucket", bucket)
        .groupBy("src", "bucket")
        .agg(F.sum("size").alias("b_size"))
        .withColumn("super", F.floor(F.col("bucket") / FAN))
    )
    prefix = Window.partitionBy("src", "super").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    level1 = materialize(level1.withColumn("in_super", F.coalesce(F.sum("b_size").over(prefix), F.lit(0))), "mix-buckets")
    level2 = level1.groupBy("src", "super").agg(F.sum("b_size").alias("s_size"))
    prefix = Window.partitionBy("src").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    level2 = level2.withColumn("to_super", F.coalesce(F.sum("s_size").over(prefix), F.lit(0))).drop("s_size")
    sources = targets(level1.groupBy("src").agg(F.sum("b_size").alias("source_size")), schedules, budget, max_repeats)
    starts = level1.join(level2, ["src", "super"]).join(sources, "src").select("src", "bucket", "turn", "source_size", "target", (F.col("in_super") + F.col("to_super")).alias("to_bucket"))
    inside = Window.partitionBy("src", "bucket").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("to_bucket") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    whole = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.greatest(F.least(whole - epochs * F.col("source_size") - F.col("before"), F.col("size")), F.lit(0).cast("long"))
    return (
        rows.withColumn("bucket", bucket)
        .join(starts, ["src", "bucket"])
        .withColumn("before", before)
        .withColumns({"rest": rest, "epochs": epochs})
        .withColumns({"taken": F.col("epochs") * F.col("size") + F.col("rest"), "copies": F.when(F.col("size") > 0, F.col("epochs") + (F.col("rest") > 0).cast("long")).otherwise(0).cast("long")})
        .withColumn("position", F.when(F.col("copies") > 0, copy_position(schedules, F.lit(0))))
        .drop("rest", "epochs", "to_bucket")
    )


def copy_position(schedules: Sequence[Schedule], copy: Column) -> Column:
    """When copy number ``copy`` (from 0) of a placed row begins."""
    share = (copy * F.col("source_size") + F.col("before")) / F.col("target")
    out = F.lit(None).cast("double")
    for k, s in enumerate(schedules):
        out = F.when(F.col("turn") == k, inverse(s, share)).otherwise(out)
    return out


def mixed_documents(docs: DataFrame, schedules: Sequence[Schedule] = CURRICULUM, budget: float = BUDGET, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The training order itself: the input's columns, one row per copy taken, range-sorted by position.

    The copy at which a source's target is reached stays whole, so a source exceeds its target by one text at most.
    """
    copies = _placed(docs, schedules, budget, max_repeats).filter("copies > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    placed = copies.select("row", copy_position(schedules, F.col("copy")).alias("at"), "order")
    return placed.orderBy("at", "order").select("row.*")
