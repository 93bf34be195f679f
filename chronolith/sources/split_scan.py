"""Large text files read by many tasks: pieces between marks, and the state in which each byte range begins.

Spark cuts a file into byte ranges and a range into pieces that end at a mark. What a piece means depends on what came
before (a comment, a string, open brackets). So every range first reports what it makes of each state that it may begin
in; the reports of a file are put together in order, which gives every range the state it does begin in; then the ranges
are read once more on their own. The reports are a row a range, as many as Spark's own driver lists to schedule them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranges with an unusual first state that are broadcast; with more, pieces are joined with them and put in order again.
BROADCAST_RANGES = 20_000


def pieces(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """``file, block, seq, text``: the pieces of every file between marks, the range they begin in, their order in it."""
    text = spark.read.option("lineSep", mark).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("text"))


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, pa.RecordBatch]]:
    """The batches of a task cut where a range ends: ((file, block), whether it is the range's first batch, rows)."""
    now = None
    for batch in batches:
        files, blocks = batch.column("file"), batch.column("block").to_pylist()
        at = 0
        for i in range(1, len(blocks) + 1):
            if i == len(blocks) or blocks[i] != blocks[at] or files[i] != files[at]:
                if len(blocks):
                    key = files[at].as_py(), blocks[at]
                    yield key, key != now, batch.slice(at, i - at)
                    now, at = key, i


def begun(reports: list[Any], initial: Any, after: Callable[[Any, Any], Any]) -> dict[tuple[str, int], Any]:
    """The state in which each range begins, from reports (rows with ``file`` and ``block``)."""
    out, state, file = {}, initial, None
    for r in sorted(reports, key=lambda r: (r.file, r.block)):
        if r.file != file:
            state, file = initial, r.file
        out[r.file, r.block] = state
        state = after(state, r)
    return out


def with_starts(rows: DataFrame, starts: list[tuple], ddl: str) -> DataFrame:
    """``rows`` (``file, block, seq, ...``) with the columns of ``starts`` (file, block, ...; unusual ranges only), a
    range's rows in order still."""
    found = rows.sparkSession.createDataFrame(starts, f"file string, block long, {ddl}")
    if len(starts) <= BROADCAST_RANGES:
        return rows.join(F.broadcast(found), ["file", "block"], "left")  # rows stay where they are
    return rows.join(found, ["file", "block"], "left").repartition("file", "block").sortWithinPartitions("file", "block", "seq")
