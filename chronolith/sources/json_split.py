"""Elements of JSON arrays of any size, read in byte ranges.

Pieces end at a ``}``. A range that may begin inside a string or between tokens reports for both what it leaves open:
whether a string is, how many brackets it closes that were open before, and the names under which its own open brackets
stand. In order, these give every range its first state; then elements are cut out as text, and the few that several
ranges share are put together from their parts. Spark parses each element by itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.sources import split_scan

_STEP = np.zeros(256, np.int8)
_STEP[[0x7B, 0x5B]], _STEP[[0x7D, 0x5D]] = 1, -1
_BLANK = b" \t\r\n"


#: Stands for a name with a bracket in it that is cut where a range begins.
CUT = "\0"


class CutNameError(ValueError):
    """Such a name is needed to tell what holds an element."""


class Place(NamedTuple):
    """Where elements stand: in arrays under these names from the root's members down, below any name that is not left out.
    Without names: in the root itself, an array."""

    names: tuple[str, ...] = ()
    without: tuple[str, ...] = ()

    @property
    def depth(self) -> int:
        """Brackets that are open round an element."""
        return 1 if not self.names else 2 + len(self.names)

    def holds(self, stack: list[str | None]) -> bool:
        if self.names and CUT in stack[: self.depth]:
            raise CutNameError
        return len(stack) == self.depth and (not self.names or (stack[1] is not None and stack[1] not in self.without and tuple(stack[2:]) == self.names))


class Brackets:
    """The brackets of a stretch of text that begins outside or inside a string."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        b = np.frombuffer(data, np.uint8)
        quotes = np.flatnonzero(b == 0x22)
        slashes = np.flatnonzero(b == 0x5C)
        if len(slashes) and len(quotes):  # a quote behind an odd number of backslashes is none
            last = np.flatnonzero(np.append(np.diff(slashes) > 1, True))
            length = np.diff(np.append(-1, last))
            k = np.minimum(np.searchsorted(slashes[last], quotes - 1), len(last) - 1)
            quotes = quotes[(slashes[last][k] != quotes - 1) | (length[k] % 2 == 0)]
        self.quotes = quotes
        self.at = np.flatnonzero(_STEP[b])
        self.inside = np.searchsorted(quotes, self.at) & 1
        self.step = _STEP[b[self.at]]

    def outside(self, in_string: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places and steps (1 opens, -1 closes) of the brackets that count."""
        live = self.inside == int(in_string)
        return self.at[live], self.step[live].astype(np.int64)

    def name(self, at: int) -> str | None:
        """The name before an opening bracket, if it has one."""
        end = at - 1
        while end >= 0 and self.data[end] in _BLANK:
            end -= 1
        if end < 0 or self.data[end] != 0x3A:
            return None
        end -= 1
        while end >= 0 and self.data[end] in _BLANK:
            end -= 1
        k = int(np.searchsorted(self.quotes, end))
        if end < 0 or k == 0 or k == len(self.quotes) or self.quotes[k] != end:
            return CUT
        return json.loads(self.data[self.quotes[k - 1] : end + 1])


def _still_open(found: Brackets, at: np.ndarray, depth: np.ndarray, step: np.ndarray, begin: int) -> tuple[int, list[str | None]]:
    """How many brackets open before are closed, and the names of those that stay open; depths count from ``begin``."""
    if not len(at):
        return 0, []
    low, last = min(begin, int(depth.min())), int(depth[-1])
    names = [found.name(int(at[np.flatnonzero((depth == level) & (step > 0))[-1]])) for level in range(low + 1, last + 1)]
    return begin - low, names


def _data(batch: pa.RecordBatch) -> bytes:
    """A range's text again: every piece with the bracket that ended it (the end of a file gets one more)."""
    return b"}".join(batch.column("text").cast(pa.binary()).to_pylist()) + b"}"


_REPORT = "file string, block long, begins boolean, ends boolean, closed int, names array<string>"


def _reports(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, told = None, []

        def report() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.list_(pa.string())]
            rows = [(*key, begins, *now) for begins, now in zip((False, True), told, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _REPORT.split(", ")])

        for now, first, batch in split_scan.ranges(batches):
            if first:
                if key:
                    yield report()
                key, told = now, [(False, 0, []), (True, 0, [])]
            found = Brackets(_data(batch))
            for h, (in_string, closed, names) in enumerate(told):
                at, step = found.outside(in_string)
                shut, opened = _still_open(found, at, np.cumsum(step), step, 0)
                keep = max(0, len(names) - shut)
                told[h] = in_string ^ bool(len(found.quotes) & 1), closed + max(0, shut - len(names)), names[:keep] + opened
        if key:
            yield report()

    return rows.mapInArrow(run, _REPORT)


def _starts(rows: DataFrame, place: Place) -> list[tuple]:
    """(file, block, in a string, names of open brackets, the range where an open element began) of the ranges that begin
    inside something."""
    by_range: dict[tuple[str, int], dict] = {}
    for r in _reports(rows).collect():
        by_range.setdefault((r.file, r.block), {})[r.begins] = r

    def after(now: tuple[bool, list, int | None], r) -> tuple[bool, list, int | None]:
        told = by_range[r.file, r.block][now[0]]
        kept = now[1][: max(0, len(now[1]) - told.closed)]
        stack = kept + list(told.names)
        inside = len(stack) > place.depth and place.holds(stack[: place.depth])
        return told.ends, stack, (now[2] if len(kept) > place.depth else r.block) if inside else None

    states = split_scan.begun([x[False] for x in by_range.values()], (False, [], None), after)
    return [(*key, *state) for key, state in states.items() if state != (False, [], None)]


_START = "in_string boolean, names array<string>, began long"
_ELEMENT = "file string, name string, began long, block long, part long, text string"


def _cut(rows: DataFrame, place: Place, starts: list[tuple], whole: bool) -> DataFrame:
    """Whole elements, or the parts of those that several ranges share (``began``: the range where they begin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _elements(batches, place, whole):
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*piece, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].cast(pa.string())], [c.split()[0] for c in _ELEMENT.split(", ")])

    placed = split_scan.with_starts(rows, starts, _START)
    return placed.select("file", "block", "text", "in_string", "names", "began").mapInArrow(run, _ELEMENT)


def _elements(batches: Iterator[pa.RecordBatch], place: Place, whole: bool) -> Iterator[list[tuple]]:
    """Rows of ``_ELEMENT``. An element that a batch leaves open waits for the next one, if the range goes on."""
    key, in_string, stack, began, waiting, part = None, False, [], None, b"", 0
    for now, first, batch in split_scan.ranges(batches):
        out = []
        if first:
            if waiting and not whole:
                out.append((key[0], _named(stack, place), key[1] if began is None else began, key[1], part, waiting))
            key, waiting, part = now, b"", 0
            in_string, stack, began = bool(batch.column("in_string")[0].as_py()), batch.column("names")[0].as_py() or [], batch.column("began")[0].as_py()
        data = _data(batch)
        found = Brackets(data)
        at, step = found.outside(in_string)
        depth = len(stack) + np.cumsum(step)
        inside = began is not None or bool(waiting)  # an element is open as the batch begins
        begin = 0
        # What changes the names round elements, and elements' first and last brackets, in order.
        for i in np.flatnonzero((depth <= place.depth) | ((depth == place.depth + 1) & (step > 0))).tolist():
            p, d, opens = int(at[i]), int(depth[i]), step[i] > 0
            if opens and d == place.depth + 1:
                if place.holds(stack):
                    inside, begin = True, p
            elif not opens and d == place.depth:
                if inside:
                    text = data[begin : p + 1]
                    if began is not None:
                        if not whole:
                            out.append((key[0], _named(stack, place), began, key[1], part, text))
                    elif whole:
                        out.append((key[0], _named(stack, place), None, key[1], 0, waiting + text if waiting else text))
                    inside, began, waiting = False, None, b""
                stack = stack[:d]
            elif opens:
                stack = [*stack[: d - 1], found.name(p)]
            else:
                stack = stack[:d]
        if inside:
            if began is not None:
                if not whole:
                    out.append((key[0], _named(stack, place), began, key[1], part, data[begin:]))
                    part += 1
            else:
                waiting += data[begin:]
        last = int(depth[-1]) if len(depth) else len(stack)
        stack = stack[: place.depth] + [None] * max(0, last - min(len(stack), place.depth))
        in_string ^= bool(len(found.quotes) & 1)
        if out:
            yield out
    if waiting and not whole:
        yield [(key[0], _named(stack, place), key[1], key[1], part, waiting)]


def _named(stack: list[str | None], place: Place) -> str | None:
    return stack[1] if place.names and len(stack) > 1 else None


def one_range(spark: SparkSession, path: str) -> bool:
    """Whether Spark reads this file as one range."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
    conf = spark._jsparkSession.sessionState().conf()
    return not status.isDirectory() and status.getLen() <= min(conf.filesOpenCostInBytes(), conf.filesMaxPartitionBytes())


def elements(spark: SparkSession, path: str, place: Place = Place()) -> DataFrame:
    """``name, text`` of the objects and arrays that stand in arrays at ``place``; the name is that of the root's member."""
    rows = split_scan.pieces(spark, path, "}")
    if one_range(spark, path):
        return _cut(rows, place, [], True).select("name", "text")
    try:
        starts = _starts(rows, place)
    except CutNameError:  # rare enough to read each file by one task
        one = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("block"), F.lit(0).alias("seq"), F.col("value").alias("text"))
        return _cut(one, place, [], True).select("name", "text")
    shared = _cut(rows, place, starts, False).groupBy("file", "began").agg(F.max("name").alias("name"), F.sort_array(F.collect_list(F.struct("block", "part", "text"))).alias("parts"))
    joined = shared.select("name", F.array_join(F.col("parts.text"), "").alias("text"))
    return _cut(rows, place, starts, True).select("name", "text").unionByName(joined)
