"""The XML export: ``Record`` elements, without those repeated inside ``Correlation``.

A file is read in byte ranges whose pieces end before a ``<``, so each piece is one tag and the text behind it, whatever
its attributes hold; only comments, character data, instructions and the document type may hold a ``<`` of their own.
A range reports the state it ends in and how far correlations are open; records are cut out once these are known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import timestamps, vocabulary
from chronolith.sources import split_scan
from chronolith.sources.common import finish

FIELDS = ("type", "sourceName", "unit", "value", "creationDate", "startDate", "endDate")
#: What a piece may stand in, and the text that ends it.
STATES = {"text": None, "comment": "-->", "cdata": "]]>", "instruction": "?>", "doctype": None, "doctype comment": "-->", "doctype instruction": "?>"}
_OPENERS = (("!--", "comment"), ("![CDATA[", "cdata"), ("?", "instruction"))
_LITERAL = re.compile(r"\"[^\"]*\"|'[^']*'")
_SUBSET_END = re.compile(r"\]\s*>")
_ATTRIBUTE = re.compile(r"\s*([^\s=/>]+)\s*=\s*(\"[^\"]*\"|'[^']*')")
_TAG_END = re.compile(r"\s*/?>")


class EmptyExportError(ValueError):
    """The export holds no records."""


class MalformedExportError(ValueError):
    """A tag or document type that no rule of XML, or none that is read here, allows."""


def _in_doctype(rest: str) -> str:
    bare = _LITERAL.sub("", rest)
    if '"' in bare or "'" in bare:
        raise MalformedExportError(f"a literal with markup in the document type: {rest[:80]!r}")
    return "text" if _SUBSET_END.search(bare) else "doctype"


def after(state: str, piece: str) -> str:
    """The state behind a piece that begins in ``state``."""
    if state == "text" or state == "doctype":
        prefix = "" if state == "text" else "doctype "
        for opener, inner in _OPENERS:
            if piece.startswith(opener) and prefix + inner in STATES:
                return _closed(prefix + inner, piece[len(opener) :])
        if state == "doctype":
            return _in_doctype(piece)
        if not piece.startswith("!DOCTYPE"):
            return "text"
        bare = _LITERAL.sub("", piece)
        return "text" if ">" in bare and "[" not in bare.split(">", 1)[0] else _in_doctype(piece)
    return _closed(state, piece)


def _closed(state: str, rest: str) -> str:
    """The state behind the rest of a piece inside ``state``."""
    at = rest.find(STATES[state])
    if at < 0:
        return state
    return _in_doctype(rest[at:].lstrip("->?")) if state.startswith("doctype") else "text"


def attributes(piece: str) -> dict[str, str]:
    """The attributes of the tag that a piece begins with, references resolved, white space as spaces."""
    parts = piece.split('"')
    found, name = {}, len(re.match(r"[^\s/>]*", piece).group())
    parts[0] = parts[0][name:]
    for i in range(0, len(parts), 2):
        between = parts[i].strip()
        if "'" in between:
            return _any_quotes(piece, name)
        if ">" in between and between.split(">", 1)[0].strip() in ("", "/"):
            break
        if ">" in between or not between.endswith("=") or i + 1 == len(parts):
            raise MalformedExportError(piece[:200])
        found[between[:-1].rstrip()] = parts[i + 1]
    return {k: _plain(v) for k, v in found.items()}


def _any_quotes(piece: str, at: int) -> dict[str, str]:
    found = {}
    while not _TAG_END.match(piece, at):
        m = _ATTRIBUTE.match(piece, at)
        if m is None:
            raise MalformedExportError(piece[:200])
        found[m[1]], at = _plain(m[2][1:-1]), m.end()
    return found


def _plain(value: str) -> str:
    if "\n" in value or "\t" in value or "\r" in value:
        value = re.sub(r"\r\n|[\r\n\t]", " ", value)
    return unescape(value) if "&" in value else value


def _alone(piece: str) -> bool:
    """Whether the tag that a piece begins with has no content."""
    return _LITERAL.sub("", piece).split(">", 1)[0].endswith("/")


def _marked(spark: SparkSession, path: str) -> DataFrame:
    """The pieces that matter: ``record`` (one of the tags wanted), ``turn`` (it may change the state or the depth)."""
    text = F.col("text")
    named = lambda name: F.startswith(text, F.lit(name))
    turn = named("Correlation") | named("/Correlation") | named("!") | named("?")
    for mark in ("-->", "]]>", "?>"):
        turn = turn | F.contains(text, F.lit(mark))
    turn = turn | (F.contains(text, F.lit("]")) & text.rlike(r"\]\s*>"))
    rows = split_scan.pieces(spark, path, "<").select("*", text.rlike(r"^Record[\s/>]").alias("record"), turn.alias("turn"))
    return rows.filter("record OR turn")


class Walk:
    """A walk over the marked pieces of a range from a given state and number of open correlations."""

    def __init__(self, state: str, depth: int) -> None:
        self.state, self.depth = state, depth

    def over(self, record: np.ndarray, turn: np.ndarray, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(first, last + 1, depth) of runs of pieces that are tags; keeps the state for the next batch."""
        at = 0
        for i in np.flatnonzero(turn).tolist():
            if self.state == "text" and i > at:
                yield at, i, self.depth
            piece = texts[i].as_py()
            if self.state == "text":
                if piece.startswith("Correlation"):
                    self.depth += re.match(r"Correlation[\s>]", piece) is not None and not _alone(piece)
                elif piece.startswith("/Correlation"):
                    self.depth -= re.match(r"/Correlation\s*>", piece) is not None
                elif record[i]:
                    yield i, i + 1, self.depth
            self.state = after(self.state, piece)
            at = i + 1
        if self.state == "text" and len(record) > at:
            yield at, len(record), self.depth


_REPORT = "file string, block long, state string, ends string, opened int, depths array<int>, counts array<long>"


def _reports(rows: DataFrame) -> DataFrame:
    """What every range makes of every state: the state it ends in, correlations opened less closed, and records by how
    many are open then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None

        def told() -> pa.RecordBatch:
            (file, block), walks, counts = held
            rows = [(file, block, s, w.state, w.depth, list(counts[s]), list(counts[s].values())) for s, w in walks.items() if w is not None]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _REPORT.split(", ")])

        for key, first, batch in split_scan.ranges(batches):
            if first:
                if held:
                    yield told()
                held = key, {s: Walk(s, 0) for s in STATES}, {s: {} for s in STATES}
            record, turn = (np.asarray(batch.column(c)) for c in ("record", "turn"))
            total = np.concatenate([[0], np.cumsum(record)])
            for s, walk in held[1].items():
                if walk is None:
                    continue
                try:
                    for a, b, depth in walk.over(record, turn, batch.column("text")):
                        if total[b] > total[a]:
                            held[2][s][depth] = held[2][s].get(depth, 0) + int(total[b] - total[a])
                except MalformedExportError:
                    held[1][s] = None  # the range can't begin so; if it does, there is no report
        if held:
            yield told()

    return rows.select("file", "block", "record", "turn", F.when(F.col("turn"), F.col("text")).alias("text")).mapInArrow(run, _REPORT)


def _starts(rows: DataFrame) -> tuple[list[tuple], int]:
    """The ranges that begin inside something, and the number of records outside correlations."""
    by_range: dict[tuple[str, int], dict] = {}
    for r in _reports(rows).collect():
        by_range.setdefault((r.file, r.block), {})[r.state] = r
    states = split_scan.begun([next(iter(x.values())) for x in by_range.values()], ("text", 0), lambda now, r: _follow(now, by_range[r.file, r.block]))
    total = 0
    for key, (state, depth) in states.items():
        r = _of(by_range[key], state)
        total += sum(n for d, n in zip(r.depths, r.counts, strict=True) if d + depth == 0)
    return [(*key, *state) for key, state in states.items() if state != ("text", 0)], total


def _of(reports: dict, state: str):
    if state not in reports:
        raise MalformedExportError(f"{next(iter(reports.values())).file}: markup inside {state}")
    return reports[state]


def _follow(now: tuple[str, int], reports: dict) -> tuple[str, int]:
    r = _of(reports, now[0])
    return r.ends, now[1] + r.opened


def _cut(rows: DataFrame, starts: list[tuple]) -> DataFrame:
    """The attributes of the records outside correlations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for _, first, batch in split_scan.ranges(batches):
            if first:
                walk = Walk(batch.column("state")[0].as_py() or "text", batch.column("depth")[0].as_py() or 0)
            record, turn, texts = np.asarray(batch.column("record")), np.asarray(batch.column("turn")), batch.column("text")
            wanted = [i for a, b, depth in walk.over(record, turn, texts) if depth == 0 for i in (np.flatnonzero(record[a:b]) + a).tolist()]
            found = [attributes(x) for x in texts.take(pa.array(wanted, pa.int64())).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.get(f) for x in found], pa.string()) for f in FIELDS], list(FIELDS))

    placed = split_scan.with_starts(rows, starts, "state string, depth int")
    return placed.select("file", "block", "record", "turn", "text", "state", "depth").mapInArrow(run, ", ".join(f"{f} string" for f in FIELDS))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records outside correlations as text columns."""
    rows = _marked(spark, path)
    return _cut(rows, _starts(rows)[0])


def read(spark: SparkSession, path: str, subject_id: str, overrides: Mapping[str, str] | None = None, source_format: str = "apple_xml") -> DataFrame:
    rows = _marked(spark, path)
    starts, count = _starts(rows)
    if not count:
        raise EmptyExportError(path)
    metric = vocabulary.restore_prefix(F.col("type"))
    stamps = {k: timestamps.spaced(F.col(c)) for k, c in (("start", "startDate"), ("end", "endDate"), ("created", "creationDate"))}
    return finish(_cut(rows, starts).select("*", metric.alias("metric"), F.col("sourceName").alias("source_name")), subject_id, source_format, stamps, overrides)


def source_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct source names of records, workouts and correlations: one pass that looks at nothing else, so that a name in
    a comment counts too."""
    piece = split_scan.pieces(spark, path, "<").filter(F.col("text").rlike(r"^(Record|Workout|Correlation)\s"))
    tags = piece.select(F.regexp_extract("text", r"""\ssourceName\s*=\s*("[^"]*"|'[^']*')""", 1).alias("quoted")).filter("quoted <> ''").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_plain(x[1:-1]) for x in batch.column("quoted").to_pylist()], pa.string())], ["source_name"])

    return tags.mapInArrow(run, "source_name string").distinct()
