"""Quotation linking: who answers whom, from the passages that messages quote, and the messages without their quotes.

A line's quote level is the number of ``>`` before it. Lines of one level form passages (a run of lines of that level, its
paragraphs, lines and sentences). Passages of every level and the messages' own are normalised (lower case, one space) and
hashed. A quoted passage is joined to the first message of the same conversation that wrote it, else, if it is not short,
to the first of any conversation; a message answers the one it quotes most of at the shallowest level that is known. Both sides of the joins hold one row for each distinct
passage, so a passage that everybody writes makes no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import lean, materialize, prepare, slices
from chronolith.llm.components import components

#: Normalised characters that a passage needs to link messages of two conversations.
LEAST_CHARS = 12
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])\s*")
_LEVEL = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")
#: Lines that announce a quotation, in four languages.
_HEADER = re.compile(r"^\s*(?:on\b.{0,200}\bwrote|le\b.{0,200}\ba écrit|am\b.{0,200}\bschrieb.{0,80}|el\b.{0,200}\bescribió)\s*:\s*$", re.I)
TEMPLATE = "<|{role}|>\n{text}\n"


def levels(text: str) -> list[tuple[int, str]]:
    """Lines with their quote level."""
    out = []
    for line in text.split("\n"):
        m = _LEVEL.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return out


def normal(lines: list[str]) -> str:
    return " ".join(" ".join(lines).split()).lower()


def _hash(text: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "replace")), "big", signed=True)


def paragraphs(lines: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for line in lines:
        if line.strip():
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return [p for p in out if p]


def _passages(run: list[str]) -> Iterator[str]:
    if run:
        yield normal(run)
        for p in paragraphs(run):
            whole = normal(p)
            yield whole
            yield from (normal([line]) for line in p)
            yield from _SENTENCE.split(whole)


def parts(text: str) -> tuple[str, int, int, dict[int, int], dict[int, tuple[int, int]]]:
    """Own text, deepest quote level, quoted lines, the hashes of own passages with lengths, and those of quoted passages
    with lengths and their shallowest level."""
    lines = levels(text)
    quoted_any = any(k for k, _ in lines)
    own = []
    follows = 0  # the level of the next line that is quoted or not blank
    for k, line in reversed(lines):
        if k == 0 and not (quoted_any and follows and _HEADER.match(line)):
            own.append(line)
        if k or line.strip():
            follows = k
    own.reverse()
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n") if quoted_any else text
    mine = {_hash(p): len(p) for p in _passages(own) if p}
    theirs: dict[int, tuple[int, int]] = {}
    run: list[str] = []
    level = 0
    for k, line in [*lines, (0, "")]:
        if k != level:
            for p in _passages(run):
                h = _hash(p)
                if p and (h not in theirs or level < theirs[h][1]):
                    theirs[h] = len(p), level
            run, level = [], k
        if k:
            run.append(line)
    return body, max((k for k, _ in lines), default=0), sum(k > 0 for k, _ in lines), mine, theirs


def parse(text: str, least: int = LEAST_CHARS) -> tuple[str, int, int, dict[int, int], dict[int, int]]:
    """As ``parts``, with the passages that can link two conversations, and of the quoted ones those at level 1."""
    body, depth, quoted, mine, theirs = parts(text)
    return body, depth, quoted, {h: n for h, n in mine.items() if n >= least}, {h: n for h, (n, level) in theirs.items() if n >= least and level == 1}


_HASHES = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64()), ("level", pa.int64())]))
_HASHES_DDL = "array<struct<h:long,n:long,level:long>>"


def linked(messages: DataFrame) -> DataFrame:
    """One row per message of ``conv_id, turn, role, text``, in reply order (``thread_id, conv_id, turn``):

    ``thread_id`` (the smallest of the conversations that quotations connect), ``conv_id, turn, role``, ``text`` without
    quotes and the lines that announce them, ``formatted`` (the text in the chat template), ``quote_depth,
    quoted_lines``, and ``reply_conv, reply_turn``: the message it answers, null where it quotes none that is known. A
    message answers earlier ones only (by ``conv_id, turn``), so the order has every message after the one it answers.

    A null or empty text stays as it is and quotes nothing; a message with a null ``conv_id`` or ``turn`` is kept,
    answers nothing and is not answered; repeated rows all stay; a text of any length is read whole, in time in proportion
    to it. Other columns are not read; an empty table gives no rows.
    """
    prepare(messages.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [parts(t) if t is not None else (None, 0, 0, {}, {}) for t in part.column("text").to_pylist()]
                roles = part.column("role").to_pylist()
                formatted = [None if r[0] is None else TEMPLATE.format(role=role or "", text=r[0]) for r, role in zip(rows, roles, strict=True)]
                own = [[{"h": h, "n": n, "level": 0} for h, n in r[3].items()] for r in rows]
                quoted = [[{"h": h, "n": n, "level": level} for h, (n, level) in r[4].items()] for r in rows]
                hashes = [pa.array(x, _HASHES) for x in (own, quoted)]
                columns = [pa.array([r[0] for r in rows], pa.string()), pa.array(formatted, pa.string()), *[pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)], *hashes]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("conv_id"), part.column("turn"), part.column("role"), *columns], ["id", "conv_id", "turn", "role", "text", "formatted", "quote_depth", "quoted_lines", "own", "quoted"])

    source = messages.select(F.monotonically_increasing_id().alias("id"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    parsed = source.mapInArrow(run, f"id long, conv_id long, turn long, role string, text string, formatted string, quote_depth long, quoted_lines long, own {_HASHES_DDL}, quoted {_HASHES_DDL}")
    parsed = materialize(parsed, "messages")
    placed = parsed.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    asks = placed.select("id", "conv_id", "turn", F.inline("quoted"))
    wrote = placed.select("conv_id", "turn", F.inline("own")).drop("level").join(asks.select("h").distinct(), "h", "left_semi")
    here = wrote.groupBy("conv_id", "h").agg(F.min("turn").alias("here_turn"), F.max("n").alias("n"))
    anywhere = here.filter(F.col("n") >= LEAST_CHARS).groupBy("h").agg(F.min(F.struct("conv_id", "here_turn")).alias("first"))
    found = asks.join(here.drop("n"), ["conv_id", "h"], "left").join(anywhere, "h", "left")
    first = F.struct(F.col("first.conv_id").alias("c"), F.col("first.here_turn").alias("t"))
    target = F.when(F.col("here_turn") < F.col("turn"), F.struct(F.col("conv_id").alias("c"), F.col("here_turn").alias("t"))).when(F.col("first").isNotNull() & (first < F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"))), first)
    votes = found.withColumn("target", target).filter("target IS NOT NULL").groupBy("id", "conv_id", "level", "target").agg(F.sum("n").alias("votes"))
    best = votes.groupBy("id", "conv_id").agg(F.max_by("target", F.struct(-F.col("level"), (F.col("target.c") == F.col("conv_id")).cast("int"), F.col("votes"), -F.col("target.c"), -F.col("target.t"))).alias("target"))
    answers = materialize(best.select("id", "conv_id", F.col("target.c").alias("reply_conv"), F.col("target.t").alias("reply_turn")), "answers")
    threads = components(answers.filter("conv_id <> reply_conv").select(F.col("conv_id").alias("a"), F.col("reply_conv").alias("b")))
    out = parsed.drop("own", "quoted").join(answers.drop("conv_id"), "id", "left").join(threads, parsed.conv_id == threads.node, "left")
    out = out.select(F.coalesce("component", "conv_id").alias("thread_id"), "conv_id", "turn", "role", "text", "formatted", "quote_depth", "quoted_lines", "reply_conv", "reply_turn", "id")
    return out.orderBy("thread_id", "conv_id", "turn", "id").drop("id")
