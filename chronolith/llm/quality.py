"""Quality rules on whole texts: base counts, and repetition found by a suffix array over each text's words.

All texts of a chunk share one array of (text, word) symbols, so suffixes of different texts never compare equal. A
suffix's longest common prefix with a neighbour is its deepest common-prefix interval, that is the longest repeated
substring that starts there; spans of shallower intervals lie inside it, so the union of the deepest spans is the union
of all maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronolith.llm.common import lean, prepare, slices, utf8
from chronolith.llm.suffix_core import cover, neighbour_lcp, repeated_prefix, suffix_array

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_INNER = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Rules:
    """Base limits, and the limits of the repetition rule. Repeats of fewer than ``repeat_words`` words don't count."""

    least_words: int = 50
    repeat_percent: int = 50
    window: int = 3
    repeat_words: int = 8
    covered_percent: int = 30
    longest_percent: int = 25
    longest_words: int = 40


RULES = Rules()
FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("covered_words", pa.int64()), ("longest_repeat", pa.int64()), ("kept", pa.bool_())]
DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_words long, longest_repeat long, kept boolean"


def assess_texts(texts: list[bytes], rules: Rules = RULES) -> dict[str, np.ndarray]:
    """The columns of ``FIELDS`` for a few texts."""
    known: dict[bytes, int] = {}
    parts, counts = [], []
    chars, symbols, lines_twice = [], [], []
    for t in texts:
        words = t.split()
        counts.append(len(words))
        parts += words
        dense = t.translate(None, SPACES)
        chars.append(len(dense.translate(None, _INNER)))
        symbols.append(len(t) - len(t.translate(None, SYMBOLS)))
        lines = [x for x in t.split(b"\n") if x.strip()]
        lines_twice.append(len(lines) - len(set(lines)))
    n_words = np.array(counts, np.int64)
    n = len(parts)
    ids = np.fromiter((known.setdefault(w, len(known)) for w in parts), np.int64, n)
    owner = np.repeat(np.arange(len(texts)), n_words)
    bounds = np.concatenate([[0], np.cumsum(n_words)])
    ends = bounds[1:][owner] if n else np.zeros(0, np.int64)
    zero = np.zeros(len(texts), np.int64)
    repeat_words, covered, longest = zero, zero, zero
    if n:
        order, levels = suffix_array(owner * np.int64(len(known)) + ids, ends)
        length = repeated_prefix(order, neighbour_lcp(order, levels, ends))
        at = np.flatnonzero(length >= rules.window)
        in_window = cover(at, np.full(len(at), rules.window), n)
        repeat_words = np.bincount(owner[in_window], minlength=len(texts))
        at = np.flatnonzero(length >= rules.repeat_words)
        covered = np.bincount(owner[cover(at, length[at], n)], minlength=len(texts))
        longest = zero.copy()
        np.maximum.at(longest, owner, length)
    failed = (n_words < rules.least_words) | (100 * repeat_words > rules.repeat_percent * n_words)
    too_much = 100 * covered > rules.covered_percent * n_words
    too_long = (longest > rules.longest_words) & (100 * longest > rules.longest_percent * n_words)
    values = [n_words, np.array(chars, np.int64), np.array(symbols, np.int64), np.array(lines_twice, np.int64), repeat_words, failed, covered, longest, ~(failed | too_much | too_long)]
    return {name: v for (name, _), v in zip(FIELDS, values, strict=True)}


def assess(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """``doc_id`` and the rules' findings, one row per input row.

    Null and empty texts have no words and fail; repeated rows and null ids are judged like any other; other columns of
    the input are not read; an empty table gives no rows. A text of any length is judged whole.
    """
    prepare(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = assess_texts(utf8(part.column("text")), rules)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(found[k], t) for k, t in FIELDS]], ["doc_id", *[k for k, _ in FIELDS]])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {DDL}")


def keep(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The input's rows, all columns, that the rules keep."""
    prepare(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(assess_texts(utf8(part.column("text")), rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
