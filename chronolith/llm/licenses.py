"""License scan: an Aho-Corasick automaton finds identifier tags and notice phrases in one pass over a text's words, and
a shunting-yard parser evaluates the licence expressions that follow the tags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from chronolith.llm.common import lean, prepare, slices, utf8

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices, their labels and how much one of them alone tells (0 to 1).
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "boost software license": ("bsl", 0.8),
    "creative commons attribution": ("cc-by", 0.7),
    "creative commons zero": ("cc0", 0.7),
    "bsd 2 clause": ("bsd", 0.7),
    "bsd 3 clause": ("bsd", 0.7),
    "bsd license": ("bsd", 0.7),
    "isc license": ("isc", 0.7),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "licensed under the apache license version 2 0": ("apache", 0.9),
    "all rights reserved": ("all-rights-reserved", 0.4),
}
BASE_WEIGHT = 0.7
TAG_WEIGHT = 0.95
TAG = "spdx license identifier"
#: Licence ids by the start of their name, and whether reuse is permissive.
FAMILIES = (("agpl", "agpl", False), ("lgpl", "lgpl", False), ("gpl", "gpl", False), ("apache", "apache", True), ("mit", "mit", True), ("bsd", "bsd", True), ("mpl", "mpl", False), ("epl", "epl", False), ("isc", "isc", True), ("cc-by-sa", "cc-by-sa", False), ("cc-by-nc", "cc-by-nc", False), ("cc-by", "cc-by", True), ("cc0", "cc0", True), ("unlicense", "unlicense", True), ("zlib", "zlib", True), ("bsl", "bsl", True))
_TAG_LINE = re.compile(rb"spdx[^0-9a-z\n\x80-\xff]+license[^0-9a-z\n\x80-\xff]+identifier[^0-9a-z(\n\x80-\xff]*([^\n]*)", re.I)
_TOKEN = re.compile(r"\s*(\(|\)|(?:documentref-[0-9a-z.-]+:)?[0-9a-z][0-9a-z.+-]*)")
#: What a tag says where there is no licence to name.
_NO_ID = frozenset(("none", "noassertion"))
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def family(identifier: str) -> tuple[str, bool] | None:
    """The label of a licence id and whether it is permissive, None for an unknown id."""
    name = identifier.rstrip("+").lower()
    return next(((label, free) for start, label, free in FAMILIES if name == start or name.startswith(start + "-")), None)


def postfix(expression: str) -> list[str] | None:
    """Shunting yard: the longest well-formed licence expression at the start of a text, in postfix order; else None."""
    output: list[str] = []
    waiting: list[str] = []
    kept, rest = 0, [""]  # the longest well-formed start: so many steps of the output, and what waited behind them
    at, operand_next, open_brackets = 0, True, 0

    def closed() -> None:
        """What waits outside brackets are at most three operators, one of each precedence."""
        nonlocal kept, rest
        if not open_brackets:
            kept, rest = len(output), waiting[::-1]

    while m := _TOKEN.match(expression, at):
        token, at = m[1].rstrip(".-"), m.end()
        if operand_next:
            if token == "(":
                waiting.append(token)
                open_brackets += 1
                continue
            if token in _PRECEDENCE or token == ")" or token in _NO_ID:
                break
            output.append(token)
            operand_next = False
            closed()
        elif token in _PRECEDENCE:
            while waiting and waiting[-1] != "(" and _PRECEDENCE[waiting[-1]] >= _PRECEDENCE[token]:
                output.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        elif token == ")" and open_brackets:
            while waiting[-1] != "(":
                output.append(waiting.pop())
            waiting.pop()
            open_brackets -= 1
            closed()
        else:
            break
    return output[:kept] + rest if kept else None


def evaluate(steps: list[str]) -> tuple[set[str], bool]:
    """Labels of an expression in postfix order, and whether its reader may choose permissive terms only.

    ``or`` lets the reader choose, ``and`` binds to both sides, ``with`` keeps its licence's label. An id of no known
    family is labelled by its own name and not taken as permissive.
    """
    stack: list[tuple[set[str], bool]] = []
    for s in steps:
        if s in _PRECEDENCE:
            (b_labels, b_free), (a_labels, a_free) = stack.pop(), stack.pop()
            if s == "with":
                stack.append((a_labels, a_free))
            else:
                small, large = sorted((a_labels, b_labels), key=len)
                large |= small  # each set is in one place only
                stack.append((large, a_free or b_free if s == "or" else a_free and b_free))
        else:
            known = family(s)
            stack.append(({known[0] if known else s.rstrip("+")}, bool(known and known[1])))
    return stack[0]


def words_of(text: bytes) -> bytes:
    """A text's lower-cased words with one space before and after each."""
    words = text.translate(_FOLD).split()
    return b" " + b" ".join(words) + b" " if words else b" "


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p in [*BASE, *NOTICES, TAG]:
            self.automaton.add_word(f" {p} ", p)
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple:
        flat = words_of(text)
        places, labels, doubt, tagged = [], set(), 1.0, False
        evidence: set[str] = set()
        for end, phrase in self.automaton.iter(flat.decode("latin-1")):
            if phrase in BASE:
                places.append(end - len(phrase) - 1)
            tagged |= phrase == TAG
            evidence.add(phrase)
        base = {BASE[p] for p in evidence if p in BASE}
        for p in sorted(evidence):
            if p in BASE:
                doubt *= 1 - BASE_WEIGHT
            elif p in NOTICES:
                labels.add(NOTICES[p][0])
                doubt *= 1 - NOTICES[p][1]
        free: bool | None = None
        found = []
        if tagged:
            for m in _TAG_LINE.finditer(text):
                steps = postfix(m[1].decode("utf-8", "replace").lower())
                if steps:
                    own, ok = evaluate(steps)
                    labels |= own
                    free = ok if free is None else free and ok
                    found.append(" ".join(steps))
                    doubt *= 1 - TAG_WEIGHT
            if not found:
                doubt *= 1 - TAG_WEIGHT
        at = [flat.count(b" ", 0, p + 1) - 1 for p in (min(places), max(places))] if places else [None, None]
        return flat.count(b" ") - 1, len(places), *at, ",".join(sorted(base)), ",".join(sorted(base | labels)), round(1 - doubt, 6), free, found


_SCANNER: Scanner | None = None
SCHEMA = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("permissive", pa.bool_()), ("expressions", pa.list_(pa.string()))])
DDL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean, expressions array<string>"


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the findings of every row, from its whole text.

    Null and empty texts have no words, no labels (empty strings) and score 0. ``score`` is the chance that a notice is
    meant, each distinct piece of evidence taken as independent. A text of any length is scanned whole, and an expression of
    any length read to its end, in time in proportion to them. ``permissive`` is null without an expression. Repeated
    rows and null ids are scanned like any other; only ``doc_id`` and ``text`` are read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _SCANNER
        _SCANNER = _SCANNER or Scanner()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [_SCANNER.scan(t) for t in utf8(part.column("text"))]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *SCHEMA.names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {DDL}")
