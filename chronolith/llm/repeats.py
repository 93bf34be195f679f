"""Removal of byte strings that an earlier document has, over a sparse enhanced suffix array.

A repeated string of ``least`` bytes holds, at the same place in all its occurrences, an anchor: the byte window of
``GRAM`` bytes with the least hash among those inside the string. Only suffixes at anchors are sorted.

1. Documents are packed into chunks of about ``CHUNK`` bytes; a chunk finds its anchors. Up to ``GROUP`` chunks in a row are
   a group: what they send to a bucket, and what it answers, is one row.
2. It asks, by an anchor's hash and by that of its context (all ``least``-byte strings around it), which document is the
   first to have them. A question is asked once a chunk, however many documents share it, so a passage that is
   everywhere costs no more than one row a chunk. Most anchors occur in one document only and end here.
3. A context whose first document is elsewhere is covered whole. The first document of each context (its class) goes on,
   if other contexts share its anchor: the right contexts of a bucket's classes are sorted as a suffix array, the
   reversed left ones likewise, with their common-prefix lengths. The interval of length r of the right array and that of
   length ``least`` - r of the left array (the left-extension test) together hold the classes that share a string; its
   smallest document is the first.
4. An anchor with more than ``HOT`` contexts would make one large bucket. Its strings are asked for one by one instead,
   again once a chunk.

All steps are exact up to collisions of 96 bits of hash (an anchor's 48 and its context's 48). ``maximal_repeats`` lists the maximal repeat groups of a few texts by
a stack scan of the interval tree.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import discard, lean, materialize, mix64, partitions, prepare, release, slices, utf8
from chronolith.llm.suffix_core import intervals, neighbour_lcp, suffix_array

LEAST = 50
GRAM = 16
CHUNK = 512_000
#: Chunks and bytes of text of a group at most (a longer chunk is a group of its own).
GROUP, GROUP_BYTES = 16, 8_000_000
#: Bytes of text whose questions meet in a bucket, and bytes of text that a task of an exchange answers for, about.
BUCKET, SHARE = 16_000_000, 32_000_000
#: Contexts of one anchor that a bucket takes; an anchor with more is answered string by string.
HOT = 4096
LAST = np.iinfo(np.int64).max
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTERS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Kinds of rows that meet at a group, in this order: all that its texts need is there before them.
STATE, ANSWER, HOT_ANSWER, TEXT = 0, 1, 2, 3
#: A chunk's number ends in its place in the group; a question's in the group is that place, then its number in the chunk.
PLACE_BITS, NUMBER_BITS = 4, 28


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join(struct.pack("<4sQ", a.dtype.str.encode(), a.nbytes) + a.tobytes() for a in arrays)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, n = struct.unpack_from("<4sQ", blob, at)
        out.append(np.frombuffer(blob, np.dtype(kind.rstrip(b"\0").decode()), n // np.dtype(kind.rstrip(b"\0").decode()).itemsize, at + 12))
        at += 12 + n
    return out


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every window of ``width`` elements, by doubling."""
    out, done, cur, size = None, 0, x, 1
    while True:
        if width & size:
            if out is None:
                out, done = cur, size
            else:
                n = len(out) - size
                out, done = op(out[:n], cur[done : done + n]), done + size
        if size * 2 > width:
            return out
        n = len(cur) - size
        cur, size = op(cur[:n], cur[size : size + n]), size * 2


class Texts:
    """A chunk's documents end to end, with hashes of any substring."""

    def __init__(self, doc_ids: np.ndarray, lengths: np.ndarray, data: bytes) -> None:
        self.doc_ids, self.lengths, self.data = doc_ids, lengths, data
        self.bytes = np.frombuffer(data, np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])
        self.sums: np.ndarray | None = None

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.sums is None:
            n = len(self.bytes)
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_LETTERS[self.bytes] * _powers(_BASE, n), out=self.sums[1:])
            self.shift = _powers(_INVERSE, n + 1)
        return mix64((self.sums[ends] - self.sums[starts]) * self.shift[starts] + (ends - starts).astype(np.uint64))

    def anchors(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of anchors, the documents (by number) they lie in, and their hashes."""
        n = len(self.bytes)
        if n < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(n - GRAM + 1)
        h = self.hashes(at, at + GRAM) | np.uint64(1)
        width = least - GRAM + 1
        low = _slide(h, width, np.minimum)
        owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        whole = owner[: n - least + 1] == owner[least - 1 :]
        low = np.where(whole, low, np.uint64(0))
        pad = np.zeros(width - 1, np.uint64)
        places = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), width, np.maximum) == h)
        return places, owner[places], mix64(h[places])  # least hashes are small ones: spread them again


class Anchors:
    """A chunk's anchors with their contexts, and its distinct questions in order."""

    def __init__(self, texts: Texts, least: int) -> None:
        self.texts, self.least = texts, least
        self.place, self.owner, self.gram = texts.anchors(least)
        reach = least - GRAM
        self.left = np.minimum(self.place - texts.bounds[self.owner], reach)
        self.right = np.minimum(texts.bounds[self.owner + 1] - self.place, least)
        self.context = texts.hashes(self.place - self.left, self.place + self.right) + self.left.astype(np.uint64)
        self.doc = texts.doc_ids[self.owner]
        order = np.lexsort((self.doc, self.context, self.gram))
        g, c = self.gram[order], self.context[order]
        first = np.ones(len(order), bool)
        first[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        self.question = np.zeros(len(order), np.int64)
        self.question[order] = np.cumsum(first) - 1
        head = order[first]
        self.q_gram, self.q_context, self.q_doc = self.gram[head], self.context[head], self.doc[head]


def _by_bucket(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each 64-bit key, by its upper bits (so ascending keys have ascending buckets)."""
    number = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return number, np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else np.zeros(0, np.int64)


def _rows(columns: Sequence[Sequence], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema.names)


CHUNKS = pa.schema([("chunk", pa.int64()), ("blob", pa.binary()), ("z", pa.binary()), ("rest", pa.binary())])
CHUNKS_DDL = "chunk long, blob binary, z binary, rest binary"
ASKED = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary())])
ASKED_DDL = "kind int, bucket long, chunk long, blob binary"


def chunked(docs: DataFrame) -> DataFrame:
    """Documents packed into chunks: ids and lengths, compressed texts, and the other columns."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        part, group, place, grouped = TaskContext.get().partitionId(), 0, 0, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal group, place, grouped, size
            if place == GROUP or place and grouped + size > GROUP_BYTES:
                group, place, grouped = group + 1, 0, 0
            whole = pa.Table.from_batches(held)
            texts = [t for b in held for t in utf8(b.column("text"))]
            ids = whole.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy()
            rest = whole.drop_columns("text")
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as writer:
                writer.write_table(rest)
            row = (part << 32) + (group << PLACE_BITS) + place, pack(ids, np.array([len(t) for t in texts], np.int64)), compress(b"".join(texts)), sink.getvalue().to_pybytes()
            place, grouped, size = place + 1, grouped + size, 0
            held.clear()
            return _rows([[x] for x in row], CHUNKS)

        for batch in batches:
            for piece in slices(batch, "text", CHUNK // 8):
                held.append(piece)
                size += piece.column("text").nbytes
                if size >= CHUNK:
                    yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(run, CHUNKS_DDL)


def _texts(blob: bytes, z: bytes) -> Texts:
    import zstandard

    ids, lengths = unpack(blob)
    return Texts(ids, lengths, zstandard.decompress(z) if zstandard.frame_content_size(z) else b"")


def _narrow(x: np.ndarray) -> np.ndarray:
    """The upper 48 bits of 64-bit hashes, six bytes each."""
    return np.ascontiguousarray((x >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1)


def _widen(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = b.reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


class Outbox:
    """What the chunks of a group send to the buckets, a row a kind and bucket for all of them."""

    def __init__(self, chunk: int) -> None:
        self.group, self.questions, self.classes = chunk >> PLACE_BITS, {}, {}

    def ask(self, kind: int, chunk: int, buckets: int, gram: np.ndarray, context: np.ndarray, doc: np.ndarray) -> None:
        """A chunk's questions, sorted by ``gram``: their hashes, and documents."""
        number, starts = _by_bucket(gram, buckets)
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(gram))[: len(starts)].tolist(), strict=True):
            self.questions.setdefault((kind, int(number[a])), []).append((int(_numbered(chunk, a)), gram[a:b], context[a:b], doc[a:b]))

    def add(self, bucket: int, *columns: np.ndarray) -> None:
        """A chunk's classes for a bucket."""
        self.classes.setdefault(bucket, []).append(columns)

    def rows(self) -> Iterator[tuple[int, int, int, bytes]]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for (kind, bucket), parts in self.questions.items():
            first, gram, context, doc = zip(*parts, strict=True)
            sizes, doc = [len(g) for g in gram], np.concatenate(doc)
            base = doc.min()
            far = doc.astype(np.uint64) - base.astype(np.uint64)
            near = far.astype(np.uint32) if int(far.max()) < 1 << 32 else far
            yield kind, bucket, self.group << PLACE_BITS, pack(np.array(first, np.uint32), np.array(sizes, np.uint32), _narrow(np.concatenate(gram)), _narrow(np.concatenate(context)), base.reshape(1), near)
        for bucket, parts in self.classes.items():
            yield ANSWER, bucket, self.group << PLACE_BITS, squeeze(pack(*(np.concatenate(c) for c in zip(*parts, strict=True))))


def _numbered(chunk: int, number: np.ndarray | int) -> np.ndarray:
    """A question's number in its group."""
    return np.asarray(number, np.uint32) | np.uint32((chunk & (1 << PLACE_BITS) - 1) << NUMBER_BITS)


def _asked(columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    first, sizes, gram, context, base, far = columns
    inside = np.arange(len(far), dtype=np.int64) - np.repeat(np.cumsum(sizes, dtype=np.int64) - sizes, sizes)
    return (np.repeat(first.astype(np.int64), sizes) + inside).astype(np.uint32), _widen(gram), _widen(context), (base.astype(np.uint64) + far.astype(np.uint64)).astype(np.int64)


def _questions(chunks: DataFrame, least: int, buckets: int) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("chunk", "blob", "z")), strict=True))
        for _, own in itertools.groupby(rows, key=lambda row: row[0] >> PLACE_BITS):
            out = None
            for chunk, blob, z in own:
                out = out or Outbox(chunk)
                a = Anchors(_texts(blob, z), least)
                out.ask(ANSWER, chunk, buckets, a.q_gram, a.q_context, a.q_doc)
            yield _rows(list(zip(*out.rows(), strict=True)) or [[]] * 4, ASKED)

    return chunks.select("chunk", "blob", "z").mapInArrow(run, ASKED_DDL)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[list[np.ndarray]]]]:
    """Buckets of a partition sorted by bucket: the groups that ask (by their first chunk's number), and their columns."""
    import zstandard

    bucket, chunks, columns = None, [], []
    for batch in batches:
        for b, chunk, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "blob")), strict=True):
            if b != bucket and chunks:
                yield bucket, chunks, columns
                chunks, columns = [], []
            bucket = b
            chunks.append(chunk)
            columns.append(unpack(zstandard.decompress(blob) if blob[:4] == zstandard.FRAME_HEADER else blob))
    if chunks:
        yield bucket, chunks, columns


def _answer(kind: int, chunks: list[int], sizes: list[int], live: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Answers to the questions of ``live`` (places in the groups' questions laid end to end), a row a group."""
    bounds = np.searchsorted(live, np.concatenate([[0], np.cumsum(sizes)]))
    out = []
    for chunk, a, b in zip(chunks, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if a < b:
            out.append((kind, None, chunk, pack(*[c[a:b] for c in columns])))
    return _rows(list(zip(*out, strict=True)) or [[]] * 4, ASKED)


#: Answers: the first document is in another chunk; it is here and other contexts share the anchor; so too, but many do.
ELSEWHERE, SHARED, CROWDED = 1, 2, 3


def _first_documents(asked: DataFrame, kind: int, hot: int, tasks: int) -> DataFrame:
    """For every question (anchor, context, chunk's first document): whether the first document overall is elsewhere."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunks, columns in _gathered(batches):
            columns = [_asked(c) for c in columns]
            number, gram, context, doc = (np.concatenate(c) for c in zip(*columns, strict=True))
            order = np.lexsort((doc, context, gram))
            g, c, d = gram[order], context[order], doc[order]
            new_g = np.append(True, g[1:] != g[:-1])
            new_c = new_g | np.append(True, c[1:] != c[:-1])
            class_start = np.flatnonzero(new_c)
            class_of = np.cumsum(new_c) - 1
            first = d[class_start][class_of]
            gram_of = np.cumsum(new_g) - 1
            classes = np.bincount(gram_of[class_start])
            by_gram = np.flatnonzero(new_g)
            mixed = np.maximum.reduceat(first, by_gram) > np.minimum.reduceat(first, by_gram)
            code = np.where(d > first, ELSEWHERE, np.where((mixed & (classes <= hot))[gram_of], SHARED, np.where((mixed & (classes > hot))[gram_of], CROWDED, 0)))
            back = np.empty(len(order), np.uint8)
            back[order] = code
            live = np.flatnonzero(back)
            yield _answer(kind, chunks, [len(x[0]) for x in columns], live, number[live], back[live])

    return _spread(asked.select("bucket", "chunk", "blob"), tasks, F.col("bucket")).sortWithinPartitions("bucket", "chunk").mapInArrow(run, ASKED_DDL)


def _spans(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


def _spread(df: DataFrame, tasks: int, number: Column) -> DataFrame:
    """Rows dealt out by a number, in turn: as many numbers to every task, where hashes would pile some up."""
    return df.repartitionById(tasks, F.pmod(number, F.lit(tasks)).cast("int"))


def _meet(chunks: DataFrame, tasks: int, *others: DataFrame) -> DataFrame:
    """Chunks beside the rows addressed to their groups, sorted by group and kind, the chunks last."""
    own = chunks.select("chunk", F.lit(TEXT).alias("kind"), "blob", "z", "rest")
    for o in others:
        own = own.union(o.select("chunk", "kind", "blob", F.lit(None).cast("binary"), F.lit(None).cast("binary")))
    group = F.shiftright("chunk", PLACE_BITS)
    number = F.shiftright("chunk", 32) * 7919 + group.bitwiseAND(F.lit((1 << 32 - PLACE_BITS) - 1))
    return _spread(own, tasks, number).sortWithinPartitions(group, "kind", "chunk")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple]]:
    """The rows of every group."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, own in itertools.groupby(rows, key=lambda row: row[0] >> PLACE_BITS):
        yield own


def _joined(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Answers of several buckets by number."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros((0, 1), np.uint8)
    number = np.concatenate([n for n, _ in parts]).astype(np.int64)
    order = np.argsort(number, kind="stable")
    return number[order], np.concatenate([found.reshape(len(n), -1) for n, found in parts])[order]


def _own(answers: tuple[np.ndarray, np.ndarray], chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Those to one chunk, by its own numbers."""
    number, found = answers
    first = (chunk & (1 << PLACE_BITS) - 1) << NUMBER_BITS
    a, b = np.searchsorted(number, [first, first + (1 << NUMBER_BITS)])
    return number[a:b] - first, found[a:b]


def _chunks(own: Iterator[tuple]) -> Iterator[tuple]:
    """A group's chunks: number, texts, other columns, state, answers by anchor and by string."""
    state: dict[int, bytes] = {}
    sent: dict[int, list] = {ANSWER: [], HOT_ANSWER: []}
    found = None
    for chunk, kind, blob, z, rest in own:
        if kind == STATE:
            state[chunk] = blob
        elif kind != TEXT:
            sent[kind].append(unpack(blob))
        else:
            if found is None:
                found = [_joined(sent.pop(k)) for k in (ANSWER, HOT_ANSWER)]
            yield chunk, _texts(blob, z), rest, state.pop(chunk, None), *(_own(f, chunk) for f in found)


def _covered_by(questions: np.ndarray, which: np.ndarray) -> np.ndarray:
    out = np.zeros(len(which), bool)
    out[questions] = True
    return out


def _classes(chunks: DataFrame, answers: DataFrame, least: int, buckets: int, tasks: int) -> DataFrame:
    """What the answers cover at once (kind STATE), and the classes that go on (ANSWER: by anchor, HOT_ANSWER: by string)."""
    reach = least - GRAM

    def prepared(chunk: int, texts: Texts, answers: tuple[np.ndarray, np.ndarray], out: Outbox) -> bytes:
        a = Anchors(texts, least)
        code = np.zeros(len(a.q_gram), np.uint8)
        code[answers[0]] = answers[1][:, 0]
        own = code[a.question]
        covered = (own == ELSEWHERE) | (a.doc > a.q_doc[a.question])
        delta = np.zeros(len(texts.bytes) + 1, np.int32)
        np.add.at(delta, (a.place - a.left)[covered], 1)
        np.add.at(delta, (a.place + a.right)[covered], -1)
        starts, ends = _spans(np.cumsum(delta[:-1]) > 0)
        go = np.flatnonzero(~covered & (own == SHARED))
        if len(go):
            order = go[np.argsort(a.gram[go], kind="stable")]
            rank = np.empty(len(a.place), np.uint32)
            rank[go] = np.arange(len(go))
            around = np.zeros((len(order), reach + least), np.uint8)
            offset = np.arange(-reach, least)
            inside = (offset >= -a.left[order, None]) & (offset < a.right[order, None])
            around[inside] = texts.bytes[(a.place[order, None] + offset)[inside]]
            number, cut = _by_bucket(a.gram[order], buckets)
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
                o = order[i:j]
                out.add(int(number[i]), _numbered(chunk, rank[o]), a.doc[o], a.left[o].astype(np.uint8), a.right[o].astype(np.uint8), around[i:j].reshape(-1))
        hot = np.flatnonzero(~covered & (own == CROWDED))
        grid = np.zeros((0, 2), np.int64)
        if len(hot):
            back = np.arange(reach + 1)
            fits = (back <= a.left[hot, None]) & (least - back <= a.right[hot, None])
            which, j = np.nonzero(fits)
            begin = a.place[hot][which] - j
            string = texts.hashes(begin, begin + least)
            key = mix64(string ^ a.gram[hot][which])
            order = np.lexsort((a.doc[hot][which], string, key))
            first = np.append(True, (key[order][1:] != key[order][:-1]) | (string[order][1:] != string[order][:-1]))
            number = np.cumsum(first) - 1
            head = order[first]
            doc = a.doc[hot][which]
            out.ask(HOT_ANSWER, chunk, buckets, key[head], string[head], doc[head])
            grid = np.stack([begin[order], number], axis=1)
            later = doc[order] > doc[head][number]
            grid[later, 1] = -1
        return pack(starts.astype(np.uint32), ends.astype(np.uint32), a.place[go].astype(np.uint32), grid[:, 0].astype(np.uint32), grid[:, 1].astype(np.int32))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _met(batches):
            out, state = None, []
            for chunk, texts, _, _, answers, _ in _chunks(own):
                out = out or Outbox(chunk)
                state.append((STATE, None, chunk, prepared(chunk, texts, answers, out)))
            if out:
                yield _rows(list(zip(*state, *out.rows(), strict=True)), ASKED)

    return _meet(chunks.withColumn("rest", F.lit(None).cast("binary")), tasks, answers).mapInArrow(run, ASKED_DDL)


def _sorted_prefixes(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array of bounded contexts: order, and neighbours' common-prefix lengths (within ``lengths``)."""
    n, width = rows.shape
    words = -(-width // 8)
    padded = np.zeros((n, words * 8), np.uint8)
    padded[:, :width] = rows
    keys = padded.view(">u8").astype(np.uint64)
    order = np.lexsort([lengths, *[keys[:, k] for k in range(words - 1, -1, -1)]])
    ordered = rows[order]
    differ = ordered[1:] != ordered[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    sizes = lengths[order].astype(np.int64)
    return order, np.concatenate([[0], np.minimum(lcp, np.minimum(sizes[1:], sizes[:-1]))])


def first_sharers(doc: np.ndarray, left: np.ndarray, right: np.ndarray, around: np.ndarray, least: int) -> np.ndarray:
    """For every class and offset j, whether a smaller document has the string from j bytes before the anchor."""
    reach = least - GRAM
    n = len(doc)
    r_order, r_lcp = _sorted_prefixes(np.ascontiguousarray(around[:, reach:]), right)
    l_order, l_lcp = _sorted_prefixes(np.ascontiguousarray(around[:, :reach][:, ::-1]), left)
    out = np.zeros((n, reach + 1), bool)
    r_id, l_id = np.empty(n, np.int64), np.empty(n, np.int64)
    for j in range(reach + 1):
        # the intervals of length least - j to the right, and j to the left
        r_id[r_order] = np.cumsum(r_lcp < least - j)
        l_id[l_order] = np.cumsum(l_lcp < j) if j else 0
        fits = np.flatnonzero((left >= j) & (right >= least - j))
        key = r_id[fits] * np.int64(n + 1) + l_id[fits]
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(fits) else np.zeros(0, np.int64)
        if not len(start):
            continue
        low = np.minimum.reduceat(doc[fits][order], start)
        size = np.diff(np.append(start, len(fits)))
        out[fits[order], j] = doc[fits][order] > np.repeat(low, size)
    return out


def _sharers(asked: DataFrame, least: int, tasks: int) -> DataFrame:
    reach = least - GRAM

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunks, columns in _gathered(batches):
            number, doc, left, right, around = (np.concatenate(c) for c in zip(*columns, strict=True))
            found = first_sharers(doc, left.astype(np.int64), right.astype(np.int64), around.reshape(len(doc), reach + least), least)
            live = np.flatnonzero(found.any(axis=1))
            bits = np.packbits(found[live], axis=1)
            yield _answer(ANSWER, chunks, [len(x[0]) for x in columns], live, number[live], _Wide(bits))

    return _spread(asked.select("bucket", "chunk", "blob"), tasks, F.col("bucket")).sortWithinPartitions("bucket", "chunk").mapInArrow(run, ASKED_DDL)


class _Wide:
    """Rows of bytes that slice like a column and pack flat."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows

    def __getitem__(self, cut: slice) -> np.ndarray:
        return self.rows[cut].reshape(-1)


def _finished(chunks: DataFrame, state: DataFrame, answers: DataFrame, hot: DataFrame, least: int, tasks: int, finish, ddl: str) -> DataFrame:
    """Every chunk with its answers laid out as removed bytes, given to ``finish(texts, removed, rest)``."""
    reach = least - GRAM

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _met(batches):
            for _, texts, rest, state_of, (which, bits), (hot_which, code) in _chunks(own):
                delta = np.zeros(len(texts.bytes) + 1, np.int32)
                starts, ends, places, begin, number = unpack(state_of)
                np.add.at(delta, starts, 1)
                np.add.at(delta, ends, -1)
                found = np.unpackbits(bits, axis=1)[:, : reach + 1].astype(bool)
                row, j = np.nonzero(found)
                asked = np.zeros(max(int(number.max(initial=0)), int(hot_which.max(initial=0))) + 1, bool)
                asked[hot_which[code[:, 0] == ELSEWHERE]] = True
                for more in (begin[number < 0].astype(np.int64), places[which[row]].astype(np.int64) - j, begin[(number >= 0) & asked[np.maximum(number, 0)]].astype(np.int64)):
                    np.add.at(delta, more, 1)
                    np.add.at(delta, more + least, -1)
                yield finish(texts, np.cumsum(delta[:-1]) > 0, rest)

    return _meet(chunks, tasks, state, answers, hot).mapInArrow(run, ddl)


def _run(docs: DataFrame, least: int, finish, ddl: str, hot: int) -> DataFrame:
    spark = prepare(docs.sparkSession)
    chunks = materialize(chunked(docs), "repeat-chunks")
    size = chunks.count() * CHUNK
    # both follow the bytes of text, so that a task's share stays as it is when the input grows
    buckets, tasks = max(2 * partitions(spark), size // BUCKET), max(partitions(spark), size // SHARE)
    asked = _questions(chunks, least, buckets)
    answers = materialize(_first_documents(asked, ANSWER, hot, tasks), "repeat-answers")
    release(spark)
    classes = materialize(_classes(chunks, answers, least, buckets, tasks), "repeat-classes")
    discard(answers)
    release(spark)
    state, by_anchor, by_string = (classes.filter(F.col("kind") == k) for k in (STATE, ANSWER, HOT_ANSWER))
    # small tables of their own, so that the classes and both exchanges are gone before the texts meet once more
    state = materialize(state, "repeat-state")
    shared = materialize(_sharers(by_anchor, least, tasks), "repeat-shared")
    release(spark)
    strings = materialize(_first_documents(by_string, HOT_ANSWER, 0, tasks), "repeat-strings")
    discard(classes)
    release(spark)
    return _finished(chunks, state, shared, strings, least, tasks, finish, ddl)


def removed(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``: what is removed from each row's UTF-8 bytes.

    A byte goes if a string of ``least`` bytes that covers it also starts in a document with a smaller id. Null and empty
    texts have no bytes; rows that repeat an id never remove each other; a null id counts as the largest. An empty table
    gives no rows.
    """

    def finish(texts: Texts, gone: np.ndarray, rest: bytes) -> pa.RecordBatch:
        ids = pa.ipc.open_stream(rest).read_all().column("doc_id").combine_chunks()
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        starts = texts.bounds[:-1][texts.lengths > 0]
        begins[starts] = gone[starts]
        spans = np.concatenate([[0], np.cumsum(begins)])
        low, high = texts.bounds[:-1], texts.bounds[1:]
        hashes = [hashlib.sha256(texts.bytes[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        columns = [ids.cast(pa.int64()), *[pa.array(x, pa.int64()) for x in (texts.lengths, total[high] - total[low], spans[high] - spans[low])], pa.array(hashes)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _run(docs.select("doc_id", "text"), least, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", hot)


def cleaned(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """The input's rows and columns, repeated strings cut out of ``text``.

    As ``removed``, but a character goes only if all its bytes do, so texts stay valid; a null text stays null.
    """
    schema = docs.schema
    names = docs.columns

    def finish(texts: Texts, gone: np.ndarray, rest: bytes) -> pa.RecordBatch:
        other = pa.ipc.open_stream(rest).read_all()
        inner = (texts.bytes & 0xC0) == 0x80
        lead = np.cumsum(~inner) - 1
        if len(gone):
            stays = np.bincount(lead[~gone], minlength=int(lead[-1]) + 1) > 0
            gone = ~stays[lead]
        null = other.column("__null").to_pylist()
        out = [None if n else texts.bytes[a:b][~gone[a:b]].tobytes().decode("utf-8") for n, a, b in zip(null, texts.bounds[:-1].tolist(), texts.bounds[1:].tolist(), strict=True)]
        columns = [pa.array(out, pa.string()) if c == "text" else other.column(f"c{k}").combine_chunks() for k, c in enumerate(names)]
        return pa.RecordBatch.from_arrays([c if not isinstance(c, pa.ChunkedArray) else c.chunk(0) for c in columns], names)

    packed = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names) if c != "text"], F.col("text").isNull().alias("__null"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _run(packed, least, finish, schema, hot)


def maximal_repeats(texts: Sequence[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeat groups of a few texts: (length, [(text, start), ...]), every occurrence in the group.

    An interval of the common-prefix tree is kept if its occurrences are not all preceded by the same byte.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    n = int(lengths.sum())
    if not n:
        return []
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(texts)), lengths)
    ends = bounds[1:][owner]
    order, levels = suffix_array(data, ends)
    lcp = neighbour_lcp(order, levels, ends)
    begins = np.zeros(n, bool)
    begins[bounds[:-1][lengths > 0]] = True
    before = np.where(begins, -1 - np.arange(n), np.concatenate([[0], data[:-1]]))[order]
    out = []
    for length, first, last in intervals(lcp, least):
        own = before[first : last + 1]
        if (own != own[0]).any():
            places = np.sort(order[first : last + 1])
            out.append((length, [(int(owner[p]), int(p - bounds[owner[p]])) for p in places]))
    return out
