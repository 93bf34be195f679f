"""Token ids as directly addressable codes: any token can be read without decoding its block.

A block holds whole documents. Its ids are cut into chunks of 8 bits; level 0 has the low chunk of every id, and a bitmap
tells which ids go on to level 1, and so forth. A rank directory (ones before every 512th bit) finds the place of an id's
next chunk. Blocks are rows of a Parquet table in the shared folder, so Spark commits them and any executor can read them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import HashIndex, lean, materialize, partitions, prepare, slices, span_hashes, utf8

MAGIC = b"DAC1"
#: Tokens of a block; a longer document has a block of its own.
BLOCK_TOKENS = 32_768
RANK_BITS = 512
MARK = b"\x01"
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 32 if c in b"\t\n\x0b\x0c\r" else c for c in range(256))
_ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
#: Words whose ids a worker remembers; beyond it the memory is emptied and filled anew.
MEMORY = 600_000
STORE_DDL = "part int, block int, first_doc long, at long, n_docs int, n_tokens long, payload binary"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """``tokenizers`` encoding of whole texts by way of their words.

    Splitting at ASCII white space first gives the same ids as encoding the text at once: the tokenizer drops white
    space and lets no token or normalisation cross it. It lower-cases, so A-Z may be folded before; and it starts a new
    token at a stop or comma between a letter or digit and white space, so a word may end there. Words are found, hashed
    and looked up for a whole chunk at a time in an open-addressing table (a word is its 64-bit hash); new words are
    encoded many at once, with a control character of a known id between them.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.spelled, self.bare = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)  # one model in memory
        self.spelled.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        (self.mark,) = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self._reset()

    def _reset(self) -> None:
        self.index = HashIndex()
        self.start = np.zeros(1024, np.int32)
        self.length = np.zeros(1024, np.int32)
        self.flat = np.zeros(4096, np.uint32)
        self.count = self.used = 0

    def _learn(self, words: list[bytes], h: np.ndarray) -> None:
        """Encode new words: a-z words and other words of letters need none of the tokenizer's normalising."""
        plain, letters, letter_texts, rest, odd = [], [], [], [], []
        for k, w in enumerate(words):
            if w.isalpha():
                plain.append(k)
            elif MARK in w:
                odd.append(k)
            elif w.isascii():
                rest.append(k)
            else:
                low = w.decode("utf-8").lower()
                if low.isalpha() and max(low) < "\u0180":
                    letters.append(k)
                    letter_texts.append(low)
                else:
                    rest.append(k)
        self._many(self.bare, h[plain], [words[k].decode("ascii") for k in plain], "\u0101")
        self._many(self.spelled, h[letters], letter_texts, "\x01")
        self._many(self.tokenizer, h[rest], [words[k].decode("utf-8") for k in rest], "\x01")
        for k in odd:
            own = np.array(self.tokenizer.encode(words[k].decode("utf-8"), add_special_tokens=False).ids, np.uint32)
            self._add(h[k : k + 1], own, np.zeros(1, np.int64), np.array([len(own)]))

    def _many(self, tokenizer, h: np.ndarray, texts: list[str], mark: str) -> None:
        between = f" {mark} "
        rows = [between.join(texts[i : i + 512]) + between for i in range(0, len(texts), 512)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in tokenizer.encode_batch_fast(rows, add_special_tokens=False)), np.uint32)
        stops = np.flatnonzero(ids == self.mark)
        starts = np.concatenate([[0], stops[:-1] + 1])[: len(stops)]
        self._add(h, ids, starts, stops - starts)

    def _add(self, h: np.ndarray, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        k, n = self.count, len(h)
        while k + n > len(self.start):
            self.start, self.length = (np.resize(x, 2 * len(x)) for x in (self.start, self.length))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k : k + n], self.length[k : k + n] = starts + self.used, lengths
        self.used += len(ids)
        self.count = k + n
        self.index.insert(h, np.arange(k, k + n, dtype=np.int32))

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words of folded text that begins and ends with a space."""
        b = np.frombuffer(data, np.uint8)
        space = b == 32
        stop = (b == 46) | (b == 44)
        stop[1:-1] &= _ALNUM[b[:-2]] & space[2:]
        stop[[0, -1]] = False
        begin = ~space
        begin[1:] &= space[:-1] | stop[1:]
        end = ~space
        end[:-1] &= space[1:] | stop[1:]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        return starts, ends, span_hashes(data, starts, ends)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and the number of ids of each."""
        data = (b" " + b" ".join(texts) + b" ").translate(_FOLD)
        starts, ends, h = self._words(data)
        if self.count > MEMORY:
            self._reset()
        at = self.index.find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            fresh, first = np.unique(h[missing], return_index=True)
            first = missing[first]
            self._learn([data[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], fresh)
            at[missing] = self.index.find(h[missing])
        lengths = self.length[at].astype(np.int64)
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.flat[np.repeat(self.start[at] - (stops - lengths), lengths) + np.arange(total)]
        edges = np.cumsum([1, *[len(t) + 1 for t in texts]])
        counts = np.concatenate([[0], stops])[np.searchsorted(starts, edges)]
        return ids, np.diff(counts)


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A block's bytes."""
    absent = np.array([x is None for x in doc_ids], np.uint8)
    out = [MAGIC, struct.pack("<II", len(doc_ids), len(ids)), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), absent.tobytes(), np.concatenate([[0], np.cumsum(lengths)]).astype("<u4").tobytes()]
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(more)])[: len(rest) + 1 : RANK_BITS].astype("<u4")
        levels.append(struct.pack("<III", len(rest), len(bits), len(ones)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ones.tobytes())
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    return b"".join([*out, struct.pack("<I", len(levels)), *levels])


class Block:
    """A packed block: documents' places, random access, and whole decoding."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a token block")
        docs, _ = struct.unpack_from("<II", payload, 4)
        at = 12
        ids = np.frombuffer(payload, "<i8", docs, at)
        absent = np.frombuffer(payload, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if a else int(x) for x, a in zip(ids, absent, strict=True)]
        at += 9 * docs
        self.offsets = np.frombuffer(payload, "<u4", docs + 1, at).astype(np.int64)
        at += 4 * (docs + 1)
        (count,) = struct.unpack_from("<I", payload, at)
        at += 4
        self.levels = []
        for _ in range(count):
            n, b, r = struct.unpack_from("<III", payload, at)
            at += 12
            self.levels.append((np.frombuffer(payload, np.uint8, n, at), np.frombuffer(payload, np.uint8, b, at + n), np.frombuffer(payload, "<u4", r, at + n + b)))
            at += n + b + 4 * r

    def access(self, i: int) -> int:
        """Token i, touching one chunk, one bit and one rank a level."""
        value, shift = 0, 0
        for chunks, bits, ones in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            base = i - i % RANK_BITS
            inside = np.unpackbits(bits[base >> 3 : (i >> 3) + 1], bitorder="little")[: i - base]
            i = int(ones[i // RANK_BITS]) + int(inside.sum())
            shift += 8
        return value

    def decode(self) -> np.ndarray:
        out = self.levels[0][0].astype(np.uint32)
        live = np.arange(len(out))
        for k in range(1, len(self.levels)):
            bits = np.unpackbits(self.levels[k - 1][1], bitorder="little", count=len(live)).astype(bool)
            live = live[bits]
            out[live] |= self.levels[k][0].astype(np.uint32) << np.uint32(8 * k)
        return out


def write(docs: DataFrame, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """The store as a table of blocks, documents in ascending ``doc_id`` (null ids first, equal ids by text hash).

    Null and empty texts have no ids of their own, only the end id; repeated rows are stored as often as they come; only
    ``doc_id`` and ``text`` are read; an empty table gives an empty store. A task holds one range of ids, a block of it
    at a time.
    """
    spark = prepare(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    ranged = keyed.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _ENCODER
        if _ENCODER is None or _ENCODER[0] != tokenizer:
            _ENCODER = tokenizer, WordEncoder(tokenizer)
        encoder = _ENCODER[1]
        part, block, at = TaskContext.get().partitionId(), 0, 0
        held_ids: list[int | None] = []
        held_lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, at, tokens
            ids = np.concatenate(held)
            row = [part, block, held_ids[0], at, len(held_ids), len(ids), pack(held_ids, np.concatenate(held_lengths), ids)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            block, at, tokens = block + 1, at + len(ids), 0
            held_ids.clear(), held_lengths.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in STORE_DDL.split(", ")])

        for batch in batches:
            for piece in slices(batch, "text", 250_000):
                ids, lengths = encoder.encode(utf8(piece.column("text")))
                stops = np.cumsum(lengths)
                for doc, stop, n in zip(piece.column("doc_id").to_pylist(), stops.tolist(), lengths.tolist(), strict=True):
                    own = ids[stop - n : stop]
                    own = own if end_id is None else np.append(own, np.uint32(end_id))
                    if held and tokens + len(own) > BLOCK_TOKENS:
                        yield flush()
                    held_ids.append(doc)
                    held_lengths.append(np.array([len(own)]))
                    held.append(own)
                    tokens += len(own)
        if held:
            yield flush()

    return materialize(ranged.mapInArrow(run, STORE_DDL), "token-store")


_ENCODER: tuple[str, WordEncoder] | None = None


def located(store: DataFrame) -> DataFrame:
    """The store with ``base``: ids of all parts before a block's part. The totals are one row a part."""
    from pyspark.sql import Window

    totals = store.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return store.join(F.broadcast(totals), "part")  # as many rows as the store was written in partitions


def read(store: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every document, decoded from the blocks."""
    prepare(store.sparkSession)
    return located(store).select("payload", (F.col("base") + F.col("at")).alias("start")).mapInArrow(_reader(False), "doc_id long, start long, ids array<int>")


def digest(store: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the decoded blocks."""
    prepare(store.sparkSession)
    return located(store).select("payload", (F.col("base") + F.col("at")).alias("start")).mapInArrow(_reader(True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _reader(digests: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, start in zip(batch.column("payload"), batch.column("start").to_pylist(), strict=True):
                block = Block(payload.as_py())
                ids, bounds = block.decode(), block.offsets
                columns = [pa.array(block.doc_ids, pa.int64()), pa.array(start + bounds[:-1], pa.int64())]
                if digests:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    columns += [pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])
                else:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids"])

    return run
