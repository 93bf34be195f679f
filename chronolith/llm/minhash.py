"""Near-duplicate documents by fast similarity sketches, banding, and verification on full shingle sets.

1. Every text becomes its set of word shingles, a 128-bit fingerprint of the set, and a sketch cut into bands. Bands are
   as many as a pair at the threshold needs to share one but for a chance of ``MISS``.
2. Documents with the same set form a class; only its smallest id goes on.
3. Classes that share a band meet in a bucket. First every class is verified against one partner only, the bucket's
   smallest id it shares most bands with. Buckets that then hold more than one component are compared whole, in blocks
   of ``BLOCK`` members (strays against the bucket's main component and each other), so that no link that matters is
   lost.
4. Components of the verified links.

Nothing is sampled or capped. Buckets and classes are counted with map-side sums; texts of candidates alone are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import discard, lean, materialize, prepare, release, runs, slices, utf8
from chronolith.llm.components import components
from chronolith.llm.minhash_core import band_keys, shingles, sketches

ROWS = 4
MISS = 1e-6
BLOCK = 256
#: Partners of one centre that are verified together.
FAN = 64


def bands_for(percent: int) -> int:
    """Bands of ``ROWS`` coordinates that a pair at the threshold misses altogether with a chance of ``MISS`` at most."""
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set, as signed integers."""
    from chronolith.llm.common import mix64

    a = mix64(s ^ np.uint64(0x3C79AC492BA7B653)).sum(dtype=np.uint64)
    b = mix64(s ^ np.uint64(0x1C69B3F74AC4AE35)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def sketch(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, bands`` of every row."""
    bands = bands_for(percent)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                sets = [shingles(t, size) for t in utf8(part.column("text"))]
                keys = band_keys(sketches(sets, bands * ROWS), bands, ROWS)
                marks = [fingerprint(s) for s in sets]
                offsets = np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def compressed(docs: DataFrame) -> DataFrame:
    """``doc_id, z``: texts compressed, for a shuffle."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([pack(t) for t in utf8(part.column("text"))], pa.binary())], ["doc_id", "z"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, z binary")


def opened(z: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(z) if zstandard.frame_content_size(z) else b""


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def similar(both: int, a: int, b: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough. A ``b`` with many partners is dealt out ``FAN`` at a time."""
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / FAN).alias("shares"))
    dealt = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("shares")).alias("share"))
    members = dealt.join(texts, dealt.a == texts.doc_id).select("b", "share", "a", "z")
    centres = dealt.select("b", "share").distinct().join(texts, F.col("b") == texts.doc_id).select("b", "share", F.lit(None).cast("long").alias("a"), "z")
    rows = members.union(centres).repartition("b", "share").sortWithinPartitions("b", "share", "a")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (b, _), members in runs(batches, 2):
            heads = [shingles(opened(z), size) for a, z in members if a is None]
            for a, z in members:
                if a is not None:
                    s = shingles(opened(z), size)
                    if any(similar(common(s, h), len(s), len(h), percent) for h in heads):
                        out.append((a, b))
            if len(out) >= 4096:
                yield _links(out)
                out = []
        yield _links(out)

    return rows.mapInArrow(run, "a long, b long")


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def forest(ids: list[int], groups: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between different groups that are enough to join all groups that any link joins."""
    lengths = np.array([len(s) for s in sets], np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), lengths)
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    live = shared[column]
    row, column = row[live], place[column[live]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, [start, start + 4096])
        grid = np.zeros((len(sets), 4096), np.float32)
        grid[row[lo:hi], column[lo:hi] - start] = 1
        both += grid @ grid.T
    inter = both.astype(np.int64)
    linked = 100 * inter >= percent * (lengths[:, None] + lengths[None, :] - inter)
    _, group = np.unique(np.array(groups), return_inverse=True)
    linked &= group[:, None] < group[None, :]
    root = list(range(int(group.max()) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in np.argwhere(linked).tolist():
        a, b = find(int(group[i])), find(int(group[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((ids[i], ids[j]))
    return out


def compared(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components inside buckets: ``members`` has ``key, rep, component, major`` (a component of the bucket).

    Members of ``major`` need no comparison with each other. The others meet its blocks and each other's, so a bucket of
    near copies with some strays makes rows in proportion to its size times the blocks of strays.
    """
    own = F.col("component") == F.col("major")
    blocks = lambda which: F.greatest(F.ceil(F.sum(which.cast("long")) / BLOCK), F.lit(1).cast("long"))
    counts = members.groupBy("key").agg(blocks(own).alias("g"), blocks(~own).alias("s"))
    sized = members.join(counts, "key")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    columns = ["key", "kind", "i", "j", "rep", "component"]
    inner = sized.filter(own).withColumns({"kind": F.lit(0), "i": block("g"), "j": upto("s")}).select(*columns)
    stray = sized.filter(~own)
    outer = stray.withColumns({"kind": F.lit(0), "j": block("s"), "i": upto("g")}).select(*columns)
    pairs = stray.filter("s > 1").withColumns({"kind": F.lit(1), "b": block("s"), "o": upto("s")}).withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).select(*columns)
    dealt = inner.union(outer).union(pairs)
    rows = dealt.join(texts, dealt.rep == texts.doc_id).select("key", "kind", "i", "j", "rep", "component", "z")
    rows = rows.repartition("key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in runs(batches, 4):
            yield _links(forest([r[0] for r in found], [r[1] for r in found], [shingles(opened(r[2]), size) for r in found], percent))

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row: links are Jaccard similarities of ``percent``/100 or more.

    A text of fewer than ``size`` words has its word sequence as its only shingle; null and empty texts, and texts
    without words, have none and link with nothing. ``component_id`` is the smallest id that links reach; ``kept`` is
    true for that id. Rows that repeat an id are all returned and count as one document that has each of the texts; a
    null id links with nothing and is kept. Only ``doc_id`` and ``text`` are read; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    marks = materialize(sketch(docs, size, percent), "minhash-sketches")
    classes = ["n_shingles", "set_a", "set_b"]
    full = marks.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = materialize(full.groupBy(*classes).agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "minhash-classes")
    banded = reps.select("rep", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("centre")).filter("n > 1")
    met = materialize(banded.join(buckets, "key"), "minhash-buckets")
    wanted = met.select(F.col("rep").alias("doc_id")).distinct()
    texts = materialize(compressed(docs).join(wanted, "doc_id", "left_semi"), "minhash-texts")
    release(spark)

    votes = met.filter("rep <> centre").groupBy("rep", "centre").agg(F.count("*").alias("votes"))
    star = votes.groupBy("rep").agg(F.max_by("centre", F.struct("votes", -F.col("centre"))).alias("b")).select(F.col("rep").alias("a"), "b")
    links = materialize(verified(star, texts, size, percent), "minhash-links")
    release(spark)
    known = components(links)

    placed = met.join(known, met.rep == known.node, "left").select("key", "n", "rep", F.coalesce("component", "rep").alias("component"))
    placed = materialize(placed, "minhash-placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.col("rep"), F.lit(1))).alias("y"), F.first("n").alias("m"), F.min_by("component", "rep").alias("major"))
    once = mixed.filter("low < high").groupBy("x", "y", "m").agg(F.min("key").alias("key"), F.first("major").alias("major")).select("key", "major")
    more = materialize(compared(placed.join(once, "key"), texts, size, percent), "minhash-more")
    for done in (met, texts, links, placed):
        discard(done)
    release(spark)

    joined = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    named = reps.drop("bands").join(joined, reps.rep == joined.node, "left").select(*classes, F.coalesce("component", "rep").alias("component"))
    out = marks.drop("bands").join(named, classes, "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
