"""Hard negatives by a vector-approximation file: bounds of scores from cells, exact scores of candidates only.

1. Vectors are dealt out in groups and stored in blocks of at most ``BLOCK``. A block cuts every dimension into ``CELLS``
   cells that hold about as many of its vectors each, and keeps every vector's cell numbers (a byte a dimension) and the
   cells' edges beside the components.
2. Anchors meet every group, a batch at a time: a score lies within what the cells' middles and half widths, looked up by
   cell number, make of the anchor's components.
3. Positives: a row whose upper bound reaches the k-th lower bound, or the k-th score found so far, is scored.
   Negatives: so is one that may lie in a positive's window, unless enough rows that surely do so have more.
4. The best of every group meet in a window a (anchor, positive), which has few rows.

An anchor is sent to every group once a search and vectors stay where they are, so nothing is paired but in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import lean, materialize, partitions, prepare

BLOCK, CELLS = 4096, 64
#: Bytes of a group's components (float64), which a task holds at once.
GROUP_BYTES = 48_000_000
#: Anchors whose bounds are computed at once.
TOGETHER = 64
#: Whole numbers up to here are exact in float64.
_EXACT = 2.0**53
_LONG = 2**63

_BLOCK_DDL = "width int, grp int, ids binary, labels binary, cells binary, edges binary, values binary"


def whole(embedding: pa.Array, scale: float) -> list[np.ndarray | None]:
    """floor(scale * x) of every component x; None for a vector that is null or has a null or non-finite component."""
    out = []
    for v in embedding:
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid and v.values.null_count == 0 else None
        x = None if x is None else np.floor(x * scale)
        out.append(x if x is not None and np.isfinite(x).all() else None)
    return out


def _rows(vectors: DataFrame, label: Column, scale: float) -> DataFrame:
    """``width, id, label, v`` of the rows that take part, one of each id."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), "embedding").filter("id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = whole(batch.column("embedding"), scale)
            take = pa.array([i for i, x in enumerate(found) if x is not None], pa.int64())
            some = [x for x in found if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in some], pa.int32()), batch.column("id").take(take), batch.column("label").take(take), pa.array([x.astype("<f8").tobytes() for x in some], pa.binary())], ["width", "id", "label", "v"])

    rows = materialize(kept.mapInArrow(run, "width int, id long, label long, v binary"), "whole-vectors")
    if rows.groupBy("id").count().filter("count > 1").isEmpty():
        return rows
    return materialize(rows.groupBy("id").agg(F.min(F.struct("width", "label", "v")).alias("x")).select("x.width", "id", "x.label", "x.v"), "whole-vectors")


def approximated(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers of the vectors' components, and the cells' edges: dimensions x (CELLS + 1)."""
    ranks = np.linspace(0, len(x) - 1, CELLS + 1).round().astype(np.int64)
    edges = np.ascontiguousarray(np.sort(x, axis=0)[ranks].T) if x.shape[1] else np.zeros((0, CELLS + 1))
    cells = np.empty(x.shape, np.uint8)
    for d in range(x.shape[1]):
        cells[:, d] = np.clip(np.searchsorted(edges[d], x[:, d], "right") - 1, 0, CELLS - 1)
    return cells, edges


def _file(rows: DataFrame, groups: int) -> DataFrame:
    """The approximation file: blocks of rows of one width and group."""
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).repartition(max(groups, partitions(rows.sparkSession)), "width", "grp")
    dealt = dealt.sortWithinPartitions("width", "grp", "id").select("width", "grp", "id", "label", "v")

    def block(key: tuple[int, int], held: list[tuple]) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(v for _, _, v in held), "<f8").reshape(len(held), key[0])
        cells, edges = approximated(x)
        arrays = [np.array([i for i, _, _ in held], "<i8"), np.array([b for _, b, _ in held], "<i8"), cells, edges.astype("<f8"), x]
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], [c.split()[0] for c in _BLOCK_DDL.split(", ")])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for width, grp, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((width, grp) != now or len(held) == BLOCK):
                    yield block(now, held)
                    held = []
                now = width, grp
                held.append(row)
        if held:
            yield block(now, held)

    return materialize(dealt.mapInArrow(run, _BLOCK_DDL), "approximations")


class Block:
    """A block of the file with its cells looked up: each component's cell middle and half width."""

    def __init__(self, width: int, ids: bytes, labels: bytes, cells: bytes, edges: bytes, values: bytes) -> None:
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        shape = len(self.ids), width
        self.x = np.frombuffer(values, "<f8").reshape(shape)
        codes, table = np.frombuffer(cells, np.uint8).reshape(shape), np.frombuffer(edges, "<f8").reshape(width, CELLS + 1)
        low, high = np.empty(shape), np.empty(shape)
        for d in range(width):
            low[:, d], high[:, d] = table[d, codes[:, d]], table[d, codes[:, d].astype(np.int64) + 1]
        self.middle, self.half = low / 2 + high / 2, high / 2 - low / 2
        self.size = np.abs(self.x).max(axis=0, initial=0.0) if width else np.zeros(0)

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lowest and highest that each row's score with each anchor can be."""
        with np.errstate(over="ignore", invalid="ignore"):
            centre, spread, most = a @ self.middle.T, np.abs(a) @ self.half.T, (np.abs(a) @ self.size)[:, None]
            spread = spread + np.where(most * 4 < _EXACT, 0.0, most * 1e-9)  # beyond, sums are rounded
            low, high = centre - spread, centre + spread
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)

    def scores(self, a: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact scores; those beyond 64 bits are the least or greatest long."""
        with np.errstate(over="ignore"):
            exact = np.abs(a) @ self.size < _EXACT
        if exact:
            return (self.x[rows] @ a).astype(np.int64)
        whole_a = [int(x) for x in a]
        sums = [sum(int(x) * y for x, y in zip(v, whole_a, strict=True)) for v in self.x[rows].tolist()]
        return np.array([max(-_LONG, min(_LONG - 1, s)) for s in sums], np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first by falling score, then by id."""
    if len(scores) > 4 * k:  # what can't be among them goes before the sort
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == -_LONG else -scores))[:k]
    return scores[order], ids[order]


def _searched(file: DataFrame, anchors: DataFrame, groups: int, extra: list[str], search, ddl: str) -> DataFrame:
    """``search(blocks of a group, anchor rows)`` for every group and every batch of anchors of its width. ``anchors``: ``width,
    id, label, v`` and ``extra`` columns."""
    blocks = file.select("width", "grp", F.lit(0).alias("kind"), *[F.lit(None).cast(dict(anchors.dtypes)[c]).alias(c) for c in ("id", "label", "v", *extra)], "ids", "labels", "cells", "edges", "values")
    asked = anchors.select("width", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(1).alias("kind"), "id", "label", "v", *extra, *[F.lit(None).cast("binary").alias(c) for c in ("ids", "labels", "cells", "edges", "values")])
    dealt = blocks.unionByName(asked).repartition(max(groups, partitions(file.sparkSession)), "width", "grp").sortWithinPartitions("width", "grp", "kind")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            waiting: list[dict] = []
            for row in batch.to_pylist():
                key = row["width"], row["grp"]
                if key != now:
                    if waiting:
                        yield search(held, waiting)
                    now, held, waiting = key, [], []
                if row["kind"] == 0:
                    held.append(Block(key[0], row["ids"], row["labels"], row["cells"], row["edges"], row["values"]))
                else:
                    waiting.append(row)
                    if len(waiting) == TOGETHER:
                        yield search(held, waiting)
                        waiting = []
            if waiting:
                yield search(held, waiting)

    return dealt.mapInArrow(run, ddl)


def _matrix(rows: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(r["v"] for r in rows), "<f8").reshape(len(rows), -1 if rows[0]["v"] else 0)


_POSITIVE_DDL = "anchor_id long, positive_id long, positive_score long"
_NEGATIVE_DDL = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _positives(k: int):
    def search(blocks: list[Block], rows: list[dict]) -> pa.RecordBatch:
        a = _matrix(rows)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(rows)
        for block in blocks:
            lows, highs = block.bounds(a)
            for i, row in enumerate(rows):
                same = np.flatnonzero((block.labels == row["label"]) & (block.ids != row["id"]))
                scores, ids = best[i]
                cut = scores[-1] if len(scores) == k else -np.inf
                if len(same) > k:
                    cut = max(cut, np.partition(lows[i, same], len(same) - k)[len(same) - k])
                same = same[highs[i, same] >= cut]
                best[i] = _best(np.concatenate([scores, block.scores(a[i], same)]), np.concatenate([ids, block.ids[same]]), k)
        ids = np.repeat([r["id"] for r in rows], [len(s) for s, _ in best])
        columns = [ids, np.concatenate([x for _, x in best]), np.concatenate([s for s, _ in best])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in _POSITIVE_DDL.split(", ")])

    return search


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


def _negatives(k: int, low: int, high: int):
    def search(blocks: list[Block], rows: list[dict]) -> pa.RecordBatch:
        a = _matrix(rows)
        asked = [(i, p["positive_id"], p["positive_score"], *window(p["positive_score"], low, high)) for i, r in enumerate(rows) for p in r["positives"]]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)
        for block in blocks:
            lows, highs = block.bounds(a)
            other, last = None, -1
            for w, (i, _, _, least, most) in enumerate(asked):
                if least > most:
                    continue
                if i != last:
                    other, last = np.flatnonzero(block.labels != rows[i]["label"]), i
                    lo, hi = lows[i, other], highs[i, other]
                scores, ids = best[w]
                cut = scores[-1] if len(scores) == k else least
                sure = lo[(lo >= least) & (hi <= most)]
                if len(sure) > k:
                    cut = max(cut, np.partition(sure, len(sure) - k)[len(sure) - k])
                maybe = other[(hi >= cut) & (lo <= most)]
                found = block.scores(a[i], maybe)
                inside = (found >= least) & (found <= most)
                best[w] = _best(np.concatenate([scores, found[inside]]), np.concatenate([ids, block.ids[maybe[inside]]]), k)
        counts = [len(s) for s, _ in best]
        empty = np.zeros(0, np.int64)
        columns = [np.repeat(np.array([rows[i]["id"] for i, *_ in asked], np.int64), counts), np.repeat(np.array([p for _, p, *_ in asked], np.int64), counts), np.repeat(np.array([s for _, _, s, *_ in asked], np.int64), counts)]
        columns += [np.concatenate([empty, *[x for _, x in best]]), np.concatenate([empty, *[s for s, _ in best]])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in _NEGATIVE_DDL.split(", ")])

    return search


def mine(vectors: DataFrame, anchors: str = "vec_id % 100 = 0", label: Column | None = None, scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for every anchor (a condition on
    ``vec_id``) and each of its first ``positives`` other rows of the same label, the first ``negatives`` rows of other labels
    with ``low * positive_score <= 100 * negative_score <= high * positive_score``. Scores are inner products of
    floor(``scale`` * component), higher ones first, ties by smaller id.

    Rows whose id, label or vector is null, or that hold a null or non-finite component, take no part. Of rows that share
    an id one takes part, the least by width, label and components. Vectors of different widths have no score, those
    without components have 0. Scores beyond 64 bits count as the least or greatest long. Only ``vec_id``, ``label`` and
    ``embedding`` are read; an empty table, or one without anchors, gives no rows.
    """
    spark = prepare(vectors.sparkSession)
    rows = _rows(vectors, F.col("label") if label is None else label, scale)
    count, width = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("v")), F.lit(0))).first()
    groups = int(max(1, -(-width // GROUP_BYTES), min(partitions(spark), count // BLOCK)))
    file = _file(rows, groups)
    chosen = rows.withColumnRenamed("id", "vec_id").filter(anchors).withColumnRenamed("vec_id", "id")
    near = _searched(file, chosen, groups, [], _positives(positives), _POSITIVE_DDL)
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = materialize(near.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= positives).drop("r"), "positives")
    wanted = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # few rows each
    asked = chosen.join(wanted, chosen.id == wanted.anchor_id).drop("anchor_id")
    far = _searched(file, asked, groups, ["positives"], _negatives(negatives, low, high), _NEGATIVE_DDL)
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    return far.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def shifted() -> Column:
    """The labels of the registered query: every seventh row has the next of ten."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
