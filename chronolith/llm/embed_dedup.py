"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets, and verification in double precision.

1. Equal vectors form a class; its smallest id goes on.
2. Classes are hashed into ``tables`` tables, each into its own bucket and the next nearest ones (``codes``). The depth
   follows the number of classes, so that buckets stay small at any size.
3. Tight groups: a class within half the linking angle of the smallest id of one of its buckets joins that centre's
   group. Any two members of a group are within the linking angle, so a crowd of near copies needs no pairs.
4. Groups that meet in a bucket are candidates if two of their members may be close enough by their 8-bit forms: each
   comes with the length of what rounding took from it, which bounds how far their product may be off. In a bucket the
   members of its main group are not compared with each other; the others meet its blocks and each other's.
5. A candidate pair of groups is settled by the angle of its centres where the members' spread allows; otherwise the
   members are compared, block by block, and only counted.
6. Components of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import discard, lean, materialize, prepare, runs
from chronolith.llm.components import components
from chronolith.llm.crosspolytope import codes, tables_for

#: Probes by depth of hashing.
PROBES = {1: 4, 2: 4, 3: 8, 4: 16}
#: The chance that a pair at the threshold shares no bucket; the number of tables follows from it.
MISS = 1e-6
#: Classes in a bucket on average, at most.
FILL = 4
BLOCK = 512
#: Angles that are settled by bounds keep this distance from the threshold, in radians.
MARGIN = 1e-6


def _vectors(rows: pa.RecordBatch) -> Iterator[tuple[int, int | None, bytes | None, int, int]]:
    """(vec_id, width, unit vector or None, fingerprint halves); None where a vector links with nothing."""
    for vec_id, v in zip(rows.column("vec_id").to_pylist(), rows.column("embedding"), strict=True):
        unit, a, b, width = None, 0, 0, 0
        if v.is_valid and vec_id is not None and v.values.null_count == 0 and len(v.values):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            if np.isfinite(x).all():
                x = x / np.abs(x).max() if x.any() else x
                norm = math.sqrt(float(x @ x))
                if norm > 0:
                    unit, width = (x / norm).astype("<f8").tobytes(), len(x)
                    mark = xxhash.xxh3_128_intdigest(unit)
                    a, b = (int(np.uint64(h).astype(np.int64)) for h in (mark >> 64, mark & 0xFFFFFFFFFFFFFFFF))
        yield vec_id, width, unit, a, b


def _units(vectors: DataFrame) -> DataFrame:
    names = ["vec_id", "width", "v", "a", "b"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*_vectors(batch), strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, width int, v binary, a long, b long")


def _small(x: np.ndarray) -> list[bytes]:
    """Unit vectors in 8 bits: step, length of the rounding error (both rounded up), components in steps."""
    step = (np.abs(x).max(axis=1, keepdims=True) / 127).astype("<f4")
    q = np.clip(np.rint(x / step), -127, 127).astype(np.int8)
    error = np.linalg.norm(x - q * step.astype(np.float64), axis=1, keepdims=True)
    head = np.concatenate([step, (error * (1 + 1e-6) + 1e-7).astype("<f4")], axis=1).view(np.uint8)
    return [r.tobytes() for r in np.concatenate([head, q.view(np.uint8)], axis=1)]


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)


def _rough(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What ``_small`` made: the rounded vectors, and the lengths of their errors."""
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
    head = np.ascontiguousarray(raw[:, :8]).view("<f4")
    return np.ascontiguousarray(raw[:, 8:]).view(np.int8).astype(np.float32) * head[:, :1], head[:, 1]


def _at_most(product: np.ndarray, e: np.ndarray, f: np.ndarray, width: int) -> np.ndarray:
    """The cosine that rounded vectors with this product and these errors can have at most: with x = a + d, y = b + g
    the rest a.g + d.b + d.g is no longer than (1+e)f + e(1+f) + ef; single precision adds its own."""
    return product + (e + f + 3 * e * f) + np.float32(1e-5 + 1e-7 * width)


def _entries(classes: DataFrame, depth: int, tables: int) -> DataFrame:
    probes = PROBES[depth]
    names = ["key", "rep", "own", "q"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, blobs = np.array(batch.column("rep").to_pylist(), np.int64), batch.column("v").to_pylist()
            widths = np.array([len(b) for b in blobs])
            for w in np.unique(widths):
                at = np.flatnonzero(widths == w)
                x = _matrix([blobs[i] for i in at])
                number = codes(x, tables, depth, probes)
                first = np.ones(number.shape, bool)
                for p in range(1, probes):
                    first[:, :, p] = (number[:, :, p : p + 1] != number[:, :, :p]).all(axis=2)
                key = number + (np.arange(tables) << 56)[None, :, None] + (int(w) & 0xFFF) * (1 << 44)
                row, _, p = np.nonzero(first)
                q = pa.array(_small(x), pa.binary()).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(reps[at][row]), pa.array(p == 0), q], names)

    return classes.select("rep", "v").mapInArrow(run, "key long, rep long, own boolean, q binary")


def _by_width(a: list[bytes], b: list[bytes]) -> Iterator[np.ndarray]:
    """Places of pairs of equal width, a width at a time."""
    x, y = np.array([len(v) for v in a]), np.array([len(v) for v in b])
    for w in np.unique(x[x == y]):
        yield np.flatnonzero((x == w) & (y == w))


def _close(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs ``rep, centre`` whose cosine may reach ``least`` by their 8-bit forms."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("q").to_pylist(), batch.column("cq").to_pylist()
            keep = np.zeros(batch.num_rows, bool)
            for at in _by_width(x, y):
                (a, e), (b, f) = _rough([x[i] for i in at]), _rough([y[i] for i in at])
                keep[at] = _at_most(np.einsum("ij,ij->i", a, b), e, f, a.shape[1]) >= least
            yield batch.select(["rep", "centre"]).filter(pa.array(keep))

    return pairs.select("rep", "centre", "q", "cq").mapInArrow(run, "rep long, centre long")


def _cosines(pairs: DataFrame) -> DataFrame:
    """``x, y, cosine`` of pairs with their vectors ``vx, vy``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("vx").to_pylist(), batch.column("vy").to_pylist()
            c = np.full(batch.num_rows, -1.0)
            for at in _by_width(x, y):
                c[at] = np.einsum("ij,ij->i", _matrix([x[i] for i in at]), _matrix([y[i] for i in at]))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(c)], ["x", "y", "cosine"])

    return pairs.select("x", "y", "vx", "vy").mapInArrow(run, "x long, y long, cosine double")


def _dealt(entries: DataFrame) -> DataFrame:
    """``key, kind, i, j, grp, own, q``: the entries of buckets that hold several groups, in comparable blocks.

    Kind 0 brings a block of the main group (the one with most entries) together with a block of the others, kind 1 two
    blocks of the others. A bucket of near copies with some strays makes rows in proportion to its size.
    """
    per_group = entries.groupBy("key", "grp").agg(F.count("*").alias("n"))
    per_key = per_group.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("m"), F.max_by("grp", F.struct("n", -F.col("grp"))).alias("major"), F.count("*").alias("groups")).filter("groups > 1")
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("long")
    sized = entries.join(per_key.select("key", "major", blocks(F.col("m")).alias("g"), blocks(F.col("n") - F.col("m")).alias("s")), "key")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    columns = ["key", "kind", "i", "j", "grp", "own", "q"]
    main, stray = sized.filter("grp = major"), sized.filter("grp <> major")
    inner = main.withColumns({"kind": F.lit(0), "i": block("g"), "j": upto("s")}).select(*columns)
    outer = stray.withColumns({"kind": F.lit(0), "j": block("s"), "i": upto("g")}).select(*columns)
    pairs = stray.filter("s > 1").withColumns({"kind": F.lit(1), "b": block("s"), "o": upto("s")}).withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).select(*columns)
    return inner.union(outer).union(pairs)


def _candidates(entries: DataFrame, least: float) -> DataFrame:
    """Pairs of groups ``x < y`` of which two members meet in a bucket and may be close."""
    rows = _dealt(entries).repartition("key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for _, members in runs(batches, 4):
            group = np.array([m[0] for m in members])
            if group.min() == group.max():
                continue
            own = np.array([m[1] for m in members])
            x, e = _rough([m[2] for m in members])
            near = (_at_most(x @ x.T, e[:, None], e[None, :], x.shape[1]) >= least) & (own[:, None] | own[None, :]) & (group[:, None] < group[None, :])
            i, j = np.nonzero(near)
            found.update(zip(group[i].tolist(), group[j].tolist(), strict=True))
            if len(found) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["x", "y"])
                found.clear()
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["x", "y"])

    return rows.mapInArrow(run, "x long, y long").distinct()


def _compared(pairs: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """Members of pairs of groups compared one by one: per member the vectors it links with in the other group."""
    blocks = members.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    sized = pairs.join(blocks.withColumnsRenamed({"grp": "x", "blocks": "bx"}), "x").join(blocks.withColumnsRenamed({"grp": "y", "blocks": "by"}), "y")
    dealt = sized.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bx") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("by") - 1)))
    placed = members.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).drop("blocks")
    one = dealt.join(placed, (dealt.x == placed.grp) & (dealt.i == placed.block)).select("x", "y", "i", "j", F.lit(0).alias("side"), "rep", "size", "v")
    two = dealt.join(placed, (dealt.y == placed.grp) & (dealt.j == placed.block)).select("x", "y", "i", "j", F.lit(1).alias("side"), "rep", "size", "v")
    rows = one.union(two).repartition("x", "y", "i", "j").sortWithinPartitions("x", "y", "i", "j", "side")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in runs(batches, 4):
            sides = [[r[1:] for r in found if r[0] == k] for k in (0, 1)]
            if not all(sides):
                continue
            linked = _matrix([r[2] for r in sides[0]]) @ _matrix([r[2] for r in sides[1]]).T >= cosine
            out: list[tuple[int, int, int]] = []
            for (own, other), grid in (((sides[0], sides[1]), linked), ((sides[1], sides[0]), linked.T)):
                sizes = np.array([r[1] for r in other])
                for k in np.flatnonzero(grid.any(axis=1)).tolist():
                    out.append((own[k][0], int(sizes[grid[k]].sum()), other[int(grid[k].argmax())][0]))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], ["rep", "links", "partner"])

    return rows.mapInArrow(run, "rep long, links long, partner long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, depth: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding``.

    Links are cosines of ``cosine`` or more (positive) between vectors of the same width. A vector that is null, empty,
    zero, or holds null or non-finite components, and one with a null id, links with nothing. Rows that repeat an id and
    a vector count as vectors of their own. Other columns are not read; an empty table gives no rows. ``depth`` follows
    the number of distinct vectors unless it is given.
    """
    prepare(vectors.sparkSession)
    rows = materialize(_units(vectors), "vectors")
    classes = rows.filter("v IS NOT NULL").groupBy("a", "b", "width").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.any_value("v").alias("v"))
    classes = materialize(classes, "vector-classes")
    shape = classes.agg(F.count("*").alias("n"), F.coalesce(F.max("width"), F.lit(2)).alias("w")).first()
    axes = 2 << max(1, (shape["w"] - 1).bit_length())
    depth = depth or next((k for k in PROBES if shape["n"] / axes**k <= FILL), max(PROBES))
    tables = tables_for(shape["w"], depth, PROBES[depth], cosine, MISS)
    entries = materialize(_entries(classes, depth, tables), "vector-entries")

    angle = math.acos(cosine)
    tight = math.cos(angle / 2 - MARGIN)
    centres = entries.filter("own").groupBy("key").agg(F.min_by(F.struct(F.col("rep").alias("centre"), F.col("q").alias("cq")), "rep").alias("c"), F.count("*").alias("n")).filter("n > 1").select("key", "c.*")
    met = _close(entries.join(centres, "key").filter("rep <> centre"), tight).groupBy("rep", "centre").agg(F.count("*").alias("votes"))
    chosen = met.groupBy("rep").agg(F.max_by("centre", F.struct("votes", -F.col("centre"))).alias("centre"))
    look = classes.select("rep", "v")
    with_vectors = chosen.join(look, "rep").select(F.col("rep").alias("x"), F.col("centre").alias("y"), F.col("v").alias("vx")).join(look.select(F.col("rep").alias("y"), F.col("v").alias("vy")), "y")
    joined = materialize(_cosines(with_vectors).filter(F.col("cosine") >= tight), "vector-groups")

    members = classes.join(joined.select(F.col("x").alias("rep"), F.col("y").alias("grp"), "cosine"), "rep", "left")
    members = members.select("rep", "size", "v", F.coalesce("grp", "rep").alias("grp"), F.coalesce("cosine", F.lit(1.0)).alias("cosine"))
    members = materialize(members, "vector-members")
    spread = F.when(F.max("cosine") >= 1.0, F.when(F.count("*") > 1, F.acos(F.least(F.min("cosine"), F.lit(1.0)))).otherwise(0.0)).otherwise(F.acos(F.least(F.min("cosine"), F.lit(1.0))))
    groups = members.groupBy("grp").agg(F.sum("size").alias("weight"), spread.alias("spread"))
    groups = materialize(groups.join(look.withColumnRenamed("rep", "grp"), "grp"), "vector-centres")

    pairs = _candidates(entries.join(members.select("rep", "grp"), "rep"), cosine)
    left = groups.select(F.col("grp").alias("x"), F.col("v").alias("vx"))
    right = groups.select(F.col("grp").alias("y"), F.col("v").alias("vy"))
    measured = _cosines(pairs.join(left, "x").join(right, "y"))
    for side in ("x", "y"):
        own = groups.select(F.col("grp").alias(side), F.col("spread").alias(f"s{side}"), F.col("weight").alias(f"w{side}"))
        measured = measured.join(own, side)
    between = F.acos(F.greatest(F.least("cosine", F.lit(1.0)), F.lit(-1.0)))
    reach = F.col("sx") + F.col("sy")
    verdict = (
        F.when(reach == 0, F.when(F.col("cosine") >= cosine, 1).otherwise(0))
        .when(between + reach <= angle - MARGIN, 1)
        .when(between - reach > angle + MARGIN, 0)
        .otherwise(2)
    )
    settled = materialize(measured.withColumn("verdict", verdict), "vector-pairs")
    discard(entries)
    all_linked = settled.filter("verdict = 1")
    compared = materialize(_compared(settled.filter("verdict = 2").select("x", "y"), members, cosine), "vector-compared")

    per_group = all_linked.select(F.col("x").alias("grp"), F.col("wy").alias("more")).union(all_linked.select("y", "wx")).groupBy("grp").agg(F.sum("more").alias("more"))
    per_rep = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    links = (
        joined.select(F.col("x").alias("a"), F.col("y").alias("b"))
        .union(all_linked.select("x", "y"))
        .union(compared.select("rep", "partner"))
    )
    comps = components(links)
    counted = (
        members.select("rep", "grp")
        .join(groups.select("grp", "weight"), "grp")
        .join(per_group, "grp", "left")
        .join(per_rep, "rep", "left")
        .join(comps, F.col("rep") == comps.node, "left")
        .select("rep", (F.col("weight") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    named = classes.select("a", "b", "width", "rep").join(counted, "rep").drop("rep")
    out = rows.drop("v").join(named, ["a", "b", "width"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
