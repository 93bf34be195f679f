"""A Merkle manifest of a table: a tree a group, a root over the groups, and a proof for every row.

1. Leaves are hashed by SQL functions, numbered within their group by a range sort, and dealt out in blocks of ``SPAN``
   consecutive nodes. A task reduces a block at a time to one node.
2. While more than ``TOP`` nodes are left, they are dealt out and reduced again; groups of one node each are numbered in
   one sequence. The driver only builds the tree of the last ``TOP`` nodes.
3. What leads from each of these nodes to the root (its suffix path) is broadcast, at most some 12 MB. Tasks add the paths
   inside their blocks, downwards round by round, hash every row's proof and fold it.

A run of ``ARITY`` consecutive nodes, the last one shorter, is hashed to one node of the level above while a level has
more than one node. Digests are lower-case hexadecimal text, and nodes hash the texts of their children end to end.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import lean, materialize, partitions, prepare, runs

ARITY = 8
#: Levels that are built inside a block, and nodes of a full block.
LEVELS = 4
SPAN = ARITY**LEVELS
#: Nodes that the driver builds the top of the tree from.
TOP = 4096
#: Rows of one range of the sort; a row has some 90 bytes.
RANGE_ROWS = 2_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Path = list[tuple[str, str]]


def hashed(parts: str) -> str:
    return hashlib.sha256(parts.encode("ascii")).hexdigest()


def leaf(columns: dict[str, Column] | tuple[str, ...]) -> Column:
    """The digest of a row's fields in turn: each its UTF-8 bytes, a colon and its value, or ``-`` where it is null."""
    fields = columns.values() if isinstance(columns, dict) else [F.col(f"`{c}`") for c in columns]
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def levels_above(n: int) -> int:
    """Levels between ``n`` nodes and their root."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def climbed(digests: list[str], levels: int) -> list[list[str]]:
    """The digests and the levels above them."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([hashed("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return out


def siblings(level: list[str], i: int) -> tuple[str, str]:
    """The other digests of node ``i``'s run, left and right of it."""
    begin = i - i % ARITY
    return "".join(level[begin:i]), "".join(level[i + 1 : begin + ARITY])


def folded(digest: str, path: Path) -> str:
    for left, right in path:
        digest = hashed(left + digest + right)
    return digest


def _placed(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``nodes`` (a table) with ``pos``, the place in the group, and ``n``, the nodes of the group. Equal rows may stand in
    any order, so the row's place in the table ends the sort key and a crowd of them is spread."""
    spark = nodes.sparkSession
    ranges = max(partitions(spark), nodes.count() // RANGE_ROWS)
    keyed = nodes.withColumn("row", F.monotonically_increasing_id())
    by = [group, *order, "row"]
    ranged = keyed.repartitionByRange(ranges, *by).sortWithinPartitions(*by).drop("row")
    ranged = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")  # range << 33, then place
    part = F.shiftright("at", 33)
    counts = ranged.groupBy(F.col(group).alias("g"), part.alias("p")).agg(F.count("*").alias("c"), F.min("at").alias("first"))
    whole = Window.partitionBy("g")
    before = whole.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("g", "p", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"), F.sum("c").over(whole).alias("n"))
    out = ranged.join(counts, F.col(group).eqNullSafe(F.col("g")) & (part == F.col("p")))
    return out.select(*nodes.columns, (F.col("at") - F.col("first") + F.col("base")).alias("pos"), "n")


_BLOCK_DDL = "grp string, block long, n long, ids array<long>, digests array<binary>, others array<binary>, top binary"


def _reduced(nodes: DataFrame, rows: int) -> DataFrame:
    """A row a block of ``nodes`` (``grp, pos, n, id, digest, other``; so many rows), with its node ``LEVELS`` above, or
    less where the group ends before. ``n`` is the group's number of nodes."""
    spark = nodes.sparkSession
    keyed = nodes.select("grp", F.floor(F.col("pos") / SPAN).alias("block"), "n", "pos", "id", "digest", "other")
    dealt = keyed.repartition(max(partitions(spark), rows // RANGE_ROWS), "grp", "block").sortWithinPartitions("grp", "block", "pos")
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary()]
    names = [x.split()[0] for x in _BLOCK_DDL.split(", ")]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp, block, n), rows in runs(batches, 3):
            _, ids, digests, others = (list(c) for c in zip(*rows, strict=True))
            (top,) = climbed([d.hex() for d in digests], min(LEVELS, levels_above(n)))[-1]
            row = [grp, block, n, ids, digests, others, bytes.fromhex(top)]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    return materialize(dealt.mapInArrow(run, _BLOCK_DDL), "merkle-blocks")


def _tops(blocks: DataFrame) -> DataFrame:
    n = F.ceil(F.col("n") / SPAN)
    return blocks.select("grp", F.col("block").alias("pos"), n.alias("n"), F.lit(None).cast("long").alias("id"), F.col("top").alias("digest"), F.lit(None).cast("binary").alias("other"))


_PATH_DDL = "grp string, pos long, lefts array<string>, rights array<string>, subroot string, root string"


def top_paths(nodes: list[tuple[str | None, int, str]]) -> list[tuple]:
    """The suffix path of every (group, place, digest): rows of ``_PATH_DDL``."""
    trees: dict[str | None, list[str]] = {}
    for grp, _, digest in sorted(nodes, key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1])):
        trees.setdefault(grp, []).append(digest)
    inside = {grp: climbed(own, levels_above(len(own))) for grp, own in trees.items()}
    over = climbed([levels[-1][0] for levels in inside.values()], levels_above(len(inside)))
    out = []
    for k, (grp, levels) in enumerate(inside.items()):
        upper = [siblings(level, k // ARITY**j) for j, level in enumerate(over[:-1])]
        for i in range(len(levels[0])):
            path = [siblings(level, i // ARITY**j) for j, level in enumerate(levels[:-1])] + upper
            out.append((grp, i, [a for a, _ in path], [b for _, b in path], levels[-1][0], over[-1][0]))
    return out


def _suffixes(nodes: DataFrame) -> DataFrame:
    """The path from every node to the root; ``nodes`` as ``_tops`` yields them, one row a block of the round below."""
    spark = nodes.sparkSession
    count = nodes.count()
    if count <= TOP:
        rows = top_paths([(r.grp, r.pos, bytes(r.digest).hex()) for r in nodes.select("grp", "pos", "digest").collect()])
        return F.broadcast(spark.createDataFrame(rows, _PATH_DDL))  # at most TOP rows
    if nodes.filter("n > 1").isEmpty():  # one node a group: their order is a sequence of its own
        heads = materialize(nodes.select(F.lit("").alias("seq"), "grp", "digest"), "merkle-groups")
        placed = _placed(heads, "seq", ["grp"])
        blocks = _reduced(placed.select(F.lit(None).cast("string").alias("grp"), "pos", "n", F.lit(None).cast("long").alias("id"), "digest", F.encode("grp", "utf-8").alias("other")), count)
        return _expanded(blocks, _suffixes(_tops(blocks)), whole_groups=True)
    blocks = _reduced(nodes, count)
    return _expanded(blocks, _suffixes(_tops(blocks)))


def _joined(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    paths = paths.withColumnsRenamed({"grp": "g", "pos": "p"})
    return blocks.join(paths, F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("p"))).drop("g", "p")


def _expanded(blocks: DataFrame, paths: DataFrame, whole_groups: bool = False) -> DataFrame:
    """The paths of the members of blocks. ``whole_groups``: each is a group's subroot, the group's name its ``other``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                levels = climbed([d.hex() for d in r["digests"]], min(LEVELS, levels_above(r["n"])))
                out = []
                for i, (digest, other) in enumerate(zip(levels[0], r["others"], strict=True)):
                    path = [siblings(level, i // ARITY**j) for j, level in enumerate(levels[:-1])]
                    key = (None if other is None else other.decode("utf-8"), 0) if whole_groups else (r["grp"], r["block"] * SPAN + i)
                    out.append((*key, [a for a, _ in path] + r["lefts"], [b for _, b in path] + r["rights"], digest if whole_groups else r["subroot"], r["root"]))
                kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _PATH_DDL.split(", ")])

    return _joined(blocks, paths).mapInArrow(run, _PATH_DDL)


_MANIFEST_DDL = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, changed: Column | None = None, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id") -> DataFrame:
    """``doc_id`` (the ``order`` column), ``leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``changed`` is a leaf to fold in the row's place with the siblings of the unchanged table (null: the row's own), as
    a reader of a tampered copy would. Null fields are marked as such; a null group is a group, the first; rows with a null
    ``order`` come first in their group, and equal ones are ordered by their leaves, so repeated rows are leaves as often as
    they come; texts of any length are hashed whole; only ``fields``, ``group`` and ``order`` are read; an empty table has
    no rows and no root.
    """
    prepare(docs.sparkSession)
    changed = F.lit(None).cast("string") if changed is None else changed
    leaves = docs.select(F.col(f"`{group}`").cast("string").alias("grp"), F.col(f"`{order}`").cast("long").alias("id"), F.unhex(leaf(fields)).alias("digest"), F.unhex(changed).alias("other"))
    leaves = materialize(leaves, "merkle-leaves")
    blocks = _reduced(_placed(leaves, "grp", ["id", "digest"]), leaves.count())
    names, kinds = [x.split()[0] for x in _MANIFEST_DDL.split(", ")], [pa.int64(), *[pa.string()] * 5, pa.bool_()]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                levels = climbed([d.hex() for d in r["digests"]], min(LEVELS, levels_above(r["n"])))
                suffix = list(zip(r["lefts"], r["rights"], strict=True))
                above: dict[int, tuple[Path, bytes]] = {}  # what a run's members share: the path from their parent on
                out = []
                for i, (own, other) in enumerate(zip(levels[0], r["others"], strict=True)):
                    first = [siblings(levels[0], i)] if len(levels) > 1 else []
                    parent = i // ARITY
                    if parent not in above:
                        shared = [siblings(level, parent // ARITY**j) for j, level in enumerate(levels[1:-1])] + suffix
                        above[parent] = shared, "".join(a + b for a, b in shared).encode("ascii")
                    shared, tail = above[parent]
                    proof = hashlib.sha256("".join(a + b for a, b in first).encode("ascii"))
                    proof.update(tail)
                    root = folded(folded(own if other is None else other.hex(), first), shared)
                    out.append((r["ids"][i], own, r["subroot"], r["root"], proof.hexdigest(), root, root == r["root"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return _joined(blocks, _suffixes(_tops(blocks))).mapInArrow(run, _MANIFEST_DDL)


def lowered(text: str) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def tampered(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, folded from a copy in which A-Z of the texts of every third row, by the unsigned crc32 of
    its decimal ``doc_id``, are lower-cased. Rows with a null id are as they were. See ``manifest`` for odd rows."""
    fields = {c: F.col(c) for c in FIELDS} | {"text": lowered("text")}
    return manifest(docs, F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(fields)))
