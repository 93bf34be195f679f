"""Connected components as DataFrame rounds: large stars, then small stars, until nothing changes (Kiveris et al. 2014).

Every round only joins edges with the least neighbour of their end, an aggregate with map-side sums; a node with very
many edges makes a skewed join, which adaptive execution splits. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import discard, materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a``, ``b``, longs): the least node it reaches.

    Loops, repeated links and links in both directions are allowed; nulls are ignored; no links give no rows.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "components")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
        after = materialize(_small(_large(edges)), "components")
        discard(edges)
        edges = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
