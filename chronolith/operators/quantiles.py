"""Exact quantiles of groups of any size: no group is gathered.

A sketch of every group gives two values between which a quantile lies for certain, but for one neighbour. A second pass
counts what lies below the two, and the distinct values between them, which are a few of each ten thousand.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of the sketch: ranks are off by 1 / ACCURACY of a group at most.
ACCURACY = 10_000
_MARGIN = 3 / ACCURACY


def exact(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float, str]]) -> DataFrame:
    """``keys`` and a column a quantile: ``wanted`` maps its name to (column, p, kind). ``linear`` lies between the values
    next to rank (n - 1) * p, ``nearest`` is the value at the rank rounded half up. Nulls are left out; a group without
    values has null."""
    names = list(wanted)
    columns = sorted({c for c, _, _ in wanted.values()})
    ps = {c: sorted({p for d, p, _ in wanted.values() if d == c}) for c in columns}
    ends = lambda c: F.array(*[F.lit(float(min(1, max(0, p + m)))) for p in ps[c] for m in (-_MARGIN, _MARGIN)])
    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    sketch = rows.groupBy(*keys).agg(*[F.count(c).alias(f"__n_{c}") for c in columns], *[F.percentile_approx(c, ends(c), F.lit(ACCURACY)).alias(f"__e_{c}") for c in columns])
    sketch = sketch.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(F.col(f"__k_{k}"))
    placed = rows.join(sketch, same).drop(*[f"__k_{k}" for k in keys])

    def bracket(name: str) -> tuple[Column, Column]:
        c, p, _ = wanted[name]
        at = 2 * ps[c].index(p)
        return F.col(f"__e_{c}")[at], F.col(f"__e_{c}")[at + 1]

    measures, between = [], []
    for i, name in enumerate(names):
        c, p, kind = wanted[name]
        low, high = bracket(name)
        v = F.col(c)
        h = (F.col(f"__n_{c}") - 1) * F.lit(float(p))
        rank = h if kind == "linear" else F.round(h)
        measures += [F.count(F.when(v < low, 1)).alias(f"below_{i}"), F.max(F.when(v < low, v)).alias(f"left_{i}"), F.min(F.when(v > high, v)).alias(f"right_{i}"), F.max(rank).alias(f"rank_{i}")]
        between.append(F.when(v.between(low, high), F.struct(F.lit(i).alias("i"), v.alias("v"))))
    counts = placed.groupBy(*keys).agg(*measures)
    held = placed.select(*keys, F.inline(F.filter(F.array(*between), lambda x: x.isNotNull()))).groupBy(*keys, "i", "v").agg(F.count("*").alias("n"))
    held = held.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "i").orderBy("v")))
    held = held.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & counts[k].eqNullSafe(F.col(f"__k_{k}"))
    joined = counts.join(held, same, "left")

    made = []
    for i in range(len(names)):
        below, own = F.col(f"below_{i}"), F.col("i") == i

        def at(rank: Column, i: int = i, below: Column = below, own: Column = own) -> Column:
            """The value at a rank, from 0: between the bracket's ends, or next to them."""
            inside = F.min(F.when(own & (F.col("upto") + below > rank), F.col("v")))
            return F.when(F.max(rank) < F.max(below), F.max(f"left_{i}")).otherwise(F.coalesce(inside, F.max(f"right_{i}")))

        rank = F.col(f"rank_{i}")
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        made.append(F.when(F.max(rank) >= 0, low + (high - low) * F.max(rank - F.floor(rank))).alias(names[i]))
    return joined.groupBy(*keys).agg(*made)
