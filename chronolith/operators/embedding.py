"""Low-dimensional views of daily features: masked scaling, principal components, an autoencoder, neighbour maps."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("subject_id", "date")
#: Rows of a map that the driver makes by itself; most points of a block of a larger one's attractions.
ALONE, BLOCK = 20_000, 50_000


def selected(train: DataFrame, columns: Sequence[str], least: float = 0.3) -> list[str]:
    """Columns set in at least a share of the training rows."""
    shares = train.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns]).first().asDict()
    return [c for c in columns if (shares[c] or 0) >= least]


def standardizer(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``subject_id, feature, median, mean, scale`` by subject, with the global values under a null subject.

    A scale of 1e-12 or less becomes 1; a feature without any value has median and mean 0 and scale 1.
    """
    long = train.select("subject_id", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot("subject_id", list(columns), "feature", "v")
    measures = [F.median("v").alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale")]
    whole = long.groupBy("feature").agg(*measures).select(F.lit(None).cast("string").alias("subject_id"), "feature", F.coalesce("median", F.lit(0.0)).alias("median"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.when(F.col("scale") > 1e-12, F.col("scale")).otherwise(1.0).alias("scale"))
    own = long.groupBy("subject_id", "feature").agg(*measures)
    back = whole.select("feature", *[F.col(c).alias(f"g_{c}") for c in ("median", "mean", "scale")])
    scale = F.coalesce("scale", "g_scale")
    own = own.join(F.broadcast(back), "feature").select("subject_id", "feature", F.coalesce("median", "g_median").alias("median"), F.coalesce("mean", "g_mean").alias("mean"), F.when(scale > 1e-12, scale).otherwise(1.0).alias("scale"))
    return own.unionByName(whole)


def standardized(df: DataFrame, stats: DataFrame, columns: Sequence[str], mask: bool = False) -> DataFrame:
    """Columns imputed by the subject's median and scaled; subjects unseen in training use the global values."""
    table = stats.groupBy("subject_id").pivot("feature", list(columns)).agg(F.first(F.struct("median", "mean", "scale")))
    own = table.filter("subject_id IS NOT NULL").select("subject_id", *[F.col(f"`{c}`").alias(f"__o_{c}") for c in columns])
    back = table.filter("subject_id IS NULL").select(*[F.col(f"`{c}`").alias(f"__g_{c}") for c in columns])
    out = df.join(own, "subject_id", "left").crossJoin(F.broadcast(back))
    if mask:
        out = out.withColumns({f"observed__{c}": F.col(c).isNotNull().cast("double") for c in columns})
    stat = lambda c: F.coalesce(F.col(f"__o_{c}"), F.col(f"__g_{c}"))
    made = {c: (F.coalesce(F.col(c).cast("double"), stat(c)["median"]) - stat(c)["mean"]) / stat(c)["scale"] for c in columns}
    return out.withColumns(made).drop(*[f"__{k}_{c}" for k in "og" for c in columns])


def pca(scaled: DataFrame, columns: Sequence[str], k: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, loadings, explained shares). Signs are fixed: each component's largest loading is positive."""
    k = min(k, len(columns))
    means = np.array(scaled.agg(*[F.avg(c) for c in columns]).first(), np.float64)
    data = VectorAssembler(inputCols=list(columns), outputCol="x").transform(scaled)
    model = PCA(k=k, inputCol="x", outputCol="y").fit(data)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    return means, loadings * np.where(signs == 0, 1, signs), model.explainedVariance.toArray()


def project(scaled: DataFrame, columns: Sequence[str], means: np.ndarray, loadings: np.ndarray, prefix: str = "pca") -> DataFrame:
    """Keys and coordinates; the means are taken off first."""
    dot = lambda j: sum(((F.col(c) - F.lit(float(means[i]))) * F.lit(float(loadings[i, j])) for i, c in enumerate(columns)), F.lit(0.0))
    return scaled.select(*KEYS, *[dot(j).alias(f"{prefix}_{j + 1}") for j in range(loadings.shape[1])])


def reconstructed(scaled: DataFrame, columns: Sequence[str], means: np.ndarray, loadings: np.ndarray) -> DataFrame:
    """Keys and columns put together again from the components."""
    joint = loadings @ loadings.T
    back = lambda i: sum(((F.col(c) - F.lit(float(means[j]))) * F.lit(float(joint[j, i])) for j, c in enumerate(columns)), F.lit(float(means[i])))
    return scaled.select(*KEYS, *[back(i).alias(c) for i, c in enumerate(columns)])


def reconstruction_errors(scaled: DataFrame, rebuilt: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, rmse, mae, n`` over observed cells (``observed__*`` of ``scaled``), with the whole under ``all``."""
    both = scaled.select(*KEYS, *columns, *[f"observed__{c}" for c in columns]).join(rebuilt.select(*KEYS, *[F.col(c).alias(f"r__{c}") for c in columns]), list(KEYS))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.when(F.col(f"observed__{c}") > 0, F.col(c) - F.col(f"r__{c}")).alias("e")) for c in columns])
    long = both.select(F.inline(cells))
    measures = [F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"), F.count("e").alias("n")]
    return long.groupBy("feature").agg(*measures).unionByName(long.agg(*measures).select(F.lit("all").alias("feature"), "rmse", "mae", "n"))


def autoencoder(scaled: DataFrame, columns: Sequence[str], seed: int = 42, epochs: int = 200, patience: int = 15) -> dict[str, np.ndarray]:
    """A denoising autoencoder with three latent units, trained in mini-batches over every row, which the driver holds.

    Input is the scaled columns and their masks; three noisy copies with 15 % of cells dropped; hidden layers (w, 3, w),
    Adam, early stopping on a tenth of the rows.
    """
    names = [*columns, *[f"observed__{c}" for c in columns]]
    x = scaled.select(*names).orderBy(F.xxhash64(*KEYS)).toPandas().to_numpy(np.float64)
    rng = np.random.default_rng(seed)
    p = len(columns)
    w = int(np.clip(2 * p, 8, 64))
    dropped = np.stack([rng.random((len(x), p)) < 0.15 for _ in range(3)]).reshape(-1, p)

    def noisy(copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, drop = x[copies % len(x)], dropped[copies]
        return np.hstack([np.where(drop, 0.0, rows[:, :p]), rows[:, p:] * ~drop]), rows[:, :p]

    sizes = [2 * p, w, 3, w, p]
    net = {}
    for i, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
        net[f"w{i}"], net[f"b{i}"] = rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    order = rng.permutation(len(dropped))
    held, fitted = order[: max(1, len(order) // 10)], order[max(1, len(order) // 10) :]
    best, kept, waited, step = np.inf, net, 0, 0
    for _ in range(epochs):
        rng.shuffle(fitted)
        for batch in np.array_split(fitted, max(1, len(fitted) // 200)):
            data, goal = noisy(batch)
            acts = forward(net, data)
            grad = 2 * (acts[-1] - goal) / max(1, acts[-1].size)
            step += 1
            for i in range(3, -1, -1):
                gw, gb = acts[i].T @ grad, grad.sum(axis=0)
                if i:
                    back = (grad @ net[f"w{i}"].T) * (acts[i] > 0)
                for name, g in ((f"w{i}", gw), (f"b{i}", gb)):
                    m, v = moments[name]
                    m[...], v[...] = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    net[name] = net[name] - 1e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                if i:
                    grad = back
        parts = (noisy(part) for part in np.array_split(held, max(1, len(held) // 10_000)))
        loss = sum(float(((forward(net, data)[-1] - goal) ** 2).sum()) for data, goal in parts) / (len(held) * p)
        best, kept, waited = (loss, {k: v.copy() for k, v in net.items()}, 0) if loss < best - 1e-5 else (best, kept, waited + 1)
        if waited >= patience:
            break
    return kept


def forward(net: dict[str, np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    acts = [x]
    for i in range(4):
        z = acts[-1] @ net[f"w{i}"] + net[f"b{i}"]
        acts.append(z if i == 3 else np.maximum(z, 0))
    return acts


def latent(scaled: DataFrame, columns: Sequence[str], net: dict[str, np.ndarray], prefix: str = "ae") -> DataFrame:
    """Keys and the three latent activations of every row, batch by batch."""
    names = [*columns, *[f"observed__{c}" for c in columns]]

    def run(frames):
        for frame in frames:
            z = forward(net, frame[names].to_numpy(np.float64))[2]
            yield pd.concat([frame[list(KEYS)].reset_index(drop=True), pd.DataFrame(z, columns=[f"{prefix}_{k}" for k in (1, 2, 3)])], axis=1)

    return scaled.select(*KEYS, *names).mapInPandas(run, f"subject_id string, date date, {', '.join(f'{prefix}_{k} double' for k in (1, 2, 3))}")


#: Points of a leaf of the neighbour search, twice the neighbours asked for at least.
LEAF = 256


@dataclass
class Leaves:
    """Points in the order of a k-d tree's leaves: leaf ``t`` holds those from ``start[t]`` on, in a box of its own."""

    order: np.ndarray
    points: np.ndarray
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray


def leaves(x: np.ndarray, size: int = LEAF) -> Leaves:
    """Points halved by rank along their widest side until ``size`` or fewer are left; copies are dealt out too."""
    order, start, parts = np.arange(len(x)), [], [(0, len(x))]
    while parts:
        at, end = parts.pop()
        if end - at <= size:
            start.append(at)
            continue
        own, half = x[order[at:end]], (end - at) // 2
        order[at:end] = order[at:end][np.argpartition(own[:, np.ptp(own, axis=0).argmax()], half)]
        parts += [(at + half, end), (at, at + half)]
    points, start = x[order], np.array(start)
    return Leaves(order, points, np.append(start, len(x)), np.minimum.reduceat(points, start), np.maximum.reduceat(points, start))


def leaf_nearest(tree: Leaves, leaf: int, k: int, block_cells: int = 8_000_000) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest other points (by rank in the tree's order) of a leaf's points and their distances, nearest first.

    A point's ``k``-th distance within its leaf bounds the boxes that can hold nearer ones; all points of those are compared.
    """
    at, end = tree.start[leaf], tree.start[leaf + 1]
    n, own = len(tree.points), tree.points[at:end]
    gaps = ((own[:, None] - own[None]) ** 2).sum(axis=2)
    gaps[np.diag_indices(len(own))] = np.inf
    bound = np.sqrt(np.partition(gaps, k - 1, axis=1)[:, k - 1]) * (1 + 1e-9) if k < len(own) else np.full(len(own), np.inf)
    index, dist = np.empty((len(own), k), np.int64), np.empty((len(own), k))
    todo, step = np.argsort(bound, kind="stable"), 64
    while len(todo):
        rows = todo[:step]
        out = np.maximum(np.maximum(tree.low[None] - own[rows][:, None], own[rows][:, None] - tree.high[None]), 0)
        reached = (np.sqrt((out**2).sum(axis=2)) < bound[rows][:, None]).any(axis=0)
        reached[leaf] = True
        others = np.concatenate([np.arange(tree.start[t], tree.start[t + 1]) for t in np.flatnonzero(reached)])
        others = others[np.argsort(tree.order[others])]
        if len(rows) > 1 and len(rows) * len(others) > block_cells:
            step = max(1, block_cells // len(others))
            continue
        todo = todo[step:]
        d = np.zeros((len(rows), len(others)))
        for c in range(own.shape[1]):
            d += np.subtract.outer(own[rows, c], tree.points[others, c]) ** 2
        d[others[None] == at + rows[:, None]] = np.inf
        near = np.sort(np.argpartition(d, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(d, axis=1)[:, :k], axis=1)
        exact = np.sqrt(np.take_along_axis(d, near, axis=1))
        sorting = np.argsort(exact, axis=1, kind="stable")
        index[rows], dist[rows] = others[np.take_along_axis(near, sorting, axis=1)], np.take_along_axis(exact, sorting, axis=1)
    return index, dist


def nearest(x: np.ndarray, k: int, block_cells: int = 8_000_000, spark: SparkSession | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest other rows of every row and their distances, nearest first: exact, a leaf at a time, by Spark's
    tasks where a session is given."""
    tree = leaves(x, max(LEAF, 2 * k))
    count = len(tree.start) - 1
    if spark is None:
        found = (leaf_nearest(tree, t, k, block_cells) for t in range(count))
    else:
        sent = spark.sparkContext.broadcast(tree)
        found = spark.sparkContext.parallelize(range(count), min(count, 4 * spark.sparkContext.defaultParallelism)).map(lambda t: leaf_nearest(sent.value, t, k, block_cells)).collect()
        sent.destroy()
    index, dist = np.empty((len(x), k), np.int64), np.empty((len(x), k))
    for t, (i, d) in enumerate(found):
        rows = tree.order[tree.start[t] : tree.start[t + 1]]
        index[rows], dist[rows] = tree.order[i], d
    return index, dist


def repulsion(y: np.ndarray, nodes: int = 3, boxes: int = 20, direct: int = 1500) -> tuple[np.ndarray, float]:
    """Of every point, the sum of (y_i - y_j) / (1 + d^2)^2 over all others, and the sum of 1 / (1 + d^2) over all pairs.

    Up to ``direct`` points are summed pair by pair. Beyond, both are sums of one kernel, interpolated on a grid and
    convolved by Fourier transform (Linderman et al. 2019), so all points push all others in linear time.
    """
    n, low = len(y), y.min(axis=0)
    if n <= direct:
        a, b = y[:, :1] - y[None, :, 0], y[:, 1:] - y[None, :, 1]
        k = 1 / (1 + a * a + b * b)
        total = float(k.sum()) - n
        k *= k
        return np.stack([(a * k).sum(axis=1), (b * k).sum(axis=1)], axis=1), max(total, 1e-12)
    span = max(float((y.max(axis=0) - low).max()), 1e-12)
    boxes = max(boxes, math.ceil(span))
    boxes += -boxes % 10
    m, width = boxes * nodes, span / boxes
    h = width / nodes
    box = np.minimum((y - low) // width, boxes - 1).astype(np.int64)
    inside = (y - low - box * width) / h - 0.5
    weight = np.stack([np.prod([(inside - j) / (i - j) for j in range(nodes) if j != i], axis=0) for i in range(nodes)])
    charges = np.stack([np.ones(n), y[:, 0], y[:, 1], (y**2).sum(axis=1)])
    pairs = [(a, b, (box[:, 0] * nodes + a) * m + box[:, 1] * nodes + b, weight[a, :, 0] * weight[b, :, 1]) for a in range(nodes) for b in range(nodes)]
    grid = np.zeros((4, m * m))
    for _, _, cell, w in pairs:
        for c in range(4):
            grid[c] += np.bincount(cell, w * charges[c], m * m)
    size = 2 * m
    offset = np.minimum(np.arange(size), size - np.arange(size)) * h
    kernel = np.fft.rfft2((1 + offset[:, None] ** 2 + offset[None] ** 2) ** -2)

    def field_at_points(charge: np.ndarray) -> np.ndarray:
        field = np.fft.irfft2(np.fft.rfft2(charge.reshape(m, m), (size, size)) * kernel, (size, size))[:m, :m].ravel()
        return sum(field[cell] * w for _, _, cell, w in pairs)

    with ThreadPoolExecutor(4) as pool:
        felt = np.stack(list(pool.map(field_at_points, grid)))
    push = y * felt[0][:, None] - felt[1:3].T
    total = ((1 + charges[3]) * felt[0] - 2 * (y[:, 0] * felt[1] + y[:, 1] * felt[2]) + felt[3]).sum()
    held = np.stack([w for *_, w in pairs])
    apart = np.array([[(1 + ((a - c) ** 2 + (b - e) ** 2) * h * h) ** -2 for c, e, *_ in pairs] for a, b, *_ in pairs])
    total -= (held * (apart @ held)).sum()  # each point's interpolated pair with itself
    return push, max(float(total), 1e-12)


def affinities(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Each row's share of its neighbours, of the given perplexity, from their distances, nearest first."""
    d = d**2 - d[:, :1] ** 2
    n = len(d)
    low, high, beta = np.zeros((n, 1)), np.full((n, 1), np.inf), np.ones((n, 1))
    for _ in range(50):
        e = np.exp(-d * beta)
        q = e / e.sum(axis=1, keepdims=True)
        flat = -(q * np.log(q + 1e-300)).sum(axis=1, keepdims=True) > np.log(perplexity)
        low, high = np.where(flat, beta, low), np.where(flat, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return q


def edges_of(tree: Leaves, leaf: int, k: int, perplexity: float, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """A leaf's attractions, both ways, by the block of ``size`` points that they pull: rows of (point, other, share)."""
    near, d = leaf_nearest(tree, leaf, k)
    share = (affinities(d, perplexity) / (2 * len(tree.points))).ravel()
    here, there = np.repeat(np.arange(tree.start[leaf], tree.start[leaf + 1]), k), near.ravel()
    both = np.empty(2 * len(here), [("point", np.int32), ("other", np.int32), ("share", np.float64)])
    both["point"], both["other"], both["share"] = np.append(here, there), np.append(there, here), np.append(share, share)
    block = both["point"] // size
    both, block = both[(by := np.argsort(block, kind="stable"))], block[by]
    cuts = np.flatnonzero(np.diff(block)) + 1
    return zip(block[np.append(0, cuts)].tolist(), np.split(both, cuts), strict=True)


def packed(parts: Iterable[np.ndarray], first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's edges in the order of its points, both ways of a pair as one: edges a point, others, shares."""
    edges = np.concatenate(list(parts))
    edges = edges[np.lexsort((edges["share"], edges["other"], edges["point"]))]
    new = np.flatnonzero(np.append(True, (np.diff(edges["point"]) != 0) | (np.diff(edges["other"]) != 0)))
    return np.bincount(edges["point"][new] - first, minlength=last - first), edges["other"][new], np.add.reduceat(edges["share"], new)


def pulled(first: int, edges: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The attraction of a block's points by their neighbours, each has some, given the map so far."""
    count, other, share = edges
    last, at = first + len(count), np.cumsum(count) - count
    a, b = np.repeat(x[first:last], count) - x[other], np.repeat(y[first:last], count) - y[other]
    weight = share / (1 + a * a + b * b)
    return np.stack([np.add.reduceat(a * weight, at), np.add.reduceat(b * weight, at)], axis=1)


def tsne(x: np.ndarray, perplexity: float = 30.0, seed: int = 42, steps: int = 500, spark: SparkSession | None = None) -> np.ndarray:
    """t-SNE in two dimensions (van der Maaten, Hinton 2008) of all rows: attraction among the 3 * perplexity nearest
    (van der Maaten 2014), repulsion among all.

    With a session, neighbours are found and their attractions kept and summed by Spark's tasks; the driver holds rows,
    map and the grid of the repulsion."""
    n = len(x)
    if n < 3:
        raise ValueError("a map needs three rows")
    perplexity = min(perplexity, max(2.0, (n - 1) / 3))
    k = min(n - 1, math.ceil(3 * perplexity))
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, 2))
    if spark is None:
        near, d = nearest(x, k)
        p = affinities(d, perplexity) / (2 * n)

        def pull(y: np.ndarray) -> np.ndarray:
            gap = y[:, None] - y[near]
            gap *= (p / (1 + (gap**2).sum(axis=2)))[:, :, None]
            return gap.sum(axis=1) - np.stack([np.bincount(near.ravel(), gap[:, :, c].ravel(), n) for c in (0, 1)], axis=1)

        return _descended(y, pull, steps)
    sc, tree = spark.sparkContext, leaves(x, max(LEAF, 2 * k))
    count, size = len(tree.start) - 1, min(BLOCK, math.ceil(n / sc.defaultParallelism))
    sent = sc.broadcast(tree)
    found = sc.parallelize(range(count), min(count, 4 * sc.defaultParallelism)).flatMap(lambda t: edges_of(sent.value, t, k, perplexity, size))
    kept = found.groupByKey(math.ceil(n / size), int).map(lambda b: (b[0] * size, packed(b[1], b[0] * size, min(n, (b[0] + 1) * size)))).persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    sent.destroy()

    def pull(y: np.ndarray) -> np.ndarray:
        now = sc.broadcast((y[:, 0].copy(), y[:, 1].copy()))
        parts = kept.map(lambda b: (b[0], pulled(*b, *now.value))).collect()
        now.destroy()
        return np.concatenate([v for _, v in sorted(parts, key=lambda b: b[0])])

    out = np.empty_like(y)
    out[tree.order] = _descended(y[tree.order], pull, steps)
    kept.unpersist()
    return out


def _descended(y: np.ndarray, pull: Callable[[np.ndarray], np.ndarray], steps: int) -> np.ndarray:
    """The map after gradient descent with momentum and gains from a start; ``pull`` gives the attraction, beside the
    repulsion."""
    speed, gain, rate = np.zeros_like(y), np.ones_like(y), max(200.0, len(y) / 48)
    with ThreadPoolExecutor(1) as beside:
        for t in range(steps):
            pulling = beside.submit(pull, y)
            push, total = repulsion(y)
            grad = 4 * ((12 if t < 100 else 1) * pulling.result() - push / total)
            gain = np.maximum(np.where(np.sign(grad) != np.sign(speed), gain + 0.2, gain * 0.8), 0.01)
            speed = (0.5 if t < 250 else 0.8) * speed - rate * gain * grad
            y = y + speed - (y + speed).mean(axis=0)
    return y


def _spectral(rows: np.ndarray, cols: np.ndarray, weight: np.ndarray, n: int, rng: np.random.Generator, steps: int = 200) -> np.ndarray:
    """The second and third eigenvectors of a graph's normalised Laplacian, by subspace iteration."""
    add = lambda v: np.bincount(rows, weight * v[cols], n) + np.bincount(cols, weight * v[rows], n)
    degree = np.sqrt(np.maximum(add(np.ones(n)), 1e-12))
    walk = lambda v: (v + add(v / degree) / degree) / 2
    q = np.linalg.qr(np.column_stack([degree, rng.normal(size=(n, min(n, 8) - 1))]))[0]
    for _ in range(steps):
        q = np.linalg.qr(np.column_stack([walk(v) for v in q.T]))[0]
    values, turn = np.linalg.eigh(q.T @ np.column_stack([walk(v) for v in q.T]))
    return (q @ turn)[:, np.argsort(-values, kind="stable")[1:3]]


def added(at: np.ndarray, moves: np.ndarray, n: int) -> np.ndarray:
    """Moves in the plane summed by row."""
    return np.stack([np.bincount(at, moves[:, c], n) for c in (0, 1)], axis=1)


def neighbour_map(x: np.ndarray, neighbours: int = 15, seed: int = 42, epochs: int = 200, spark: SparkSession | None = None) -> np.ndarray:
    """A UMAP-style map (McInnes, Healy, Melville 2018) of all rows: fuzzy neighbour graph, spectral start, sampled
    attraction."""
    n = len(x)
    if n < 3:
        raise ValueError("a map needs three rows")
    k = min(neighbours, n - 1)
    near, dist = nearest(x, k, spark=spark)
    rho = dist[:, :1]
    low, high = np.full((n, 1), 1e-9), np.full((n, 1), 1e3)
    for _ in range(60):
        mid = (low + high) / 2
        over = np.exp(-np.maximum(dist - rho, 0) / mid).sum(axis=1, keepdims=True) > np.log2(max(k, 2))
        low, high = np.where(over, low, mid), np.where(over, mid, high)
    weight = np.exp(-np.maximum(dist - rho, 0) / ((low + high) / 2)).ravel()
    here, there = np.repeat(np.arange(n), k), near.ravel()
    edges, edge = np.unique(np.minimum(here, there) * n + np.maximum(here, there), return_inverse=True)
    rows, cols = edges // n, edges % n
    weight = 1 - np.exp(np.bincount(edge, np.log(np.maximum(1 - weight, 1e-300)), len(edges)))
    rng = np.random.default_rng(seed)
    start = _spectral(rows, cols, weight, n, rng)
    y = start * 10 / max(1e-9, np.abs(start).max()) + rng.normal(0, 1e-4, (n, 2))
    for t in range(epochs):
        rate = 1 - t / epochs
        use = rng.random(len(rows)) < weight / weight.max()
        i, j = rows[use], cols[use]
        gap = y[i] - y[j]
        r2 = (gap**2).sum(axis=1, keepdims=True)
        move = np.clip(-2 * gap / (1 + r2), -4, 4) * rate
        y += added(i, move, n) - added(j, move, n)
        other = rng.integers(0, n, len(i))
        gap = y[i] - y[other]
        r2 = (gap**2).sum(axis=1, keepdims=True)
        y += added(i, np.clip(2 * gap / ((0.001 + r2) * (1 + r2)), -4, 4) * rate, n)
    return y


def mapped(coordinates: DataFrame, columns: Sequence[str], kind: str, seed: int = 42) -> DataFrame:
    """Keys and two coordinates of a t-SNE or neighbour map of every row. A map is made of all rows together: beyond
    ``ALONE`` rows Spark's tasks find the neighbours and sum t-SNE's attractions, the driver holds what is linear in the rows."""
    frame = coordinates.orderBy(*KEYS).toPandas()
    x = frame[list(columns)].to_numpy(np.float64)
    spark = coordinates.sparkSession if len(x) > ALONE else None
    y = (tsne if kind == "tsne" else neighbour_map)(x, seed=seed, spark=spark)
    out = pd.DataFrame({"subject_id": frame["subject_id"], "date": frame["date"], f"{kind}_1": y[:, 0], f"{kind}_2": y[:, 1]})
    return coordinates.sparkSession.createDataFrame(out, f"subject_id string, date date, {kind}_1 double, {kind}_2 double")


def as_columns(df: DataFrame, vector: str, k: int, prefix: str) -> DataFrame:
    """Keys and a vector column as ``prefix_i``."""
    values = vector_to_array(vector)
    return df.select(*KEYS, *[values[i].alias(f"{prefix}_{i + 1}") for i in range(k)])
