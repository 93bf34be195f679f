"""Cross-polytope hashing after fast Hadamard rotations, in NumPy (no Spark here)."""

from __future__ import annotations

import functools
import math

import numpy as np

#: Vertices of each rotation that probing considers.
NEAR = 4


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x


def rotate(x: np.ndarray, number: int) -> np.ndarray:
    """Pseudo-random rotation ``number``: three rounds of random signs and a Hadamard transform."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng((number, width)).integers(0, 2, (3, width)) * 2 - 1
    for s in signs:
        out = hadamard(out * s) / np.sqrt(width)
    return out


def codes(x: np.ndarray, tables: int, depth: int, probes: int) -> np.ndarray:
    """Bucket numbers: ``[row, table, probe]``, probe 0 the row's own bucket, the others the next nearest ones.

    A bucket joins ``depth`` hashes, each the nearest of the 2d signed axes after a rotation. Probes follow the summed
    squared loss of projection against the nearest axis, over the ``NEAR`` nearest axes of each hash.
    """
    out = np.zeros((len(x), tables, probes), np.int64)
    for t in range(tables):
        number = np.zeros((len(x), 1), np.int64)
        loss = np.zeros((len(x), 1))
        for k in range(depth):
            y = rotate(x, t * depth + k)
            size = np.abs(y)
            width = min(NEAR, size.shape[1])
            near = np.argpartition(-size, width - 1, axis=1)[:, :width]
            value = np.take_along_axis(size, near, axis=1)
            order = np.argsort(-value, axis=1, kind="stable")
            near, value = np.take_along_axis(near, order, axis=1), np.take_along_axis(value, order, axis=1)
            vertex = 2 * near + (np.take_along_axis(y, near, axis=1) < 0)
            step = (value[:, :1] - value) ** 2
            number = (number[:, :, None] * (2 * y.shape[1]) + vertex[:, None, :]).reshape(len(x), -1)
            loss = (loss[:, :, None] + step[:, None, :]).reshape(len(x), -1)
            if loss.shape[1] > probes:
                best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
                number, loss = np.take_along_axis(number, best, axis=1), np.take_along_axis(loss, best, axis=1)
        order = np.argsort(loss, axis=1, kind="stable")
        number = np.take_along_axis(number, order, axis=1)
        out[:, t, : number.shape[1]] = number[:, :probes]
        out[:, t, number.shape[1] :] = number[:, :1]
    return out


def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of rows of two ``codes`` arrays, in which tables they meet: one's own bucket is among the other's."""
    return (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)


@functools.lru_cache(maxsize=64)
def tables_for(width: int, depth: int, probes: int, cosine: float, miss: float) -> int:
    """Tables that a pair at ``cosine`` misses altogether with a chance of ``miss`` at most.

    The chance to meet in one table is measured on random pairs at that angle and lowered by three standard errors;
    rotations are random, so it depends on the angle, the width and the hashing alone.
    """
    trial = 4
    n = max(64, min(512, (1 << 19) // width))
    rng = np.random.default_rng((width, depth, probes))
    x, z = rng.normal(size=(2, n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    y = cosine * x + math.sqrt(1 - cosine * cosine) * z
    p = float(met(codes(x, trial, depth, probes), codes(y, trial, depth, probes)).mean())
    low = min(max(p - 3 * math.sqrt(p * (1 - p) / (n * trial)), p / 2, 1e-3), 0.99)
    return max(2, math.ceil(math.log(miss) / math.log1p(-low)))
