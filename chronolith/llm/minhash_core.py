"""Word shingles and fast similarity sketches, in NumPy (no Spark here)."""

from __future__ import annotations

import numpy as np

from chronolith.llm.common import carried, mix64, span_hashes

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 32 if c in b"\t\n\x0b\x0c\r" else c for c in range(256))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words in order, A-Z lower-cased, words cut at ASCII white space."""
    folded = text.translate(_FOLD)
    b = np.frombuffer(folded, np.uint8)
    word = np.concatenate([[False], b != 32, [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return span_hashes(folded, edge[::2], edge[1::2])


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of a text.

    A text of fewer words (but one at least) has its whole word sequence as its only shingle; one without words has none.
    """
    h = word_hashes(text)
    n = len(h)
    if n == 0:
        return h
    k = min(size, n)
    acc = np.full(n - k + 1, np.uint64(0x51ED270B0A1F39C1 + k), np.uint64)
    for i in range(k):
        acc = carried(acc, h[i : n - k + 1 + i])
    acc.sort()
    keep = np.empty(len(acc), bool)
    keep[0] = True
    np.not_equal(acc[1:], acc[:-1], out=keep[1:])
    return acc[keep]


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches (Dahlgaard, Knudsen, Thorup 2017) of many sets at once: one row of ``t`` values per set.

    Round i < t throws every element into a hashed bin; round t + j throws every element into bin j. A bin that is still
    empty when a round starts keeps the least hash thrown into it in that round. After 2t rounds no bin is empty; sets
    whose bins are all full drop out early. Two sets agree in a coordinate with probability equal to their Jaccard
    similarity. Rows of empty sets stay zero.
    """
    out = np.zeros((len(sets), t), np.uint64)
    live = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(live):
        return out
    values = np.concatenate([sets[i] for i in live])
    owner = np.repeat(np.arange(len(live)), [len(sets[i]) for i in live])
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    full = np.full((len(live), t), top, np.uint64)
    rows = np.arange(len(live))
    for i in range(2 * t):
        empty = full[rows] == top
        open_rows = empty.any(axis=1)
        if not open_rows.any():
            break
        if not open_rows.all():
            back = np.full(len(live), -1)
            back[rows[open_rows]] = 1
            keep = back[owner] == 1
            values, owner, rows = values[keep], owner[keep], rows[open_rows]
        h = mix64(values + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        if i < t:
            bins = ((h >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64)
        else:
            bins = np.full(len(h), i - t, np.int64)
        v = mix64(h + np.uint64(i)) & np.uint64(0xFFFFFFFFFFFFFFFE)
        flat = owner * t + bins
        free = full.reshape(-1)[flat] == top
        np.minimum.at(full.reshape(-1), flat[free], v[free])
    out[live] = full
    return out


def band_keys(sk: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key for every band of ``rows`` consecutive coordinates."""
    acc = np.zeros((len(sk), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    grid = sk[:, : bands * rows].reshape(len(sk), bands, rows)
    for r in range(rows):
        acc = carried(acc, grid[:, :, r])
    return acc.view(np.int64)
