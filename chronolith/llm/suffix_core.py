"""Enhanced suffix arrays in NumPy: suffix order, common-prefix lengths, and the interval tree over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def suffix_array(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of several sequences laid end to end, and the group ranks after each doubling.

    ``symbols`` are non-negative ints; ``ends[i]`` is the end of the sequence that position i lies in, at which its
    suffix stops. Prefix doubling; after the first pass only positions whose prefix is still shared are sorted again.
    Equal suffixes (of different sequences) stay in position order.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    first = np.empty(n, bool)
    first[:1] = True
    np.not_equal(sorted_symbols[1:], sorted_symbols[:-1], out=first[1:])
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, sizes)
    levels = [rank.copy()]
    active = order[np.repeat(sizes > 1, sizes)]
    h = 1
    while len(active):
        ahead = active + h
        inside = ahead < ends[active]
        second = np.zeros(len(active), np.int64)
        second[inside] = rank[ahead[inside]] + 1
        key = rank[active] * np.int64(n + 1) + second
        o = np.argsort(key, kind="stable")
        key, act = key[o], active[o]
        old = rank[act]
        new_sub = np.empty(len(act), bool)
        new_sub[0] = True
        np.not_equal(key[1:], key[:-1], out=new_sub[1:])
        new_old = np.empty(len(act), bool)
        new_old[0] = True
        np.not_equal(old[1:], old[:-1], out=new_old[1:])
        at = np.arange(len(act))
        sub_start = np.maximum.accumulate(np.where(new_sub, at, 0))
        old_start = np.maximum.accumulate(np.where(new_old, at, 0))
        rank[act] = old + (sub_start - old_start)
        levels.append(rank.copy())
        sub = np.flatnonzero(new_sub)
        sub_sizes = np.diff(np.append(sub, len(act)))
        # a group whose suffixes have all ended can't be told apart any more
        over = (second[o] == 0)[sub]
        active = act[np.repeat((sub_sizes > 1) & ~over, sub_sizes)]
        h *= 2
    out = np.argsort(rank, kind="stable")
    return out, levels


def neighbour_lcp(order: np.ndarray, levels: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """``lcp[i]``: symbols that suffixes ``order[i-1]`` and ``order[i]`` share at their start (``lcp[0]`` is 0)."""
    lcp = np.zeros(len(order), np.int64)
    live = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[live - 1].copy(), order[live].copy()
    end_a, end_b = ends[a], ends[b]
    length = np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        fits = (a + step <= end_a) & (b + step <= end_b)
        same = np.zeros(len(live), bool)
        same[fits] = levels[k][a[fits]] == levels[k][b[fits]]
        a += step * same
        b += step * same
        length += step * same
    # what is left is shorter than the largest level: repeat the descent for runs of equal steps
    while True:
        fits = (a < end_a) & (b < end_b)
        more = np.zeros(len(live), bool)
        more[fits] = levels[-1][a[fits]] == levels[-1][b[fits]]
        step = 1 << (len(levels) - 1)
        more &= (a + step <= end_a) & (b + step <= end_b)
        if not more.any():
            break
        a += step * more
        b += step * more
        length += step * more
    lcp[live] = length
    return lcp


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """The common-prefix interval tree by a stack scan: (length, first, last) of every interval of ``least`` or longer.

    Children come before their parents; all suffixes ``order[first..last]`` share their first ``length`` symbols, and no
    wider run does.
    """
    stack: list[tuple[int, int]] = []
    edges = np.flatnonzero(lcp >= least)
    if not len(edges):
        return
    runs = np.split(edges, np.flatnonzero(np.diff(edges) > 1) + 1)
    for run in runs:
        low = int(run[0]) - 1
        for i in range(int(run[0]), int(run[-1]) + 2):
            now = int(lcp[i]) if i < len(lcp) and i <= run[-1] else 0
            left = i - 1
            while stack and stack[-1][0] > now:
                length, left = stack.pop()
                yield length, left, i - 1
            if now >= least and (not stack or stack[-1][0] < now):
                stack.append((now, left if left >= low else low))


def repeated_prefix(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For every position the length of the longest prefix of its suffix that occurs elsewhere: its deepest interval."""
    here = np.maximum(lcp, np.append(lcp[1:], 0)) if len(lcp) else lcp
    out = np.zeros(len(order), np.int64)
    out[order] = here
    return out


def cover(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans [start, start + length)."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta[:n]) > 0
