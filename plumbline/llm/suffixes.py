"""Suffix arrays of many strings at once, by prefix doubling in NumPy.

Strings lie one after the other; ``ends`` holds for each position the end of its string. An end sorts before
every symbol, and positions of equal remainders have equal ranks. Level j ranks suffixes by their first
``base * 2**j`` symbols, so that two levels give the next, and all of them give common prefixes.
"""

from __future__ import annotations

import numpy as np


def dense(x: np.ndarray) -> np.ndarray:
    """0, 1, ... in the order of the values."""
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def levels(first: np.ndarray, ends: np.ndarray, depth: int, base: int = 1) -> list[np.ndarray]:
    """Ranks by the first base, 2 * base, ... symbols, to ``depth`` at least or until all ranks differ."""
    n = first.size
    out, have = [dense(first)], base
    at = np.arange(n)
    while have < depth and n and out[-1].max() < n - 1:
        r, nxt = out[-1], at + have
        tail = np.zeros(n, np.int64)
        ok = nxt < ends
        tail[ok] = r[nxt[ok]] + 1
        out.append(dense(r * (n + 1) + tail))
        have *= 2
    return out


def last_level(first: np.ndarray, ends: np.ndarray, depth: int, base: int = 1) -> np.ndarray:
    """The last of ``levels`` alone, in the same order: each round sorts only what is still tied."""
    n = first.size
    _, which, size = np.unique(first, return_inverse=True, return_counts=True)
    r = (np.cumsum(size) - size)[which]  # how many are less
    tied, have = np.flatnonzero(size[which] > 1), base
    while tied.size and have < depth:
        nxt = tied + have
        tail = np.zeros(tied.size, np.int64)
        ok = nxt < ends[tied]
        tail[ok] = r[nxt[ok]] + 1
        key = r[tied] * (n + 1) + tail
        o = np.argsort(key, kind="stable")
        tied, key, old = tied[o], key[o], r[tied[o]]
        at = np.arange(tied.size)
        of_old = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        new = np.r_[True, key[1:] != key[:-1]]
        r[tied] = old + np.maximum.accumulate(np.where(new, at, 0)) - of_old
        group = np.cumsum(new) - 1
        tied = tied[np.bincount(group)[group] > 1]
        have *= 2
    return r


def common(ranks: list[np.ndarray], ends: np.ndarray, a: np.ndarray, b: np.ndarray, base: int = 1) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, from levels deep enough for it."""
    room = np.minimum(ends[a] - a, ends[b] - b)
    h = np.zeros(a.size, np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        x, y = a + h, b + h
        ok = np.flatnonzero(h < room)
        ok = ok[ranks[j][x[ok]] == ranks[j][y[ok]]]
        h[ok] += base << j
    return np.minimum(h, room)
