"""Concave outlines of a few hundred points: a triangulation from which long border edges are taken off.

A small helper of ``operators.pointcloud``, which sends it the border cells' extremes of a cluster and no more.
"""

from __future__ import annotations

import heapq

import numpy as np


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def triangulated(p: np.ndarray) -> np.ndarray:
    """Delaunay triangles (rows of three places in p, counter-clockwise) of distinct points: each point in turn takes the place of the
    triangles whose circumcircle it lies in. Outside every hull edge stands a triangle with a far point (place n, always last); its circle is the
    half plane beyond the edge."""
    n = len(p)
    p = p - p.mean(0)
    third = next((k for k in range(2, n) if abs(_turn(p[0], p[1], p[k])) > 1e-12), None)
    if third is None:
        return np.zeros((0, 3), int)
    a, b, c = (0, 1, third) if _turn(p[0], p[1], p[third]) > 0 else (1, 0, third)
    tri = np.array([(a, b, c), (b, a, n), (c, b, n), (a, c, n)])
    for i in range(2, n):
        if i == third:
            continue
        x = p[i]
        real = tri[:, 2] < n
        gone = np.zeros(len(tri), bool)
        d = p[tri[real]] - x
        sq = (d * d).sum(2)
        gone[real] = (
            d[:, 0, 0] * (d[:, 1, 1] * sq[:, 2] - d[:, 2, 1] * sq[:, 1]) - d[:, 0, 1] * (d[:, 1, 0] * sq[:, 2] - d[:, 2, 0] * sq[:, 1]) + sq[:, 0] * (d[:, 1, 0] * d[:, 2, 1] - d[:, 2, 0] * d[:, 1, 1])
        ) > 0
        u, v = p[tri[~real, 0]], p[tri[~real, 1]]
        side = _turn(u, v, x)
        gone[~real] = (side > 0) | ((side == 0) & (((x - u) * (x - v)).sum(1) < 0))
        edges = np.concatenate([tri[gone][:, [0, 1]], tri[gone][:, [1, 2]], tri[gone][:, [2, 0]]]).tolist()
        there = set(map(tuple, edges))
        new = [(a, b, i) if n not in (a, b) else (b, i, n) if a == n else (i, a, n) for a, b in there if (b, a) not in there]
        tri = np.concatenate([tri[~gone], np.array(new, int).reshape(-1, 3)])
    return tri[tri[:, 2] < n]


def concave(p: np.ndarray, ratio: float = 0.3) -> np.ndarray | None:
    """The closed, counter-clockwise outline of points: from the triangulation, border edges longer than the shortest edge plus ``ratio`` of the
    range of lengths give way, longest first, to the point behind them, as long as that one isn't on the border yet. None where
    there is no area."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return None
    tri = triangulated(p)
    if not len(tri):
        return None
    behind = {e: t for t, (a, b, c) in enumerate(tri.tolist()) for e in ((a, b), (b, c), (c, a))}  # the triangle on an edge's left
    length = {e: float(np.hypot(*(p[e[0]] - p[e[1]]))) for e in behind}
    low, high = min(length.values()), max(length.values())
    limit = low + ratio * (high - low)
    border = {e for e in behind if (e[1], e[0]) not in behind}
    on = {x for e in border for x in e}
    heap = [(-length[e], e) for e in border]
    heapq.heapify(heap)
    while heap and -heap[0][0] > limit:
        _, e = heapq.heappop(heap)
        if e not in border:
            continue
        v = next(x for x in tri[behind[e]].tolist() if x not in e)
        if v in on:
            continue
        border.discard(e)
        on.add(v)
        for new in ((e[0], v), (v, e[1])):  # edges of the triangles beyond
            border.add(new)
            heapq.heappush(heap, (-length[new], new))
    after = dict(border)
    if len(after) != len(border):
        return None
    start = min(after)
    out, x = [start], after[start]
    while x != start and len(out) <= len(after):
        out.append(x)
        x = after[x]
    return p[[*out, start]] if len(out) == len(after) else None
