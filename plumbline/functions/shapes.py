"""Shapes beyond single boxes and rings: dissolving, parts, hulls and dividing, in NumPy over each group or batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hulls as H
from . import rings as R

PARTS = f"array<{R.RING}>"


BOXES = "array<struct<x0:double,y0:double,x1:double,y1:double>>"


def _edges(group: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each group's different x coordinates in order (group, x), and where every box begins and ends among them."""
    g, x = np.concatenate([group, group]), np.concatenate([x0, x1])
    order = np.lexsort((x, g))
    g, x = g[order], x[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (x[1:] != x[:-1])] if x.size else np.zeros(0, bool)
    at = np.empty(x.size, np.int64)
    at[order] = np.cumsum(new) - 1
    return g[new], x[new], at[: x0.size], at[x0.size :]


def strips(boxes: pa.ListArray, most: int = 1 << 21) -> pa.ListArray:
    """Of each list of boxes their union as boxes that share no area: a sweep over the x coordinates, for all lists of a batch at once. Memory
    goes by the batch and ``most`` pairs of a strip and a box."""
    n = len(boxes)
    counts = pc.fill_null(pc.list_value_length(boxes), 0).to_numpy(zero_copy_only=False)
    flat = boxes.flatten()
    x0, y0, x1, y1 = (pc.fill_null(pc.struct_field(flat, k), np.nan).to_numpy(zero_copy_only=False) for k in ("x0", "y0", "x1", "y1"))
    group = np.repeat(np.arange(n), counts)
    own = np.flatnonzero((x1 > x0) & (y1 > y0))
    own = own[np.lexsort((y0[own], group[own]))]
    x0, y0, x1, y1, group = x0[own], y0[own], x1[own], y1[own], group[own]
    eg, ex, lo, hi = _edges(group, x0, x1)
    tops, rank = np.unique(y1, return_inverse=True)
    crowd = np.cumsum(np.cumsum(np.bincount(lo, minlength=ex.size) - np.bincount(hi, minlength=ex.size)))  # pairs up to each edge
    out, s0 = [], 0
    while s0 < ex.size:
        s1 = max(s0 + 1, int(np.searchsorted(crowd, (crowd[s0 - 1] if s0 else 0) + most, "right")))
        some = np.flatnonzero((lo < s1) & (hi > s0))
        a, b = np.maximum(lo[some], s0), np.minimum(hi[some], s1)
        box = np.repeat(some, b - a)
        at = np.repeat(a, b - a) + np.arange(box.size) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
        order = np.argsort(at, kind="stable")  # by strip, and within it by y0
        at, box = at[order], box[order]
        top = np.maximum.accumulate(at * tops.size + rank[box])
        new = np.ones(at.size, bool)
        new[1:] = (at[1:] != at[:-1]) | (y0[box[1:]] > tops[top[:-1] % max(1, tops.size)])
        first = np.flatnonzero(new)
        last = np.r_[first[1:], at.size][: first.size] - 1
        out.append((at[first], y0[box[first]], tops[top[last] % max(1, tops.size)]))
        s0 = s1
    at, low, high = (np.concatenate([np.zeros(0, t), *(o[k] for o in out)]) for k, t in enumerate((np.int64, float, float)))
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(eg[at], minlength=n)[:n], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c) for c in (ex[at], low, ex[np.minimum(at + 1, max(0, ex.size - 1))], high)], ["x0", "y0", "x1", "y1"]))


def dissolve(df: DataFrame, *by: str) -> DataFrame:
    """The union of each group's boxes as boxes that share no area: by, x0, y0, x1, y1. A group is what one storey or building holds."""

    def run(boxes: pa.Array) -> pa.Array:
        return strips(boxes)

    boxes = df.groupBy(*by).agg(F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))).alias("boxes"))
    return boxes.select(*by, F.arrow_udf(run, BOXES)("boxes").alias("boxes")).select(*by, F.inline("boxes"))


def shared_area(a: Column, b: Column) -> Column:
    """Area that the union of the boxes a and the union of the boxes b have in common (arrays of boxes, a few each); of an array
    with itself the area of its union."""
    def at(*names: str) -> Column:
        return F.array_sort(F.array_distinct(F.concat(*(s[c] for s in (a, b) for c in names))))

    covered = lambda s, x, y: F.exists(s, lambda q: (q["x0"] <= x) & (q["x1"] > x) & (q["y0"] <= y) & (q["y1"] > y))
    steps = lambda v: F.zip_with(v, F.slice(v, 2, F.size(v)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    cell = lambda x, y: F.when(covered(a, x["p"], y["p"]) & covered(b, x["p"], y["p"]), (x["q"] - x["p"]) * (y["q"] - y["p"])).otherwise(F.lit(0.0))
    row = lambda s, x: s + F.aggregate(steps(at("y0", "y1")), F.lit(0.0), lambda t, y: t + F.coalesce(cell(x, y), F.lit(0.0)))
    return F.aggregate(steps(at("x0", "x1")), F.lit(0.0), row)


def multi_point(x: Column, y: Column) -> Column:
    """Arrays of coordinates as an array of points."""
    return F.zip_with(x, y, lambda a, b: F.struct(a.alias("x"), b.alias("y")))


def largest(parts: Column) -> Column:
    """The part (ring) of the greatest area; the first of equal ones."""
    best = F.array_max(F.transform(parts, lambda r, i: F.struct(R.area(r).alias("a"), (-i).alias("i"))))
    return F.get(parts, -best["i"])


def geojson(parts: Column) -> Column:
    """A list of parts (each a list of rings, the outer one first) as GeoJSON: null if empty, a Polygon if one, else a MultiPolygon."""
    xy = F.transform(parts, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"]))))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(xy, F.lit(0)).alias("coordinates")))
    return F.when(F.size(parts) == 1, one).when(F.size(parts) > 1, F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), xy.alias("coordinates"))))


def repaired_xy(p: np.ndarray) -> np.ndarray:
    """A closed ring without repeated or idle points, counter-clockwise; of a ring that crosses itself the hull of its points."""
    q = p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p
    keep = [i for i in range(len(q)) if not (q[i] == q[i - 1]).all()]
    q = q[keep]
    if len(q) < 3:
        return np.zeros((0, 2))
    closed = np.vstack([q, q[:1]])
    if R.proper_crossings(closed):
        return R.convex_hull(q)
    turn = (closed[:-1, 0] * closed[1:, 1] - closed[1:, 0] * closed[:-1, 1]).sum()
    return closed if turn > 0 else closed[::-1]


def _each(f, ring: Column) -> Column:
    def run(r: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [{"x": float(a), "y": float(b)} for a, b in f(R._xy(x))] for x in r], dtype=object)

    return F.pandas_udf(run, R.RING)(ring)


def repaired(ring: Column) -> Column:
    """Best effort, for display: an outline that the rules call invalid still is."""
    return _each(repaired_xy, ring)


def concave_xy(p: np.ndarray, ratio: float = 0.3) -> np.ndarray:
    """The concave outline of points, or their hull where there is none."""
    out = H.concave(p, ratio)
    return R.convex_hull(p) if out is None else out


def concave(points: Column) -> Column:
    return _each(concave_xy, points)


def chord(ring: np.ndarray, wall: np.ndarray, tolerance: float = 1e-3) -> np.ndarray:
    """A wall (two points) that reaches the ring at both ends, drawn out to meet it exactly; any other wall as it is."""
    a, b = ring[:-1], ring[1:]

    def gap(p):
        d = b - a
        t = np.clip(((p - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
        return np.hypot(*(p - a - t[:, None] * d).T).min()

    run = wall[1] - wall[0]
    if not run.any() or max(gap(wall[0]), gap(wall[1])) > tolerance:
        return wall
    d = b - a
    cross = run[0] * d[:, 1] - run[1] * d[:, 0]
    ok = np.abs(cross) > 1e-12 * np.hypot(*run)
    w = a[ok] - wall[0]
    t = (w[:, 0] * d[ok, 1] - w[:, 1] * d[ok, 0]) / cross[ok]
    s = (w[:, 0] * run[1] - w[:, 1] * run[0]) / cross[ok]
    hit = t[(s >= -1e-9) & (s <= 1 + 1e-9)]
    if hit.size < 2:
        return wall
    return wall[0] + np.array([[hit.min()], [hit.max()]]) * run


def cut_convex(p: np.ndarray, wall: np.ndarray) -> list[np.ndarray]:
    """The parts of a convex ring on either side of the line through the wall."""
    d = wall[1] - wall[0]
    n = np.array([-d[1], d[0]])
    out = []
    for sign in (1, -1):
        side = ((p - wall[0]) @ n) * sign
        q = []
        for i in range(len(p) - 1):
            if side[i] >= 0:
                q.append(p[i])
            if side[i] * side[i + 1] < 0:
                q.append(p[i] + (p[i + 1] - p[i]) * side[i] / (side[i] - side[i + 1]))
        if len(q) > 2:
            q = np.array(q)
            if abs(R.open_area(q)) > 1e-9:
                out.append(np.vstack([q, q[:1]]))
    return out


def covers(face: np.ndarray, wall: np.ndarray, tolerance: float = 1e-3) -> bool:
    """Whether the wall runs through the convex counter-clockwise face from edge to edge."""
    run = wall[1] - wall[0]
    size = np.hypot(*run)
    if size == 0:
        return False
    d = face[1:] - face[:-1]
    across = d[:, 0] * run[1] - d[:, 1] * run[0]
    off = d[:, 0] * (face[:-1, 1] - wall[0, 1]) - d[:, 1] * (face[:-1, 0] - wall[0, 0])
    into, out = across > 1e-12, across < -1e-12
    if not into.any() or not out.any():
        return False
    t0, t1 = (off[into] / across[into]).max(), (off[out] / across[out]).min()
    return bool((t1 - t0) * size > tolerance and t0 * size >= -tolerance and (t1 - 1) * size <= tolerance)


def subdivided(plate: np.ndarray, walls: list[np.ndarray], least: float = 2.0) -> list[np.ndarray]:
    """The faces of a convex plate between its walls, in any order of the walls, by decreasing area and then by their bounds. A wall
    divides where it runs from edge to edge, of the plate or of a face that another wall left; a stub divides nothing. Faces
    under the least area go, and a plate with one face or none is undivided (an empty list)."""
    faces = [plate if R.open_area(plate[:-1]) > 0 else plate[::-1]]
    walls = [chord(faces[0], w) for w in walls]
    k = 0
    while k < len(faces):
        for w in walls:
            parts = cut_convex(faces[k], w) if covers(faces[k], w) else []
            if len(parts) == 2:
                faces[k : k + 1] = parts
                k = -1
                break
        k += 1
    area = lambda f: abs(R.open_area(f[:-1]))
    faces = [f for f in faces if area(f) >= least]
    faces.sort(key=lambda f: (-round(area(f), 6), *f.min(0).round(6).tolist(), *f.max(0).round(6).tolist()))
    return faces if len(faces) > 1 else []


def planar_faces(plate: Column, walls: Column, least: float = 2.0) -> Column:
    """Faces (rings) of each plate between its walls (arrays of two points)."""

    def run(plates: pd.Series, walls: pd.Series) -> pd.Series:
        out = []
        for p, w in zip(plates, walls):
            w = [R._xy(x) for x in (w if w is not None else [])]
            out.append([[{"x": float(a), "y": float(b)} for a, b in f] for f in subdivided(R._xy(p), w, least)])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, PARTS)(plate, walls)
