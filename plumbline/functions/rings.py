"""General rings: ARRAY<STRUCT<x, y>>, closed. Measures and most of validity are higher-order functions inside the JVM; edges that cross are found in NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def _edges(ring: Column, f) -> Column:
    n = F.size(ring)
    pairs = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), f)
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def signed_area(ring: Column) -> Column:
    return _edges(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return _edges(ring, lambda a, b: F.sqrt((b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2))


def centroid(ring: Column) -> Column:
    """Area centroid; the mean of the vertices if the area is 0."""
    a6 = 6 * signed_area(ring)
    cx = _edges(ring, lambda a, b: (a["x"] + b["x"]) * (a["x"] * b["y"] - b["x"] * a["y"])) / a6
    cy = _edges(ring, lambda a, b: (a["y"] + b["y"]) * (a["x"] * b["y"] - b["x"] * a["y"])) / a6
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / F.size(ring)
    return F.when(a6 == 0, F.struct(mean("x").alias("x"), mean("y").alias("y"))).otherwise(F.struct(cx.alias("x"), cy.alias("y")))


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def snap(ring: Column, digits: int = 3) -> Column:
    return F.transform(ring, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))


def to_geojson(ring: Column) -> Column:
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"]))).alias("coordinates")))


def from_geojson(text: Column) -> Column:
    """The exterior ring of a GeoJSON Polygon; null if there is none."""
    g = F.from_json(text, "type string, coordinates array<array<array<double>>>")
    return F.when(g["type"] == "Polygon", F.transform(F.get(g["coordinates"], F.lit(0)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def crosses_itself(ring: Column) -> Column:
    """Whether two edges of a closed ring cross or overlap other than at a shared end."""

    def run(ring: pa.Array) -> pa.Array:
        from plumbline.operators.planar import crossed

        return crossed(ring)

    return F.arrow_udf(run, "boolean").asNondeterministic()(ring)  # so that a filter on it doesn't compute it twice


def validity(ring: Column) -> Column:
    """'valid', or the first reason why a ring isn't: too few points, not closed, not finite, self-intersection, no area."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    first, last = F.get(ring, F.lit(0)), F.element_at(ring, -1)
    return (
        F.when(ring.isNull() | (F.size(ring) < 4), "too few points").when((first["x"] != last["x"]) | (first["y"] != last["y"]), "not closed").when(F.exists(ring, lambda p: odd(p["x"]) | odd(p["y"])), "not finite")
        .when(crosses_itself(ring), "self-intersection").when(signed_area(ring) == 0, "no area").otherwise("valid")
    )


# --- NumPy kernels -----------------------------------------------------------------------------


def _xy(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], float) if ring is not None and len(ring) else np.zeros((0, 2))


def proper_crossings(p: np.ndarray) -> bool:
    """Whether two edges of a closed ring cross or overlap other than at a shared end."""
    a, b = p[:-1], p[1:]
    n = len(a)
    for i in range(n):
        for j in range(i + 1, n):
            near = j == i + 1 or (i == 0 and j == n - 1)
            d1, d2 = b[i] - a[i], b[j] - a[j]
            den = d1[0] * d2[1] - d1[1] * d2[0]
            r = a[j] - a[i]
            if den:
                t, u = (r[0] * d2[1] - r[1] * d2[0]) / den, (r[0] * d1[1] - r[1] * d1[0]) / den
                if not near and 0 <= t <= 1 and 0 <= u <= 1:
                    return True
            elif r[0] * d1[1] - r[1] * d1[0] == 0 and d1.any():
                s, e = sorted((r @ d1 / (d1 @ d1), (r + d2) @ d1 / (d1 @ d1)))
                if min(1, e) - max(0, s) > (1e-12 if near else -1e-12):
                    return True
    return False


def clip_convex(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Sutherland-Hodgman: any ring against a convex one. Both open, the clip counter-clockwise."""
    out = subject
    for a, b in zip(clip, np.roll(clip, -1, 0)):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        new = []
        for i in range(len(out)):
            j = (i + 1) % len(out)
            if side[i] >= 0:
                new.append(out[i])
            if (side[i] > 0 > side[j]) or (side[i] < 0 < side[j]):
                t = side[i] / (side[i] - side[j])
                new.append(out[i] + t * (out[j] - out[i]))
        out = np.array(new).reshape(-1, 2)
    return out


def open_area(p: np.ndarray) -> float:
    return float((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum() / 2) if len(p) > 2 else 0.0


def convex_parts(p: np.ndarray) -> list[np.ndarray]:
    """Ear-clipping triangles of a simple open ring."""
    if open_area(p) < 0:
        p = p[::-1]
    left, out = list(range(len(p))), []
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    while len(left) > 3:
        for k in range(len(left)):
            i, j, m = left[k - 1], left[k], left[(k + 1) % len(left)]
            t = turn(p[i], p[j], p[m])
            if t <= 0:
                if t == 0:
                    left.pop(k)
                    break
                continue
            if not any(turn(p[i], p[j], p[q]) >= 0 and turn(p[j], p[m], p[q]) >= 0 and turn(p[m], p[i], p[q]) >= 0 for q in left if q not in (i, j, m)):
                out.append(p[[i, j, m]])
                left.pop(k)
                break
        else:
            break
    if len(left) == 3:
        out.append(p[left])
    return out


def overlap_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area of the intersection of two simple open rings."""
    if not len(a) or not len(b) or (a.max(0) < b.min(0)).any() or (b.max(0) < a.min(0)).any():
        return 0.0
    parts = convex_parts(a)
    return sum(abs(open_area(clip_convex(x, y))) for x in parts for y in convex_parts(b))


# UDFs are made when they are called, since workers import this module without a session.


def intersection_area(a, b) -> Column:
    """Area that two simple closed rings share; 0 for null ones."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        from plumbline.operators.planar import areas

        one = lambda r: pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32)), r)
        return pc.fill_null(areas(one(a), one(b), 6).flatten()[2], 0.0)

    return F.arrow_udf(run, "double").asNondeterministic()(a, b)


def simplify(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker of a closed ring, between its first point and the farthest one."""

    def run(q: np.ndarray) -> np.ndarray:
        if len(q) < 3:
            return q
        d = q[-1] - q[0]
        r = q[1:-1] - q[0]
        far = np.abs(d[0] * r[:, 1] - d[1] * r[:, 0]) / np.hypot(*d) if d.any() else np.hypot(r[:, 0], r[:, 1])
        k = int(far.argmax())
        return np.vstack([run(q[: k + 2])[:-1], run(q[k + 1 :])]) if far[k] > tolerance else q[[0, -1]]

    k = int(np.hypot(*(p - p[0]).T).argmax())
    return np.vstack([run(p[: k + 1])[:-1], run(p[k:])])


def convex_hull(p: np.ndarray) -> np.ndarray:
    """Monotone chain; closed, counter-clockwise."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return np.vstack([p, p[:1]])

    def half(q):
        out: list[np.ndarray] = []
        for x in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (x[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(x)
        return out

    a, b = half(p), half(p[::-1])
    return np.array(a[:-1] + b[:-1] + a[:1])


def simplified(ring, tolerance) -> Column:
    def run(ring: pd.Series, tolerance: pd.Series) -> pd.Series:
        return pd.Series([[{"x": float(x), "y": float(y)} for x, y in simplify(_xy(r), t)] for r, t in zip(ring, tolerance)])

    return F.pandas_udf(run, RING)(ring, tolerance)
