"""Overlay and division of plates against raster counts and flood fills."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import arrangement as A


def closed(points):
    points = [(float(x), float(y)) for x, y in points]
    return [*points, points[0]]


def star(r, cx, cy, size, n, flip):
    """A simple ring around a point."""
    angles = sorted(r.uniform(0, 2 * np.pi) for _ in range(n))
    p = [(cx + r.uniform(0.3, 1) * size * np.cos(a), cy + r.uniform(0.3, 1) * size * np.sin(a)) for a in angles]
    return closed(p[::-1] if flip else p)


def inside(shape, x, y):
    odd = np.zeros(x.shape, bool)
    for ring in shape or []:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if ay != by:
                odd ^= ((ay <= y) != (by <= y)) & (ax + (y - ay) * (bx - ax) / (by - ay) < x)
    return odd


def frame(spark, rows, a="a", b="b"):
    return spark.createDataFrame(rows, f"key string, {a} {A.SHAPE}, {b} {A.SHAPE}")


def random_pairs(seed, n, shift=0.0):
    r = random.Random(seed)
    out = []
    for k in range(n):
        a = [star(r, 10 + shift, 10, 8, r.randint(3, 14), r.random() < 0.5)]
        b = [star(r, r.uniform(4, 16) + shift, r.uniform(4, 16), r.uniform(3, 8), r.randint(3, 14), r.random() < 0.5)]
        if k % 3 == 0:  # a hole, an island in it, a part of its own
            a = [closed([(2 + shift, 2), (18 + shift, 2), (18 + shift, 18), (2 + shift, 18)]), star(r, 10 + shift, 10, 6, 7, False), star(r, 10 + shift, 10, 1.2, 5, True), closed([(19 + shift, 0), (20 + shift, 0), (20 + shift, 1)])]
        if k % 7 == 0:
            b = [[(x, y) for x, y in q] for q in a]
        out.append((str(k), a, b))
    return out


@pytest.mark.parametrize("shift", [0.0, 500_000.0])
def test_overlay_against_raster(spark, shift):
    rows = random_pairs(5, 40, shift)
    got = {r.key: r for r in A.overlay_areas(frame(spark, rows)).collect()}
    step = 0.02
    x, y = np.meshgrid(np.arange(-6, 26, step) + step / 2 + shift, np.arange(-6, 26, step) + step / 2)
    for k, a, b in rows:
        ia, ib = inside(a, x, y), inside(b, x, y)
        for op, f in A.OPS.items():
            assert got[k][op] == pytest.approx(f(ia, ib).sum() * step**2, abs=0.5), (k, op)
        assert got[k].union == pytest.approx(got[k].area_a + got[k].area_b - got[k].intersection, abs=1e-4)


def test_result_shapes_against_raster(spark):
    rows = random_pairs(8, 16)
    step = 0.05
    x, y = np.meshgrid(np.arange(-6, 26, step) + step / 2, np.arange(-6, 26, step) + step / 2)
    for op, f in A.OPS.items():
        got = {r.key: r for r in A.overlay(frame(spark, rows), op).collect()}
        for k, a, b in rows:
            want = f(inside(a, x, y), inside(b, x, y))
            if k not in got:
                assert want.sum() * step**2 < 0.01
                continue
            shape = [[(p.x, p.y) for p in q] for q in got[k].shape]
            assert all(q[0] == q[-1] for q in shape)
            assert (inside(shape, x, y) != want).mean() < 1e-3
            assert got[k].area == pytest.approx(want.sum() * step**2, abs=1.0)


def test_touching_shared_and_missing(spark):
    sq = closed([(0, 0), (4, 0), (4, 4), (0, 4)])
    rows = [("same", [sq], [sq]), ("edge", [sq], [closed([(4, 1), (6, 1), (6, 3), (4, 3)])]), ("point", [sq], [closed([(4, 4), (5, 4), (5, 5)])]), ("null", [sq], None), ("empty", [], [sq]), ("none", None, None), ("flat", [closed([(0, 0), (4, 0), (2, 0)])], [sq])]
    got = {r.key: (round(r.intersection, 9), round(r.union, 9)) for r in A.overlay_areas(frame(spark, rows)).collect()}
    assert got == {"same": (16, 16), "edge": (0, 20), "point": (0, 16.5), "null": (0, 16), "empty": (0, 16), "flat": (0, 16)}


L = [(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)]


def fill(plate, walls, step=0.04):
    """Areas of the parts of a plate by flood fill; a wall lies between two cells that it parts."""
    x, y = np.meshgrid(np.arange(0, 10, step) + step / 2, np.arange(0, 10, step) + step / 2)
    name = np.where(inside(plate, x, y), np.arange(x.size).reshape(x.shape) + 1, 0)

    def parted(dx, dy):
        cut = np.zeros(x.shape, bool)
        for (ax, ay), (bx, by) in walls:
            s1 = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            s2 = (bx - ax) * (y + dy - ay) - (by - ay) * (x + dx - ax)
            t1 = dx * (ay - y) - dy * (ax - x)
            t2 = dx * (by - y) - dy * (bx - x)
            cut |= (s1 * s2 <= 0) & (t1 * t2 <= 0)
        return cut

    right, up = ~parted(step, 0)[:, :-1], ~parted(0, step)[:-1]
    while True:
        old = name.copy()
        for _ in range(30):
            for p, q, open_ in ((name[:, :-1], name[:, 1:], right), (name[:-1], name[1:], up)):
                both = open_ & (p > 0) & (q > 0)
                m = np.maximum(p, q)
                p[both] = np.maximum(p[both], m[both])
                q[both] = np.maximum(q[both], m[both])
        if (old == name).all():
            break
    n = np.unique(name[name > 0], return_counts=True)[1]
    return sorted((n * step**2).tolist(), reverse=True)


def test_faces_against_flood_fill(spark):
    r = random.Random(3)
    rows, want = [], {}
    for k in range(5):
        x = r.uniform(6, 9)
        walls = [((0, r.uniform(7, 8)), (4, r.uniform(7, 8))), ((r.uniform(1, 3), 0), (r.uniform(1, 3), 10)), ((x, 0), (x + r.uniform(-0.3, 0.3), 4)), ((0, 2.0), (10, r.uniform(1, 3)))]
        walls = [tuple((round(x, 3), round(y, 3)) for x, y in w) for w in walls]
        want[str(k)] = fill([closed(L)], walls)
        for order in range(2):
            mixed = walls + [walls[0], ((1.0, 0.0), (1.0, 0.4)), ((20.0, 0.0), (20.0, 9.0)), ((0.0, 0.0), (10.0, 0.0))]  # a double, a stub, one outside, one along the edge
            r.shuffle(mixed)
            rows.append((f"{k}/{order}", [closed(L)], [[(float(x), float(y)) for x, y in w] for w in mixed]))
    got = {}
    for f in A.faces(frame(spark, rows, "plate", "walls")).collect():
        got.setdefault(f.key, []).append((f.face, f.area))
    for key, fs in got.items():
        areas = [a for _, a in sorted(fs)]
        assert areas == sorted(areas, reverse=True)
        assert sum(areas) == pytest.approx(64, abs=1e-6)
        # slivers smaller than a cell may be lost to the raster
        big = [a for a in areas if a > 0.5]
        assert big == pytest.approx([a for a in want[key[0]] if a > 0.5], abs=0.35), key
    assert len(got) == 10


def test_walls_that_miss_by_a_little(spark):
    sq = closed([(0, 0), (10, 0), (10, 10), (0, 10)])
    w = lambda *p: [(float(x), float(y)) for x, y in p]
    rows = [("near", [sq], [w((5, 0.03), (5, 9.98))]), ("short", [sq], [w((5, 0.2), (5, 10))]), ("none", [sq], []), ("null", [sq], None), ("room", [sq], [w((4, 4), (6, 4), (6, 6), (4, 6), (4, 4))]), ("court", [sq, closed([(4, 4), (6, 4), (6, 6), (4, 6)])], [w((0, 5), (10, 5))])]
    got = {}
    for f in A.faces(frame(spark, rows, "plate", "walls")).orderBy("key", "face").collect():
        got.setdefault(f.key, []).append(round(f.area, 6))
    bent = [f.area for f in A.faces(frame(spark, [("bent", [closed(L)], [w((9, 0), (5, 4))])], "plate", "walls")).collect()]
    assert sum(bent) == pytest.approx(64)
    assert len(bent) == 3  # the chord goes on into the other wing
    assert got == {"near": [50, 50], "short": [100], "none": [100], "null": [100], "room": [96, 4], "court": [48, 48]}


def test_more_keys_than_a_block(spark):
    """Whole keys are traced together, however the rows come in batches."""
    df = spark.range(30_000).select(F.col("id").cast("string").alias("key"), F.expr("array(array(struct(0d AS x, 0d AS y), struct(4d AS x, 0d AS y), struct(4d AS x, 4d AS y), struct(0d AS x, 4d AS y), struct(0d AS x, 0d AS y)))").alias("plate"), F.expr("array(array(struct(1d AS x, 0d AS y), struct(1d AS x, 4d AS y)))").alias("walls"))
    assert A.faces(df).groupBy("face", F.round("area", 6).alias("area")).count().orderBy("face").collect() == [(1, 12.0, 30_000), (2, 4.0, 30_000)]


def test_nothing_is_shuffled(spark):
    """An arrangement is a column of its row; joins on its edges filled the disks."""
    df = frame(spark, random_pairs(2, 3))
    for out in (A.overlay_areas(df), A.overlay(df, "symmetric"), A.faces(df, "a", "b")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_rows_that_differ_by_place_are_worked_out_once(monkeypatch):
    """A batch of towers has few kinds of storeys; a hash that joins different rows changes nothing."""
    import pyarrow as pa

    from plumbline.operators import planar

    def ring(*points):
        return [{"x": x, "y": y} for x, y in (*points, points[0])]

    shape = lambda dx, w: [ring((dx, 5.0), (dx + w, 5.0), (dx + w, 9.0), (dx, 9.0))]
    wall = lambda dx: [[{"x": dx + 2.5, "y": 5.0}, {"x": dx + 2.5, "y": 9.0}]]
    rows = [(shape(100.0 * k, 6.0 + k % 2), wall(100.0 * k)) for k in range(20)] + [(shape(0.5, 6.0), None), (None, None), (shape(100.0, 6.0), wall(100.0))]
    kind = pa.list_(pa.list_(planar.POINT))
    a, b = pa.array([r for r, _ in rows], kind), pa.array([w for _, w in rows], kind)
    seen, cut = [], planar.Arrangement._cut

    def counted(self, *args):
        seen.append(self.rows)
        return cut(self, *args)

    monkeypatch.setattr(planar.Arrangement, "_cut", counted)
    got = planar.divided(a, b, 3, 0.05, 6).to_pylist()
    assert seen == [4]
    for k in range(20):
        assert [f["area"] for f in got[k]] == [14.0 + 4 * (k % 2), 10.0]
        assert min(p["x"] for f in got[k] for q in f["shape"] for p in q) == 100.0 * k
    assert [f["area"] for f in got[20]] == [24.0] and got[20][0]["shape"][0][0]["x"] % 1 == 0.5 and got[21] == [] and got[22] == [got[0][0] | {"shape": [[{"x": p["x"] + 100.0, "y": p["y"]} for p in q] for q in got[0][0]["shape"]]}, got[22][1]]
    monkeypatch.setattr(planar, "mixed", lambda v: v * 0)
    assert planar.divided(a, b, 3, 0.05, 6).to_pylist() == got
    assert planar.areas(a, a, 6).to_pylist()[20]["union"] == 24.0 and planar.divided(a[:0], b[:0], 3, 0.05, 6).to_pylist() == []


def test_a_storey_s_plan_goes_to_a_worker_once(spark):
    """One pass over plate, walls and outlines; without shapes the same areas, scopes and reasons."""
    from plumbline.operators import generation
    from plumbline.plans import shapes as P
    from plumbline.sources.cadastre import Cadastre

    c = Cadastre.load(spark, "/root/testdata/sf0.001")
    whole, slim = (generation.regions(P.planned(c.floors), "floor_number", shapes=x) for x in (True, False))
    for df in (whole, slim):
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert slim.columns == [x for x in whole.columns if x != "shape"]
    assert whole.drop("shape").exceptAll(slim).isEmpty() and slim.exceptAll(whole.drop("shape")).isEmpty()
