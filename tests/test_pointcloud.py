"""Synthetic scans with known truth, file headers and points, streams."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import pointcloud as PC
from plumbline.sources import pointfiles
from plumbline.streaming import logs

PTS = "id long, x double, y double, z double"


def cloud(boxes, seed=7, ground=4000, extent=(100.0, 60.0)):
    rng = np.random.default_rng(seed)
    g = np.c_[rng.uniform(0, extent[0], ground), rng.uniform(0, extent[1], ground)]
    out = [np.c_[g, 100 + 0.01 * g[:, 0] + rng.normal(0, 0.02, ground)]]
    for x0, y0, x1, y1, h in boxes:
        r = np.c_[rng.uniform(x0, x1, 1500), rng.uniform(y0, y1, 1500)]
        out.append(np.c_[r, 100 + 0.01 * r[:, 0] + h + rng.normal(0, 0.02, 1500)])
        for _ in range(1):
            t = rng.uniform(0, 1, 1600)
            side = rng.integers(0, 4, 1600)
            x = np.where(side == 0, x0, np.where(side == 1, x1, x0 + t * (x1 - x0)))
            y = np.where(side == 2, y0, np.where(side == 3, y1, y0 + t * (y1 - y0)))
            out.append(np.c_[x, y, 100 + 0.01 * x + rng.uniform(0, h, 1600)])
    p = np.concatenate(out)
    return [(i, *map(float, v)) for i, v in enumerate(p)]


def test_two_buildings(spark):
    df = spark.createDataFrame(cloud([(5, 5, 35, 25, 12), (60, 5, 80, 25, 25)]), PTS)
    b = sorted(PC.buildings(PC.classify(df)).collect(), key=lambda r: r.x0)
    assert len(b) == 2
    for r, (area, h) in zip(b, ((600, 12), (400, 25))):
        assert r.area == pytest.approx(area, rel=0.1) and r.height == pytest.approx(h, rel=0.1) and 0 < r.quality <= 1


def test_footprints_follow_the_building(spark):
    """An L stays an L."""
    df = spark.createDataFrame(cloud([(5, 5, 45, 15, 12), (5, 15, 15, 45, 12)]), PTS)
    (b,) = PC.buildings(PC.classify(df)).collect()
    ring = np.array([(q.x, q.y) for q in b.footprint])
    assert 700 * 0.9 < b.area < 700 * 1.15  # its convex hull has 1,150
    assert not any(30 < x < 40 and 30 < y < 40 for x, y in ring) and len(ring) >= 7


def test_triangulation_and_outline():
    from plumbline.functions import hulls as H
    from plumbline.functions import rings as R

    rng = np.random.default_rng(1)
    p = rng.random((150, 2))
    t = H.triangulated(p)
    assert sum(R.open_area(p[x]) for x in t) == pytest.approx(R.open_area(R.convex_hull(p)[:-1]))
    for x in t:  # no point in any circumcircle
        a = p[x]
        c = np.linalg.solve(2 * (a[1:] - a[0]), (a[1:] ** 2).sum(1) - (a[0] ** 2).sum())
        assert (np.hypot(*(p - c).T) > np.hypot(*(a[0] - c)) - 1e-9).all()
    grid = np.array([(i, j) for i in range(31) for j in range(31) if not (10 < i < 20 and j > 10)], float)  # a U
    for q in (grid, grid + rng.normal(0, 0.01, grid.shape)):
        assert R.open_area(H.concave(q)[:-1]) == pytest.approx(710, rel=0.03)
    assert H.concave(np.array([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)])) is None and H.concave(np.zeros((5, 2))) is None


def test_ground_alone_has_no_building(spark):
    df = PC.classify(spark.createDataFrame(cloud([], ground=2500), PTS))
    assert df.where("is_ground").count() > 2300 and PC.buildings(df).count() == 0


def brute_spread(grid, passes):
    """Cell by cell from the rule; grid: {cell: ground or None}."""
    value = dict(grid)
    for _ in range(passes):
        new = {}
        for (i, j), v in value.items():
            if v is None:
                near = [value.get((i + a, j + b)) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
                near = [x for x in near if x is not None]
                if near:
                    new[i, j] = sum(near) / len(near)
        if not new:
            break
        value |= new
    known = [v for v in value.values() if v is not None]
    return {c: (float(np.median(known)) if known else None) if v is None else v for c, v in value.items()}


def brute_classify(p):
    cells = [(int(np.floor(x)), int(np.floor(y))) for x, y, _ in p]
    by = {}
    for c, z in zip(cells, p[:, 2]):
        by.setdefault(c, []).append(z)
    grid = {c: float(np.percentile(v, 2)) for c, v in by.items()}
    for t in (0.6, 0.3, 0.15, 0.15, 0.15):
        mask = np.array([z - grid[c] < t for c, z in zip(cells, p[:, 2])])
        if not mask.any():
            break
        refit = {}
        for c, z, m in zip(cells, p[:, 2], mask):
            if m:
                refit.setdefault(c, []).append(z)
        grid = brute_spread({c: float(np.percentile(refit[c], 2)) if c in refit else None for c in by}, 32)
        for _ in range(2):
            new = {}
            for (i, j), v in grid.items():
                near = [grid[i + a, j + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (i + a, j + b) in grid]
                mid = float(np.median(near)) if near else v
                new[i, j] = mid if abs(v - mid) > 1.0 else v
            grid = new
    return mask, grid, cells


@pytest.mark.parametrize("tile", [8, 64])
def test_spread_against_the_rule(spark, tile):
    rng = np.random.default_rng(tile)
    grid = {(int(i), int(j)): None for i, j in rng.integers(-60, 60, (5000, 2))}
    for c in rng.permutation(np.array(list(grid)))[:25].tolist():
        grid[tuple(c)] = float(rng.normal(100, 5))
    grid[1000, 1000] = None  # beyond all reach
    df = spark.createDataFrame([(*c, v) for c, v in grid.items()], "ix long, iy long, ground double")
    for passes in (3, 32):
        got = {(r.ix, r.iy): (r.ground, r.filled) for r in PC.spread(df, passes, tile).collect()}
        want = brute_spread(grid, passes)
        assert got.keys() == want.keys()
        assert all(got[c][0] == pytest.approx(v) and got[c][1] == (grid[c] is None) for c, v in want.items())
    assert {r.ground for r in PC.spread(df.withColumn("ground", F.lit(None).cast("double"))).collect()} == {None}


def test_classify_against_the_rule(spark):
    rows = cloud([(5, 5, 35, 25, 12), (60, 5, 80, 25, 25)], ground=2500)
    p = np.array([r[1:] for r in rows])
    mask, grid, cells = brute_classify(p)
    got = {r.id: r for r in PC.classify(spark.createDataFrame(rows, PTS)).collect()}
    assert len(got) == len(rows)
    for k, (c, m) in enumerate(zip(cells, mask)):
        assert got[k].is_ground == m and got[k].ground_z == pytest.approx(grid[c])
    assert mask[2500:4000].mean() < 0.05  # the roof isn't ground, though it covers whole cells
    g, _ = PC.fitted(spark.createDataFrame(rows, PTS))
    asked = [(0, 20.5, 15.5), (1, 99.9, 59.9), (2, 5000.0, 0.0), (3, -0.5, 10.0)]
    for r in PC.ground_at(spark.createDataFrame([(i, x, y) for i, x, y in asked], "id long, x double, y double"), g).collect():
        i, j = int(np.floor(asked[r.id][1])), int(np.floor(asked[r.id][2]))
        near = [grid[i + a, j + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if (i + a, j + b) in grid]
        assert r.ground_z == pytest.approx(np.mean(near) if near else np.median(list(grid.values())))


def test_exact_quantiles(spark):
    from plumbline.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(1)
    for v in (rng.normal(0, 1, 3000), np.r_[np.full(2500, 7.0), rng.normal(7, 1e-9, 400), 1e12, -1e12], rng.integers(0, 3, 999).astype(float), np.array([4.5]), np.array([1.0, 2.0])):
        ps = [0.0, 0.02, 0.5, 0.95, 1.0]
        n, got = exact_quantiles(spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "x double"), "x", ps)
        assert n == len(v) and got == pytest.approx([float(np.quantile(v, p)) for p in ps], rel=1e-12, abs=1e-12)
    assert exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == (0, [None])


def brute_dbscan(p, eps, least):
    d = (p[:, None, 0] - p[None, :, 0]) ** 2 + (p[:, None, 1] - p[None, :, 1]) ** 2 <= eps * eps
    core = d.sum(1) >= least
    label = np.arange(len(p))
    while True:
        new = np.array([label[core & d[i]].min() if core[i] else label[i] for i in range(len(p))])
        if (new == label).all():
            break
        label = new
    out = {int(i): int(label[i]) for i in np.flatnonzero(core)}
    for i in np.flatnonzero(~core):
        near = np.flatnonzero(core & d[i])
        if len(near):
            out[int(i)] = out[int(near.min())]
    return out


def test_clusters_against_definition(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in ((0, 1, 80), (8, 0.3, 60), (20, 3, 60))])
    p = np.concatenate([p, p[:5]])
    df = spark.createDataFrame([(i, float(x), float(y), 0.0) for i, (x, y) in enumerate(p)], PTS)
    assert {r.id: r.cluster for r in PC.clusters(df, 1.0, 5).collect()} == brute_dbscan(p, 1.0, 5)


def test_cluster_query_takes_all_points(spark):
    from __spark_entry__ import queries

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "double(event_id % 100)", "double(user_id % 40)").orderBy("event_id").collect()
    want = brute_dbscan(np.array([r[1:] for r in e]), PC.EPS, PC.MIN_SAMPLES)
    got = {r.id: r.cluster for r in queries()["dbscan_clusters"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {e[i].event_id: e[c].event_id for i, c in want.items()}


def test_storeys(spark):
    rng = np.random.default_rng(41)
    h = [z + rng.normal(0, 0.03) for k in range(1, 6) for z in [3.2 * k] * 900] + list(rng.uniform(0, 16, 900))
    df = spark.createDataFrame([(1, float(z)) for z in h], "building long, height double")
    got = sorted(PC.storeys(df).collect(), key=lambda r: r.storey)
    assert len(got) == 5 and all(r.z_max - r.z_min == pytest.approx(3.2, abs=0.3) for r in got) and not any(r.requires_review for r in got)


def las(points, fmt=1, crs=True, minor=2):
    scale, shift = 0.01, (1000.0, 2000.0, 100.0)
    vlr = b""
    if crs:
        keys = struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, 32643)
        vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 34735, len(keys), b"") + keys
    size = {0: 20, 1: 28}[fmt]
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = bytes([1, minor])
    struct.pack_into("<HII", head, 94, 227, 227 + len(vlr), int(crs))
    struct.pack_into("<BHI", head, 104, fmt, size, len(points))
    struct.pack_into("<3d", head, 131, scale, scale, scale)
    struct.pack_into("<3d", head, 155, *shift)
    p = np.array(points)
    struct.pack_into("<6d", head, 179, *(v for k in range(3) for v in (p[:, k].max(), p[:, k].min())))
    body = b"".join(struct.pack("<3i", *(round((v - s) / scale) for v, s in zip(q, shift))) + bytes(size - 12) for q in points)
    return bytes(head) + vlr + body


def test_files(spark, tmp_path):
    pts = [(1000.0, 2000.0, 100.0), (1040.0, 2030.0, 125.5), (1001.25, 2002.5, 99.5)]
    (tmp_path / "a.las").write_bytes(las(pts))
    (tmp_path / "b.las").write_bytes(las(pts, fmt=0, crs=False))
    (tmp_path / "c.ply").write_text("ply\nformat ascii 1.0\ncomment crs EPSG:32643\nelement vertex 2\nproperty double x\nproperty double y\nproperty float z\nend_header\n1 2 3\n4 5 6\n")
    (tmp_path / "d.ply").write_bytes(b"ply\nformat binary_big_endian 1.0\nelement vertex 1\nproperty uchar red\nproperty float x\nproperty float y\nproperty float z\nend_header\n" + struct.pack(">Bfff", 1, 7, 8, 9))
    (tmp_path / "e.las").write_bytes(b"broken")
    (tmp_path / "f.txt").write_text("no")
    h = {r.path[-5:]: r for r in pointfiles.headers(spark, str(tmp_path)).collect()}
    assert sorted(h) == ["a.las", "b.las", "c.ply", "d.ply", "e.las"]
    assert (h["a.las"].point_count, h["a.las"].crs, h["a.las"].x1, h["a.las"].z0, h["a.las"].problems) == (3, "EPSG:32643", 1040, 99.5, [])
    assert h["b.las"].crs == "UNKNOWN" and h["b.las"].warnings and h["c.ply"].crs == "EPSG:32643" and h["c.ply"].x1 == 4 and h["e.las"].problems
    (tmp_path / "e.las").unlink()
    got = sorted((r.path[-5:], r.id, round(r.x, 2), round(r.y, 2), round(r.z, 2)) for r in pointfiles.points(spark, str(tmp_path)).collect())
    assert got[:3] == [("a.las", i, *p) for i, p in enumerate(pts)] and got[-1] == ("d.ply", 0, 7, 8, 9) and len(got) == 9


def test_geojson(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"type": "FeatureCollection", "features": [{"a": 1}, {"a": 2}]}')
    r = pointfiles.geojson_features(spark, str(tmp_path)).first()
    assert (r.features, r.crs) == (2, "EPSG:4326")


def test_streams(spark, tmp_path):
    schema = "id long, ts timestamp, actor string, action string"
    rows = spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 600 + 10**9).alias("ts"), F.concat(F.lit("a"), (F.col("id") % 3).cast("string")).alias("actor"), F.when(F.col("id") % 2 == 0, "APPROVE").otherwise("REJECT").alias("action"))
    rows.union(rows.limit(5)).write.parquet(str(tmp_path / "log"))
    log = logs.tail(spark, str(tmp_path / "log"), schema)
    logs.append(logs.once_only(log), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
    batch = spark.read.parquet(str(tmp_path / "log"))
    assert logs.actions_by_window(batch).agg(F.sum("n")).first()[0] == 105
    assert logs.sessions(batch).count() >= 3
