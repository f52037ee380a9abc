"""Point files by ranges of records, bad ones among them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.sources import ingest, pointfiles, pointsource

from .test_pointcloud import las


def ply(points, kind="binary_little_endian", promised=None):
    head = f"ply\nformat {kind} 1.0\ncomment crs EPSG:32643\nelement vertex {len(points) if promised is None else promised}\nproperty uchar red\nproperty double x\nproperty float y\nproperty double z\nend_header\n".encode()
    if kind == "ascii":
        return head + "\n".join(f"7 {x!r} {y!r} {z!r}" for x, y, z in points.tolist()).encode() + b"\n"
    e = ">" if "big" in kind else "<"
    rows = np.zeros(len(points), [("r", "u1"), ("x", f"{e}f8"), ("y", f"{e}f4"), ("z", f"{e}f8")])
    rows["x"], rows["y"], rows["z"] = points.T
    return head + rows.tobytes()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("points")
    p = np.round(np.random.default_rng(5).uniform(1000, 1100, (300, 3)), 2).astype(np.float32).astype(float)
    (d / "a.las").write_bytes(las(p))
    (d / "b.ply").write_bytes(ply(p[:120]))
    (d / "c.ply").write_bytes(ply(p[:130], "binary_big_endian"))
    (d / "d.ply").write_bytes(ply(p[:140], "ascii"))
    (d / "e_short.ply").write_bytes(ply(p[:50], promised=60))
    (d / "f_bad.las").write_bytes(b"LASF notmuch")
    (d / "g_empty.ply").write_bytes(b"")
    (d / "h_text.ply").write_bytes(ply(p[:3], "ascii").replace(b"7 ", b"seven "))
    (d / "i_none.ply").write_bytes(ply(p[:0]))
    (d / "notes.txt").write_text("not points")
    return d, p


def test_same_points_as_whole_files(spark, folder):
    d, p = folder
    for block in (7, 100, 10**6):
        got = {}
        for r in pointsource.read(spark, str(d), block).collect():
            got.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
        for name, n in (("a.las", 300), ("b.ply", 120), ("c.ply", 130), ("d.ply", 140), ("e_short.ply", 50)):
            rows = sorted((r for r in got[name] if r.problem is None), key=lambda r: r.id)
            assert [r.id for r in rows] == list(range(n))
            assert np.allclose([(r.x, r.y, r.z) for r in rows], p[:n], atol=0.006)
        told = {k: [r.problem for r in v if r.problem] for k, v in got.items()}
        assert {k for k, v in told.items() if v} == {"e_short.ply", "f_bad.las", "g_empty.ply", "h_text.ply"} and told["e_short.ply"] == ["10 points are missing"]
        assert "notes.txt" not in got and "i_none.ply" not in got


def test_three_blocks_are_three_tasks(spark, folder):
    d, _ = folder
    df = pointsource.read(spark, str(d / "a.las"), 100)
    assert df.rdd.getNumPartitions() == 3
    assert sorted(r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()) == [100, 100, 100]


def test_scan_goes_on_past_a_bad_file(spark, folder):
    d, _ = folder
    n = ingest.scan(spark, str(d)).count()
    assert n == 300 + 120 + 130 + 140 + 50
    assert pointfiles.points(spark, str(d)).where("path like '%a.las' or path like '%d.ply'").count() == 440
    with pytest.raises(ingest.TooManyPoints, match="a.las"):
        ingest.scan(spark, str(d), 200)
    assert {r.path.rsplit("/", 1)[1] for r in ingest.refused_scan(spark, str(d)).collect()} >= {"f_bad.las", "h_text.ply"}


def test_globs_and_missing_paths(spark, folder):
    d, _ = folder
    assert pointsource.read(spark, f"{d}/[bc].ply").count() == 250
    assert pointsource.read(spark, f"file://{d}/b.ply").count() == 120
    with pytest.raises(Exception, match="nowhere"):  # noqa: B017
        pointsource.read(spark, f"{d}/nowhere").count()
