"""Storey checks, stored findings, ingestion, the demonstration scene, CRS and shapes."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import crs as C
from plumbline.functions import identifiers as I
from plumbline.functions import rings as R
from plumbline.functions import shapes as S
from plumbline.operators import findings, lookups, rules, storeys
from plumbline.sources import demo, ingest

LEVELS = "array<struct<z:double,snapped:boolean,evidence:double>>"


def test_demo_scene_and_stored_findings(spark):
    cat = demo.scene(spark)
    cat._held["versions"] = spark.createDataFrame([], "object_id string, version int, x0 double, y0 double, x1 double, y1 double, z_min double, z_max double")
    assert {k: getattr(cat, k).count() for k in ("parcels", "buildings", "floors", "properties", "infrastructure")} == {"parcels": 1, "buildings": 1, "floors": 8, "properties": 17, "infrastructure": 1}
    found = rules.run_rules(cat)
    got = {r.rule_id: r for r in findings.stored(findings.located(findings.described(found), cat.properties)).collect()}
    assert set(got) == {"VERT-PROPERTY-OVERLAP", "INFRA-UTILITY-COLLISION", "PARCEL-PROPERTY-OUTSIDE"}
    o = got["VERT-PROPERTY-OVERLAP"]
    assert o.overlap_volume == pytest.approx(576) and o.location == "B-001 / Floor 2" and o.description == "Volumes PV-201 and PV-202 share 576.0 m3."
    xs = [p[0] for p in json.loads(o.geometry)["coordinates"][0]]
    assert (min(xs), max(xs)) == (35, 40) and o.status == "OPEN" and o.gap_m is None


def test_building_reasons(spark):
    lv = [(0.0, True, 1.0), (3.0, True, 0.8), (6.0, False, 0.0), (12.0, False, 0.0)]
    df = spark.createDataFrame([(1, lv, 3.0, True, ["merged"], ["storey 3"], [400, 30, 5]), (2, lv[:1], 0.0, False, [], [], [])], f"id int, levels {LEVELS}, storey_height double, supplied boolean, level_warnings array<string>, irregular array<string>, counts array<int>")
    got = {r.id: [x.split(":")[0] for x in r.reasons] for r in storeys.building_reasons(df).collect()}
    assert got[1] == ["LEVELS_SUPPLIED", "LEVEL_WARNING", "NO_LEVEL_EVIDENCE", "IRREGULAR_SPACING", "TOP_LEVEL_AMBIGUOUS", "SPARSE_FLOOR", "DENSE_OUTLIER", "TOO_FEW_POINTS"]
    assert got[2] == ["NO_FLOORS_DETECTED"]


def test_segmented_storeys(spark):
    r = np.random.default_rng(1)
    n = 3000
    pts = spark.createDataFrame([(i, float(x), float(y), float(h)) for i, (x, y, h) in enumerate(zip(r.uniform(0, 20, n), r.uniform(0, 10, n), r.uniform(0, 9, n)))] + [(-1, 50.0, 50.0, 1.0)], "id long, x double, y double, height double")
    boxes = spark.createDataFrame([(7, 0.0, 0.0, 20.0, 10.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    lv = spark.createDataFrame([(7, [(0.0, True, 1.0), (3.0, True, 1.0), (6.0, False, 0.0), (9.0, True, 1.0)], 3.0)], f"building long, levels {LEVELS}, storey_height double")
    got = {x.storey: x for x in storeys.segmented(pts, boxes, lv).collect()}
    assert set(got) == {1, 2, 3} and sum(x.points for x in got.values()) == n
    assert got[1].volume_m3 == 600 and got[1].height_agreement == 1 and not got[1].requires_review
    assert got[2].requires_review and got[2].reasons[0].startswith("UNSUPPORTED_BOUNDARY: the upper")
    # boundaries are the middles between levels: 1.5, 4.5
    assert got[1].points < got[2].points < got[3].points + n


def test_snap_takes_the_later_of_equals(spark):
    p = F.array(*(F.struct(F.lit(z).alias("z"), F.lit(e).alias("evidence")) for z, e in ((1.0, 0.1), (3.0, 0.3), (9.0, 0.9))))
    r = spark.range(1).select(storeys.snap(F.lit(2.0), p, F.lit(1.5)).alias("a"), storeys.snap(F.lit(6.0), p, F.lit(1.0)).alias("b")).first()
    assert (r.a.z, r.a.evidence) == (3.0, 0.3) and r.b is None


def test_changes_persist_alike_twice(spark):
    ch = spark.createDataFrame([("V-1", "B-1", 2, "S", "HEIGHT", 1.5), ("V-9", "B-1", 8, "S", "NEW_FLOOR", 0.0)], "object_id string, building_id string, floor_number int, source_id string, change_type string, delta double")
    a, b = (findings.persisted(ch, F.lit("2026-01-01 10:00:00").cast("timestamp"), "me") for _ in range(2))
    for k in a:
        assert sorted(map(str, a[k].collect())) == sorted(map(str, b[k].collect())) and a[k].count() == 2
    new = a["issues"].where("rule_id = 'CHANGE-UNREGISTERED-FLOOR'").first()
    assert new.location == "Storey 8 of building B-1" and new.severity == "WARNING"
    rep = findings.report(a["changes"]).first()
    assert (rep.total_changes, rep.status, json.loads(rep.by_type)) == (2, "REQUIRES_VERIFICATION", {"HEIGHT": 1, "NEW_FLOOR": 1})
    assert findings.report(a["changes"].limit(0)).first().status == "NO_CHANGE"
    with pytest.raises(ValueError):
        lookups.changes_of(ch, change_type="COLOUR")


def las(path, n=50, seed=0):
    xyz = np.random.default_rng(seed).integers(0, 1000, (n, 3)).astype("<i4")
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = bytes([1, 2])
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    struct.pack_into("<BHI", head, 104, 0, 20, n)
    struct.pack_into("<6d", head, 131, 0.1, 0.1, 0.1, 5e5, 2e6, 0)
    lo, hi = xyz.min(0) * 0.1 + [5e5, 2e6, 0], xyz.max(0) * 0.1 + [5e5, 2e6, 0]
    struct.pack_into("<6d", head, 179, hi[0], lo[0], hi[1], lo[1], hi[2], lo[2])
    body = np.zeros((n, 20), np.uint8)
    body[:, :12] = xyz.view(np.uint8).reshape(n, 12)
    path.write_bytes(bytes(head) + body.tobytes())


def test_ingestion(spark, tmp_path):
    from plumbline.sources import pointfiles

    files = tmp_path / "in"
    files.mkdir()
    for k in range(3):
        las(files / f"a{k}.las", seed=k)
    (files / "same.las").write_bytes((files / "a0.las").read_bytes())
    (files / "broken.las").write_bytes(b"LASFxx")
    (files / "notes.txt").write_text("x")
    path = f"{files}/*"
    assert {r.why for r in ingest.refused(spark, path).collect()} == {"unsupported extension"}
    assert {r.why for r in ingest.refused(spark, path, 100).collect()} == {"unsupported extension", "file too large"}
    taken = spark.createDataFrame([("DS-041", "nothing")], "id string, sha256 string")
    got = ingest.ingested(pointfiles.headers(spark, path), taken, F.lit("2026-01-01").cast("timestamp"), "me", "EPSG:32643")
    src = got["sources"].collect()
    assert sorted(r.id for r in src) == ["DS-042", "DS-043", "DS-044"] and {r.crs_source for r in src} == {"caller_supplied"}
    assert all(r.processing_crs == "EPSG:32643" and 74.9 < r.display_bounds.x0 < 75.1 and r.density > 0 for r in src)
    assert got["jobs"].count() == 3 and got["links"].count() == 6
    keep = str(tmp_path / "kept")
    assert sorted(r.new for r in ingest.retain(spark, path, keep).collect()) == [True] * 4
    assert sorted(r.new for r in ingest.retain(spark, path, keep).collect()) == [False] * 4
    assert spark.read.parquet(keep).count() == 4
    assert ingest.scan(spark, f"{files}/a*.las").count() == 150
    with pytest.raises(ingest.TooManyPoints):
        ingest.scan(spark, f"{files}/a*.las", 10)
    assert {r.why for r in ingest.refused_scan(spark, f"{files}/a*.las", 10).collect()} == {"too many points"}


def test_polar_and_rings(spark):
    r = spark.range(1).select(C.from_wgs84(F.lit(-45.0), F.lit(70.0), F.lit("EPSG:3413")).alias("n"), C.from_wgs84(F.lit(0.0), F.lit(-71.0), F.lit("EPSG:3031")).alias("s"), C.transform(F.lit(1.0), F.lit(2.0), F.lit("EPSG:4326"), F.lit("EPSG:4326")).alias("same")).first()
    # on the central meridian at the latitude of true scale, the distance from the pole is the parallel's radius
    e2 = C.FLATTENING * (2 - C.FLATTENING)
    radius = lambda lat: C.A * math.cos(math.radians(lat)) / math.sqrt(1 - e2 * math.sin(math.radians(lat)) ** 2)
    assert r.n.x == pytest.approx(0, abs=1e-6) and r.n.y == pytest.approx(-radius(70), abs=1e-3) and r.s.y == pytest.approx(radius(71), abs=1e-3)
    assert (r.same.x, r.same.y) == (1.0, 2.0)
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((500000, 2000000), (500100, 2000000), (500100, 2000050), (500000, 2000050), (500000, 2000000))))
    there = C.transform_ring(ring, F.lit("EPSG:32643"), F.lit("EPSG:4326"))
    back = spark.range(1).select(C.transform_ring(there, F.lit("EPSG:4326"), F.lit("EPSG:32643")).alias("r")).select(R.area(F.col("r")).alias("a")).first()
    assert back.a == pytest.approx(5000, rel=1e-6)


def test_shapes(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0), (1, 2.0, 2.0, 6.0, 6.0), (1, 3.0, 0.0, 5.0, 1.0), (2, 0.0, 0.0, 1.0, 1.0)], "k int, x0 double, y0 double, x1 double, y1 double")
    area = {r.k: r.a for r in S.dissolve(boxes, "k").groupBy("k").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("a")).collect()}
    assert area == {1: 29.0, 2: 1.0}
    lists = boxes.groupBy("k").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("b")).orderBy("k")
    assert [r.a for r in lists.select(S.shared_area(F.col("b"), F.col("b")).alias("a")).collect()] == [29.0, 1.0]
    plate = np.array([[0, 0], [10, 0], [10, 6], [0, 6], [0, 0]], float)
    walls = [np.array([[4, 0], [4, 6]], float), np.array([[4, 3], [10, 3]], float), np.array([[1, 1], [2, 2]], float)]
    a, b = S.subdivided(plate, walls), S.subdivided(plate, walls[::-1])
    assert [round(abs(R.open_area(f[:-1])), 6) for f in a] == [24, 18, 18] and all(np.allclose(x.min(0), y.min(0)) for x, y in zip(a, b))
    assert S.subdivided(plate, walls[2:]) == []
    tilted = S.chord(plate, np.array([[4, 1e-4], [5, 6]], float))
    assert tilted[:, 1] == pytest.approx([0, 6])
    bow = np.array([[0, 0], [1, 1], [1, 0], [0, 1], [0, 0]], float)
    assert len(S.repaired_xy(bow)) == 5 and len(S.repaired_xy(np.array([[0, 0], [0, 0]], float))) == 0
    ell = np.array([[x, y] for x in range(11) for y in range(11) if x <= 4 or y <= 4], float)
    out = S.concave_xy(ell)
    assert abs(R.open_area(out[:-1])) < abs(R.open_area(R.convex_hull(ell)[:-1])) and not R.proper_crossings(out)
    rings = spark.createDataFrame([([[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 0.0)]],), ([],)], f"p array<{R.RING}>")
    big = [r.b for r in rings.select(S.largest(F.col("p")).alias("b")).collect()]
    assert big[0][1].x == 9 and big[1] is None


def test_identifiers_and_dates(spark):
    r = spark.sql("select timestamp'2026-03-04 05:06:07.000089' t, timestamp'2026-03-04 05:06:07' u").select(I.event_id("AE", F.col("t"), F.lit("x")).alias("e"), I.iso(F.col("t")).alias("i"), I.iso(F.col("u")).alias("j"), I.day(F.lit("2026-03-04T1")).alias("d"), I.day(F.lit("soon")).alias("n")).first()
    assert r.e.startswith("AE-20260304050607000089-") and r.i.endswith("07.000089") and r.j == "2026-03-04T05:06:07" and str(r.d) == "2026-03-04" and r.n is None
    assert math.isclose(spark.range(1).select(C.density(F.lit(100), *map(F.lit, (5e5, 2e6, 500010.0, 2000010.0)), F.lit("EPSG:32643")).alias("d")).first().d, 1.0)


def test_answers_and_faces(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert ingest.answers(df).first().json == '{"a":1,"b":null}'
    f = F.array(*(F.struct(F.lit(a).alias("area"), F.lit(x).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1")) for a, x in ((1.0, 5.0), (3.0, 0.0), (1.0, 2.0))))
    assert [(x.area, x.x0) for x in spark.range(1).select(lookups.faces_in_order(f).alias("f")).first().f] == [(3.0, 0.0), (1.0, 2.0), (1.0, 5.0)]
