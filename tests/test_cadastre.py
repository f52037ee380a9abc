"""The demo scene, writes, geometry kernels, CRS, histories."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import boxes as B
from plumbline.functions import crs
from plumbline.functions import identifiers as I
from plumbline.functions import rings as R
from plumbline.operators import changes, history, rules, spatial_join, store, volumes
from plumbline.sources.cadastre import Cadastre

BOX = "id string, seq long, x0 double, y0 double, x1 double, y1 double"


def demo(spark):
    """One parcel, one building of eight storeys, a basement and sixteen flats (two of them faulty), one corridor."""
    h = 3.2
    props = [("V-B", 0, 10.0, 8.0, 70.0, 44.0, -h, 0.0, -1, "basement")]
    for n in range(1, 9):
        left, right = (10.0, 40.0), (35.0 if n == 2 else 40.0, 86.0 if n == 5 else 70.0)
        props += [(f"V-{n}0{k}", 10 * n + k, a, 8.0, b, 44.0, h * (n - 1), h * n, n, f"U{k}") for k, (a, b) in enumerate((left, right), 1)]
    t = {
        "parcels": spark.createDataFrame([("P-001", 1, 0.0, 0.0, 80.0, 52.0)], BOX),
        "buildings": spark.createDataFrame([("B-001", 1, 10.0, 8.0, 70.0, 44.0, "P-001", 8)], BOX + ", parcel_id string, floor_count int"),
        "floors": spark.createDataFrame([(f"F{n}", n, 10.0, 8.0, 70.0, 44.0, "B-001", n, h * (n - 1), h * n) for n in range(1, 9)], BOX + ", building_id string, floor_number int, z_min double, z_max double"),
        "properties": spark.createDataFrame(props, BOX + ", z_min double, z_max double, floor_number int, unit_label string").withColumns({"building_id": F.lit("B-001"), "parcel_id": F.lit("P-001"), "block": F.lit(1), "ulpin": I.ulpin("VP", F.lit("P-001"), F.col("id"))}),
        "infrastructure": spark.createDataFrame([("I-1", 1, 18.0, 21.0, 62.0, 25.0, -2.2, 0.0, "UTILITY")], BOX + ", z_min double, z_max double, kind string"),
        "versions": spark.createDataFrame([], "object_id string, version int, x0 double, y0 double, x1 double, y1 double, z_min double, z_max double"),
    }
    return Cadastre(spark, t)


def test_demo_scene(spark):
    got = {r.rule_id: r for r in rules.run_rules(demo(spark)).collect()}
    assert set(got) == {"VERT-PROPERTY-OVERLAP", "INFRA-UTILITY-COLLISION", "PARCEL-PROPERTY-OUTSIDE"}
    assert got["VERT-PROPERTY-OVERLAP"].measure == pytest.approx(576) and (got["VERT-PROPERTY-OVERLAP"].object_a, got["VERT-PROPERTY-OVERLAP"].object_b) == ("V-201", "V-202")
    assert got["INFRA-UTILITY-COLLISION"].measure == pytest.approx(387.2) and got["INFRA-UTILITY-COLLISION"].object_a == "V-B"
    assert got["PARCEL-PROPERTY-OUTSIDE"].measure == pytest.approx(216) and got["PARCEL-PROPERTY-OUTSIDE"].object_a == "V-502"
    assert len(rules.RULES) == 30


def test_rules_survive_empty_collections(spark):
    c = demo(spark)
    empty = Cadastre(spark, {k: c._held[k].limit(0) for k in c._held})
    assert rules.run_rules(empty).count() == 0


def test_registered_rule(spark):
    rules.rule("OWN-TALL", "VERTICAL", "INFO")(lambda cat: rules.finding(cat.properties.where(B.height() > 3), "id", None, B.height()))
    try:
        assert rules.run_rules(demo(spark), "OWN-TALL").count() == 17
    finally:
        rules.RULES.pop("OWN-TALL")


def test_grid_join_is_the_theta_join(spark):
    rng = np.random.default_rng(5)
    make = lambda n: [(str(i), i, float(x), float(y), float(x + w), float(y + v)) for i, (x, y, w, v) in enumerate(rng.integers([-50, -50, 0, 0], [200, 200, 60, 60], (n, 4)))]
    a, b = make(60), make(50)
    want = {(p[0], q[0]) for p in a for q in b if p[2] <= q[4] and p[4] >= q[2] and p[3] <= q[5] and p[5] >= q[3]}
    for cell in (7.0, 40.0, 1000.0):
        got = [(r[0], r[1]) for r in spatial_join.grid_pairs(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), cell).select("a.id", "b.id").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_no_nested_loop_in_spatial_rules(spark):
    c = demo(spark)
    for df in (rules.property_overlap_global(c), rules.infra_collisions(c, "TUNNEL"), rules.unassigned_building(c), volumes.parcel_match(c.buildings, c.parcels)):
        assert "NestedLoop" not in df._jdf.queryExecution().toString()


def test_writes(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    new = spark.createDataFrame([("c", 3, "z")], t.schema)
    assert store.insert(t, new).count() == 3
    with pytest.raises(store.DuplicateRecord):
        store.insert(t, t)
    with pytest.raises(store.DuplicateRecord):
        store.insert(t, new.union(new))
    u = store.update(t, spark.createDataFrame([("a", 9, "no"), ("b", None, "no")], t.schema), ["n"])
    assert sorted(map(tuple, u.collect())) == [("a", 9, "x"), ("b", 2, "y")]
    assert [r.id for r in store.delete(t, new.union(t.where("id = 'a'"))).collect()] == ["b"]
    assert sorted(r.n for r in store.upsert(t, spark.createDataFrame([("b", 7, "q")], t.schema), ["id"]).collect()) == [1, 7]
    assert store.truncate(t).count() == 0
    assert store.find_by_id({"t": t, "u": u}, "a").first().kind_ == "t"
    ids = spark.createDataFrame([("DS-007",), ("DS-x",), (None,)], "id string")
    assert I.next_source_id(ids).first().next_id == "DS-008" and I.next_source_id(ids.limit(0)).first().next_id == "DS-001"


def test_validity_and_overlay():
    shape = np.array([(0, 0), (4, 0), (4, 4), (2, 2), (0, 4)], float)  # notched
    assert R.overlap_area(shape, np.array([(0, 2), (4, 2), (4, 4), (0, 4)], float)) == pytest.approx(4)
    assert R.overlap_area(shape, shape[::-1]) == pytest.approx(12)
    assert R.overlap_area(shape, shape + 10) == 0
    hull = R.convex_hull(np.random.default_rng(1).random((200, 2)))
    assert 0.8 < R.open_area(hull[:-1]) < 1
    line = np.array([(0, 0), (5, 0.01), (10, 0), (10, 10), (0, 10), (0, 0)], float)
    assert len(R.simplify(line, 0.1)) == 5


def test_validity(spark):
    rings = {
        "valid": [[(0, 0), (4, 0), (4, 3), (0, 3), (0, 0)], [(0, 0), (4, 0), (4, 4), (2, 2), (0, 4), (0, 0)]],
        "self-intersection": [[(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)], [(0, 0), (4, 0), (4, 0), (0, 0), (0, 0)], [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)], [(0, 0), (4, 0), (2, 0), (2, 3), (0, 0)]],
        "too few points": [[(0, 0), (1, 0), (0, 0)], None, []],
        "not closed": [[(0, 0), (1, 0), (1, 1), (2, 2)]],
        "not finite": [[(0, 0), (float("nan"), 0), (1, 1), (0, 0)]],
    }
    rows = [(k, None if r is None else [(float(x), float(y)) for x, y in r]) for k, rs in rings.items() for r in rs]
    for r in spark.createDataFrame(rows, f"want string, r {R.RING}").withColumn("got", R.validity(F.col("r"))).collect():
        assert r.got == r.want, r


def test_rules_on_rings(spark):
    """Triangles whose boxes overlap by more than they do."""
    ring = lambda *p: [(float(x), float(y)) for x, y in (*p, p[0])]
    rows = [("a", 1, 0.0, 0.0, 10.0, 10.0, 0.0, 3.0, 1, ring((0, 0), (10, 0), (0, 10))), ("b", 2, 0.0, 0.0, 10.0, 10.0, 1.0, 3.0, 1, ring((10, 10), (0, 10), (10, 0))), ("c", 3, 0.0, 0.0, 10.0, 10.0, 2.0, 5.0, 1, ring((0, 0), (10, 0), (10, 10))), ("d", 4, 1.0, 1.0, 1.0, 1.0, 0.0, 3.0, 2, ring((1, 1), (1, 1), (1, 1)))]
    cat = Cadastre(spark, {"properties": spark.createDataFrame(rows, BOX + f", z_min double, z_max double, floor_number int, ring {R.RING}")})
    assert {(r.object_a, r.object_b, round(r.measure, 6)) for r in rules.property_overlap_global(cat).collect()} == {("a", "c", 25.0), ("b", "c", 25.0)}
    assert [r.object_a for r in rules.zero_area(cat).collect()] == ["d"] and [r.object_a for r in rules.invalid(cat).collect()] == ["d"]


def test_a_corridor_has_four_cells(spark):
    """A box of any size lives in four cells at most, and meets small ones as the theta join says."""
    rng = np.random.default_rng(2)
    long = [("corridor", 0, -500_000.0, 10.0, 500_000.0, 14.0), ("hall", 1, 50.0, -9000.0, 7000.0, 9000.0)]
    small = [(f"s{k}", 10 + k, float(x), float(y), float(x + 30), float(y + 20)) for k, (x, y) in enumerate(zip(rng.integers(-9000, 9000, 150), rng.integers(-60, 60, 150)))]
    a, b = spark.createDataFrame(long + small[:70], BOX), spark.createDataFrame(small + long, BOX)
    copies = {r.id: r["count"] for r in spatial_join.keyed(a, 100.0, F.array().cast("array<int>")).groupBy("id").count().collect()}
    assert max(copies.values()) <= 4 and copies["corridor"] <= 4
    got = [(r[0], r[1]) for r in spatial_join.grid_pairs(a, b, 100.0).select("a.id", "b.id").collect()]
    want = {(p[0], q[0]) for p in long + small[:70] for q in small + long if p[2] <= q[4] and p[4] >= q[2] and p[3] <= q[5] and p[5] >= q[3]}
    assert len(got) == len(set(got)) and set(got) == want


def test_rings_in_the_engine(spark):
    d = spark.createDataFrame([(0.0, 0.0, 4.0, 3.0)], "x0 double, y0 double, x1 double, y1 double").select(B.ring().alias("r"))
    r = d.select(R.area("r" and F.col("r")).alias("a"), R.perimeter(F.col("r")).alias("p"), R.centroid(F.col("r")).alias("c"), R.validity(F.col("r")).alias("v"), R.from_geojson(R.to_geojson(F.col("r"))).alias("g"), F.col("r")).first()
    assert (r.a, r.p, r.c.x, r.c.y, r.v) == (12, 14, 2, 1.5, "valid") and r.g == r.r


def test_utm_against_known_places(spark):
    # central meridian and equator are exact; the scale there is 0.9996
    d = spark.createDataFrame([(75.0, 0.0), (75.0, 45.0), (77.2, 28.6), (77.2, -28.6)], "lon double, lat double")
    got = d.select(crs.to_utm(F.col("lon"), F.col("lat"), F.lit(43), F.col("lat") >= 0).alias("u"), "lon", "lat").collect()
    assert got[0].u.x == pytest.approx(500000) and got[0].u.y == pytest.approx(0, abs=1e-6)
    assert got[1].u.y == pytest.approx(0.9996 * 4984944.378, abs=0.01)  # meridian arc to 45 degrees
    assert got[2].u.x == got[3].u.x and got[2].u.y == pytest.approx(1e7 - got[3].u.y)
    names = spark.createDataFrame([("EPSG:32643",), ("urn:ogc:def:crs:EPSG::4326",), ("wgs84",), ("UNKNOWN",), ("epsg:3857",)], "c string")
    assert [tuple(r) for r in names.select(crs.resolve(F.col("c")), crs.is_metric(F.col("c"))).collect()] == [("EPSG:32643", True), ("EPSG:4326", False), ("EPSG:4326", False), (None, False), ("EPSG:3857", False)]


def test_review_machine(spark):
    acts = {"a": ["ASSIGN", "APPROVE", "REJECT"], "b": ["REJECT", "REOPEN", "RESURVEY"], "c": ["CLOSE", "APPROVE"], "d": ["REOPEN"]}
    log = spark.createDataFrame([(k, i, i, x) for k, v in acts.items() for i, x in enumerate(v)], "case_id string, ts int, id int, action string")
    assert {r.case_id: (r.state, r.decisions) for r in history.fold_cases(log).collect()} == {"a": ("APPROVED", 1), "b": ("RESURVEY_REQUESTED", 2), "c": ("CLOSED", 0), "d": ("PENDING", 0)}


def test_walk_ends_on_cycles(spark):
    links = spark.createDataFrame([("a", "b", "X"), ("b", "c", "Y"), ("c", "a", "Z"), ("d", None, "Z")], "object_id string, parent_id string, stage string")
    got = {(r.object_id, r.depth) for r in history.walk(links, links.where("object_id = 'a'"), True).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}
    line = history.lineage(links, links.where("object_id = 'a'"), ["Z", "Y", "X", "W"]).first()
    assert (line.present, line.missing, line.complete) == ("Z,Y,X", "W", True)


def test_changes(spark):
    cols = "id string, seq int, building_id string, floor_number int, x0 double, y0 double, x1 double, y1 double, z_min double, z_max double"
    box = (0.0, 0.0, 10.0, 10.0, 0.0, 3.0)
    a = spark.createDataFrame([("p", 1, "B", 1, *box), ("q", 2, None, 2, *box), ("r", 3, "B", 3, *box)], cols)
    b = spark.createDataFrame([("p", 1, "B", 1, *box), ("p", 2, "B", 1, 0.0, 0.0, 12.0, 10.0, 0.0, 3.0), ("q", 2, None, 2, 0.0, 0.0, 10.0, 10.0, 0.0, 4.0), ("s", 4, "B", 4, *box)], cols)
    got = {(r.object_id, r.change_type): r.delta for r in changes.compare(a, b).collect()}
    assert got == {("p", "FOOTPRINT"): 20, ("p", "VOLUME"): 60, ("q", "HEIGHT"): 1, ("q", "VOLUME"): 100, ("s", "NEW_FLOOR"): 0, ("r", "REMOVED_FLOOR"): 0}
    assert changes.compare(a, a).count() == 0


def test_labels(spark):
    d = spark.createDataFrame([(-2,), (0,), (1,), (4,)], "n int").select(I.floor_label(F.col("n")))
    assert [r[0] for r in d.collect()] == ["B2", "B1", "GF", "4"]
    one = spark.range(1).select(I.ulpin("LP", F.lit("P-001"), F.lit(None)), I.ulpin("VP", F.lit(""), F.lit("a 1")), I.volume_key(F.lit("DS-B01"), F.lit(3), F.lit(None))).first()
    assert tuple(one) == ("VC-LP-P001-LAND", "VC-VP-A1", "DS-B01-F03") and math.isfinite(1)
