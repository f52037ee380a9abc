"""Volumes from storeys and plans, and what a run leaves: whole or not at all."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import arrangement as A
from plumbline.operators import generation as G
from plumbline.operators.commits import Store


def box(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


W = lambda *p: [(float(x), float(y)) for x, y in p]
FLOORS = f"id string, building_id string, floor_number int, z_min double, z_max double, plate {A.SHAPE}, walls {A.SHAPE}, units {A.SHAPE}, labels array<string>"
BUILDINGS = "id string, ref string, source_id string, seq long, x0 double, y0 double, x1 double, y1 double"


def scene(spark):
    plate = [box(0, 0, 10, 10)]
    floors = [
        ("F1", "XB-1", -1, -3.0, 0.0, plate, None, None, None),
        ("F2", "XB-1", 1, 0.0, 3.0, plate, [W((4, 0), (6, 10))], None, ["shop", "hall"]),
        ("F3", "XB-1", 2, 3.0, 6.0, plate, [W((4, 0), (4, 5))], None, None),  # a stub
        ("F4", "XB-1", 3, 6.0, 9.0, plate, None, [box(0, 0, 5, 10), box(5, 0, 9, 10), box(20, 0, 30, 10)], ["01", "02", "03"]),
        ("F5", "XB-1", 4, 9.0, 9.0, plate, None, None, None),  # no height
        ("F6", "XB-1", 5, 9.0, 12.0, [box(0, 0, 0, 10)], None, None, None),  # no area
        ("F7", "XB-2", None, 0.0, 3.0, plate, [W((0.1, 0), (0.1, 10))], None, None),  # a sliver of one square metre
        ("F8", "XB-9", 1, 0.0, 3.0, plate, None, None, None),  # no such building
        ("F9", "XB-3", 12, 0.0, 3.0, plate, None, [box(20, 0, 30, 10)], None),  # outlines elsewhere
    ]
    buildings = [("XB-1", "DS-1-B01", "DS-1", 1, 0.0, 0.0, 10.0, 10.0), ("XB-2", "DS-1-B02", "DS-1", 2, 15.0, 0.0, 25.0, 10.0), ("XB-3", "DS-2-B123", "DS-2", 3, 500.0, 0.0, 510.0, 10.0)]
    parcels = [("P-1", 1, -5.0, -5.0, 20.0, 20.0), ("P-2", 2, -9.0, -9.0, 19.0, 19.0), ("P-3", 3, 22.0, 0.0, 40.0, 20.0)]
    return spark.createDataFrame(buildings, BUILDINGS), spark.createDataFrame(floors, FLOORS), spark.createDataFrame(parcels, "id string, seq long, x0 double, y0 double, x1 double, y1 double")


def test_generate(spark):
    got = {}
    for v in G.generate(*scene(spark), 0.0).collect():
        got[v.key] = (v.parent_parcel_id, v.parcel_match, v.floor_number, v.floor_label, v.volume_scope, v.property_type, v.vertical_position, v.area_m2, v.volume_m3, v.label_source, tuple(v.review_reasons))
        assert v.requires_human_review == (v.status == G.REVIEW) == bool(v.review_reasons)
    many = ("P-1", "ambiguous")
    b1 = "DS-1-B01-F{0:02d}"
    unit = lambda n, label: f"{b1.format(n)}-{b1.format(n)}-{label}"
    assert got == {
        "DS-1-B01-F-1": (*many, -1, "B1", "FLOOR", "BASEMENT", "UNDERGROUND", 100.0, 300.0, "synthesised", ("MULTIPLE_PARCELS",)),
        unit(1, "shop"): (*many, 1, "GF", "UNIT", "UNIT", "ELEVATED", 50.0, 150.0, "floor_plan", ("MULTIPLE_PARCELS",)),
        unit(1, "hall"): (*many, 1, "GF", "UNIT", "UNIT", "ELEVATED", 50.0, 150.0, "floor_plan", ("MULTIPLE_PARCELS",)),
        "DS-1-B01-F02": (*many, 2, "2", "FLOOR", "FLOOR", "ELEVATED", 100.0, 300.0, "synthesised", ("MULTIPLE_PARCELS", "WALLS_PRODUCED_NO_DIVISION")),
        unit(3, "01"): (*many, 3, "3", "UNIT", "UNIT", "ELEVATED", 50.0, 150.0, "floor_plan", ("MULTIPLE_PARCELS", "UNIT_OUTSIDE_FLOOR", "AREA_MISMATCH")),
        unit(3, "02"): (*many, 3, "3", "UNIT", "UNIT", "ELEVATED", 40.0, 120.0, "floor_plan", ("MULTIPLE_PARCELS", "UNIT_OUTSIDE_FLOOR", "AREA_MISMATCH")),
        "DS-1-B02-F01-DS-1-B02-F01-U01": ("UNASSIGNED", "ambiguous", 1, "GF", "UNIT", "UNIT", "ELEVATED", 99.0, 297.0, "synthesised", ("MULTIPLE_PARCELS",)),
        "DS-2-B123-F12": ("UNASSIGNED", "none", 12, "12", "FLOOR", "FLOOR", "ELEVATED", 100.0, 300.0, "synthesised", ("NO_PARCEL_MATCH", "UNIT_OUTSIDE_FLOOR")),
    }
    assert {r for v in G.generate(*scene(spark)).collect() for r in v.review_reasons[-1:]} == {"DATUM_UNKNOWN"}


def test_generate_nothing(spark):
    b, f, p = scene(spark)
    assert G.generate(b, f.limit(0), p).count() == 0
    assert G.generate(b.limit(0), f, p).count() == 0
    assert {v.parcel_match for v in G.generate(b, f.where("id = 'F1'"), p.limit(0)).collect()} == {"none"}


def test_ready(spark):
    b, f, _ = scene(spark)
    sources = spark.createDataFrame([("DS-1", "EPSG:32643"), ("DS-2", "UNKNOWN"), ("DS-3", "EPSG:4326")], "id string, crs string")
    G.ready(sources, b, f, "DS-1")
    for s in ("DS-2", "DS-3", "DS-4"):
        with pytest.raises(G.NothingToGenerate):
            G.ready(sources, b, f, s)
    with pytest.raises(G.NothingToGenerate):
        G.ready(sources, b, f.where("building_id = 'XB-9'"), "DS-1")


def run(spark, store, volumes, job):
    rows = G.rows_of_run(volumes, store.read("volumes"), job, F.to_timestamp(F.lit("2024-05-01 10:00:00")), "me")
    return store.commit(job, append={k: rows[k] for k in ("links", "jobs", "audit")}, replace={"volumes": rows["volumes"]})


def test_service_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    made = G.generate(*scene(spark), 0.0)
    v = spark.createDataFrame(made.collect(), made.schema)
    assert store.read("volumes") is None
    assert run(spark, store, v, "JOB-1")
    n = v.count()
    assert (store.read("volumes").count(), store.read("links").count(), store.read("jobs").count(), store.read("audit").count()) == (n, 2 * n, 2, 2)
    assert not run(spark, store, v, "JOB-1")  # the same run again adds nothing
    assert store.read("links").count() == 2 * n
    # a later run takes the place of the volumes of its keys and leaves the others
    assert run(spark, store, v.where("source_id = 'DS-1'").withColumn("area_m2", F.lit(1.0)), "JOB-2")
    got = {r.key: (r.job_id, r.area_m2) for r in store.read("volumes").collect()}
    assert len(got) == n and got["DS-2-B123-F12"] == ("JOB-1", 100.0) and got["DS-1-B01-F02"] == ("JOB-2", 1.0)
    assert {r.id for r in store.read("jobs").collect()} == {"JOB-1/DS-1", "JOB-1/DS-2", "JOB-2/DS-1"}
    links = {(r.object_id, r.parent_id, r.stage) for r in store.read("links").collect()}
    assert ("GPV-DS2B123F12", "F9", "PROPERTY_VOLUME") in links and any(stage == "ULPIN" and parent == "GPV-DS2B123F12" for _, parent, stage in links)


def test_killed_between_writes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    a, b = spark.range(5).toDF("x"), spark.range(7).toDF("x")
    assert store.commit("one", append={"a": a, "b": b})

    def dies(*_):
        raise KeyboardInterrupt

    broken = b.select(F.assert_true(F.col("x") < 3).alias("z"), "x")
    with pytest.raises(Exception):  # noqa: B017  the second table's job fails after the first is written
        store.commit("two", append={"a": a, "b": broken.select("x", "z")})
    whole = Store(spark, f"file://{tmp_path}/store")
    whole._publish = dies  # or the driver dies after both
    with pytest.raises(KeyboardInterrupt):
        whole.commit("two", append={"a": a, "b": b})
    assert (store.read("a").count(), store.read("b").count(), store.committed("two")) == (5, 7, False)
    assert store.commit("two", append={"a": a, "b": b})
    assert (store.read("a").count(), store.read("b").count()) == (10, 14)


def test_two_writers(spark, tmp_path):
    one, two = Store(spark, f"file://{tmp_path}/store"), Store(spark, f"file://{tmp_path}/store")
    x = spark.range(3)
    assert one.commit("base", replace={"t": x})
    real = two._last
    stale = real()
    calls = iter([stale, stale])
    two._last = lambda: next(calls, None) or real()
    one.commit("between", append={"t": x})
    assert two.commit("late", append={"t": x})  # its number is taken: it goes on from what the other left
    assert one.read("t").count() == 9
    calls = iter([real(), real()])
    one.commit("again", replace={"t": x})
    with pytest.raises(RuntimeError):
        two.commit("lost", replace={"t": x})
    assert one.read("t").count() == 3


def test_regions_shuffle_nothing(spark):
    sq = "array(array(struct(0d AS x, 0d AS y), struct(9d AS x, 0d AS y), struct(9d AS x, 9d AS y), struct(0d AS x, 9d AS y), struct(0d AS x, 0d AS y)))"
    df = spark.sql(f"SELECT 'f' AS id, {sq} AS plate, {sq} AS walls, {sq} AS units")
    plan = G.regions(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
