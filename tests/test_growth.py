"""What keeps queries from growing faster than their input."""

from pyspark.sql import functions as F

from plumbline.operators import findings, spatial_join
from plumbline.sources import cadastre

SMALL = "/root/testdata/sf0.001"


def test_long_boxes_live_on_flat_cells(spark):
    """A corridor's cells are as long as it, but no higher than its own height calls for."""
    long = spark.sql("SELECT 'c' AS id, 0 AS seq, -50000e0 AS x0, 21e0 AS y0, 900044e0 AS x1, 25e0 AS y1")
    small = spark.range(500).selectExpr("concat('b', id) AS id", "id AS seq", "10e0 AS x0", "100e0 * id AS y0", "40e0 AS x1", "100e0 * id + 36 AS y1")
    cells = spatial_join.keyed(small, 100.0, spatial_join.levels_in(long, 100.0)).where("gk <> gl").groupBy("gk", "gx", "gy").count()
    assert cells.agg(F.max("count")).first()[0] == 1
    assert [r.id for r in spatial_join.grid_pairs(small, long, 100.0).select("a.id").collect()] == ["b0"]


def test_stored_ids_are_long(spark):
    """Forty bits met among millions of changes; all ids of a comparison that are stored have 128."""
    ch = spark.sql("SELECT 'V-1' AS object_id, 'B-1' AS building_id, 1 AS floor_number, 'S' AS source_id, 'HEIGHT' AS change_type, 1e0 AS delta")
    out = findings.persisted(ch, F.lit("2026-01-01 10:00:00").cast("timestamp"), "me")
    for name, col in (("changes", "id"), ("changes", "finding_id"), ("issues", "id"), ("audit", "id"), ("cases", "case_id"), ("cases", "issue_id")):
        assert len(out[name].first()[col].rsplit("-", 1)[1]) == 32, (name, col)
    assert out["issues"].first().id == out["changes"].first().finding_id


def test_kept_collections_are_derived_once(spark):
    c = cadastre.Cadastre.load(spark, SMALL)
    n = c.properties.count()
    plan = c.kept("properties").properties._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    assert c.properties.count() == n


def test_a_comparison_groups_both_sides_once(spark):
    c = cadastre.Cadastre.load(spark, SMALL).kept("properties")
    from plumbline.operators import changes

    plan = changes.compare(c.properties, c.survey)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_crossings_of_many_rings_at_once(spark):
    """By Arrow batches, as the pair by pair version has them; higher-order functions took minutes a million."""
    import random

    import numpy as np

    from plumbline.functions import rings as R

    r = random.Random(4)
    rows = []
    for k in range(300):
        p = [(float(r.randint(0, 6)), float(r.randint(0, 6))) for _ in range(r.randint(3, 7))]
        rows.append((k, [*p, p[0]]))
    got = spark.createDataFrame(rows + [(300, None)], f"k int, ring {R.RING}").select("k", R.crosses_itself(F.col("ring")).alias("c"), R.validity(F.col("ring")).alias("v"))
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
    out = {x.k: x for x in got.collect()}
    assert out[300].v == "too few points"
    simple = [(k, p) for k, p in rows if all(a != b for a, b in zip(p, p[1:]))]
    assert all(out[k].c == R.proper_crossings(np.array(p)) for k, p in simple)
    assert 0 < sum(out[k].c for k, _ in simple) < len(simple)


def test_shared_area_of_many_rings_at_once(spark):
    from plumbline.functions import rings as R

    ring = lambda x, y: f"array(struct({x} AS x, 0d AS y), struct({x} + 4d AS x, 0d AS y), struct({x} + 4d AS x, {y} AS y), struct({x} AS x, {y} AS y), struct({x} AS x, 0d AS y))"
    df = spark.range(20).select("id", F.expr(ring("0d", "3d")).alias("a"), F.expr(f"CASE WHEN id < 9 THEN {ring('CAST(id AS DOUBLE)', '2d')} END").alias("b")).select("id", R.intersection_area(F.col("a"), F.col("b")).alias("s"))
    assert {r.id: r.s for r in df.collect()} == {k: 2.0 * max(0, 4 - k) if k < 9 else 0.0 for k in range(20)}


def test_boxes_are_dissolved_by_batches(spark):
    """All lists of a batch at once; a sweep for each group took minutes a million."""
    import random

    import pyarrow as pa

    from plumbline.functions import shapes as S

    r = random.Random(5)
    lists = [[dict(zip(("x0", "y0", "x1", "y1"), (float(r.randint(0, 7)) for _ in range(4)))) for _ in range(r.randint(0, 9))] for _ in range(60)]
    cells = lambda boxes: sorted((x, y) for b in boxes for x in range(int(b["x0"]), int(b["x1"])) for y in range(int(b["y0"]), int(b["y1"])))
    for most in (1, 7, 1 << 21):
        got = S.strips(pa.array([*lists, None]), most).to_pylist()
        assert [cells(g) for g in got[:-1]] == [sorted(set(cells(b))) for b in lists] and got[-1] == []
    df = spark.createDataFrame([(k, *b.values()) for k, g in enumerate(lists) for b in g], "k int, x0 double, y0 double, x1 double, y1 double")
    out = S.dissolve(df, "k")
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
    assert out.selectExpr("cast(sum((x1 - x0) * (y1 - y0)) as long) a").first().a == sum(len(set(cells(b))) for b in lists)


def test_walls_are_looked_at_once_a_storey(spark):
    """The cuts of a storey are sorted in one place of the plan, not again for each use of its units."""
    from plumbline.operators import volumes

    floors = spark.sql("SELECT 'B-1-F1' AS id, 'B-1' AS building_id, 1 AS floor_number, 0e0 AS x0, 0e0 AS y0, 60e0 AS x1, 36e0 AS y1, 0e0 AS z_min, 3e0 AS z_max UNION ALL SELECT 'B-1-F2', 'B-1', 2, 0e0, 0e0, 60e0, 36e0, 3e0, 6e0")
    walls = spark.sql("SELECT 'B-1-F2' AS floor_id, explode(array(10e0, 30e0, 70e0)) AS x")
    out = volumes.split_by_walls(floors, walls)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_sort") == 1
    assert sorted((r.key, r.scope, r.x0, r.x1) for r in out.collect()) == [("B-1-F01", "FLOOR", 0.0, 60.0), ("B-1-F02-U1", "UNIT", 0.0, 10.0), ("B-1-F02-U2", "UNIT", 10.0, 30.0), ("B-1-F02-U3", "UNIT", 30.0, 60.0)]


def test_a_walk_writes_its_rounds_once(spark):
    """As tables; an eager checkpoint computes its rows twice. Stages that aren't asked for and cycles change nothing."""
    from plumbline.operators import history

    links = spark.createDataFrame([("a", None, "S"), ("b", "a", "T"), ("b", "a", "T"), ("c", "b", "U"), ("c", "b", "odd"), ("d", "e", None), ("e", "d", "T")], "object_id string, parent_id string, stage string")
    seeds = spark.createDataFrame([("c",), ("d",)], "object_id string")
    got = history.walk(links, seeds, True)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parquet") >= 2
    assert sorted(map(tuple, got.collect())) == [("c", "a", 2), ("c", "b", 1), ("c", "c", 0), ("d", "d", 0), ("d", "e", 1)]
    rows = sorted(map(tuple, history.lineage(links, seeds, ["S", "T", "U", "V"]).collect()))
    assert rows == [("c", 2, "S,T,U", "V", True), ("d", 1, "T", "S,U,V", False)]


def test_a_task_s_share_is_small(spark):
    """Two megabytes of a table for each shuffle partition, which adaptive execution doesn't join into larger ones as the table grows."""
    n = "spark.sql.shuffle.partitions"
    was = spark.conf.get(n)
    try:
        df = cadastre.dealt(spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet"))
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        assert int(spark.conf.get(n)) >= size / (2 << 20)
        assert all(int(spark.conf.get(k)) == 16 << 20 for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"))
    finally:
        spark.conf.set(n, was)


def test_pairs_of_a_class_are_dealt(spark):
    """One class fills more than one task, and no pair is lost or doubled."""
    box = "0e0 AS x0, 0e0 AS y0, 1e0 AS x1, 1e0 AS y1"
    many = spark.range(200).selectExpr("concat('v', id) AS id", "id * 50 AS seq", *box.split(", "))
    few = spark.range(7).selectExpr("concat('i', id) AS id", "id * 50 AS seq", *box.split(", "))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = spatial_join.class_pairs(many, few, F.col("seq") % 50)
        parts = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(parts) > 1 and sum(r["count"] for r in parts) == 1400
        assert out.select("a.id", F.col("b.id").alias("b_id")).distinct().count() == 1400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_copies_of_a_class_are_not_broadcast(spark):
    """By the size of the few rows alone they would be; a million copies then stood in the driver. A share without rows gets none."""
    box = "0e0 AS x0, 0e0 AS y0, 1e0 AS x1, 1e0 AS y1".split(", ")
    many = spark.range(40).selectExpr("concat('v', id) AS id", "id * 50 AS seq", *box)
    few = spark.range(30).selectExpr("concat('i', id) AS id", "id AS seq", *box)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = spatial_join.class_pairs(many, few, F.col("seq") % 50)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.split("\n")[1].count("ShuffledHashJoin") == 1 and "Generate" not in plan
        assert sorted((r[0], r[1]) for r in out.select("a.id", "b.id").collect()) == sorted((f"v{k}", "i0") for k in range(40))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_texts_are_told_apart_by_hash_and_compared_if_it_repeats(spark, monkeypatch):
    """Only hashes are shuffled; equal texts count once, and texts that a hash joins are still two."""
    rows = spark.sql("SELECT * FROM VALUES ('b'), ('a'), ('a'), (NULL), ('cc'), ('d') AS v(t)")
    assert findings.text_totals(rows, F.col("t")) == (6, 4, "a", "d", 6)
    assert findings.text_totals(rows.where("t = 'x'"), F.col("t")) == (0, 0, None, None, None)
    monkeypatch.setattr(findings, "hashed", lambda t: F.ascii(t) % 2)
    assert findings.text_totals(rows, F.col("t")) == (6, 4, "a", "d", 6)


def test_a_mark_within_an_id_stays(spark):
    got = spark.sql("SELECT 'VERT-FLOOR-OVERLAP' AS rule_id, 'x' AS object_a, 'y%a' AS object_b, 2e0 AS measure UNION ALL SELECT 'OWN', 'z%b', NULL, NULL")
    assert sorted(r.description for r in findings.described(got).collect()) == ["OWN: z%b.", "Storeys x and y%a share 2.0 m3."]


def test_a_rule_s_shuffle_files_go_before_the_next(spark, monkeypatch):
    """Rules run one after another, and none leaves shuffle files behind; the session's own setting comes back."""
    import glob
    import time
    from types import SimpleNamespace

    from plumbline.operators import rules, store

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for d in disk.localDirs() for f in glob.glob(f"{d.getPath()}/**/shuffle_*.data", recursive=True)}
    there, seen = files(), []
    wide = lambda cat: cat.properties.groupBy("id").agg(F.max("x").alias("m")).select(F.col("id").alias("object_a"), F.lit(None).cast("string").alias("object_b"), F.col("m").alias("measure"))
    monkeypatch.setattr(rules, "RULES", {k: rules.Rule(k, "OWN", "INFO", wide) for k in ("ONE", "TWO")})

    def total(r, found):
        assert spark.conf.get(key) == "true"
        for _ in range(50):  # they go in the background
            if not files() - there:
                break
            time.sleep(0.1)
        seen.append(len(files() - there))
        return [(r.rule_id, len(found.collect()))]

    was = spark.conf.get(key)
    out = rules.summed_up(SimpleNamespace(properties=spark.range(500).selectExpr("concat('V', id) AS id", "1e0 * id AS x")), total, "rule_id string, n long")
    assert [tuple(r) for r in out.collect()] == [("ONE", 500), ("TWO", 500)] and spark.conf.get(key) == was
    assert seen == [0, 0]
    store.written(spark.range(50).groupBy((F.col("id") % 7).alias("k")).count())
    assert spark.conf.get(key) == was


def test_locations_without_geometry_look_up_one_object(spark):
    found = spark.sql("SELECT 'VERT-PROPERTY-OVERLAP' AS rule_id, 'a' AS object_a, 'b' AS object_b, 1e0 AS measure")
    objects = spark.sql("SELECT 'a' AS id, 'B-1' AS building_id, 2 AS floor_number, 0e0 AS x0, 0e0 AS y0, 1e0 AS x1, 1e0 AS y1")
    whole, slim = findings.located(found, objects), findings.located(found, objects, geometry=False)
    assert slim.collect() == whole.drop("geometry").collect() and slim.first().location == "B-1 / Floor 2"
    assert slim._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
