"""Queries over general shapes: overlay, plates and walls."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import identifiers as I
from plumbline.operators import arrangement, generation, lookups, pointcloud, rules

from .catalogue import ORACLES, STACK_SQL, rule_query
from .catalogue import query


def ring(*points: tuple[str, str]) -> Column:
    """A closed ring of points given as SQL."""
    return F.expr("array(" + ", ".join(f"struct(CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y)" for x, y in [*points, points[0]]) + ")")


def line(*points: tuple[str, str]) -> Column:
    return F.expr("array(" + ", ".join(f"struct(CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y)" for x, y in points) + ")")


_BOX = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]


def plates(floors: DataFrame) -> DataFrame:
    """Storeys with a plate, of every third building with a corner missing, and walls: a slanted one, one along, on even storeys one
    across, and a stub."""
    notch = ring(("x0", "y0"), ("x1", "y0"), ("x1", "y0 + 20"), ("x0 + 40", "y0 + 20"), ("x0 + 40", "y1"), ("x0", "y1"))
    walls = [
        line(("x0 + 10 + floor_number", "y0"), ("x0 + 14 + floor_number", "y1")), line(("x1", "y0 + 10"), ("x0", "y0 + 10")), line(("x0 + 5", "y0"), ("x0 + 5", "y0 + 3")),
        F.when(F.expr("floor_number % 2 = 0"), line(("x0 + 50", "CASE WHEN notched THEN y0 + 20 ELSE y1 END"), ("x0 + 50", "y0"))),
    ]
    f = floors.withColumn("notched", F.expr("(seq - floor_number) % 30 = 0"))
    return f.withColumns({"plate": F.array(F.when(F.col("notched"), notch).otherwise(ring(*_BOX))), "walls": F.array_compact(F.array(*walls))})


#: The faces of ``plates``: trapezoids on either side of the slanted wall.
PLATE_FACES = """SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(area, 6) DESC, x0, y0, x1, y1) AS face FROM (
 SELECT id, floor_number, k, r, fz_min, fz_max, CASE k WHEN 0 THEN (yb - ya) * cm WHEN 1 THEN CASE WHEN r = 1 AND notched THEN 10e0 * far + 640e0 - 26e0 * cm ELSE (yb - ya) * (far - cm) END
   ELSE CASE WHEN r = 1 AND notched THEN 100e0 ELSE 10e0 * (yb - ya) END END AS area,
  px + CASE k WHEN 0 THEN 0e0 WHEN 1 THEN 10e0 + floor_number + ya / 9e0 ELSE 50e0 END AS x0, py + ya AS y0,
  px + CASE k WHEN 0 THEN 10e0 + floor_number + yb / 9e0 WHEN 1 THEN far ELSE 60e0 END AS x1, py + CASE WHEN k = 2 AND r = 1 AND notched THEN 20e0 ELSE yb END AS y1
 FROM (SELECT f.id, floor_number, f.x0 AS px, f.y0 AS py, f.z_min AS fz_min, f.z_max AS fz_max, (seq - floor_number) % 30 = 0 AS notched, k, r, CASE r WHEN 0 THEN 0e0 ELSE 10e0 END AS ya, CASE r WHEN 0 THEN 10e0 ELSE 36e0 END AS yb,
  CASE WHEN floor_number % 2 = 0 THEN 50e0 ELSE 60e0 END AS far, 10e0 + floor_number + CASE r WHEN 0 THEN 5e0 ELSE 23e0 END / 9e0 AS cm
  FROM floors f CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)) AS t(k, r) WHERE k < 2 OR floor_number % 2 = 0) a) b"""

query("plate_faces", f"SELECT id, CAST(face AS INTEGER) AS face, round(area, 3) AS area FROM ({PLATE_FACES}) q", "floors")(
    lambda c: arrangement.faces(plates(c.floors.repartition("id")).withColumnRenamed("id", "key"), shapes=False).select(F.col("key").alias("id"), "face", F.round("area", 3).alias("area"))
)

# approved outlines with a court, and surveyed ones that are moved and lack a corner
_COURT = [("x0 + 8", "y0 + 10"), ("x0 + 14", "y0 + 10"), ("x0 + 14", "y0 + 20"), ("x0 + 8", "y0 + 20")]
_MX, _MY = "supp % 5", "supp % 3"


def outlines(properties: DataFrame) -> DataFrame:
    m = lambda x, y: (f"{x} + {_MX}", f"{y} + {_MY}")
    moved = ring(m("x0", "y0"), m("x1", "y0"), m("x1", "y1 - 9"), m("x1 - 6", "y1 - 9"), m("x1 - 6", "y1"), m("x0", "y1"))
    return properties.select(F.col("id").alias("key"), F.array(ring(*_BOX), ring(*_COURT)).alias("a"), F.array(moved).alias("b"))


_SIGNED = """SELECT a.id, sum(a.s * b.s * greatest(0e0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0e0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS both_ FROM
 (SELECT id, 1 AS s, x0, y0, x1, y1 FROM properties UNION ALL SELECT id, -1, x0 + 8, y0 + 10, x0 + 14, y0 + 20 FROM properties) a JOIN
 (SELECT id, 1 AS s, x0 + supp % 5 AS x0, y0 + supp % 3 AS y0, x1 + supp % 5 AS x1, y1 + supp % 3 AS y1 FROM properties UNION ALL SELECT id, -1, x1 - 6 + supp % 5, y1 - 9 + supp % 3, x1 + supp % 5, y1 + supp % 3 FROM properties) b ON a.id = b.id GROUP BY 1"""
_OVER = f"SELECT p.id, both_, (p.x1 - p.x0) * (p.y1 - p.y0) - 60e0 AS aa, (p.x1 - p.x0) * (p.y1 - p.y0) - 54e0 AS ab FROM properties p JOIN ({_SIGNED}) s ON p.id = s.id"
query("overlay_areas", f"SELECT id, both_ AS intersection, aa + ab - both_ AS union_, aa - both_ AS difference, aa + ab - 2 * both_ AS symmetric FROM ({_OVER}) q", "properties")(
    lambda c: arrangement.overlay_areas(outlines(c.properties)).select(F.col("key").alias("id"), *(F.round(x, 6).alias("union_" if x == "union" else x) for x in arrangement.OPS))
)
query("overlay_difference_shapes", f"SELECT id, aa + ab - 2 * both_ AS area FROM ({_OVER}) q WHERE aa + ab - 2 * both_ > 0", "properties")(
    lambda c: arrangement.overlay(outlines(c.properties), "symmetric").select(F.col("key").alias("id"), F.round("area", 6).alias("area"))
)


def planned(floors: DataFrame) -> DataFrame:
    """Storeys with plans: first and fourth ones have none, fifth ones outlines of two units with a label for the first, the others walls."""
    units = F.array(ring(("x0", "y0"), ("x0 + 30", "y0"), ("x0 + 30", "y1"), ("x0", "y1")), ring(("x0 + 30", "y0"), ("x1 + 5", "y0"), ("x1 + 5", "y1"), ("x0 + 30", "y1")))
    n = F.col("floor_number")
    return plates(floors).withColumns({"walls": F.when(~n.isin(1, 4, 5), F.col("walls")), "units": F.when(n == 5, units), "labels": F.when(n == 5, F.array(F.lit("A")))})


def generated(c) -> DataFrame:
    """Volumes without their outlines, which no query here returns."""
    ref = I.building_ref(F.lit("DS-1"), F.col("seq"))
    return generation.generate(c.buildings.select("id", ref.alias("ref"), F.lit("DS-1").alias("source_id"), "seq", "x0", "y0", "x1", "y1"), planned(c.floors), c.parcels, 4.0, shapes=False)


_PARTS = f"""SELECT f.id, f.floor_number, f.building_id, f.z_min, f.z_max, k, area, scope, label, clipped FROM floors f JOIN (
 SELECT id, face AS k, area, 'UNIT' AS scope, CAST(NULL AS VARCHAR) AS label, FALSE AS clipped FROM ({PLATE_FACES}) q WHERE floor_number NOT IN (1, 4, 5)
 UNION ALL SELECT id, 1, CASE WHEN (seq - floor_number) % 30 = 0 THEN 1840e0 ELSE 2160e0 END, 'FLOOR', NULL, FALSE FROM floors WHERE floor_number IN (1, 4)
 UNION ALL SELECT id, 1, 1080e0, 'UNIT', 'A', TRUE FROM floors WHERE floor_number = 5
 UNION ALL SELECT id, 2, CASE WHEN (seq - floor_number) % 30 = 0 THEN 760e0 ELSE 1080e0 END, 'UNIT', NULL, TRUE FROM floors WHERE floor_number = 5) p ON f.id = p.id"""
_VOLUMES = f"""SELECT p.*, b.seq, b.cust, r, concat(r, '-F0', p.floor_number, CASE WHEN scope = 'UNIT' THEN concat('-', r, '-F0', p.floor_number, '-', coalesce(label, concat('U', lpad(CAST(k AS VARCHAR), 2, '0')))) ELSE '' END) AS key
 FROM ({_PARTS}) p JOIN (SELECT *, concat('DS-1-B', CASE WHEN seq < 10 THEN '0' ELSE '' END, seq) AS r FROM buildings) b ON p.building_id = b.id"""
query(
    "volumes_generated",
    f"""SELECT concat('GPV-', regexp_replace(upper(key), '[^A-Z0-9]+', '', 'g')) AS id, concat('VC-VP-P', cust, '-', regexp_replace(upper(key), '[^A-Z0-9]+', '', 'g')) AS ulpin, concat('P-', cust) AS parent_parcel_id, building_id,
 CASE WHEN floor_number = 1 THEN 'GF' ELSE CAST(floor_number AS VARCHAR) END AS floor_label, scope AS volume_scope, CASE WHEN z_max <= 4 THEN 'BASEMENT' WHEN scope = 'UNIT' THEN 'UNIT' ELSE 'FLOOR' END AS property_type,
 CASE WHEN z_max <= 4 THEN 'UNDERGROUND' WHEN z_min >= 4 THEN 'ELEVATED' ELSE 'AT_GRADE' END AS vertical_position, round(area, 2) AS area_m2, round(area * (z_max - z_min), 2) AS volume_m3,
 concat_ws(',', CASE WHEN seq % 13 = 0 THEN 'PARTIAL_OVERLAP' END, CASE WHEN clipped THEN 'UNIT_CLIPPED' END) AS reasons FROM ({_VOLUMES}) v""",
    "floors", "buildings",
)(lambda c: generated(c).select("id", "ulpin", "parent_parcel_id", "building_id", "floor_label", "volume_scope", "property_type", "vertical_position", "area_m2", "volume_m3", F.array_join("review_reasons", ",").alias("reasons")))
query(
    "volume_generation_report",
    f"""SELECT building_id, count(DISTINCT id) AS floors, count(*) AS volumes, count(*) FILTER (WHERE scope = 'UNIT') AS units, CASE WHEN max(floor_number) >= 4 THEN 'F01,F04' ELSE 'F01' END AS undivided,
 round(sum(round(area, 2)), 2) AS total_area_m2, round(sum(round(area * (z_max - z_min), 2)), 2) AS total_volume_m3 FROM ({_VOLUMES}) v GROUP BY 1""",
    "floors", "buildings",
)(lambda c: generation.per_building(generated(c)).select("building_id", "floors", "volumes", "units", F.array_join("floors_without_unit_data", ",").alias("undivided"), "total_area_m2", "total_volume_m3"))


# --- rules on records with faults ---------------------------------------------------------------
# The derived records have sound outlines and whole stacks, so these rules run on records with faults put in, and replace the queries without rows.

_WRONG = "part % 101"  # 0: a bow tie, 1: flat, 2: not closed, 3: three points


def drawn(c) -> SimpleNamespace:
    """Volumes with outlines of their own, some of them faulty."""
    flat = ring(("x0", "y0"), ("x1", "y0"), ("x1", "y0"), ("x0", "y0"))
    faulty = F.when(F.expr(f"{_WRONG} = 0"), ring(("x0", "y0"), ("x1", "y1"), ("x1", "y0"), ("x0", "y1"))).when(F.expr(f"{_WRONG} = 1"), flat)
    faulty = faulty.when(F.expr(f"{_WRONG} = 2"), line(*_BOX, ("x0", "y0 + 1"))).when(F.expr(f"{_WRONG} = 3"), line(("x0", "y0"), ("x1", "y0"), ("x0", "y0")))
    return SimpleNamespace(properties=c.properties.withColumn("ring", faulty.otherwise(ring(*_BOX))))


# The four corners in order, and whether opposite edges cross, by the sides that their ends lie on.
_CORNERS = """SELECT id, part % 101 AS w, x0 AS ax, y0 AS ay, x1 AS bx, CASE part % 101 WHEN 0 THEN y1 ELSE y0 END AS by_, x1 AS cx, CASE part % 101 WHEN 0 THEN y0 WHEN 1 THEN y0 ELSE y1 END AS cy, x0 AS dx, CASE part % 101 WHEN 1 THEN y0 ELSE y1 END AS dy FROM properties"""
_TURN = "(({1}x - {0}x) * ({2}y - {0}y) - ({1}y - {0}y) * ({2}x - {0}x))"
_SIDES = lambda p, q, r, s: f"({_TURN.format(p, q, r)} * {_TURN.format(p, q, s)} <= 0 AND {_TURN.format(r, s, p)} * {_TURN.format(r, s, q)} <= 0)".replace("by ", "by_ ").replace("by)", "by_)")
_CROSSED = f"({_SIDES('a', 'b', 'c', 'd')} OR {_SIDES('b', 'c', 'd', 'a')})"
_DRAWN = f"SELECT id AS object_a, NULL AS object_b, NULL AS measure FROM ({_CORNERS}) q WHERE "
rule_query("rule_invalid_geometry", lambda c: rules.invalid(drawn(c)), f"{_DRAWN} w IN (2, 3) OR {_CROSSED}", "properties")
rule_query("rule_self_intersection", lambda c: rules.self_intersection(drawn(c)), f"{_DRAWN} w NOT IN (2, 3) AND {_CROSSED}", "properties")
rule_query("rule_zero_area", lambda c: rules.zero_area(drawn(c)), f"SELECT id AS object_a, NULL AS object_b, 0e0 AS measure FROM ({_CORNERS}) q WHERE w = 3 OR w <> 2 AND abs((ax * by_ - bx * ay) + (bx * cy - cx * by_) + (cx * dy - dx * cy) + (dx * ay - ax * dy)) <= 0.02", "properties")


def split(c) -> SimpleNamespace:
    """Volumes whose storeys from the fifth on stand elsewhere, those from the sixth on higher by two metres."""
    up = F.when(F.col("floor_number") >= 6, 2.0).otherwise(0.0)
    aside = F.when(F.col("floor_number") >= 5, 50_000.0).otherwise(0.0)
    return SimpleNamespace(properties=c.properties.withColumns({"x0": F.col("x0") + aside, "x1": F.col("x1") + aside, "z_min": F.col("z_min") + up, "z_max": F.col("z_max") + up}))


_SPLIT = """(SELECT block, floor_number, x0 + CASE WHEN floor_number >= 5 THEN 50000e0 ELSE 0e0 END AS x0, x1 + CASE WHEN floor_number >= 5 THEN 50000e0 ELSE 0e0 END AS x1, y0, y1,
 z_min + CASE WHEN floor_number >= 6 THEN 2e0 ELSE 0e0 END AS z_min, z_max + CASE WHEN floor_number >= 6 THEN 2e0 ELSE 0e0 END AS z_max FROM properties) p"""
rule_query("rule_disconnected_stack_global", lambda c: rules.disconnected_stack_global(split(c)), STACK_SQL.format(_SPLIT), "properties")
_BY_BLOCK = STACK_SQL.format(_SPLIT).replace("SELECT floor_number AS object_a, nf AS object_b", "SELECT concat(block, '/', floor_number) AS object_a, concat(block, '/', nf) AS object_b").replace("SELECT floor_number, min(z_min)", "SELECT block, floor_number, min(z_min)").replace("GROUP BY 1)", "GROUP BY 1, 2)").replace("(ORDER BY", "(PARTITION BY block ORDER BY")
rule_query("rule_disconnected_stack", lambda c: rules.disconnected_stack(split(c)), _BY_BLOCK, "properties")
rule_query("rule_floor_gap_global", lambda c: rules.floor_gap_global(split(c)), f"SELECT floor_number AS object_a, nxt AS object_b, gap AS measure FROM (SELECT floor_number, lead(floor_number) OVER w AS nxt, lead(z_min) OVER w - z_max AS gap FROM (SELECT floor_number, min(z_min) AS z_min, max(z_max) AS z_max FROM {_SPLIT} GROUP BY 1) s WINDOW w AS (ORDER BY z_min, floor_number)) t WHERE gap > 0.05", "properties")
query("points_in_boxes", "SELECT p.id, b.id AS box_id FROM (SELECT id, x * 50 AS x, y * 50 + 20 AS y FROM points) p JOIN buildings b ON p.x BETWEEN b.x0 - 1 AND b.x1 + 1 AND p.y BETWEEN b.y0 - 1 AND b.y1 + 1", "points", "buildings")(
    lambda c: lookups.points_in(c.points.select("id", (F.col("x") * 50).alias("x"), (F.col("y") * 50 + 20).alias("y")), c.buildings).select("id", "box_id")
)

# --- corridors over many cells ------------------------------------------------------------------

_INF = "SELECT id, seq, x0 + 100e0 * (seq % 7) - 50000e0 AS x0, y0, x1 + 950000e0 AS x1, y1, z_min, z_max FROM infrastructure"
query(
    "corridor_collisions",
    f"SELECT a.id AS object_a, b.id AS object_b FROM properties a JOIN ({_INF}) b ON a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0 AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) * (least(a.z_max, b.z_max) - greatest(a.z_min, b.z_min)) > 0.01 AND a.z_max > b.z_min AND b.z_max > a.z_min",
    "properties", "infrastructure",
)(lambda c: rules.infra_collisions(SimpleNamespace(properties=c.properties, infrastructure=c.spark.sql(_INF.replace("FROM infrastructure", "FROM {i}"), i=c.infrastructure).withColumn("kind", F.lit("TUNNEL"))), "TUNNEL").select("object_a", "object_b"))


# --- ground by the rule, unrolled ---------------------------------------------------------------


def _ground_sql() -> str:
    """The grid of each round from the one before: refit, fill (cell by cell, pass by pass), two smoothings."""
    near = "JOIN {0} b ON b.ix BETWEEN a.ix - 1 AND a.ix + 1 AND b.iy BETWEEN a.iy - 1 AND a.iy + 1 AND (a.ix <> b.ix OR a.iy <> b.iy)"
    smooth = lambda src: f"SELECT a.ix, a.iy, CASE WHEN abs(any_value(a.ground) - quantile_cont(b.ground, 0.5)) > 1 THEN quantile_cont(b.ground, 0.5) ELSE any_value(a.ground) END AS ground FROM {src} a LEFT {near.format(src)} GROUP BY 1, 2"
    out = ["pt AS MATERIALIZED (SELECT id, z, CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy FROM points)", "g0 AS MATERIALIZED (SELECT ix, iy, quantile_cont(z, 0.02) AS ground FROM pt GROUP BY 1, 2)", "sh AS MATERIALIZED (SELECT dx, dy FROM (VALUES (-1), (0), (1)) p(dx), (VALUES (-1), (0), (1)) q(dy))"]
    for k, t in enumerate(pointcloud.THRESHOLDS, 1):
        out += [
            f"m{k} AS MATERIALIZED (SELECT id, ix, iy, z, z - ground < {t} AS is_ground FROM pt JOIN g{k - 1} USING (ix, iy))",
            f"r{k} AS MATERIALIZED (SELECT ix, iy, quantile_cont(z, 0.02) AS ground FROM m{k} WHERE is_ground GROUP BY 1, 2)",
            f"f{k} AS (SELECT 0 AS pass, ix, iy, r{k}.ground FROM g0 LEFT JOIN r{k} USING (ix, iy) UNION ALL SELECT pass + 1, ix + dx, iy + dy, coalesce(max(CASE WHEN dx = 0 AND dy = 0 THEN ground END), avg(CASE WHEN dx <> 0 OR dy <> 0 THEN ground END)) FROM f{k}, sh WHERE pass < 32 GROUP BY pass + 1, ix + dx, iy + dy HAVING bool_or(dx = 0 AND dy = 0))",
            f"e{k} AS MATERIALIZED (SELECT ix, iy, coalesce(ground, (SELECT quantile_cont(ground, 0.5) FROM f{k} WHERE pass = 32)) AS ground FROM f{k} WHERE pass = 32)",
            f"s{k} AS MATERIALIZED ({smooth(f'e{k}')})", f"g{k} AS MATERIALIZED ({smooth(f's{k}')})",
        ]
    return ", ".join(out)


def rounded(value: str) -> Column:
    """To six digits as the SQL does it, on the number itself and away from zero; Spark's round takes its shortest decimal form."""
    x = F.col(value) * 1e6
    return F.when(x == 0, x).when(x < 0, -F.round(-x)).otherwise(F.round(x)) / 1e6


_LAST = len(pointcloud.THRESHOLDS)
query("ground_classify", f"SELECT id, round(ground, 6) AS ground_z, round(z - ground, 6) AS height, is_ground FROM m{_LAST} JOIN g{_LAST} USING (ix, iy)", "points")(
    lambda c: pointcloud.classify(c.points).select("id", rounded("ground_z").alias("ground_z"), rounded("height").alias("height"), "is_ground")
)
ORACLES["ground_classify"] = ORACLES["ground_classify"].replace("\nSELECT id, round", f", {_ground_sql()}\nSELECT id, round", 1)
_ASKED = "SELECT id, (x0 + x1) / 50 AS x, (y0 + y1) / 50 AS y FROM buildings"
query("ground_lookup", f"SELECT b.id, round(coalesce(avg(g.ground), (SELECT quantile_cont(ground, 0.5) FROM g{_LAST})), 6) AS ground_z FROM ({_ASKED}) b LEFT JOIN g{_LAST} g ON g.ix BETWEEN floor(b.x) - 1 AND floor(b.x) + 1 AND g.iy BETWEEN floor(b.y) - 1 AND floor(b.y) + 1 GROUP BY 1", "points", "buildings")(
    lambda c: pointcloud.ground_at(c.spark.sql(_ASKED.replace("FROM buildings", "FROM {b}"), b=c.buildings), pointcloud.fitted(c.points)[0]).select("id", rounded("ground_z").alias("ground_z"))
)
ORACLES["ground_lookup"] = ORACLES["ground_lookup"].replace("\nSELECT b.id", f", {_ground_sql()}\nSELECT b.id", 1)

# --- what is said of changes --------------------------------------------------------------------

_CH = "SELECT concat('CH-', id) AS id, id AS object_id, CASE WHEN supp % 7 = 0 THEN 'HEIGHT' ELSE 'FOOTPRINT' END AS change_type FROM {properties} WHERE supp % 7 = 0 OR supp % 11 = 0"
_CASE = "SELECT concat('CH-', id) AS issue_id, CASE part % 8 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'RESURVEY_REQUESTED' WHEN 3 THEN 'EXPECTED' WHEN 4 THEN 'PENDING' WHEN 5 THEN 'IN_REVIEW' ELSE 'CLOSED' END AS state FROM {properties} WHERE part % 8 < 7 AND (supp % 7 = 0 OR supp % 11 = 0)"
query(
    "change_statuses",
    f"""SELECT p.id, change_type, CASE WHEN state IN ('APPROVED', 'REJECTED') THEN state WHEN state = 'RESURVEY_REQUESTED' THEN 'RESURVEY REQUESTED' WHEN state = 'EXPECTED' THEN 'ACCEPTED AS EXPECTED' WHEN state IN ('PENDING', 'IN_REVIEW') THEN 'REQUIRES REVIEW'
 WHEN c.id IS NOT NULL THEN 'CHANGE DETECTED' ELSE 'NO CHANGE' END AS status FROM properties p LEFT JOIN ({_CH.format(properties="properties")}) c ON c.object_id = p.id LEFT JOIN ({_CASE.format(properties="properties")}) r ON r.issue_id = c.id""",
    "properties",
)(lambda c: lookups.change_statuses(c.properties, c.spark.sql(_CH, properties=c.properties), c.spark.sql(_CASE, properties=c.properties)))
