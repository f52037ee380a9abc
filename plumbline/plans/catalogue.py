"""Named queries over the derived cadastre: each a Spark plan and, where SQL can say it, the same in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import boxes as B
from plumbline.functions import crs
from plumbline.functions import identifiers as I
from plumbline.functions import rings as R
from plumbline.operators import changes, history, pointcloud, rules, spatial_join, store, volumes
from plumbline.session import ship
from plumbline.sources.cadastre import STAGE_ORDER, Cadastre, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Geometry in SQL, over sides a and b.
_AREA = "(({0}x1 - {0}x0) * ({0}y1 - {0}y0))"
_PLAN = "(greatest(0e0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0e0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))"
_VOL = f"({_PLAN} * greatest(0e0, least(a.z_max, b.z_max) - greatest(a.z_min, b.z_min)))"
_TOUCH = "a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0"
_MM = "CAST(CAST(round({0} * 1000) AS BIGINT) AS VARCHAR)"
_HASH = "upper(substr(sha256(concat_ws(',', " + ", ".join(_MM.format("{0}" + c) for c in ("x0", "y0", "x1", "y1", "z_min", "z_max")) + ")), 1, 12))"


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: (ship(spark), f(Cadastre.load(spark, sf_dir)))[1]
        if sql:
            ORACLES[name] = oracle(sql, *views)
        return f

    return add


RULE_SQL: dict[str, tuple[str, tuple[str, ...]]] = {}


def rule_query(name: str, build, sql: str | None = None, *views: str):
    if sql:
        RULE_SQL[name] = sql, views
    query(name, sql and f"SELECT CAST(object_a AS VARCHAR) AS object_a, CAST(object_b AS VARCHAR) AS object_b, CAST(measure AS DOUBLE) AS measure FROM ({sql}) t", *views)(build)


def area_sql(side: str = "") -> str:
    return _AREA.format(side)


# --- scans, lookups, search ---------------------------------------------------------------------

query("scan_parcels", "SELECT id, x0, y0, x1, y1, land_use FROM parcels", "parcels")(lambda c: c.parcels.select("id", "x0", "y0", "x1", "y1", "land_use"))
query("scan_properties_projected", "SELECT id, floor_number, status FROM properties WHERE status = 'R'", "properties")(lambda c: c.properties.where("status = 'R'").select("id", "floor_number", "status"))
query("find_by_id", "SELECT id, 'buildings' AS kind FROM buildings WHERE id = 'B-7' UNION ALL SELECT id, 'parcels' FROM parcels WHERE id = 'B-7'", "buildings", "parcels")(
    lambda c: store.find_by_id({"parcels": c.parcels.select("id"), "buildings": c.buildings.select("id"), "properties": c.properties.select("id"), "infrastructure": c.infrastructure.select("id")}, "B-7").select("id", F.col("kind_").alias("kind"))
)
query("search_substring", "SELECT id, land_use FROM parcels WHERE instr(lower(concat_ws(' ', id, land_use)), 'auto') > 0", "parcels")(lambda c: store.search({"parcels": c.parcels}, "AUTO", ["id", "land_use"], None).select("id", "land_use"))
for _rel, _cond in (
    ("intersects", "x0 <= 1090 AND x1 >= 150 AND y0 <= 660 AND y1 >= 120"),
    ("contains", "x0 >= 150 AND x1 <= 1090 AND y0 >= 120 AND y1 <= 660"),
    ("overlaps", "x0 < 1090 AND x1 > 150 AND y0 < 660 AND y1 > 120 AND NOT (x0 >= 150 AND x1 <= 1090 AND y0 >= 120 AND y1 <= 660) AND NOT (x0 <= 150 AND x1 >= 1090 AND y0 <= 120 AND y1 >= 660)"),
):
    query(f"spatial_query_{_rel}", f"SELECT id FROM buildings WHERE {_cond}", "buildings")(lambda c, r=_rel: spatial_join.probe(c.buildings, (150.0, 120.0, 1090.0, 660.0), r).select("id"))
query("spatial_query_within", "SELECT id FROM buildings WHERE x0 <= 130 AND x1 >= 140 AND y0 <= 20 AND y1 >= 30", "buildings")(lambda c: spatial_join.probe(c.buildings, (130.0, 20.0, 140.0, 30.0), "within").select("id"))
query("import_source_types", "SELECT CASE WHEN instr(url, '?') > 0 THEN 'QUERY' WHEN instr(url, '#') > 0 THEN 'FRAGMENT' ELSE 'PLAIN' END AS kind, count(*) AS n, sum(CAST(strlen(html) AS BIGINT))::BIGINT AS bytes FROM pages GROUP BY 1")(
    lambda c: c.pages.groupBy(F.when(F.instr("url", "?") > 0, "QUERY").when(F.instr("url", "#") > 0, "FRAGMENT").otherwise("PLAIN").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html").cast("long")).alias("bytes"))
)
query("upsert_volumes", "SELECT p.id, p.floor_number, p.z_max FROM properties p LEFT JOIN survey s ON p.id = s.id WHERE s.id IS NULL UNION ALL SELECT id, floor_number, z_max FROM survey", "properties", "survey")(
    lambda c: store.upsert(c.properties.select("id", "floor_number", "z_max"), c.survey.select("id", "floor_number", "z_max"), ["id"])
)
query("update_fields", "SELECT p.id, coalesce(s.z_max, p.z_max) AS z_max, p.ulpin FROM properties p LEFT JOIN survey s ON p.id = s.id", "properties", "survey")(
    lambda c: store.update(c.properties.select("id", "z_max", "ulpin"), c.survey.select("id", "z_max", F.lit("no").alias("ulpin")), ["z_max"])
)
query("delete_by_id", "SELECT p.id FROM properties p LEFT JOIN survey s ON p.id = s.id WHERE s.id IS NULL", "properties", "survey")(lambda c: store.delete(c.properties.select("id"), c.survey))

# --- geometry, CRS, identifiers -----------------------------------------------------------------

query("geom_area_volume", f"SELECT id, {area_sql()} AS area, {area_sql()} * (z_max - z_min) AS volume, CASE WHEN z_max > z_min THEN {area_sql()} * (z_max - z_min) ELSE 0e0 END AS measured FROM properties", "properties")(
    lambda c: c.properties.select("id", B.area().alias("area"), B.volume().alias("volume"), B.measured_volume().alias("measured"))
)
query("geom_vertical_overlap", "SELECT p.id, greatest(0e0, least(p.z_max, f.z_max) - greatest(p.z_min, f.z_min)) AS shared FROM properties p JOIN floors f ON p.building_id = f.building_id AND p.floor_number = f.floor_number", "properties", "floors")(
    lambda c: c.properties.alias("a").join(c.floors.alias("b"), ["building_id", "floor_number"]).select("a.id", B.vertical_overlap("a", "b").alias("shared"))
)
query("geom_outside_area", f"SELECT a.id, {area_sql('a.')} - {_PLAN} AS outside FROM buildings a JOIN parcels b ON a.parcel_id = b.id", "buildings", "parcels")(
    lambda c: c.buildings.alias("a").join(c.parcels.alias("b"), F.col("a.parcel_id") == F.col("b.id")).select("a.id", B.outside_area("a", "b").alias("outside"))
)
query("geom_shoelace_ring", f"SELECT id, {area_sql()} AS area, 2 * (x1 - x0 + y1 - y0) AS perimeter FROM parcels", "parcels")(lambda c: c.parcels.select("id", R.area(B.ring()).alias("area"), R.perimeter(B.ring()).alias("perimeter")))
query("geom_centroid_spatial_code", "SELECT id, concat(lpad(CAST(CAST(floor((x0 + x1) / 2) AS BIGINT) AS VARCHAR), 5, '0'), '-', lpad(CAST(CAST(floor((y0 + y1) / 2) AS BIGINT) AS VARCHAR), 5, '0')) AS code FROM buildings", "buildings")(
    lambda c: c.buildings.select("id", B.spatial_code().alias("code"))
)
query("geom_hash_sha256", f"SELECT id, {_HASH.format('')} AS geometry_hash FROM properties", "properties")(lambda c: c.properties.select("id", B.geometry_hash().alias("geometry_hash")))
query("geom_geojson_round_trip", "SELECT id, (x1 - x0) * (y1 - y0) AS area, x0, y1 FROM parcels", "parcels")(
    lambda c: c.parcels.select("id", R.from_geojson(R.to_geojson(B.ring())).alias("r")).select("id", R.area(F.col("r")).alias("area"), R.bounds(F.col("r"))["x0"].alias("x0"), R.bounds(F.col("r"))["y1"].alias("y1"))
)
query("geom_intersection_kernel", f"SELECT a.id, round({_PLAN}, 6) AS area FROM buildings a JOIN parcels b ON a.parcel_id = b.id", "buildings", "parcels")(
    lambda c: c.buildings.alias("a").join(c.parcels.alias("b"), F.col("a.parcel_id") == F.col("b.id")).select("a.id", B.ring("a").alias("r"), B.ring("b").alias("s")).select("id", F.round(R.intersection_area("r", "s"), 6).alias("area"))
)
_LON, _LAT = "CAST((c_custkey * 7) % 360 - 180 AS DOUBLE)", "CAST((c_custkey * 11) % 180 - 90 AS DOUBLE)"
query("crs_utm_zone", f"SELECT c_custkey, CASE WHEN lat >= 84 THEN 3413 WHEN lat <= -80 THEN 3031 ELSE CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + greatest(1, least(60, CAST(floor((lon + 180) / 6) AS INTEGER) + 1)) END AS epsg FROM (SELECT c_custkey, {_LON} AS lon, {_LAT} AS lat FROM customer) t")(
    lambda c: c.customer.select("c_custkey", F.expr(_LON).alias("lon"), F.expr(_LAT).alias("lat")).select("c_custkey", F.substring_index(crs.processing_crs(F.lit("EPSG:4326"), F.col("lon"), F.col("lat")), ":", -1).cast("int").alias("epsg"))
)
query("crs_round_trip", f"SELECT c_custkey, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (SELECT c_custkey, CAST(c_custkey % 6 AS DOUBLE) / 2 + 75.25e0 AS lon, CAST(c_custkey % 140 - 70 AS DOUBLE) + 0.5e0 AS lat FROM customer) t")(
    lambda c: c.customer.selectExpr("c_custkey", "CAST(c_custkey % 6 AS DOUBLE) / 2 + 75.25e0 AS lon", "CAST(c_custkey % 140 - 70 AS DOUBLE) + 0.5e0 AS lat").withColumn("u", crs.to_utm(F.col("lon"), F.col("lat"), F.lit(43), F.col("lat") >= 0)).withColumn("g", crs.from_utm(F.col("u.x"), F.col("u.y"), F.lit(43), F.col("lat") >= 0)).select("c_custkey", F.round("g.lon", 6).alias("lon"), F.round("g.lat", 6).alias("lat"))
)
_SLUG = "regexp_replace(upper(coalesce({0}, '')), '[^A-Z0-9]+', '', 'g')"
query("ulpin_generate", f"SELECT id, concat_ws('-', 'VC', 'VP', nullif({_SLUG.format('parcel_id')}, ''), coalesce(nullif({_SLUG.format('unit_label')}, ''), 'LAND')) AS ulpin FROM properties", "properties")(
    lambda c: c.properties.select("id", I.ulpin("VP", F.col("parcel_id"), F.col("unit_label")).alias("ulpin"))
)
query("ulpin_assign_missing", f"SELECT id, status = 'R' AS assigned, CASE WHEN status = 'R' THEN concat_ws('-', 'VC', 'VP', {_SLUG.format('id')}, 'LAND') ELSE ulpin END AS ulpin FROM properties", "properties")(
    lambda c: I.assign_missing(c.properties.withColumn("ulpin", F.when(F.col("status") != "R", F.col("ulpin"))), I.ulpin("VP", F.col("id"), F.lit(None))).select("id", "assigned", "ulpin")
)
query("floor_label", "SELECT id, CASE WHEN n < 0 THEN concat('B', abs(n)) WHEN n = 0 THEN 'B1' WHEN n = 1 THEN 'GF' ELSE CAST(n AS VARCHAR) END AS label FROM (SELECT id, floor_number - 3 AS n FROM floors) t", "floors")(
    lambda c: c.floors.select("id", I.floor_label(F.col("floor_number") - 3).alias("label"))
)
query("vertical_position", "SELECT id, CASE WHEN z_max <= 3 THEN 'UNDERGROUND' WHEN z_min >= 3 THEN 'ELEVATED' ELSE 'AT_GRADE' END AS position FROM properties", "properties")(
    lambda c: c.properties.select("id", I.vertical_position(F.col("z_min"), F.col("z_max"), F.lit(3.0)).alias("position"))
)
query("object_ids", "SELECT id, concat('GV-', id, '-v', floor_number) AS version_id, 'PROPERTY' AS kind FROM properties", "properties")(
    lambda c: c.properties.select("id", I.version_id(F.col("id"), F.col("floor_number")).alias("version_id"), I.object_type(F.col("id")).alias("kind"))
)

# --- rules --------------------------------------------------------------------------------------

_P = "FROM properties a"
_NONE = "SELECT id AS object_a, NULL AS object_b, NULL AS measure FROM properties WHERE x1 <= x0 OR y1 <= y0"
rule_query("rule_invalid_geometry", rules.invalid, _NONE, "properties")
rule_query("rule_self_intersection", rules.self_intersection, _NONE + " AND FALSE", "properties")
rule_query("rule_zero_area", rules.zero_area, f"SELECT id AS object_a, NULL AS object_b, {area_sql()} AS measure FROM properties WHERE {area_sql()} <= 0.01", "properties")
rule_query("rule_zero_volume", rules.zero_volume, f"SELECT id AS object_a, NULL AS object_b, {area_sql()} * (z_max - z_min) AS measure FROM properties WHERE {area_sql()} * (z_max - z_min) <= 0.01", "properties")
_Z = "SELECT id AS object_a, NULL AS object_b, z_max - z_min AS measure FROM properties WHERE NOT (z_min < z_max)"
rule_query("rule_invalid_z_range", rules.invalid_z_range, _Z, "properties")
rule_query("rule_z_order", rules.z_order, _Z, "properties")
_OUT = f"SELECT a.id AS object_a, b.id AS object_b, {area_sql('a.')} - {_PLAN} AS measure"
rule_query("rule_property_outside_first", rules.property_outside_first, f"{_OUT} FROM properties a, (SELECT * FROM parcels ORDER BY seq LIMIT 1) b WHERE {area_sql('a.')} - {_PLAN} > 0.01", "properties", "parcels")
rule_query("rule_property_outside", rules.property_outside_own, f"{_OUT} FROM properties a JOIN parcels b ON a.parcel_id = b.id WHERE {area_sql('a.')} - {_PLAN} > 0.01", "properties", "parcels")
rule_query("rule_building_outside", rules.building_outside, f"{_OUT} FROM buildings a JOIN parcels b ON a.parcel_id = b.id WHERE {area_sql('a.')} - {_PLAN} > 0.01", "buildings", "parcels")
_IN = "SELECT a.id AS object_a, min_by(b.id, b.seq) AS object_b, NULL AS measure FROM {0} a JOIN parcels b ON floor(a.x0 / 100) = floor(b.x0 / 100) AND floor(a.y0 / 100) = floor(b.y0 / 100) AND a.x0 >= b.x0 AND a.x1 <= b.x1 AND a.y0 >= b.y0 AND a.y1 <= b.y1 WHERE coalesce(a.parcel_id, '') = '' GROUP BY a.id"
rule_query("rule_unassigned_building", rules.unassigned_building, _IN.format("buildings"), "buildings", "parcels")
rule_query("rule_unassigned_property", rules.unassigned_property, _IN.format("properties"), "properties", "parcels")
_PAIR = f"SELECT a.id AS object_a, b.id AS object_b, {_VOL} AS measure"
rule_query("rule_floor_overlap", rules.floor_overlap, f"{_PAIR} FROM floors a JOIN floors b ON a.building_id = b.building_id AND a.seq < b.seq WHERE {_VOL} > 0.01", "floors")
rule_query("rule_floor_overlap_global", rules.floor_overlap_global, f"{_PAIR} FROM floors a JOIN floors b ON a.y0 = b.y0 AND floor(a.x0 / 100) = floor(b.x0 / 100) AND a.seq < b.seq WHERE {_VOL} > 0.01", "floors")
rule_query("rule_property_overlap", rules.property_overlap, f"{_PAIR} {_P} JOIN properties b ON a.block = b.block AND a.floor_number IS NOT DISTINCT FROM b.floor_number AND a.seq < b.seq WHERE {_VOL} > 0.01", "properties")
rule_query("rule_property_overlap_global", rules.property_overlap_global, f"{_PAIR} {_P} JOIN properties b ON a.site = b.site AND a.floor_number IS NOT DISTINCT FROM b.floor_number AND a.seq < b.seq WHERE {_VOL} > 0.01 UNION ALL {_PAIR} {_P} JOIN properties b ON a.site <> b.site AND a.floor_number = b.floor_number AND a.y0 = b.y0 AND a.seq < b.seq AND {_TOUCH} WHERE {_VOL} > 0.01", "properties")
rule_query("rule_floor_gap", rules.floor_gap, "SELECT id AS object_a, nxt AS object_b, gap AS measure FROM (SELECT id, lead(id) OVER w AS nxt, lead(z_min) OVER w - z_max AS gap FROM floors WINDOW w AS (PARTITION BY building_id ORDER BY z_min, floor_number)) t WHERE gap > 0.05", "floors")
rule_query("rule_floor_gap_global", rules.floor_gap_global, "SELECT floor_number AS object_a, nxt AS object_b, gap AS measure FROM (SELECT floor_number, lead(floor_number) OVER w AS nxt, lead(z_min) OVER w - z_max AS gap FROM (SELECT floor_number, min(z_min) AS z_min, max(z_max) AS z_max FROM properties GROUP BY 1) s WINDOW w AS (ORDER BY z_min, floor_number)) t WHERE gap > 0.05", "properties")
rule_query(
    "rule_disconnected_stack", rules.disconnected_stack,
    "SELECT concat(block, '/', floor_number) AS object_a, concat(block, '/', nf) AS object_b, s AS measure FROM (SELECT *, greatest(0e0, least(x1, nx1) - greatest(x0, nx0)) * greatest(0e0, least(y1, ny1) - greatest(y0, ny0)) AS s FROM (SELECT *, lead(x0) OVER w AS nx0, lead(y0) OVER w AS ny0, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1, lead(floor_number) OVER w AS nf FROM (SELECT block, floor_number, min(z_min) AS z_min, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM properties GROUP BY 1, 2) q WINDOW w AS (PARTITION BY block ORDER BY z_min, floor_number)) r) t WHERE nx0 IS NOT NULL AND s < 0.01",
    "properties",
)
rule_query("rule_floor_height", rules.floor_height, "SELECT id AS object_a, f.building_id AS object_b, abs(z_max - z_min - mid) / mid AS measure FROM floors f JOIN (SELECT building_id, quantile_cont(z_max - z_min, 0.5) AS mid, count(*) AS n FROM floors GROUP BY 1) m ON f.building_id = m.building_id WHERE n >= 3 AND mid > 0 AND abs(z_max - z_min - mid) / mid > 0.3", "floors")
STACK_SQL = "SELECT floor_number AS object_a, nf AS object_b, s AS measure FROM (SELECT *, greatest(0e0, least(x1, nx1) - greatest(x0, nx0)) * greatest(0e0, least(y1, ny1) - greatest(y0, ny0)) AS s FROM (SELECT *, lead(x0) OVER w AS nx0, lead(y0) OVER w AS ny0, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1, lead(floor_number) OVER w AS nf FROM (SELECT floor_number, min(z_min) AS z_min, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM {0} GROUP BY 1) q WINDOW w AS (ORDER BY z_min, floor_number)) r) t WHERE nx0 IS NOT NULL AND s < 0.01"
rule_query("rule_disconnected_stack_global", rules.disconnected_stack_global, STACK_SQL.format("properties"), "properties")
rule_query("rule_floor_height_global", rules.floor_height_global, "SELECT id AS object_a, NULL AS object_b, abs(z_max - z_min - mid) / mid AS measure FROM floors f, (SELECT quantile_cont(z_max - z_min, 0.5) AS mid FROM floors WHERE z_max > z_min) m WHERE z_max > z_min AND abs(z_max - z_min - mid) / mid > 0.3", "floors")
_REP = "SELECT id AS object_a, first_id AS object_b, NULL AS measure FROM (SELECT id, seq, first_value(id) OVER w AS first_id, row_number() OVER w AS rn FROM ({0}) q WINDOW w AS (PARTITION BY k ORDER BY seq)) t WHERE rn > 1"
rule_query("rule_duplicate_ulpin", rules.duplicate_ulpin, _REP.format("SELECT *, ulpin AS k FROM properties"), "properties")
rule_query("rule_duplicate_geometry", rules.duplicate_geometry, _REP.format(f"SELECT *, {_HASH.format('')} AS k FROM properties"), "properties")
rule_query("rule_missing_parent", rules.missing_parent, "SELECT id AS object_a, parcel_id AS object_b, NULL AS measure FROM properties WHERE coalesce(parcel_id, '') <> '' AND NOT EXISTS (SELECT 1 FROM parcels p WHERE p.id = properties.parcel_id)", "properties", "parcels")
rule_query("rule_orphan_property", rules.orphan_property, "SELECT id AS object_a, building_id AS object_b, NULL AS measure FROM properties WHERE coalesce(building_id, '') <> '' AND NOT EXISTS (SELECT 1 FROM buildings p WHERE p.id = properties.building_id)", "properties", "buildings")
rule_query("rule_invalid_hierarchy", rules.invalid_hierarchy, "SELECT p.id AS object_a, f.id AS object_b, greatest(abs(p.z_min - f.z_min), abs(p.z_max - f.z_max)) AS measure FROM properties p JOIN floors f ON p.building_id = f.building_id AND p.floor_number = f.floor_number WHERE greatest(abs(p.z_min - f.z_min), abs(p.z_max - f.z_max)) > 0.05", "properties", "floors")
rule_query("rule_utility_collision", rules.utility_collision, f"{_PAIR} {_P}, (SELECT * FROM infrastructure ORDER BY seq LIMIT 1) b WHERE {_VOL} > 0.01", "properties", "infrastructure")
rule_query("rule_infra_typed", lambda c: rules.infra_collisions(c, "TUNNEL", "BASEMENT", "FOUNDATION", "ELEVATED_STRUCTURE"), f"{_PAIR} {_P} JOIN infrastructure b ON {_TOUCH} WHERE kind <> 'UTILITY' AND {_VOL} > 0.01", "properties", "infrastructure")
for _k in ("TUNNEL", "BASEMENT", "FOUNDATION", "ELEVATED_STRUCTURE"):
    rule_query(f"rule_infra_{_k.lower()}", lambda c, k=_k: rules.infra_collisions(c, k), f"{_PAIR} {_P} JOIN infrastructure b ON {_TOUCH} WHERE kind = '{_k}' AND {_VOL} > 0.01", "properties", "infrastructure")
_LATEST = "FROM properties a JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY version DESC) AS rn FROM versions) q WHERE rn = 1) b ON a.id = b.object_id"
rule_query("rule_change_footprint", rules.change_footprint, f"SELECT a.id AS object_a, NULL AS object_b, b.version AS measure {_LATEST} WHERE {_HASH.format('a.')} <> {_HASH.format('b.')}", "properties", "versions")
_DH = "((a.z_max - a.z_min) - (b.z_max - b.z_min))"
rule_query("rule_change_height", rules.change_height, f"SELECT a.id AS object_a, NULL AS object_b, {_DH} AS measure {_LATEST} WHERE abs({_DH}) > 1e-6", "properties", "versions")
rule_query("rule_change_volume", rules.change_volume, f"SELECT a.id AS object_a, NULL AS object_b, {area_sql('a.')} * {_DH} AS measure {_LATEST} WHERE abs({area_sql('a.')} * {_DH}) > 1e-6", "properties", "versions")
rule_query("rule_new_floor", rules.new_floor, "SELECT p.id AS object_a, b.id AS object_b, floor_number AS measure FROM properties p JOIN buildings b ON p.building_id = b.id WHERE floor_number > floor_count", "properties", "buildings")
rule_query("rule_removed_floor", rules.removed_floor, "SELECT b.id AS object_a, NULL AS object_b, n AS measure FROM buildings b CROSS JOIN numbers WHERE n <= floor_count AND NOT EXISTS (SELECT 1 FROM properties p WHERE p.building_id = b.id AND p.floor_number = n)", "buildings", "numbers", "properties")

_RUN = ("GEOM-INVALID-Z-RANGE", "CAD-MISSING-PARENT", "CAD-ORPHAN-PROPERTY", "PARCEL-BUILDING-OUTSIDE", "VERT-PROPERTY-OVERLAP")
_FOUND = f"""SELECT 'GEOM-INVALID-Z-RANGE' AS rule_id, 'GEOMETRY' AS category, 'CRITICAL' AS severity, id AS o FROM properties WHERE NOT (z_min < z_max)
 UNION ALL SELECT 'CAD-MISSING-PARENT', 'CADASTRE', 'CRITICAL', id FROM properties WHERE coalesce(parcel_id, '') <> '' AND parcel_id NOT IN (SELECT id FROM parcels)
 UNION ALL SELECT 'CAD-ORPHAN-PROPERTY', 'CADASTRE', 'CRITICAL', id FROM properties WHERE building_id NOT IN (SELECT id FROM buildings)
 UNION ALL SELECT 'PARCEL-BUILDING-OUTSIDE', 'PARCEL', 'WARNING', a.id FROM buildings a JOIN parcels b ON a.parcel_id = b.id WHERE {area_sql("a.")} - {_PLAN} > 0.01
 UNION ALL SELECT 'VERT-PROPERTY-OVERLAP', 'VERTICAL', 'CRITICAL', object_a FROM ({RULE_SQL['rule_property_overlap_global'][0]}) q"""
query("validation_summary_grouping_sets", f"SELECT severity, category, rule_id, count(*) AS n FROM ({_FOUND}) f GROUP BY GROUPING SETS ((severity), (category), (rule_id), ())", "properties", "parcels", "buildings")(lambda c: rules.summary(rules.run_rules(c.kept("properties"), *_RUN)))
query("validation_run_counts", f"SELECT count(*) AS issues, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'WARNING') AS warning FROM ({_FOUND}) f", "properties", "parcels", "buildings")(
    lambda c: rules.run_rules(c.kept("properties"), *_RUN).agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "WARNING").alias("warning"))
)
_OF_RULE = {
    "GEOM-INVALID": "invalid_geometry", "GEOM-SELF-INTERSECTION": "self_intersection", "GEOM-ZERO-AREA": "zero_area", "GEOM-ZERO-VOLUME": "zero_volume", "GEOM-INVALID-Z-RANGE": "invalid_z_range", "PARCEL-PROPERTY-OUTSIDE": "property_outside_first",
    "PARCEL-BUILDING-OUTSIDE": "building_outside", "PARCEL-UNASSIGNED-BUILDING": "unassigned_building", "PARCEL-UNASSIGNED-PROPERTY": "unassigned_property", "VERT-FLOOR-OVERLAP": "floor_overlap_global", "VERT-PROPERTY-OVERLAP": "property_overlap_global",
    "VERT-FLOOR-GAP": "floor_gap_global", "VERT-DISCONNECTED-STACK": "disconnected_stack_global", "VERT-Z-ORDER": "z_order", "VERT-FLOOR-HEIGHT": "floor_height_global", "CAD-DUPLICATE-ULPIN": "duplicate_ulpin", "CAD-DUPLICATE-GEOMETRY": "duplicate_geometry",
    "CAD-MISSING-PARENT": "missing_parent", "CAD-ORPHAN-PROPERTY": "orphan_property", "CAD-INVALID-HIERARCHY": "invalid_hierarchy", "INFRA-UTILITY-COLLISION": "utility_collision", "INFRA-TUNNEL": "infra_tunnel", "INFRA-BASEMENT": "infra_basement",
    "INFRA-FOUNDATION": "infra_foundation", "INFRA-ELEVATED_STRUCTURE": "infra_elevated_structure", "CHANGE-FOOTPRINT": "change_footprint", "CHANGE-HEIGHT": "change_height", "CHANGE-VOLUME": "change_volume", "CHANGE-NEW-FLOOR": "new_floor", "CHANGE-REMOVED-FLOOR": "removed_floor",
}
query(
    "validation_run_all",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS rule_id, '{rules.RULES[r].severity}' AS severity, count(*) AS n FROM ({RULE_SQL[f'rule_{q}'][0]}) q{k}" for k, (r, q) in enumerate(_OF_RULE.items())) + ") t WHERE n > 0",
    *sorted({v for q in _OF_RULE.values() for v in RULE_SQL[f"rule_{q}"][1]}),
)(lambda c: rules.summed_up(c.kept("properties"), lambda r, found: [(r.rule_id, r.severity, n)] if (n := found.count()) else [], "rule_id string, severity string, n long"))

# --- aggregates ---------------------------------------------------------------------------------

query("analytics_summary", "SELECT (SELECT count(*) FROM parcels) AS parcels, (SELECT count(*) FROM buildings) AS buildings, (SELECT count(*) FROM properties) AS properties, (SELECT count(*) FROM properties WHERE floor_number = 1) AS ground_floor, (SELECT count(*) FROM infrastructure) AS infrastructure", "parcels", "buildings", "properties", "infrastructure")(
    lambda c: c.properties.agg(F.count(F.lit(1)).alias("properties"), F.count_if(F.col("floor_number") == 1).alias("ground_floor")).crossJoin(c.parcels.agg(F.count(F.lit(1)).alias("parcels"))).crossJoin(c.buildings.agg(F.count(F.lit(1)).alias("buildings"))).crossJoin(c.infrastructure.agg(F.count(F.lit(1)).alias("infrastructure")))
)
query("analytics_levels", f"SELECT floor_number, count(*) AS n, sum({area_sql()}) AS area FROM properties GROUP BY 1", "properties")(lambda c: c.properties.groupBy("floor_number").agg(F.count(F.lit(1)).alias("n"), F.sum(B.area()).alias("area")))
query("floor_bands", "SELECT block, floor_number, min(z_min) AS z_min, max(z_max) AS z_max, min(x0) AS x0, max(x1) AS x1 FROM properties GROUP BY 1, 2", "properties")(lambda c: rules._bands(c, "block").select("block", "floor_number", "z_min", "z_max", "x0", "x1"))
query("generation_totals", f"SELECT status, count(*) AS n, sum({area_sql()}) AS area, sum(CASE WHEN z_max > z_min THEN {area_sql()} * (z_max - z_min) ELSE 0e0 END) AS volume, bool_or(z_max <= z_min) AS review FROM properties GROUP BY 1", "properties")(
    lambda c: c.properties.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(B.area()).alias("area"), F.sum(B.measured_volume()).alias("volume"), F.bool_or(F.col("z_max") <= F.col("z_min")).alias("review"))
)

# --- changes and versions -----------------------------------------------------------------------

_SYM = f"({area_sql('a.')} + {area_sql('b.')} - 2 * {_PLAN})"
_VOLA, _VOLB = f"{area_sql('a.')} * (a.z_max - a.z_min)", f"{area_sql('b.')} * (b.z_max - b.z_min)"
_BOTH = "FROM properties a JOIN survey b ON a.id = b.id"
_ST = "SELECT building_id, floor_number, min_by(id, seq) AS object_id FROM {0} GROUP BY 1, 2"
_CHANGES = f"""SELECT a.id AS object_id, 'FOOTPRINT' AS change_type, {_SYM} AS delta {_BOTH} WHERE {_SYM} > 0.01 OR abs({area_sql("b.")} - {area_sql("a.")}) > 0.01
 UNION ALL SELECT a.id, 'HEIGHT', (b.z_max - b.z_min) - (a.z_max - a.z_min) {_BOTH} WHERE abs((b.z_max - b.z_min) - (a.z_max - a.z_min)) > 0.01
 UNION ALL SELECT a.id, 'VOLUME', {_VOLB} - {_VOLA} {_BOTH} WHERE abs({_VOLB} - {_VOLA}) > 0.01
 UNION ALL SELECT t.object_id, 'NEW_FLOOR', 0e0 FROM ({_ST.format("survey")}) t WHERE NOT EXISTS (SELECT 1 FROM properties p WHERE p.building_id = t.building_id AND p.floor_number = t.floor_number)
 UNION ALL SELECT t.object_id, 'REMOVED_FLOOR', 0e0 FROM ({_ST.format("properties")}) t WHERE NOT EXISTS (SELECT 1 FROM survey p WHERE p.building_id = t.building_id AND p.floor_number = t.floor_number)"""
query("change_compare", _CHANGES, "properties", "survey")(lambda c: changes.compare(c.properties, c.survey))
query("filter_changes_by_type", f"SELECT * FROM ({_CHANGES}) q WHERE change_type = 'HEIGHT'", "properties", "survey")(lambda c: changes.compare(c.properties, c.survey).where("change_type = 'HEIGHT'"))
query("change_report", f"SELECT change_type, count(*) AS n, count(DISTINCT object_id) AS objects, max(abs(delta)) AS largest FROM ({_CHANGES}) q GROUP BY 1", "properties", "survey")(lambda c: changes.report(changes.compare(c.properties, c.survey)))
query("change_agreement", f"SELECT a.id, {_PLAN} / ({area_sql('a.')} + {area_sql('b.')} - {_PLAN}) AS iou {_BOTH}", "properties", "survey")(
    lambda c: c.properties.alias("a").join(c.survey.alias("b"), "id").select("id", changes.plan_agreement().alias("iou"))
)
query("version_latest", "SELECT object_id, version, z_max, reason FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY version DESC) AS rn FROM versions) q WHERE rn = 1", "versions")(lambda c: changes.latest(c.versions).select("object_id", "version", "z_max", "reason"))
query(
    "version_compare_lag",
    f"SELECT object_id, version, CASE WHEN lag(h) OVER w IS NULL THEN 'CREATED' WHEN lag(h) OVER w <> h THEN 'GEOMETRY_CHANGED' ELSE 'UPDATED' END AS kind, z_max - lag(z_max) OVER w AS d_top, area - lag(area) OVER w AS d_area, vol - lag(vol) OVER w AS d_volume FROM (SELECT *, {_HASH.format('')} AS h, {area_sql()} AS area, {area_sql()} * (z_max - z_min) AS vol FROM versions) q WINDOW w AS (PARTITION BY object_id ORDER BY version)",
    "versions",
)(lambda c: changes.history(c.versions))
query("version_append", "SELECT object_id, version FROM versions UNION ALL SELECT p.id, 2 + p.part % 3 FROM properties p WHERE p.z_min < p.z_max AND p.status = 'R'", "versions")(
    lambda c: changes.append_version(c.versions, c.properties.where("status = 'R'").select(F.col("id").alias("object_id"), "x0", "y0", "x1", "y1", "z_min", "z_max")).select("object_id", F.col("version").cast("long").alias("version"))
)
query(
    "parcel_match",
    f"SELECT b.id, CASE how WHEN 'CONTAINED' THEN holder WHEN 'OVERLAPPING' THEN other END AS parcel_id, coalesce(how, 'NONE') AS how FROM buildings b LEFT JOIN (SELECT id, holder, other, CASE WHEN inside = 1 THEN 'CONTAINED' WHEN inside > 1 THEN 'AMBIGUOUS' WHEN touching = 1 THEN 'OVERLAPPING' ELSE 'AMBIGUOUS' END AS how FROM (SELECT a.id, count(*) FILTER (WHERE {area_sql('a.')} = {_PLAN}) AS inside, min(b.id) FILTER (WHERE {area_sql('a.')} = {_PLAN}) AS holder, count(*) AS touching, min(b.id) AS other FROM buildings a JOIN parcels b ON a.y0 - 8 = b.y0 AND {_TOUCH} WHERE {_PLAN} > 0 GROUP BY 1) g) m ON b.id = m.id",
    "buildings", "parcels",
)(lambda c: volumes.parcel_match(c.buildings, c.parcels))
query("unit_split_walls", "SELECT concat(building_id, '-F', lpad(CAST(floor_number AS VARCHAR), 2, '0'), '-U', u) AS key, id AS floor_id, 30 * 36 * (z_max - z_min) AS volume_m3 FROM floors CROSS JOIN (VALUES (1), (2)) AS t(u) WHERE seq % 4 = 0 UNION ALL SELECT concat(building_id, '-F', lpad(CAST(floor_number AS VARCHAR), 2, '0')), id, 60 * 36 * (z_max - z_min) FROM floors WHERE seq % 4 <> 0", "floors")(
    lambda c: volumes.split_by_walls(c.floors, c.floors.where("seq % 4 = 0").select(F.col("id").alias("floor_id"), (F.col("x0") + 30).alias("x"))).select("key", "floor_id", "volume_m3")
)
query("unit_split_polygons", "SELECT concat(building_id, '-F', lpad(CAST(floor_number AS VARCHAR), 2, '0'), '-A') AS key, TRUE AS clipped, 30 * 36 * (z_max - z_min) AS volume_m3 FROM floors", "floors")(
    lambda c: volumes.split_by_polygons(c.floors, c.floors.select(F.col("id").alias("floor_id"), F.lit("A").alias("label"), (F.col("x0") + 30).alias("x0"), "y0", (F.col("x1") + 5).alias("x1"), "y1")).select("key", "clipped", "volume_m3")
)

# --- point cloud --------------------------------------------------------------------------------

query("ground_cell_percentile", "SELECT CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy, round(quantile_cont(z, 0.02), 6) AS ground, count(*) AS n FROM points GROUP BY 1, 2", "points")(lambda c: pointcloud.cell_ground(c.points).withColumn("ground", F.round("ground", 6)))
query(
    "ground_neighbour_smooth",
    "SELECT ix, iy, round(CASE WHEN abs(ground - mid) > 1.0 THEN mid ELSE ground END, 6) AS ground, n FROM (SELECT a.ix, a.iy, a.ground, a.n, quantile_cont(b.ground, 0.5) AS mid FROM g a LEFT JOIN g b ON b.ix BETWEEN a.ix - 1 AND a.ix + 1 AND b.iy BETWEEN a.iy - 1 AND a.iy + 1 AND NOT (a.ix = b.ix AND a.iy = b.iy) GROUP BY 1, 2, 3, 4) q",
    "points",
)(lambda c: pointcloud.smooth(pointcloud.cell_ground(c.points)).withColumn("ground", F.round("ground", 6)))
ORACLES["ground_neighbour_smooth"] = ORACLES["ground_neighbour_smooth"].replace("\nSELECT ix", ", g AS (SELECT CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy, quantile_cont(z, 0.02) AS ground, count(*) AS n FROM points GROUP BY 1, 2)\nSELECT ix", 1)
query("height_p95", "SELECT building, round(quantile_cont(z, 0.95), 6) AS p95 FROM points GROUP BY 1", "points")(lambda c: c.points.groupBy("building").agg(F.round(F.expr("percentile(z, 0.95)"), 6).alias("p95")))
query("elevation_histogram", "SELECT building, CAST(floor(z / 5) AS BIGINT) AS bin, count(*) AS n FROM points GROUP BY 1, 2", "points")(lambda c: pointcloud.histogram(c.points.withColumnRenamed("z", "height"), 5.0))
query("histogram_smooth5", "SELECT building, bin, sum(n) OVER (PARTITION BY building ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5e0 AS smooth FROM (SELECT building, CAST(floor(z / 5) AS BIGINT) AS bin, count(*) AS n FROM points GROUP BY 1, 2) q", "points")(
    lambda c: pointcloud.smoothed(pointcloud.histogram(c.points.withColumnRenamed("z", "height"), 5.0)).select("building", "bin", "smooth")
)
query("storey_spacing_check", "SELECT f.id, f.building_id, z_max - z_min AS height, mid FROM floors f JOIN (SELECT building_id, quantile_cont(z_max - z_min, 0.5) AS mid FROM floors GROUP BY 1) m ON f.building_id = m.building_id WHERE abs(z_max - z_min - mid) > 0.15 * mid", "floors")(lambda c: pointcloud.spacing_check(c.floors))
query("coverage_ratio", "SELECT building, hit, hit / ((b - a + 1) * (d - c + 1)) AS coverage FROM (SELECT building, count(DISTINCT (ix, iy)) AS hit, max(ix) AS b, min(ix) AS a, max(iy) AS d, min(iy) AS c FROM (SELECT building, floor(x) AS ix, floor(y) AS iy FROM points) p GROUP BY 1) q", "points")(lambda c: pointcloud.coverage(c.points))
query("dbscan_clusters")(lambda c: pointcloud.clusters(c.points))
query("ground_classify")(lambda c: pointcloud.classify(c.points).select("id", "ground_z", "height", "is_ground"))
query("storey_levels")(lambda c: pointcloud.storeys(c.points.withColumnRenamed("z", "height")))

# --- history ------------------------------------------------------------------------------------

query("audit_recent_topk", "SELECT id, case_id, action FROM audit ORDER BY ts DESC, id DESC LIMIT 50", "audit")(lambda c: history.recent(c.audit, 50).select("id", "case_id", "action"))
query("audit_history", "SELECT id, actor, action FROM audit WHERE case_id = 'RC-7'", "audit")(lambda c: history.of_case(c.audit, "RC-7").select("id", "actor", "action"))
query(
    "review_state_fold",
    """SELECT case_id, state, decisions FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY k DESC) AS last FROM f) q WHERE last = 1""",
    "audit",
)(lambda c: history.fold_cases(c.audit))
ORACLES["review_state_fold"] = ORACLES["review_state_fold"].replace(
    "\nSELECT case_id",
    """, o AS (SELECT case_id, action, row_number() OVER (PARTITION BY case_id ORDER BY ts, id) AS k FROM audit),
 f AS (SELECT DISTINCT case_id, CAST(0 AS BIGINT) AS k, 'PENDING' AS state, CAST(0 AS BIGINT) AS decisions FROM audit
 UNION ALL SELECT f.case_id, o.k, CASE WHEN action = 'CLOSE' THEN 'CLOSED' WHEN action = 'REOPEN' AND state NOT IN ('PENDING', 'IN_REVIEW') THEN 'IN_REVIEW' WHEN state NOT IN ('PENDING', 'IN_REVIEW') THEN state WHEN action = 'ASSIGN' THEN 'IN_REVIEW' WHEN action = 'APPROVE' THEN 'APPROVED' WHEN action = 'REJECT' THEN 'REJECTED' ELSE state END,
 decisions + CASE WHEN state IN ('PENDING', 'IN_REVIEW') AND action IN ('APPROVE', 'REJECT') THEN 1 ELSE 0 END FROM f JOIN o ON o.case_id = f.case_id AND o.k = f.k + 1)
SELECT case_id""",
    1,
)
_CASES = "SELECT id AS case_id, CASE WHEN seq % 3 = 0 THEN 'CRITICAL' WHEN seq % 3 = 1 THEN 'WARNING' ELSE 'INFO' END AS severity, CASE WHEN seq % 4 = 0 THEN 'me' END AS assigned, part AS created_at FROM properties"
query("review_queue", f"SELECT * FROM ({_CASES}) q ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, assigned IS NOT NULL, created_at, case_id LIMIT 100", "properties")(
    lambda c: history.queue(c.spark.sql(_CASES.replace("FROM properties", "FROM {p}"), p=c.properties), 100)
)
query("review_restore", "SELECT p.id AS issue_id, coalesce(CASE WHEN seq % 5 = 0 THEN 'APPROVED' END, 'OPEN') AS status FROM properties p", "properties")(
    lambda c: history.restore(c.properties.select(F.col("id").alias("issue_id")), c.properties.where("seq % 5 = 0").select(F.col("id").alias("issue_id"), F.lit("APPROVED").alias("state")))
)
_WALK = "SELECT o.o AS seed, object_id, min(depth) AS depth FROM w JOIN (SELECT 1 AS z) z ON TRUE JOIN (SELECT DISTINCT seed AS o FROM w) o ON o.o = w.seed GROUP BY 1, 2"
for _name, _up, _seed in (("lineage_up_recursive", True, "FROM links WHERE stage = 'FLOOR_SEGMENTATION'"), ("lineage_down_recursive", False, "FROM links WHERE stage = 'POINT_CLOUD'")):
    _a, _b = ("object_id", "parent_id") if _up else ("parent_id", "object_id")
    query(_name, _WALK, "links")(lambda c, up=_up, seed=_seed: history.walk(c.links, c.links.where(seed.split("WHERE ")[1]), up))
    ORACLES[_name] = ORACLES[_name].replace("\nSELECT", f", w AS (SELECT object_id AS seed, object_id, 0 AS depth {_seed} UNION SELECT w.seed, l.{_b}, w.depth + 1 FROM w JOIN links l ON l.{_a} = w.object_id WHERE l.parent_id IS NOT NULL)\nSELECT", 1)
query("lineage_stages", "SELECT object_id AS seed, 3 AS depth, 'DATA_SOURCE,POINT_CLOUD,BUILDING_EXTRACTION,FLOOR_SEGMENTATION' AS present, 'PROPERTY_VOLUME' AS missing, TRUE AS complete FROM links WHERE stage = 'FLOOR_SEGMENTATION'", "links")(
    lambda c: history.lineage(c.links, c.links.where("stage = 'FLOOR_SEGMENTATION'"), STAGE_ORDER)
)
query("derived_objects_by_stage", "SELECT stage, count(DISTINCT object_id) AS objects, count(DISTINCT parent_id) AS parents FROM links GROUP BY 1", "links")(lambda c: history.derived_by_stage(c.links))
_JOBS = "SELECT o_orderkey AS id, concat('DS-', o_custkey % 20) AS source_id, concat('J', o_orderkey % 3) AS job_type, o_orderdate AS created_at, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status FROM orders"
query("source_status_rollup", f"SELECT source_id, CASE WHEN bool_or(status = 'FAILED') THEN 'FAILED' WHEN bool_or(status = 'RUNNING') THEN 'RUNNING' WHEN bool_and(status = 'DONE') THEN 'DONE' ELSE 'PENDING' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY source_id, job_type ORDER BY created_at DESC, id DESC) AS rn FROM ({_JOBS}) j) q WHERE rn = 1 GROUP BY 1")(
    lambda c: store.status_rollup(c.spark.sql(_JOBS.replace("FROM orders", "FROM {orders}"), orders=c.orders))
)

# --- more geometry and history ------------------------------------------------------------------

_GX, _GY = "greatest(0e0, a.x0 - b.x1, b.x0 - a.x1)", "greatest(0e0, a.y0 - b.y1, b.y0 - a.y1)"
_MID = "sqrt(power((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2, 2) + power((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2, 2))"
query("geom_distances", f"SELECT a.id, round(sqrt(power({_GX}, 2) + power({_GY}, 2)), 6) AS least, round({_MID}, 6) AS centroid FROM properties a JOIN infrastructure b ON a.seq % 50 = b.seq % 50", "properties", "infrastructure")(
    lambda c: spatial_join.class_pairs(c.properties, c.infrastructure, F.col("seq") % 50).select("a.id", F.round(B.distance("a", "b"), 6).alias("least"), F.round(B.centroid_distance("a", "b"), 6).alias("centroid"))
)
query("geom_difference", f"SELECT a.id, {_SYM} AS difference, greatest(a.x0, b.x0) AS x0, least(a.x1, b.x1) AS x1 {_BOTH} WHERE {_PLAN} > 0", "properties", "survey")(
    lambda c: c.properties.alias("a").join(c.survey.alias("b"), "id").select("id", B.difference_area("a", "b").alias("difference"), B.clipped("a", "b").alias("k")).where("k is not null").select("id", "difference", "k.x0", "k.x1")
)
query("record_links", "SELECT object_id, parent_id, stage FROM links UNION ALL SELECT concat('NEW-', object_id), object_id, 'PROPERTY_VOLUME' FROM links WHERE stage = 'FLOOR_SEGMENTATION'", "links")(
    lambda c: history.record_links(
        c.links,
        c.links.where("stage = 'FLOOR_SEGMENTATION'").select(F.concat(F.lit("NEW-"), "object_id").alias("object_id"), F.col("object_id").alias("parent_id"), F.explode(F.array(F.lit("PROPERTY_VOLUME"), F.lit("NO_SUCH_STAGE"))).alias("stage"), F.lit("ALGORITHM").alias("method"), F.lit(None).cast("string").alias("model_name"))
        .unionByName(c.links.withColumns({"method": F.lit("MODEL"), "model_name": F.lit("m")})),
        STAGE_ORDER,
    ).select("object_id", "parent_id", "stage")
)
query("sources_behind", "SELECT concat('N', n_nationkey) AS seed, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM (SELECT n_nationkey, concat('DS-', o_orderkey % 9) AS s FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey) q GROUP BY 1")(
    lambda c: history.sources_behind(c.links, c.links.where("stage = 'POINT_CLOUD'"), c.orders.select(F.concat(F.lit("O"), "o_orderkey").alias("object_id"), F.concat(F.lit("DS-"), (F.col("o_orderkey") % 9).cast("string")).alias("source_id")))
)
query("processing_history", "SELECT concat('O', o_orderkey) AS seed, concat('J', c_nationkey % 4) AS job_id, 2 AS depth FROM orders JOIN customer ON o_custkey = c_custkey")(
    lambda c: history.processing_history(c.links, c.links.where("stage = 'FLOOR_SEGMENTATION'"), c.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("object_id"), F.concat(F.lit("J"), (F.col("n_nationkey") % 4).cast("string")).alias("job_id")))
)
query("audit_by_actor", "SELECT id, action FROM audit WHERE actor = 'actor3' AND action = 'REJECT' ORDER BY ts DESC, id DESC LIMIT 20", "audit")(lambda c: history.recent(c.audit, 20, "REJECT", "actor3").select("id", "action"))
query("quality_summary", f"SELECT floor_number, count(*) AS n, min(z_max - z_min) AS least, max(z_max - z_min) AS most, sum({area_sql()}) AS total FROM properties GROUP BY 1", "properties")(lambda c: history.quality_summary(c.properties, "floor_number", B.height(), B.area()))
query("jobs_by_source", f"SELECT id, job_type, status FROM ({_JOBS}) j WHERE source_id = 'DS-3'")(lambda c: c.spark.sql(_JOBS.replace("FROM orders", "FROM {orders}"), orders=c.orders).where("source_id = 'DS-3'").select("id", "job_type", "status"))
