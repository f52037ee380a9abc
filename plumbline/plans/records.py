"""More named queries: stored records, lookups, roll-ups, storeys, findings and CRS, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import boxes as B
from plumbline.functions import crs as C
from plumbline.functions import identifiers as I
from plumbline.functions import shapes as S
from plumbline.operators import changes, findings, lookups, rules, storeys
from plumbline.sources import ingest
from plumbline.sources.cadastre import STAGE_ORDER

from .catalogue import _OF_RULE, _PLAN, ORACLES, QUERIES, RULE_SQL, area_sql, query

__all__ = ["ORACLES", "QUERIES"]

# --- lookups ------------------------------------------------------------------------------------

query("exact_object_resolve", "SELECT id, 'properties' AS kind FROM properties WHERE ulpin = 'VC-VP-B7-F1U1' AND id <> 'VC-VP-B7-F1U1' ORDER BY seq LIMIT 1", "properties")(
    lambda c: lookups.resolve_object({"parcels": c.parcels.select("id"), "buildings": c.buildings.select("id", "parcel_id"), "properties": c.properties.select("id", "parcel_id", "ulpin")}, "VC-VP-B7-F1U1").select("id", F.col("kind_").alias("kind"))
)
query("version_by_number", "SELECT object_id, version, z_max FROM versions WHERE object_id = 'V-7-1-1' AND version = 1", "versions")(lambda c: lookups.version(c.versions, "V-7-1-1", 1).select("object_id", "version", "z_max"))
query("filter_storeys", "SELECT id, z_min, z_max FROM floors WHERE building_id = 'B-7' AND floor_number = 3", "floors")(lambda c: lookups.matching(c.floors, building_id="B-7", floor_number=3, source_id=None).select("id", "z_min", "z_max"))
query("filter_volumes", "SELECT id FROM properties WHERE building_id = 'B-7'", "properties")(lambda c: lookups.matching(c.properties, building_id="B-7", parcel_id=None).select("id"))
query("filter_extracted_buildings", "SELECT id, floor_count FROM buildings WHERE parcel_id = 'P-7'", "buildings")(lambda c: lookups.matching(c.buildings, parcel_id="P-7").select("id", "floor_count"))
query("floors_in_order", "SELECT id, row_number() OVER (ORDER BY building_id, floor_number) AS k FROM floors QUALIFY k <= 100", "floors")(
    lambda c: lookups.in_floor_order(c.floors).limit(100).select("id", (F.monotonically_increasing_id() + 1).alias("k"))
)
query("identified_objects", "SELECT id, 'parcel' AS kind, NULL AS ulpin FROM parcels UNION ALL SELECT id, 'volume', ulpin FROM properties", "parcels", "properties")(
    lambda c: lookups.identified(c.parcels.select("id", F.lit("parcel").alias("kind")), c.properties.select("id", F.lit("volume").alias("kind"), "ulpin"))
)
query("points_in_boxes", "SELECT p.id, b.id AS box_id FROM points p JOIN (SELECT * FROM buildings WHERE seq < 400) b ON p.x BETWEEN b.x0 - 1 AND b.x1 + 1 AND p.y BETWEEN b.y0 - 1 AND b.y1 + 1", "points", "buildings")(
    lambda c: lookups.points_in(c.points, c.buildings.where("seq < 400")).select("id", "box_id")
)

# --- JSON, sources, jobs ------------------------------------------------------------------------

_SOURCES = """SELECT concat('DS-', page_id) AS id, concat('f', page_id, '.las') AS filename, 'POINT_CLOUD' AS source_type, CASE page_id % 4 WHEN 0 THEN 'epsg:32643' WHEN 1 THEN 'urn:ogc:def:crs:EPSG::4326' WHEN 2 THEN 'local grid' END AS crs,
 concat('{{"point_cloud": ', CASE WHEN page_id % 3 = 0 THEN 'false' ELSE 'true' END, ', "format": "LAS", "point_count": ', page_id % 1000, ', "sha256": "', page_id, '"}}') AS metadata FROM {pages}"""
_JOBS = """SELECT o_orderkey AS id, concat('DS-', o_custkey % 20) AS source_id, CASE o_orderkey % 3 WHEN 0 THEN 'BUILDING_EXTRACTION' WHEN 1 THEN 'METADATA_EXTRACTION' ELSE 'FLOOR_SEGMENTATION' END AS job_type,
 CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'RUNNING' ELSE 'PENDING' END AS status FROM {orders}"""
_ISSUES = """SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS severity, CASE WHEN event_id % 5 > 0 THEN event_type END AS category,
 CASE WHEN event_id % 7 > 0 THEN concat('R', event_id % 7) END AS rule_id, CASE WHEN event_id % 11 = 0 THEN 'APPROVED' ELSE 'OPEN' END AS status FROM {events}"""
_sql = lambda t, **names: f"({t.format(**names)})"
_sources = lambda c: c.spark.sql(_SOURCES, pages=c.pages)
_jobs = lambda c: c.spark.sql(_JOBS, orders=c.orders)
_issues = lambda c: c.spark.sql(_ISSUES, events=c.events)
_PAGES, _ORDERS, _EVENTS = _sql(_SOURCES, pages="pages"), _sql(_JOBS, orders="orders"), _sql(_ISSUES, events="events")

query("point_cloud_sources", f"SELECT id FROM {_PAGES} s WHERE CAST(substr(id, 4) AS BIGINT) % 3 <> 0")(lambda c: lookups.point_cloud_sources(_sources(c)).select("id"))
query("metadata_lifted", f"SELECT id, 'LAS' AS format, CAST(CAST(substr(id, 4) AS BIGINT) % 1000 AS VARCHAR) AS point_count FROM {_PAGES} s")(lambda c: lookups.lifted(_sources(c), "metadata", {"format": "format", "point_count": "point_count"}).select("id", "format", "point_count"))
query("point_cloud_summary", f"SELECT id AS source_id, CASE WHEN crs LIKE '%32643' THEN 'EPSG:32643' WHEN crs LIKE '%4326' THEN 'EPSG:4326' ELSE 'UNKNOWN' END AS crs, substr(id, 4) AS sha256, 'PENDING' AS status FROM {_PAGES} s WHERE CAST(substr(id, 4) AS BIGINT) % 3 <> 0")(
    lambda c: lookups.point_cloud_summary(_sources(c), c.spark.createDataFrame([], "source_id string, status string")).select("source_id", "crs", "sha256", "status")
)
query("extraction_stage", f"SELECT source_id, CASE WHEN bool_or(job_type = 'BUILDING_EXTRACTION' AND status = 'FAILED') THEN 'EXTRACTION_FAILED' WHEN bool_or(job_type = 'BUILDING_EXTRACTION' AND status = 'RUNNING') THEN 'EXTRACTING' WHEN bool_or(job_type = 'BUILDING_EXTRACTION' AND status = 'DONE') THEN 'EXTRACTED' WHEN bool_or(job_type = 'BUILDING_EXTRACTION') OR bool_or(job_type = 'METADATA_EXTRACTION' AND status = 'DONE') THEN 'METADATA_ONLY' ELSE 'UNKNOWN' END AS stage FROM {_ORDERS} j GROUP BY 1")(
    lambda c: lookups.extraction_stage(_jobs(c))
)
query("stored_issue_summary", " UNION ALL ".join([f"SELECT '{k}' AS by, {k} AS value, count(*) AS n FROM {_EVENTS} i WHERE {k} IS NOT NULL GROUP BY 2" for k in ("severity", "category", "rule_id")] + [f"SELECT 'total', NULL, count(*) FROM {_EVENTS} i"]))(
    lambda c: lookups.issue_summary(_issues(c))
)
_KINDS = ("parcels", "buildings", "floors", "properties", "infrastructure")
query("health_counts", " UNION ALL ".join(f"SELECT '{k}' AS collection, count(*) AS n FROM {k}" for k in _KINDS), *_KINDS)(lambda c: lookups.counts({k: getattr(c, k) for k in _KINDS}))
query("versioned_object_counts", " UNION ALL ".join(f"SELECT '{k}' AS collection, count(*) AS n FROM {k}" for k in ("parcels", "buildings", "properties", "infrastructure")), "parcels", "buildings", "properties", "infrastructure")(
    lambda c: lookups.counts({k: getattr(c, k) for k in ("parcels", "buildings", "properties", "infrastructure")})
)
query("adapter_counts", "SELECT 'building-extraction' AS collection, count(*) AS n FROM buildings UNION ALL SELECT 'floor-segmentation', count(*) FROM floors UNION ALL SELECT 'vertical-delineation', count(*) FROM properties", "buildings", "floors", "properties")(
    lambda c: lookups.counts({"building-extraction": c.buildings, "floor-segmentation": c.floors, "vertical-delineation": c.properties})
)
query("job_links", f"SELECT object_id, parent_id, stage FROM links UNION ALL SELECT CAST(id AS VARCHAR), source_id, 'PROCESSING_JOB' FROM {_ORDERS} j", "links")(
    lambda c: lookups.job_links(c.links, _jobs(c).withColumn("id", F.col("id").cast("string")).unionAll(_jobs(c).withColumn("id", F.col("id").cast("string")))).select("object_id", "parent_id", "stage")
)
query("pipeline_links", f"SELECT object_id, parent_id, stage FROM links UNION ALL SELECT CAST(id AS VARCHAR), source_id, 'PROCESSING_JOB' FROM {_ORDERS} j UNION ALL SELECT concat('X', o_orderkey), CAST(o_orderkey AS VARCHAR), 'BUILDING_EXTRACTION' FROM orders", "links")(
    lambda c: lookups.pipeline_links(c.links, _jobs(c).withColumn("id", F.col("id").cast("string")), c.orders.select(F.concat(F.lit("X"), "o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("job_id")), "BUILDING_EXTRACTION").select("object_id", "parent_id", "stage")
)
query("provenance_by_stage", "SELECT object_id, CASE stage WHEN 'DATA_SOURCE' THEN 0 WHEN 'POINT_CLOUD' THEN 1 WHEN 'BUILDING_EXTRACTION' THEN 2 WHEN 'FLOOR_SEGMENTATION' THEN 3 ELSE 4 END AS stage_rank FROM links", "links")(
    lambda c: lookups.by_stage(c.links.withColumn("created_at", F.lit(0)), STAGE_ORDER).select("object_id", "stage_rank")
)
query("workflow_steps", f"""SELECT * FROM (SELECT 1 AS idx, 'sources' AS step, (SELECT count(*) FROM pages) AS n, 'ready' AS state UNION ALL SELECT 2, 'parcel', (SELECT count(*) FROM parcels), 'ready'
 UNION ALL SELECT 3, 'extraction', (SELECT count(*) FROM buildings), 'running' UNION ALL SELECT 4, 'floors', (SELECT count(*) FROM floors), 'running' UNION ALL SELECT 5, 'volumes', (SELECT count(*) FROM properties), 'attention'
 UNION ALL SELECT 6, 'ulpin', (SELECT count(*) FROM properties), 'attention' UNION ALL SELECT 7, 'validation', (SELECT count(*) FROM events), 'attention' UNION ALL SELECT 8, 'review', (SELECT count(*) FROM {_EVENTS} i WHERE status <> 'APPROVED'), 'attention'
 UNION ALL SELECT 9, 'approved', (SELECT count(*) FROM {_EVENTS} i WHERE status = 'APPROVED'), 'ready') w""", "parcels", "buildings", "floors", "properties")(
    lambda c: lookups.workflow({
        "sources": c.pages, "parcels": c.parcels, "jobs": _jobs(c), "extracted": c.buildings.withColumn("flagged", F.lit(False)), "storeys": c.floors.withColumn("flagged", F.lit(False)), "volumes": c.properties.withColumn("flagged", F.col("status") == "R"),
        "identified": lookups.identified(c.parcels.select("id"), c.properties.select("id", "ulpin")), "issues": _issues(c), "cases": _issues(c).select(F.when(F.col("status") == "APPROVED", "APPROVED").otherwise("PENDING").alias("state")),
    })
)

# --- identifiers, dates -------------------------------------------------------------------------

query("stable_unit_labels", "SELECT id, concat(building_id, '-F', lpad(CAST(floor_number AS VARCHAR), 2, '0'), '-', unit_label) AS label FROM properties", "properties")(lambda c: c.properties.select("id", I.unit_label(F.col("building_id"), F.col("floor_number"), F.col("unit_label")).alias("label")))
query("extraction_ordinals", "SELECT id, CAST(substr(id, 3) AS BIGINT) AS k FROM buildings UNION ALL SELECT concat(id, '-x'), 5 FROM buildings", "buildings")(
    lambda c: c.buildings.select("id").unionAll(c.buildings.select(F.concat("id", F.lit("-x")))).select("id", I.extraction_ordinal(F.col("id"), F.lit(5)).alias("k"))
)
query("types_by_fields", "SELECT 'BUILDING' AS kind, count(*) AS n FROM buildings WHERE parcel_id IS NOT NULL UNION ALL SELECT 'PROPERTY_VOLUME', count(*) FROM buildings WHERE parcel_id IS NULL", "buildings")(
    lambda c: c.buildings.groupBy(I.type_by_fields(parcel_id=F.col("parcel_id"), floor_count=F.col("floor_count")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
)
query("iso_dates", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")(
    lambda c: c.orders.select(F.col("o_orderkey").alias("id"), I.iso(F.col("o_orderdate")).alias("iso")).withColumn("day", I.day(F.col("iso")).cast("string"))
)
query("audit_event_ids", "SELECT concat('AE-', strftime(ts, '%Y%m%d%H%M%S'), lpad(CAST(CAST(date_part('microseconds', ts) AS BIGINT) % 1000000 AS VARCHAR), 6, '0'), '-', substr(sha256(CAST(event_id AS VARCHAR)), 1, 8)) AS id FROM events")(lambda c: c.events.select(I.event_id("AE", F.col("ts"), F.col("event_id").cast("string")).alias("id")))

# --- findings and changes -----------------------------------------------------------------------

query(
    "findings_described",
    f"SELECT object_a, object_b, concat('Volumes ', object_a, ' and ', object_b, ' share ', CAST(CAST(round(measure, 1) AS DECIMAL(28,1)) AS VARCHAR), ' m3.') AS description, concat(p.building_id, ' / Floor ', p.floor_number) AS location FROM ({RULE_SQL['rule_property_overlap_global'][0]}) z JOIN properties p ON p.id = z.object_a",
    "properties",
)(
    lambda c: findings.described(findings.located(rules.run_rules(c.kept("properties"), "VERT-PROPERTY-OVERLAP"), c.properties, geometry=False)).select("object_a", "object_b", "description", "location")
)
# all rules, all findings: what is said, by rule
_MARKS = {"%0m": "CAST(CAST(round(measure, 0) AS DECIMAL(28,0)) AS VARCHAR)", "%p": "CAST(CAST(round(measure * 100, 0) AS DECIMAL(28,0)) AS VARCHAR)", "%2m": "CAST(CAST(round(measure, 2) AS DECIMAL(28,2)) AS VARCHAR)", "%m": "CAST(CAST(round(measure, 1) AS DECIMAL(28,1)) AS VARCHAR)", "%b": "object_b", "%a": "object_a"}


def _said(rule: str) -> str:
    parts = re.split(r"(%0m|%2m|%p|%m|%b|%a)", findings.SAID[rule])
    return "concat(" + ", ".join(f"coalesce({_MARKS[p]}, '?')" if p in _MARKS else "'" + p.replace("'", "''") + "'" for p in parts if p) + ")"


def _texts_of(rule: rules.Rule, found: DataFrame) -> list[tuple]:
    """What is said by a rule, in one row, if it finds anything."""
    n, *rest = findings.text_totals(found, findings.sentence(rule.rule_id))
    return [(rule.rule_id, n, *rest)] if n else []


_EACH = " UNION ALL ".join(
    f"SELECT '{r}' AS rule_id, {_said(r)} AS description, object_a FROM (SELECT CAST(object_a AS VARCHAR) AS object_a, CAST(object_b AS VARCHAR) AS object_b, CAST(measure AS DOUBLE) AS measure FROM ({RULE_SQL[f'rule_{q}'][0]}) z) y" for r, q in _OF_RULE.items()
)
query(
    "findings_described_all",
    f"SELECT rule_id, count(*) AS n, count(DISTINCT description) AS texts, min(description) AS first_text, max(description) AS last_text, sum(strlen(description)) AS length FROM ({_EACH}) q GROUP BY 1",
    *sorted({v for q in _OF_RULE.values() for v in RULE_SQL[f"rule_{q}"][1]}),
)(
    lambda c: rules.summed_up(c.kept("properties"), _texts_of, "rule_id string, n long, texts long, first_text string, last_text string, length long")
)
_CH = "SELECT id AS object_id, building_id, floor_number, 'S' AS source_id, CASE WHEN seq % 2 = 0 THEN 'HEIGHT' ELSE 'NEW_FLOOR' END AS change_type, CAST(floor_number AS DOUBLE) AS delta FROM {properties}"
_changes = lambda c: c.spark.sql(_CH, properties=c.properties)
query("change_findings", f"SELECT object_id AS object_a, building_id AS object_b, CASE WHEN change_type = 'HEIGHT' THEN 'HEIGHT_CHANGE' ELSE 'UNREGISTERED_FLOOR' END AS issue_type, 'WARNING' AS severity, CASE WHEN change_type = 'HEIGHT' THEN object_id ELSE concat('Storey ', floor_number, coalesce(concat(' of building ', building_id), '')) END AS location, concat('CHGF-', substr(sha256(concat('S|', object_id, '|', change_type)), 1, 10)) AS id FROM {_sql(_CH, properties='properties')} t", "properties")(
    lambda c: findings.change_findings(_changes(c)).select("object_a", "object_b", "issue_type", "severity", "location", "id")
)
query("change_persist", "SELECT 'changes' AS collection, count(*) AS n FROM properties UNION ALL SELECT 'issues', count(*) FROM properties UNION ALL SELECT 'audit', count(*) FROM properties UNION ALL SELECT 'cases', count(*) FROM properties", "properties")(
    lambda c: lookups.counts({k: v.select("object_id" if k in ("changes", "audit") else "id" if k == "issues" else "case_id").distinct() for k, v in findings.persisted(_changes(c), F.lit("2026-01-01").cast("timestamp"), "me").items()})
)
query("change_report_full", "SELECT count(*) AS total_changes, count(DISTINCT id) AS objects_affected, 'REQUIRES_VERIFICATION' AS status, TRUE AS all_require_verification FROM properties", "properties")(
    lambda c: findings.report(_changes(c).withColumn("status", F.lit("REQUIRES_VERIFICATION"))).select("total_changes", "objects_affected", "status", "all_require_verification")
)
query("change_list_capped", "SELECT id AS object_id FROM properties ORDER BY part, id LIMIT 500", "properties")(lambda c: lookups.listed_changes(c.properties.withColumn("detected_at", F.col("part"))).select(F.col("id").alias("object_id")))
query("change_difference_boxes", f"SELECT a.id, round({area_sql('a.')} + {area_sql('b.')} - 2 * {_PLAN}, 6) AS area FROM properties a JOIN survey b ON a.id = b.id", "properties", "survey")(
    lambda c: c.properties.alias("a").join(c.survey.alias("b"), "id").select("id", F.round(F.aggregate(findings.difference_boxes(), F.lit(0.0), lambda s, b: s + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])), 6).alias("area"))
)
query("derived_refresh", f"SELECT id, round({area_sql()}, 2) AS area_m2, round(CASE WHEN z_max > z_min THEN {area_sql()} * (z_max - z_min) ELSE 0e0 END, 2) AS volume_m3 FROM properties", "properties")(lambda c: findings.derived_refresh(c.properties, "properties").select("id", "area_m2", "volume_m3"))
query("change_direction", f"SELECT a.id, CASE WHEN {area_sql('b.')} - {area_sql('a.')} > 0.01 THEN 'expanded' WHEN {area_sql('a.')} - {area_sql('b.')} > 0.01 THEN 'contracted' ELSE 'moved' END AS what FROM properties a JOIN survey b ON a.id = b.id", "properties", "survey")(
    lambda c: changes.indexed(c.properties).alias("a").join(c.survey.alias("b"), "id").select("id", findings.change_direction(B.area("a"), B.area("b")).alias("what"))
)

# --- storeys ------------------------------------------------------------------------------------

query("base_datum", "SELECT p.building, round(quantile_cont(z, 0.02), 6) AS base_z FROM points p JOIN (SELECT building, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM points GROUP BY 1) m ON p.building = m.building WHERE abs(x - mx) <= 2 AND abs(y - my) <= 2 GROUP BY 1", "points")(
    lambda c: storeys.base_datum(c.points, c.spark.createDataFrame([], "id long, x0 double, y0 double, x1 double, y1 double")).withColumn("base_z", F.round("base_z", 6))
)


def _levels():
    level = lambda z, snapped, evidence: F.struct(F.lit(z).alias("z"), F.lit(snapped).alias("snapped"), F.lit(evidence).alias("evidence"))
    return F.array(level(0.0, True, 1.0), level(100.0, True, 0.5), level(130.0, False, 0.0), level(300.0, True, 0.25))


query("points_by_storey", "SELECT CASE WHEN z <= 50 THEN 1 WHEN z <= 115 THEN 2 ELSE 3 END AS storey, count(*) AS n FROM points GROUP BY 1", "points")(lambda c: c.points.groupBy(storeys.storey_of(F.col("z"), _levels()).alias("storey")).agg(F.count(F.lit(1)).alias("n")))
query("peaks_snapped", "SELECT id, CASE WHEN abs(z - 200) <= 60 AND abs(z - 200) <= abs(z - 100) THEN 200e0 WHEN abs(z - 100) <= 60 THEN 100e0 END AS peak FROM points", "points")(
    lambda c: c.points.select("id", storeys.snap(F.col("z"), F.array(*(F.struct(F.lit(v).alias("z"), F.lit(1.0).alias("evidence")) for v in (100.0, 200.0))), F.lit(60.0))["z"].alias("peak"))
)
query("levels_without_thin", "SELECT id, CASE WHEN floor_number < 6 THEN 4 ELSE 3 END AS n FROM floors", "floors")(lambda c: c.floors.select("id", F.size(storeys.without_thin(_levels(), F.col("floor_number") * 6.0)).alias("n")))
query("storey_records", "SELECT building, storey, count(*) AS points, CASE storey WHEN 1 THEN 0e0 WHEN 2 THEN 100e0 ELSE 130e0 END AS z_min, CASE storey WHEN 1 THEN 4000e0 * 100 WHEN 2 THEN 4000e0 * 30 ELSE 4000e0 * 170 END AS volume_m3 FROM (SELECT building, CASE WHEN z <= 50 THEN 1 WHEN z <= 115 THEN 2 ELSE 3 END AS storey FROM points) p GROUP BY 1, 2", "points")(
    lambda c: storeys.records(
        storeys.assigned(c.points.withColumn("height", F.col("z")), c.points.select("building").distinct().withColumn("levels", _levels())),
        c.points.select("building").distinct().withColumns({"levels": _levels(), "storey_height": F.lit(100.0)}),
        c.points.select(F.col("building").alias("id")).distinct().selectExpr("id", "0e0 x0", "0e0 y0", "100e0 x1", "40e0 y1"),
    ).select("building", "storey", "points", "z_min", "volume_m3")
)
query("union_footprints", "SELECT block, floor_number, sum(d) AS area FROM (SELECT block, floor_number, greatest(0e0, x1 - greatest(x0, coalesce(max(x1) OVER (PARTITION BY block, floor_number ORDER BY x0, x1, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), x0))) * (y1 - y0) AS d FROM properties) q GROUP BY 1, 2 HAVING sum(d) > 0", "properties")(
    lambda c: c.properties.groupBy("block", "floor_number").agg(F.collect_set(F.struct("x0", "y0", "x1", "y1")).alias("b")).select("block", "floor_number", S.shared_area(F.col("b"), F.col("b")).alias("area"))
)
query("footprints_dissolved", "SELECT block, sum(d) AS area FROM (SELECT block, greatest(0e0, x1 - greatest(x0, coalesce(max(x1) OVER (PARTITION BY block ORDER BY x0, x1, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), x0))) * (y1 - y0) AS d FROM properties) q GROUP BY 1 HAVING sum(d) > 0", "properties")(
    lambda c: S.dissolve(c.properties, "block").groupBy("block").agg(F.sum(B.area()).alias("area"))
)
query("warnings_sorted", "SELECT block, string_agg(DISTINCT unit_label, ',' ORDER BY unit_label) AS w FROM properties GROUP BY 1", "properties")(lambda c: c.properties.groupBy("block").agg(F.array_join(lookups.warnings(F.collect_list("unit_label")), ",").alias("w")))

# --- CRS ----------------------------------------------------------------------------------------

_CODES = "CASE id % 5 WHEN 0 THEN 'EPSG:4326' WHEN 1 THEN 'epsg:32643' WHEN 2 THEN 'EPSG:3857' WHEN 3 THEN 'EPSG:3413' ELSE 'nowhere' END"
query("crs_traits", f"SELECT id, CASE id % 5 WHEN 0 THEN 'degree' WHEN 4 THEN 'unknown' ELSE 'metre' END AS units, id % 5 IN (1, 2, 3) AS projected, id % 5 IN (1, 3) AS suitable, CASE WHEN id % 5 = 4 THEN 'UNKNOWN' ELSE upper({_CODES}) END AS source FROM points", "points")(
    lambda c: c.points.select("id", F.expr(_CODES).alias("k")).select("id", C.units(F.col("k")).alias("units"), C.is_projected(F.col("k")).alias("projected"), C.is_suitable(F.col("k")).alias("suitable"), C.source_crs(F.col("k")).alias("source"))
)
query("crs_contexts", "SELECT id, CASE id % 2 WHEN 0 THEN 'EPSG:4326' ELSE 'UNKNOWN' END AS source_crs, CASE WHEN id % 2 = 0 THEN 'EPSG:32643' END AS processing_crs FROM points", "points")(
    lambda c: c.points.select("id", C.context(F.when(F.col("id") % 2 == 0, "wgs84"), F.lit(75.5), F.lit(20.0)).alias("k")).select("id", "k.source_crs", "k.processing_crs")
)
query("crs_polar_round_trip", "SELECT id, CAST(id % 340 - 170 AS DOUBLE) AS lon, CASE WHEN id % 2 = 0 THEN 84.5e0 + id % 5 ELSE -84.5e0 - id % 5 END AS lat FROM points", "points")(
    lambda c: c.points.selectExpr("id", "CAST(id % 340 - 170 AS DOUBLE) AS lon", "CASE WHEN id % 2 = 0 THEN 84.5e0 + id % 5 ELSE -84.5e0 - id % 5 END AS lat").withColumn("code", F.when(F.col("lat") > 0, "EPSG:3413").otherwise("EPSG:3031"))
    .withColumn("p", C.from_wgs84(F.col("lon"), F.col("lat"), F.col("code"))).withColumn("g", C.to_wgs84(F.col("p.x"), F.col("p.y"), F.col("code"))).select("id", F.round("g.lon", 6).alias("lon"), F.round("g.lat", 6).alias("lat"))
)
query("crs_display_bounds", "SELECT id, TRUE AS ok FROM buildings", "buildings")(
    lambda c: c.buildings.select("id", *((F.col(k) + base).alias(k) for k, base in (("x0", 5e5), ("y0", 2e6), ("x1", 5e5), ("y1", 2e6))))
    .withColumns({"d": C.display_bounds(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit("EPSG:32643")), "a": C.bounds_area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit("EPSG:32643"), F.lit("EPSG:32643"))})
    .select("id", (F.col("d.x0").between(74.9, 75.5) & (F.col("d.x1") > F.col("d.x0")) & (F.col("d.y1") > F.col("d.y0")) & (F.abs(F.col("a") - 2160) < 1e-6)).alias("ok"))
)
query("records_encoded", "SELECT id, concat('{\"x0\":', CAST(x0 AS VARCHAR), '}') AS box FROM parcels", "parcels")(lambda c: ingest.encoded(c.parcels.select("id", F.struct("x0").alias("box"))))

from . import shapes as _shapes  # noqa: E402, F401  further queries register themselves
