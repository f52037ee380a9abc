"""Findings as they are stored, and changes made durable: rows for the issue, change, audit and review collections.

Everything is derived from the rows at hand, ids included, so that a retried task or a second run gives the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import boxes as B
from plumbline.functions import identifiers as I
from plumbline.functions import rings as R

_COLLIDES = "Volume %a and infrastructure %b share %m m3."
#: What each rule says of its objects: %a and %b stand for them, %m for the measure (%0m and %2m with none and two decimals, %p as a percentage). The
#: sentences are this library's own.
SAID = {
    "GEOM-INVALID": "%a has an invalid outline.",
    "GEOM-SELF-INTERSECTION": "The outline of %a crosses itself.",
    "GEOM-ZERO-AREA": "The outline of %a has an area of %2m m2.",
    "GEOM-ZERO-VOLUME": "%a has a volume of %2m m3.",
    "GEOM-INVALID-Z-RANGE": "The top of %a is not above its base: the height is %2m m.",
    "PARCEL-PROPERTY-OUTSIDE": "%a leaves parcel %b by %2m m2.",
    "PARCEL-BUILDING-OUTSIDE": "%a leaves parcel %b by %2m m2.",
    "PARCEL-UNASSIGNED-BUILDING": "%a names no parcel and lies in %b.",
    "PARCEL-UNASSIGNED-PROPERTY": "%a names no parcel and lies in %b.",
    "VERT-FLOOR-OVERLAP": "Storeys %a and %b share %m m3.",
    "VERT-PROPERTY-OVERLAP": "Volumes %a and %b share %m m3.",
    "VERT-FLOOR-GAP": "Between storeys %a and %b there is a gap of %2m m.",
    "VERT-DISCONNECTED-STACK": "Storeys %a and %b share %2m m2 in plan.",
    "VERT-Z-ORDER": "The base of %a is not below its top: the height is %2m m.",
    "VERT-FLOOR-HEIGHT": "The height of %a is %p % off the median.",
    "CAD-DUPLICATE-ULPIN": "%a and %b carry one identifier.",
    "CAD-DUPLICATE-GEOMETRY": "%a and %b have one geometry.",
    "CAD-MISSING-PARENT": "Parcel %b, which %a names, isn't registered.",
    "CAD-ORPHAN-PROPERTY": "Building %b, which %a names, isn't registered.",
    "CAD-INVALID-HIERARCHY": "The band of %a departs from that of storey %b by %2m m.",
    "CHANGE-FOOTPRINT": "%a differs from its version %0m.",
    "CHANGE-HEIGHT": "The height of %a changed by %2m m.",
    "CHANGE-VOLUME": "The volume of %a changed by %2m m3.",
    "CHANGE-NEW-FLOOR": "Storey %0m of %a is beyond those of building %b.",
    "CHANGE-REMOVED-FLOOR": "Storey %0m of %a has no volume.",
} | {f"INFRA-{k}": _COLLIDES for k in ("UTILITY-COLLISION", "TUNNEL", "BASEMENT", "FOUNDATION", "ELEVATED_STRUCTURE")}
#: The names under which measure and second object are evidence: rule -> {name: (m or b, digits)}.
EVIDENCE = {
    "GEOM-ZERO-AREA": {"area_m2": ("m", 6)}, "GEOM-ZERO-VOLUME": {"volume_m3": ("m", 6)}, "GEOM-INVALID-Z-RANGE": {"height_m": ("m", 3)}, "VERT-Z-ORDER": {"height_m": ("m", 3)},
    "PARCEL-PROPERTY-OUTSIDE": {"outside_area_m2": ("m", 2)}, "PARCEL-BUILDING-OUTSIDE": {"outside_area_m2": ("m", 2)}, "PARCEL-UNASSIGNED-BUILDING": {"containing_parcel_id": ("b", 0)}, "PARCEL-UNASSIGNED-PROPERTY": {"containing_parcel_id": ("b", 0)},
    "VERT-FLOOR-OVERLAP": {"overlap_volume_m3": ("m", 2)}, "VERT-PROPERTY-OVERLAP": {"overlap_volume_m3": ("m", 2)}, "VERT-FLOOR-GAP": {"gap_m": ("m", 2)}, "VERT-DISCONNECTED-STACK": {"shared_area_m2": ("m", 4)}, "VERT-FLOOR-HEIGHT": {"deviation_ratio": ("m", 4)},
    "CAD-DUPLICATE-ULPIN": {"first_id": ("b", 0)}, "CAD-DUPLICATE-GEOMETRY": {"first_id": ("b", 0)}, "CAD-MISSING-PARENT": {"parent_parcel_id": ("b", 0)}, "CAD-ORPHAN-PROPERTY": {"building_id": ("b", 0)}, "CAD-INVALID-HIERARCHY": {"floor_id": ("b", 0), "departure_m": ("m", 3)},
    "CHANGE-FOOTPRINT": {"previous_version": ("m", 0)}, "CHANGE-HEIGHT": {"delta_m": ("m", 3)}, "CHANGE-VOLUME": {"delta_m3": ("m", 2)}, "CHANGE-NEW-FLOOR": {"floor_number": ("m", 0), "building_id": ("b", 0)}, "CHANGE-REMOVED-FLOOR": {"floor_number": ("m", 0)},
} | {k: {"overlap_volume_m3": ("m", 2), "infrastructure_id": ("b", 0)} for k in SAID if k.startswith("INFRA-")}


def _number(c: Column, digits: int) -> Column:
    return F.round(c, digits).cast(f"decimal(28,{digits})").cast("string")


_MARKS = {"%0m": lambda: _number(F.col("measure"), 0), "%p": lambda: _number(F.col("measure") * 100, 0), "%2m": lambda: _number(F.col("measure"), 2), "%m": lambda: _number(F.col("measure"), 1), "%b": lambda: F.col("object_b"), "%a": lambda: F.col("object_a")}


def sentence(rule: str) -> Column:
    """What a rule says of a finding, put together from its parts, so that a mark within an id stays what it is. A rule that was registered by the caller is
    told by its id."""
    parts = [x for x in re.split(f"({'|'.join(_MARKS)})", SAID[rule]) if x] if rule in SAID else [f"{rule}: ", "%a", "."]
    return F.concat(*(F.coalesce(_MARKS[x](), F.lit("?")) if x in _MARKS else F.lit(x) for x in parts))


def described(findings: DataFrame) -> DataFrame:
    """Findings (rule_id, object_a, object_b, measure, ...) with a description and evidence, a JSON object whose names depend on the rule. A rule that was
    registered by the caller is told by its id."""
    text, told = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for rule in SAID:
        text = text.when(F.col("rule_id") == rule, sentence(rule))
    text = text.otherwise(F.concat("rule_id", F.lit(": "), F.coalesce("object_a", F.lit("?")), F.lit(".")))
    for rule, names in EVIDENCE.items():
        value = lambda kind, digits: F.col("object_b") if kind == "b" else F.round("measure", digits).cast(f"decimal(28,{digits})")
        told = told.when(F.col("rule_id") == rule, F.to_json(F.struct(*(value(*v).alias(k) for k, v in names.items()))))
    return findings.withColumns({"description": text, "evidence": told})


def text_totals(rows: DataFrame, text: Column) -> tuple[int, int, str | None, str | None, int | None]:
    """n, different texts, the first and the last one, bytes of all, of the rows' texts. Only hashes are shuffled: texts with different hashes differ, and those
    whose hash occurs again are compared themselves."""
    t = rows.select(text.alias("t")).withColumn("h", hashed(F.col("t")))
    again = t.where("t is not null").groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    # both in one job, which shuffles what the rows come from once
    total = t.agg(F.count(F.lit(1)), F.count("t"), F.min("t"), F.max("t"), F.sum(F.octet_length("t").cast("long")))
    n, texts, first, last, length, more = total.crossJoin(again.agg(F.sum("k"))).first()
    if more:
        texts += t.where("t is not null").join(again.select("h"), "h", "left_semi").select("t").distinct().count() - more
    return n, texts, first, last, length


def hashed(text: Column) -> Column:
    return F.xxhash64(text)


def located(findings: DataFrame, objects: DataFrame, geometry: bool = True) -> DataFrame:
    """Findings with location and, if wanted, geometry. objects: id, building_id, floor_number, x0..y1 (unique ids). The geometry is what the two
    objects share in plan, else the first one's outline, as GeoJSON; without it the second object isn't looked up. Findings are best described after
    this, so that no text is shuffled."""
    if not geometry:
        j = findings.join(objects.select(F.col("id").alias("object_a"), "building_id", "floor_number"), "object_a", "left")
        place = F.concat_ws(" / ", "building_id", F.concat(F.lit("Floor "), F.col("floor_number").cast("string")))
        return j.select(*findings.columns, F.when(place != "", place).alias("location"))
    cols = ["building_id", "floor_number", "x0", "y0", "x1", "y1"]
    side = lambda k: objects.select(F.col("id").alias(f"object_{k}"), F.struct(*cols).alias(k))
    j = findings.join(side("a"), "object_a", "left").join(side("b"), "object_b", "left")
    c = B.clipped("a", "b")
    box = F.coalesce(c, F.struct(*(F.col(f"a.{k}") for k in ("x0", "y0", "x1", "y1"))))
    place = F.concat_ws(" / ", F.col("a.building_id"), F.concat(F.lit("Floor "), F.col("a.floor_number").cast("string")))
    j = j.withColumns({"location": F.when(place != "", place), "box": F.when(box["x0"].isNotNull(), box)})
    return j.withColumn("geometry", F.when(F.col("box").isNotNull(), R.to_geojson(B.ring("box")))).drop("a", "b", "box").select(*findings.columns, "location", "geometry")


def stored(findings: DataFrame) -> DataFrame:
    """The stored shape of described and located findings."""
    has = lambda kind: F.get_json_object("evidence", f"$.{kind}").cast("double")
    return findings.select(F.col("issue_id").alias("id"), "object_a", "object_b", F.col("rule_id").alias("issue_type"), "severity", F.round(F.coalesce(has("overlap_volume_m3"), F.lit(0.0)), 2).alias("overlap_volume"), has("gap_m").alias("gap_m"), "description", "geometry", F.lit("OPEN").alias("status"), "location", "rule_id", "category", "evidence")


#: Digits of the ids that a store holds: ten would meet among a few million rows.
STORED = 32


def _id(prefix: str, *parts, digits: int = 10) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits))


def change_direction(old: Column, new: Column, tolerance: float = 0.01) -> Column:
    """What a changed outline did, by its areas."""
    return F.when(new - old > tolerance, "expanded").when(old - new > tolerance, "contracted").otherwise("moved")


def change_findings(changes: DataFrame, digits: int = 10) -> DataFrame:
    """A finding for each change (object_id, change_type, delta, source_id; building_id and floor_number where known). It is a warning: a
    comparison asks for a look and states no fault. A storey that the register lacks has a rule of its own."""
    new = F.col("change_type") == "NEW_FLOOR"
    where = F.concat(F.lit("Storey "), F.col("floor_number").cast("string"), F.coalesce(F.concat(F.lit(" of building "), F.col("building_id")), F.lit("")))
    text = F.concat_ws(" ", F.lower(F.replace("change_type", F.lit("_"), F.lit(" "))), F.lit("change of"), "object_id", F.concat(F.lit("by "), F.format_number("delta", 2)))
    evidence = F.to_json(F.struct("change_type", "floor_number", "building_id", "source_id", _id("CH", "source_id", "object_id", "change_type", digits=digits).alias("change_id"), "delta"))
    return changes.select(
        _id("CHGF", "source_id", "object_id", "change_type", digits=digits).alias("id"), F.col("object_id").alias("object_a"), F.col("building_id").alias("object_b"), F.when(new, "UNREGISTERED_FLOOR").otherwise(F.concat(F.col("change_type"), F.lit("_CHANGE"))).alias("issue_type"), F.lit("WARNING").alias("severity"),
        text.alias("description"), F.lit("OPEN").alias("status"), F.when(new, where).otherwise(F.col("object_id")).alias("location"), F.when(new, "CHANGE-UNREGISTERED-FLOOR").otherwise("CHANGE").alias("rule_id"), F.lit("CHANGE").alias("category"), evidence.alias("evidence"),
    )


def persisted(changes: DataFrame, at: Column, actor: str) -> dict[str, DataFrame]:
    """Rows to append for a comparison: changes, issues, audit and cases, linked by ids that derive from the change."""
    ch = changes.withColumns({"id": _id("CH", "source_id", "object_id", "change_type", digits=STORED), "finding_id": _id("CHGF", "source_id", "object_id", "change_type", digits=STORED), "status": F.lit("REQUIRES_VERIFICATION"), "detected_at": at})
    audit = ch.select(I.event_id("AE", at, F.col("id"), digits=STORED).alias("id"), at.alias("ts"), F.lit("CHANGE_DETECTED").alias("action"), F.lit(actor).alias("actor"), "object_id", F.to_json(F.struct(F.col("id").alias("change_id"), "change_type", "source_id", "delta", "finding_id")).alias("extra"))
    cases = ch.select(_id("RC", "finding_id", digits=STORED).alias("case_id"), F.col("finding_id").alias("issue_id"), F.lit("PENDING").alias("state"), at.alias("created_at"))
    return {"changes": ch, "issues": change_findings(changes, STORED), "audit": audit, "cases": cases}


def report(changes: DataFrame) -> DataFrame:
    """One row: totals of the stored changes, by kind, and what follows from them."""
    n = F.count(F.lit(1))
    kinds = changes.groupBy("change_type").agg(n.alias("k")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("change_type", "k"))))).alias("by_type"))
    head = changes.agg(n.alias("total_changes"), F.count_distinct("object_id").alias("objects_affected"), F.coalesce(F.bool_and(F.col("status") == "REQUIRES_VERIFICATION"), F.lit(True)).alias("all_require_verification"))
    any_ = F.col("total_changes") > 0
    return head.crossJoin(kinds).select("total_changes", "by_type", "objects_affected", F.when(any_, "REQUIRES_VERIFICATION").otherwise("NO_CHANGE").alias("status"), "all_require_verification", F.when(any_, "Each change needs a person's verification.").otherwise("No change against the approved record.").alias("message"))


def difference_boxes(a: str = "a", b: str = "b") -> Column:
    """The symmetric difference of two footprints as boxes that share no area: strips of each outside the other; empty if they are equal."""

    def outside(p: str, q: str) -> list[Column]:
        c = lambda k, s: F.col(f"{s}.{k}")
        lo = {k: F.least(F.greatest(c(f"{k}0", q), c(f"{k}0", p)), c(f"{k}1", p)) for k in "xy"}
        hi = {k: F.greatest(F.least(c(f"{k}1", q), c(f"{k}1", p)), lo[k]) for k in "xy"}
        apart = B.plan_overlap(p, q) <= 0
        box = lambda x0, y0, x1, y1: F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))
        whole = box(c("x0", p), c("y0", p), c("x1", p), c("y1", p))
        strips = [box(c("x0", p), c("y0", p), lo["x"], c("y1", p)), box(hi["x"], c("y0", p), c("x1", p), c("y1", p)), box(lo["x"], c("y0", p), hi["x"], lo["y"]), box(lo["x"], hi["y"], hi["x"], c("y1", p))]
        return [F.when(apart, whole), *(F.when(~apart, s) for s in strips)]

    return F.filter(F.array(*outside(a, b), *outside(b, a)), lambda x: x.isNotNull())


def derived_refresh(objects: DataFrame, kind: str) -> DataFrame:
    """Cached measures again from the geometry: a parcel's area, a volume's area and volume, a building's band."""
    if kind == "parcels":
        return objects.withColumn("area", B.area())
    if kind == "properties":
        return objects.withColumns({"area_m2": F.round(B.area(), 2), "volume_m3": F.round(B.measured_volume(), 2)})
    if kind == "buildings":
        return objects.withColumn("geometry_3d", F.struct("z_min", "z_max", R.to_geojson(B.ring()).alias("footprint")))
    return objects
