"""The thirty integrity rules, each a DataFrame of (object_a, object_b, measure) over a catalog of collections.

``RULES`` is ordered; order is behaviour. A rule reads only the collections it names, and further ones can be
registered. Storey rules compare all records, as ``_global``; variants keyed by building are there beside them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import boxes as B
from plumbline.functions import rings as R
from plumbline.functions.shapes import shared_area

from .arrangement import overlay_areas
from .quantiles import exact_quantiles
from .spatial_join import first_containing, grid_pairs
from .store import swept

CELL = 100.0


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    severity: str
    build: Callable[[object], DataFrame]


RULES: dict[str, Rule] = {}


def rule(rule_id: str, category: str, severity: str):
    def add(f):
        RULES[rule_id] = Rule(rule_id, category, severity, f)
        return f

    return add


def finding(df: DataFrame, a, b=None, measure=None) -> DataFrame:
    as_col = lambda c, kind: F.lit(None).cast(kind) if c is None else (F.col(c) if isinstance(c, str) else c).cast(kind)
    return df.select(as_col(a, "string").alias("object_a"), as_col(b, "string").alias("object_b"), as_col(measure, "double").alias("measure"))


# --- geometry ----------------------------------------------------------------------------------


def _ringed(df: DataFrame) -> DataFrame:
    """Records with their ring: their own where they carry one, else that of their box."""
    return df if "ring" in df.columns else df.withColumn("ring", B.ring())


@rule("GEOM-INVALID", "GEOMETRY", "CRITICAL")
def invalid(cat):
    return finding(_ringed(cat.properties).withColumn("why", R.validity(F.col("ring"))).where("why <> 'valid'"), "id")


@rule("GEOM-SELF-INTERSECTION", "GEOMETRY", "CRITICAL")
def self_intersection(cat):
    return finding(_ringed(cat.properties).withColumn("why", R.validity(F.col("ring"))).where("why = 'self-intersection'"), "id")


@rule("GEOM-ZERO-AREA", "GEOMETRY", "WARNING")
def zero_area(cat):
    area = R.area(F.col("ring")) if "ring" in cat.properties.columns else B.area()
    return finding(cat.properties.where(area <= B.EPS_AREA), "id", None, area)


@rule("GEOM-ZERO-VOLUME", "GEOMETRY", "CRITICAL")
def zero_volume(cat):
    return finding(cat.properties.where(B.volume() <= B.EPS_AREA), "id", None, B.volume())


@rule("GEOM-INVALID-Z-RANGE", "GEOMETRY", "CRITICAL")
def invalid_z_range(cat):
    return finding(cat.properties.where("not (z_min < z_max)"), "id", None, B.height())


# --- parcels -----------------------------------------------------------------------------------


def _first(df: DataFrame) -> DataFrame:
    return df.orderBy("seq").limit(1)


@rule("PARCEL-PROPERTY-OUTSIDE", "PARCEL", "WARNING")
def property_outside_first(cat):
    """Against the first parcel of the store, which the limit bounds to one row."""
    p = cat.properties.alias("a").crossJoin(F.broadcast(_first(cat.parcels)).alias("b"))
    return finding(p.where(B.outside_area("a", "b") > B.EPS_AREA), "a.id", "b.id", B.outside_area("a", "b"))


def property_outside_own(cat):
    p = cat.properties.alias("a").join(cat.parcels.alias("b"), F.col("a.parcel_id") == F.col("b.id"))
    return finding(p.where(B.outside_area("a", "b") > B.EPS_AREA), "a.id", "b.id", B.outside_area("a", "b"))


@rule("PARCEL-BUILDING-OUTSIDE", "PARCEL", "WARNING")
def building_outside(cat):
    p = cat.buildings.alias("a").join(cat.parcels.alias("b"), F.col("a.parcel_id") == F.col("b.id"))
    return finding(p.where(B.outside_area("a", "b") > B.EPS_AREA), "a.id", "b.id", B.outside_area("a", "b"))


@rule("PARCEL-UNASSIGNED-BUILDING", "PARCEL", "WARNING")
def unassigned_building(cat):
    return finding(first_containing(cat.buildings.where("coalesce(parcel_id, '') = ''"), cat.parcels, CELL), "inner_id", "outer_id")


@rule("PARCEL-UNASSIGNED-PROPERTY", "PARCEL", "WARNING")
def unassigned_property(cat):
    return finding(first_containing(cat.properties.where("coalesce(parcel_id, '') = ''"), cat.parcels, CELL), "inner_id", "outer_id")


# --- vertical ----------------------------------------------------------------------------------


def _overlaps(pairs: DataFrame, rings: bool = False) -> DataFrame:
    """Pairs that share volume; with rings, of those whose boxes do, by an overlay of the outlines themselves."""
    v = B.volume_overlap("a", "b")
    if rings:
        near = pairs.where(v > B.EPS_AREA).select(F.concat_ws("|", "a.id", "b.id").alias("key"), F.col("a.id").alias("ia"), F.col("b.id").alias("ib"), F.array("a.ring").alias("a"), F.array("b.ring").alias("b"), B.vertical_overlap("a", "b").alias("high"))
        plan = overlay_areas(near.select("key", "a", "b")).select("key", (F.col("intersection")).alias("plan"))
        v = F.col("plan") * F.col("high")
        return finding(near.select("key", "ia", "ib", "high").join(plan, "key").where(v > B.EPS_AREA), "ia", "ib", v)
    return finding(pairs.where(v > B.EPS_AREA), "a.id", "b.id", v)


def floor_overlap(cat):
    """Storeys of one building only."""
    a, b = cat.floors.alias("a"), cat.floors.alias("b")
    return _overlaps(a.join(b, (F.col("a.building_id") == F.col("b.building_id")) & (F.col("a.seq") < F.col("b.seq"))))


@rule("VERT-FLOOR-OVERLAP", "VERTICAL", "CRITICAL")
def floor_overlap_global(cat):
    """Any two storeys, of whatever buildings: the grid join."""
    cols = cat.floors.select("id", "seq", "x0", "y0", "x1", "y1", "z_min", "z_max")
    return _overlaps(grid_pairs(cols, cols, CELL, F.col("a.seq") < F.col("b.seq")))


def property_overlap(cat):
    """Keyed by block (the building's place) and storey, so cost is linear in the volumes."""
    a, b = cat.properties.alias("a"), cat.properties.alias("b")
    on = (F.col("a.block") == F.col("b.block")) & F.col("a.floor_number").eqNullSafe(F.col("b.floor_number")) & (F.col("a.seq") < F.col("b.seq"))
    return _overlaps(a.join(b, on & B.touches_box("a", "b")))


@rule("VERT-PROPERTY-OVERLAP", "VERTICAL", "CRITICAL")
def property_overlap_global(cat):
    """Any two volumes of one storey number (null equals null), wherever they are: the grid join."""
    rings = "ring" in cat.properties.columns
    cols = cat.properties.select("id", "seq", "floor_number", "x0", "y0", "x1", "y1", "z_min", "z_max", *(["ring"] if rings else []))
    return _overlaps(grid_pairs(cols, cols, CELL, F.col("a.seq") < F.col("b.seq"), ["floor_number"]), rings)


def _bands(cat, *by) -> DataFrame:
    return cat.properties.groupBy(*by, "floor_number").agg(F.min("z_min").alias("z_min"), F.max("z_max").alias("z_max"), *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))


def floor_gap(cat):
    """Within each building, over its own storeys."""
    w = Window.partitionBy("building_id").orderBy("z_min", "floor_number")
    f = cat.floors.withColumn("next_id", F.lead("id").over(w)).withColumn("gap", F.lead("z_min").over(w) - F.col("z_max"))
    return finding(f.where(F.col("gap") > B.EPS_GAP), "id", "next_id", "gap")


@rule("VERT-FLOOR-GAP", "VERTICAL", "WARNING")
def floor_gap_global(cat):
    """Bands by storey number over all buildings: as many rows as there are storey numbers."""
    w = Window.orderBy("z_min", "floor_number")
    f = _bands(cat).withColumn("next", F.lead("floor_number").over(w)).withColumn("gap", F.lead("z_min").over(w) - F.col("z_max"))
    return finding(f.where(F.col("gap") > B.EPS_GAP), "floor_number", "next", "gap")


def disconnected_stack(cat):
    """Within each block: neighbouring storeys of a block whose footprints, each the union of its units', share no area in plan."""
    w = Window.partitionBy("block").orderBy("z_min", "floor_number")
    f = cat.properties.groupBy("block", "floor_number").agg(F.min("z_min").alias("z_min"), F.collect_set(F.struct("x0", "y0", "x1", "y1")).alias("boxes"))
    f = f.withColumns({"next": F.lead("floor_number").over(w), "above": F.lead("boxes").over(w)}).where("next is not null")
    both = lambda x, y: F.greatest(F.lit(0.0), F.least(x["x1"], y["x1"]) - F.greatest(x["x0"], y["x0"])) * F.greatest(F.lit(0.0), F.least(x["y1"], y["y1"]) - F.greatest(x["y0"], y["y0"]))
    # one pair of units that lie over each other settles nearly every storey; only the others are measured
    f = f.where(~F.exists("boxes", lambda x: F.exists("above", lambda y: both(x, y) >= B.EPS_AREA))).withColumn("shared", shared_area(F.col("boxes"), F.col("above")))
    name = lambda c: F.concat(F.col("block").cast("string"), F.lit("/"), F.col(c).cast("string"))
    return finding(f.where(F.col("shared") < B.EPS_AREA), name("floor_number"), name("next"), "shared")


@rule("VERT-DISCONNECTED-STACK", "VERTICAL", "WARNING")
def disconnected_stack_global(cat):
    """Neighbouring bands over all buildings. A band's footprint, the union of its units, is dissolved cell by cell of the grid; the parts that two
    bands share are summed over the cells. A cell where one pair of units shares enough settles its bands, and only the others are measured."""
    w = Window.orderBy("z_min", "floor_number")
    bands = cat.properties.groupBy("floor_number").agg(F.min("z_min").alias("z_min")).withColumn("next", F.lead("floor_number").over(w)).where("next is not null").select("floor_number", "next")
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / CELL), F.floor(F.col(hi) / CELL)))
    cells = cat.properties.select("floor_number", "x0", "y0", "x1", "y1").distinct().withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
    cut = {c: (F.greatest if c[1] == "0" else F.least)(F.col(c), (F.col(f"c{c[0]}") + int(c[1])) * CELL).alias(c) for c in ("x0", "y0", "x1", "y1")}
    cells = cells.select("floor_number", "cx", "cy", *cut.values()).where("x1 > x0 and y1 > y0")
    cells = cells.groupBy("cx", "cy", "floor_number").agg(F.collect_set(F.struct("x0", "y0", "x1", "y1")).alias("boxes"))
    pairs = cells.join(F.broadcast(bands), "floor_number").join(cells.select("cx", "cy", F.col("floor_number").alias("next"), F.col("boxes").alias("above")), ["cx", "cy", "next"])  # as many bands as storey numbers
    both = lambda x, y: F.greatest(F.lit(0.0), F.least(x["x1"], y["x1"]) - F.greatest(x["x0"], y["x0"])) * F.greatest(F.lit(0.0), F.least(x["y1"], y["y1"]) - F.greatest(x["y0"], y["y0"]))
    pairs = pairs.withColumn("sure", F.exists("boxes", lambda x: F.exists("above", lambda y: both(x, y) >= B.EPS_AREA)))
    sure = pairs.where("sure").select("floor_number", "next").distinct()
    open_ = pairs.join(sure, ["floor_number", "next"], "left_anti").groupBy("floor_number", "next").agg(F.sum(shared_area(F.col("boxes"), F.col("above"))).alias("shared"))
    f = bands.join(sure, ["floor_number", "next"], "left_anti").join(open_, ["floor_number", "next"], "left").withColumn("shared", F.coalesce("shared", F.lit(0.0)))
    return finding(f.where(F.col("shared") < B.EPS_AREA), "floor_number", "next", "shared")


@rule("VERT-Z-ORDER", "VERTICAL", "CRITICAL")
def z_order(cat):
    return invalid_z_range(cat)


@rule("VERT-FLOOR-HEIGHT", "VERTICAL", "WARNING")
def floor_height_global(cat):
    """Storeys unlike the median of all storeys with a height; with less than three there is nothing to be unlike."""
    f = cat.floors.where("z_max > z_min")
    n, (mid,) = exact_quantiles(f, B.height(), [0.5])
    off = F.abs(B.height() - F.lit(mid)) / F.lit(mid)
    return finding(f.where(F.lit(n >= 3) & (off > B.HEIGHT_TOLERANCE)), "id", None, off)


def floor_height(cat):
    """Within each building."""
    h = cat.floors.groupBy("building_id").agg(F.expr("percentile(z_max - z_min, 0.5)").alias("mid"), F.count(F.lit(1)).alias("n")).where("n >= 3 and mid > 0")
    f = cat.floors.join(h, "building_id").withColumn("off", F.abs(B.height() - F.col("mid")) / F.col("mid"))
    return finding(f.where(F.col("off") > B.HEIGHT_TOLERANCE), "id", "building_id", "off")


# --- cadastre ----------------------------------------------------------------------------------


def _repeats(df: DataFrame, key: str) -> DataFrame:
    """Each later record of a key with the first one, by aggregation and join: no key is one task's."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("id", "seq").alias("first_id"), F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return finding(df.join(first, key).where("seq > first_seq"), "id", "first_id")


@rule("CAD-DUPLICATE-ULPIN", "CADASTRE", "CRITICAL")
def duplicate_ulpin(cat):
    return _repeats(cat.properties, "ulpin")


@rule("CAD-DUPLICATE-GEOMETRY", "CADASTRE", "WARNING")
def duplicate_geometry(cat):
    return _repeats(cat.properties.withColumn("geometry_hash", B.geometry_hash()), "geometry_hash")


@rule("CAD-MISSING-PARENT", "CADASTRE", "CRITICAL")
def missing_parent(cat):
    p = cat.properties.where("coalesce(parcel_id, '') <> ''")
    return finding(p.join(cat.parcels.select(F.col("id").alias("parcel_id")), "parcel_id", "left_anti"), "id", "parcel_id")


@rule("CAD-ORPHAN-PROPERTY", "CADASTRE", "CRITICAL")
def orphan_property(cat):
    p = cat.properties.where("coalesce(building_id, '') <> ''")
    return finding(p.join(cat.buildings.select(F.col("id").alias("building_id")), "building_id", "left_anti"), "id", "building_id")


@rule("CAD-INVALID-HIERARCHY", "CADASTRE", "WARNING")
def invalid_hierarchy(cat):
    f = cat.floors.select("building_id", "floor_number", F.col("id").alias("floor_id"), F.col("z_min").alias("f_min"), F.col("z_max").alias("f_max"))
    p = cat.properties.join(f, ["building_id", "floor_number"])
    off = F.greatest(F.abs(F.col("z_min") - F.col("f_min")), F.abs(F.col("z_max") - F.col("f_max")))
    return finding(p.where(off > B.EPS_GAP), "id", "floor_id", off)


# --- infrastructure ----------------------------------------------------------------------------


@rule("INFRA-UTILITY-COLLISION", "INFRASTRUCTURE", "CRITICAL")
def utility_collision(cat):
    """Against the first infrastructure record, whatever its kind (one row)."""
    return _overlaps(cat.properties.alias("a").crossJoin(F.broadcast(_first(cat.infrastructure)).alias("b")))


def infra_collisions(cat, *kinds: str) -> DataFrame:
    """Volumes that meet infrastructure of the kinds: object_b is the infrastructure."""
    i = cat.infrastructure.where(F.col("kind").isin(*kinds))
    cols = ["id", "seq", "x0", "y0", "x1", "y1", "z_min", "z_max"]
    return _overlaps(grid_pairs(cat.properties.select(*cols), i.select(*cols), CELL))


for _kind in ("TUNNEL", "BASEMENT", "FOUNDATION", "ELEVATED_STRUCTURE"):
    RULES[f"INFRA-{_kind}"] = Rule(f"INFRA-{_kind}", "INFRASTRUCTURE", "CRITICAL", lambda cat, k=_kind: infra_collisions(cat, k))

# --- change ------------------------------------------------------------------------------------


def _with_latest(cat) -> DataFrame:
    v = cat.versions.groupBy("object_id").agg(F.max_by(F.struct("version", "x0", "y0", "x1", "y1", "z_min", "z_max"), "version").alias("v"))
    return cat.properties.alias("a").join(v.select(F.col("object_id").alias("id"), "v.*").alias("b"), "id")


@rule("CHANGE-FOOTPRINT", "CHANGE", "INFO")
def change_footprint(cat):
    """The latest version's hash, which includes the band, differs from the record's."""
    return finding(_with_latest(cat).where(B.geometry_hash("a") != B.geometry_hash("b")), "id", None, "b.version")


@rule("CHANGE-HEIGHT", "CHANGE", "INFO")
def change_height(cat):
    d = B.height("a") - B.height("b")
    return finding(_with_latest(cat).where(F.col("b.z_min").isNotNull() & (F.abs(d) > 1e-6)), "id", None, d)


@rule("CHANGE-VOLUME", "CHANGE", "INFO")
def change_volume(cat):
    """With the current footprint on both sides."""
    d = B.area("a") * (B.height("a") - B.height("b"))
    return finding(_with_latest(cat).where(F.abs(d) > 1e-6), "id", None, d)


@rule("CHANGE-NEW-FLOOR", "CHANGE", "INFO")
def new_floor(cat):
    b = cat.buildings.select(F.col("id").alias("building_id"), "floor_count")
    return finding(cat.properties.join(b, "building_id").where("floor_number > floor_count"), "id", "building_id", "floor_number")


@rule("CHANGE-REMOVED-FLOOR", "CHANGE", "INFO")
def removed_floor(cat):
    n = cat.buildings.select(F.col("id").alias("building_id"), F.explode(F.sequence(F.lit(1), "floor_count")).alias("floor_number"))
    have = cat.properties.select("building_id", "floor_number").distinct()
    return finding(n.join(have, ["building_id", "floor_number"], "left_anti"), "building_id", None, "floor_number")


def _found(r: Rule, cat) -> DataFrame:
    return r.build(cat).select(F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.concat_ws("-", F.lit(r.rule_id), "object_a", "object_b").alias("issue_id"), "object_a", "object_b", "measure")


def run_rules(cat, *rule_ids: str) -> DataFrame:
    """Findings of the given rules (all by default) with their rule, category, severity and issue id."""
    out = None
    for r in [RULES[i] for i in rule_ids] if rule_ids else RULES.values():
        f = _found(r, cat)
        out = f if out is None else out.unionAll(f)
    return out


def summed_up(cat, total: Callable[[Rule, DataFrame], list[tuple]], schema: str, *rule_ids: str) -> DataFrame:
    """The rows, few, that ``total`` makes of each rule and its findings. Rules run one after another, and a rule's shuffle files go before the next one,
    so that the disk holds those of one rule at a time."""
    spark = cat.properties.sparkSession
    with swept(spark):
        rows = [tuple(x) for r in ([RULES[i] for i in rule_ids] if rule_ids else RULES.values()) for x in total(r, _found(r, cat))]
    return spark.createDataFrame(rows, schema)


def summary(findings: DataFrame) -> DataFrame:
    """Counts by severity, by category, by rule and in total: one pass over grouping sets."""
    g = findings.groupingSets([[F.col("severity")], [F.col("category")], [F.col("rule_id")], []], F.col("severity"), F.col("category"), F.col("rule_id"))
    return g.agg(F.count(F.lit(1)).alias("n"))
