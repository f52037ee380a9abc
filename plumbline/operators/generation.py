"""Property volumes of extracted buildings: storeys divided by their plans, labelled, identified, matched to parcels, and
the rows that a run leaves in the volume, link, job and audit collections.

Unit outlines come before walls, walls before none. A storey without either, or whose walls part nothing, is one volume
of scope FLOOR; no boundary is made up. Reasons and notes are codes; their order is that of the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import boxes as B
from plumbline.functions import identifiers as I

from . import arrangement as A
from .spatial_join import grid_pairs

LEAST_UNIT, AREA_TOLERANCE = 2.0, 0.02
UNASSIGNED, MAPPED, REVIEW = "UNASSIGNED", "MAPPED", "HUMAN REVIEW REQUIRED"
METHOD = "derived_geometric"


def parent_parcels(buildings: DataFrame, parcels: DataFrame, cell: float = 100.0) -> DataFrame:
    """id, parcel_id, match, reason: the parcel that holds a building, the first of several by seq, else the only one that shares area with it."""
    cols = ["id", "seq", "x0", "y0", "x1", "y1"]
    p = grid_pairs(buildings.select(*cols), parcels.select(*cols), cell, B.plan_overlap("a", "b") > 0)
    held = B.outside_area("a", "b") <= F.greatest(F.lit(1e-9), B.area("a") * 1e-9)
    g = p.groupBy(F.col("a.id").alias("id")).agg(F.count_if(held).alias("inside"), F.min_by("b.id", F.when(held, F.col("b.seq"))).alias("holder"), F.count(F.lit(1)).alias("touching"), F.min("b.id").alias("other"))
    out = buildings.select("id").join(g, "id", "left")
    one, many, some = F.col("inside") == 1, F.col("inside") > 1, F.coalesce("touching", F.lit(0))
    return out.select(
        "id", F.when(one | many, F.col("holder")).when(some == 1, F.col("other")).alias("parcel_id"), F.when(one, "contained").when(many | (some > 1), "ambiguous").when(some == 1, "overlapping").otherwise("none").alias("match"),
        F.when(one, None).when(many | (some > 1), "MULTIPLE_PARCELS").when(some == 1, "PARTIAL_OVERLAP").otherwise("NO_PARCEL_MATCH").alias("reason"),
    )


def regions(floors: DataFrame, *carried: str, least: float = LEAST_UNIT, shapes: bool = True) -> DataFrame:
    """floor_id, k (from 1), shape (if wanted), area, scope, reasons (of the split) and the carried columns: floors (id, plate as a shape, walls, units) divided.
    units and walls may be null. All of a storey is in its row, so nothing is shuffled, and its plan goes to a worker once."""
    f = floors.select("id", *carried, "plate", F.size(F.coalesce("walls", F.array())).alias("walls"), A.shape_units(F.col("plate"), F.col("walls"), F.col("units"), least, shapes=shapes).alias("r"))
    f = f.select("id", *carried, *(["plate"] if shapes else []), "walls", "r.*").where("plate_area > 0")
    # outlines, clipped to the plate; walls, where no outline is left
    f = f.withColumn("kept", F.filter("clips", lambda c: c["area"] >= least))
    part = lambda x: F.struct(*([x["shape"].alias("shape")] if shapes else []), x["area"].alias("area"))
    split = F.when(F.size("faces") > 1, F.filter("faces", lambda x: x["area"] >= least))
    f = f.withColumn("parts", F.when(F.size("kept") > 0, F.transform("kept", part)).otherwise(split)).withColumn("parts", F.when(F.size("parts") > 0, F.col("parts")))
    said = F.array_compact(F.transform("clips", lambda c: F.when(F.coalesce(c["area"], F.lit(0.0)) < least, "UNIT_OUTSIDE_FLOOR").when(c["area"] < c["own"] - least, "UNIT_CLIPPED")))
    divided = F.col("parts").isNotNull()
    off = F.abs(F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["area"]) - F.col("plate_area")) / F.col("plate_area") > AREA_TOLERANCE
    idle = ~divided & (F.col("walls") > 0) & (F.size("faces") <= 1)
    reasons = F.concat(said, F.array_compact(F.array(F.when(idle, "WALLS_PRODUCED_NO_DIVISION"), F.when(divided & off, "AREA_MISMATCH"))))
    one = F.array(F.struct(*([F.col("plate").alias("shape")] if shapes else []), F.col("plate_area").alias("area")))
    out = f.select(F.col("id").alias("floor_id"), *carried, F.when(divided, "UNIT").otherwise("FLOOR").alias("scope"), reasons.alias("reasons"), F.posexplode(F.coalesce("parts", one)).alias("k", "p"))
    return out.select("floor_id", *carried, (F.col("k") + 1).alias("k"), "p.*", "scope", "reasons")


def assign_building(building: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(building, F.lit("")), F.nullif(fallback, F.lit("")), F.lit(UNASSIGNED))


def assign_floor(number: Column, fallback: Column | None = None) -> Column:
    """The storey's number, else the fallback, else the ground storey."""
    return F.coalesce(number, *([] if fallback is None else [fallback]), F.lit(1)).cast("int")


def generate(buildings: DataFrame, floors: DataFrame, parcels: DataFrame, datum: float | None = None, shapes: bool = True) -> DataFrame:
    """Volumes. buildings: id, ref (see ``identifiers.building_ref``), source_id, seq, x0..y1. floors: id, building_id, floor_number, z_min, z_max, plate, walls,
    units, labels (of the plan, may be null). Storeys without plan area, height or a building give none. A caller that needs neither shape nor geometry_hash
    spares the workers to send the outlines (``shapes=False``)."""
    b = buildings.select(F.col("id").alias("building_id"), "ref", "source_id").join(parent_parcels(buildings, parcels).withColumnRenamed("id", "building_id"), "building_id")
    b = b.withColumn("parent_slug", I.slug(F.coalesce("parcel_id", F.lit(UNASSIGNED))))
    f = floors.where("z_max > z_min").withColumn("floor_number", assign_floor(F.col("floor_number"))).join(b, "building_id")
    f = f.withColumn("floor_slug", I.slug(I.volume_key(F.col("ref"), F.col("floor_number"), F.lit(None).cast("string"))))
    v = regions(f, "building_id", "floor_number", "z_min", "z_max", "labels", "ref", "source_id", "parcel_id", "match", "reason", "parent_slug", "floor_slug", shapes=shapes)
    planned = F.get("labels", F.col("k") - 1)
    unit = F.col("scope") == "UNIT"
    label = F.coalesce(planned, F.when(unit, F.concat(F.lit("U"), I.two_digits(F.col("k")))))
    v = v.withColumns({"label": label, "label_source": F.when(planned.isNotNull(), "floor_plan").otherwise("synthesised"), "vertical_position": I.vertical_position(F.col("z_min"), F.col("z_max"), F.lit(datum).cast("double"))})
    v = v.withColumn("unit_label", F.when(F.col("label").isNotNull(), I.unit_label(F.col("ref"), F.col("floor_number"), F.col("label"))))
    key = I.volume_key(F.col("ref"), F.col("floor_number"), F.col("unit_label"))
    reasons = F.concat(F.array_compact(F.array("reason")), "reasons", F.array_compact(F.array(F.when(F.col("vertical_position") == "UNDETERMINED", "DATUM_UNKNOWN"))))
    kind = F.when(F.col("vertical_position") == "UNDERGROUND", "BASEMENT").when(unit, "UNIT").otherwise("FLOOR")
    h = F.col("z_max") - F.col("z_min")
    mm = F.array_join(F.flatten(F.transform("shape", lambda q: F.transform(q, lambda p: F.concat_ws(",", F.round(p["x"] * 1000).cast("long").cast("string"), F.round(p["y"] * 1000).cast("long").cast("string"))))), ",")
    out = v.withColumns({"key": key, "review_reasons": reasons, "parent": F.coalesce("parcel_id", F.lit(UNASSIGNED))})
    # the key's slug from those of its parts: a building's, a storey's and a plan's labels are many volumes'
    synthesised = F.coalesce(F.when(planned.isNotNull(), I.slug(planned)), F.col("label"))
    out = out.withColumn("slug", F.concat("floor_slug", F.when(F.col("label").isNotNull(), F.concat("floor_slug", synthesised)).otherwise("")))
    drawn = ["shape", F.upper(F.substring(F.sha2(F.concat_ws(",", mm, F.round(F.col("z_min") * 1000).cast("long").cast("string"), F.round(F.col("z_max") * 1000).cast("long").cast("string")), 256), 1, 12)).alias("geometry_hash")] if shapes else []
    return out.select(
        F.concat(F.lit("GPV-"), "slug").alias("id"), "key", I.ulpin("VP", F.col("parent_slug"), F.col("slug"), slugged=True).alias("ulpin"), F.col("parent").alias("parent_parcel_id"), F.col("match").alias("parcel_match"), assign_building(F.col("building_id"), F.lit("")).alias("building_id"),
        "source_id", "floor_id", "floor_number", I.floor_label(F.col("floor_number")).alias("floor_label"), "unit_label", "label_source", F.col("scope").alias("volume_scope"), kind.alias("property_type"), "vertical_position", F.round("z_min", 3).alias("z_min"), F.round("z_max", 3).alias("z_max"),
        *drawn[:1], F.round("area", 2).alias("area_m2"), F.round(F.col("area") * h, 2).alias("volume_m3"), *drawn[1:],
        F.when(F.size("review_reasons") > 0, REVIEW).otherwise(MAPPED).alias("status"), (F.size("review_reasons") > 0).alias("requires_human_review"), "review_reasons", F.lit(METHOD).alias("method"),
    )


def per_building(volumes: DataFrame) -> DataFrame:
    """What a run reports of each building."""
    floor_only = F.when(F.col("volume_scope") == "FLOOR", F.concat(F.lit("F"), I.two_digits(F.col("floor_number"))))
    return volumes.groupBy("building_id").agg(
        F.first("parent_parcel_id").alias("parent_parcel_id"), F.first("parcel_match").alias("parcel_match"), F.count_distinct("floor_id").alias("floors"), F.count(F.lit(1)).alias("volumes"), F.count_if(F.col("volume_scope") == "UNIT").alias("units"),
        F.array_sort(F.collect_set(floor_only)).alias("floors_without_unit_data"), F.round(F.sum("area_m2"), 2).alias("total_area_m2"), F.round(F.sum("volume_m3"), 2).alias("total_volume_m3"), F.bool_or("requires_human_review").alias("requires_human_review"),
    )


def rows_of_run(volumes: DataFrame, stored: DataFrame | None, job_id: str, at: Column, actor: str | None = None) -> dict[str, DataFrame]:
    """What a run leaves: all volumes after it (those stored before give way to new ones of their key), links of volumes and identifiers, a
    job and an audit event a source. Ids derive from the rows and the job, so that the same run gives the same rows. volumes should be written already."""
    v = volumes.withColumn("job_id", F.lit(job_id))
    kept = v if stored is None else stored.join(v.select("key"), "key", "left_anti").unionByName(v, allowMissingColumns=True)
    link = lambda obj, parent, stage, above: v.where(F.col(obj).isNotNull()).select(F.col(obj).alias("object_id"), F.col(parent).alias("parent_id"), F.lit(stage).alias("stage"), F.lit(above).alias("parent_stage"), "source_id", "job_id", F.lit("ALGORITHM").alias("method"))
    links = link("id", "floor_id", "PROPERTY_VOLUME", "FLOOR").unionByName(link("ulpin", "id", "ULPIN", "PROPERTY_VOLUME"))
    n = v.groupBy("source_id").agg(F.count(F.lit(1)).alias("volumes"), F.count_if(F.col("volume_scope") == "UNIT").alias("units"), F.count_distinct("building_id").alias("buildings"), F.bool_or("requires_human_review").alias("requires_human_review"))
    done = F.to_json(F.struct("volumes", "units", "buildings", "requires_human_review", F.lit(METHOD).alias("method"), F.lit(False).alias("units_inferred")))
    jobs = n.select(F.concat_ws("/", F.lit(job_id), "source_id").alias("id"), "source_id", F.lit("PROPERTY_VOLUME_GENERATION").alias("job_type"), F.lit("COMPLETED").alias("status"), at.alias("created_at"), done.alias("metadata"))
    audit = n.select(I.event_id("AE", at, F.lit(job_id), F.col("source_id")).alias("id"), at.alias("ts"), F.lit("PROCESSED").alias("action"), F.lit(actor).cast("string").alias("actor"), F.col("source_id").alias("object_id"), done.alias("detail"))
    return {"volumes": kept, "links": links, "jobs": jobs, "audit": audit}


class NothingToGenerate(ValueError):
    pass


def ready(sources: DataFrame, buildings: DataFrame, floors: DataFrame, source_id: str) -> None:
    """Refuses a source that isn't there, declares no CRS, or has no extracted building or storey."""
    source = sources.where(F.col("id") == source_id).select("crs").head(1)
    if not source:
        raise NothingToGenerate(f"no source {source_id}")
    if source[0].crs in (None, "", "UNKNOWN"):
        raise NothingToGenerate(f"source {source_id} declares no CRS")
    own = buildings.where(F.col("source_id") == source_id)
    if own.isEmpty():
        raise NothingToGenerate(f"source {source_id} has no extracted building")
    if floors.join(own.select(F.col("id").alias("building_id")), "building_id", "left_semi").isEmpty():
        raise NothingToGenerate(f"source {source_id} has no storeys")
