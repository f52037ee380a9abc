"""Property volumes: matching buildings to parcels, splitting storeys into units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import boxes as B
from plumbline.functions import identifiers as I

from .spatial_join import grid_pairs


def parcel_match(buildings: DataFrame, parcels: DataFrame, cell: float = 100.0) -> DataFrame:
    """(id, parcel_id, how): CONTAINED by the only parcel that holds it, else OVERLAPPING the only one that
    shares area, AMBIGUOUS with several, NONE."""
    cols = ["id", "seq", "x0", "y0", "x1", "y1"]
    p = grid_pairs(buildings.select(*cols), parcels.select(*cols), cell, B.plan_overlap("a", "b") > 0)
    held = B.contains("b", "a")
    g = p.groupBy(F.col("a.id").alias("id")).agg(F.count_if(held).alias("inside"), F.min(F.when(held, F.col("b.id"))).alias("holder"), F.count(F.lit(1)).alias("touching"), F.min("b.id").alias("other"))
    how = F.when(F.col("inside") == 1, "CONTAINED").when(F.col("inside") > 1, "AMBIGUOUS").when(F.col("touching") == 1, "OVERLAPPING").when(F.col("touching") > 1, "AMBIGUOUS").otherwise("NONE")
    out = buildings.select("id").join(g, "id", "left").withColumn("how", how)
    return out.select("id", F.when(F.col("how") == "CONTAINED", F.col("holder")).when(F.col("how") == "OVERLAPPING", F.col("other")).alias("parcel_id"), "how")


def split_by_walls(floors: DataFrame, walls: DataFrame, least: float = 2.0) -> DataFrame:
    """Units of each storey between its vertical walls (floor_id, x); faces under the least area join the
    storey undivided. Without walls the storey is one unit of scope FLOOR."""
    cuts = walls.groupBy("floor_id").agg(F.collect_set("x").alias("xs"))
    f = floors.join(cuts.withColumnRenamed("floor_id", "id"), "id", "left")
    inner = F.filter("xs", lambda x: (x > F.col("x0")) & (x < F.col("x1")))
    at = F.array_sort(F.concat(F.array("x0"), inner, F.array("x1")))
    # a generator between two steps, so that each is computed once a row; storeys without walls need none of them
    f = f.withColumn("at", F.explode(F.array(F.when(F.col("xs").isNotNull(), at))))
    faces = F.zip_with(F.slice("at", 1, F.size("at") - 1), F.slice("at", 2, F.size("at") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    good = F.filter(faces, lambda s: (s["b"] - s["a"]) * (F.col("y1") - F.col("y0")) >= least)
    f = f.withColumn("good", F.explode(F.array(F.when(F.col("at").isNotNull(), good))))
    divided = F.coalesce(F.size("good") > 1, F.lit(False))
    use = F.when(divided, F.col("good")).otherwise(F.array(F.struct(F.col("x0").alias("a"), F.col("x1").alias("b"))))
    u = f.withColumn("scope", F.when(divided, "UNIT").otherwise("FLOOR")).select("*", F.posexplode(use).alias("k", "s"))
    out = u.withColumns({"x0": F.col("s.a"), "x1": F.col("s.b")})
    key = I.volume_key(F.col("building_id"), F.col("floor_number"), F.when(F.col("scope") == "UNIT", F.concat(F.lit("U"), (F.col("k") + 1).cast("string"))))
    return out.select(key.alias("key"), F.col("id").alias("floor_id"), "scope", "x0", "y0", "x1", "y1", "z_min", "z_max", B.area().alias("area_m2"), B.measured_volume().alias("volume_m3")).where("volume_m3 > 0")


def split_by_polygons(floors: DataFrame, units: DataFrame, least: float = 2.0) -> DataFrame:
    """Units (floor_id, label and box) clipped to their storey; those left with less than the least area go."""
    j = units.alias("u").join(floors.alias("f"), F.col("u.floor_id") == F.col("f.id"))
    c = {k: (F.greatest if k.endswith("0") else F.least)(f"u.{k}", f"f.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")}
    moved = F.lit(False)
    for k in c:
        moved |= F.col(f"u.{k}") != c[k]
    out = j.select(I.volume_key(F.col("f.building_id"), F.col("f.floor_number"), F.col("u.label")).alias("key"), "u.floor_id", *c.values(), "f.z_min", "f.z_max", moved.alias("clipped"))
    return out.where("x1 > x0 and y1 > y0").where(B.area() >= least).withColumn("volume_m3", B.measured_volume()).where("volume_m3 > 0")
