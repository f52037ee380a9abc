"""Survey against approved record: five kinds of change, their report, and version history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import boxes as B

COLUMNS = ["id", "building_id", "floor_number", "x0", "y0", "x1", "y1", "z_min", "z_max"]


def indexed(side: DataFrame) -> DataFrame:
    """One record an id: the last duplicate (by seq) wins, in the place of the first."""
    return side.groupBy("id").agg(F.max_by(F.struct(*COLUMNS[1:]), "seq").alias("r"), F.min("seq").alias("seq")).select("id", "seq", "r.*")


def compare(approved: DataFrame, survey: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(object_id, change_type, delta): FOOTPRINT, HEIGHT and VOLUME of objects on both sides, NEW_FLOOR and
    REMOVED_FLOOR of storeys (building, floor; a null building equals a null one) on one side only, told by their first record."""
    # both sides in one grouping by id, whose rows serve objects and storeys alike; an id without a record on a side has a null there
    tagged = approved.select("id", "seq", *COLUMNS[1:], F.lit(0).alias("side")).unionByName(survey.select("id", "seq", *COLUMNS[1:], F.lit(1).alias("side")))
    last = lambda k: F.max_by(F.struct(*COLUMNS[1:]), F.when(F.col("side") == k, F.col("seq"))).alias("ab"[k])
    first = lambda k: F.min(F.when(F.col("side") == k, F.col("seq"))).alias(f"{'ab'[k]}_seq")
    each_id = tagged.groupBy("id").agg(last(0), last(1), F.struct(first(0), first(1)).alias("seqs"))
    both = each_id.where("id is not null and seqs.a_seq is not null and seqs.b_seq is not null")
    sym = B.area("a") + B.area("b") - 2 * B.plan_overlap("a", "b")
    kinds = [
        ("FOOTPRINT", sym, (sym > tolerance) | (F.abs(B.area("b") - B.area("a")) > tolerance)),
        ("HEIGHT", B.height("b") - B.height("a"), F.abs(B.height("b") - B.height("a")) > tolerance),
        ("VOLUME", B.volume("b") - B.volume("a"), F.abs(B.volume("b") - B.volume("a")) > tolerance),
    ]
    # one pass over the join for all three kinds
    each = F.filter(F.array(*(F.when(c, F.struct(F.lit(k).alias("change_type"), d.alias("delta"))) for k, d, c in kinds)), lambda x: x.isNotNull())
    pairs = both.select(F.col("id").alias("object_id"), F.inline(each))
    told = lambda k: F.when(F.col(f"seqs.{k}_seq").isNotNull() & F.col(f"{k}.floor_number").isNotNull(), F.struct(F.lit(k).alias("side"), F.col(f"{k}.building_id").alias("building_id"), F.col(f"{k}.floor_number").alias("floor_number"), F.col(f"seqs.{k}_seq").alias("seq")))
    here = each_id.select("id", F.inline(F.array_compact(F.array(told("a"), told("b")))))
    least = lambda k: F.min(F.when(F.col("side") == k, F.struct("seq", "id"))).alias(k)
    storeys = here.groupBy("building_id", "floor_number").agg(least("a"), least("b")).where("a is null or b is null")
    new = F.col("a").isNull()
    one = storeys.select(F.coalesce("a.id", "b.id").alias("object_id"), F.when(new, "NEW_FLOOR").otherwise("REMOVED_FLOOR").alias("change_type"), F.lit(0.0).alias("delta"))
    return pairs.unionAll(one)


def agreement(a, b):
    """1 - |difference| / larger, not below 0; 1 if both are 0."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / top))


def plan_agreement(a: str = "a", b: str = "b"):
    """Intersection over union of the footprints; 1 if the union is empty."""
    i = B.plan_overlap(a, b)
    u = B.area(a) + B.area(b) - i
    return F.when(u == 0, 1.0).otherwise(i / u)


def report(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("object_id").alias("objects"), F.max(F.abs("delta")).alias("largest"))


# --- versions ----------------------------------------------------------------------------------


def latest(versions: DataFrame) -> DataFrame:
    rest = [c for c in versions.columns if c not in ("object_id", "version")]
    return versions.groupBy("object_id").agg(F.max("version").alias("version"), F.max_by(F.struct(*rest), "version").alias("r")).select("object_id", "version", "r.*")


def history(versions: DataFrame) -> DataFrame:
    """Each version with its change from the one before, and what an audit calls it."""
    w = Window.partitionBy("object_id").orderBy("version")
    v = versions.withColumn("hash", B.geometry_hash())
    was = F.lag("hash").over(w)
    kind = F.when(was.isNull(), "CREATED").when(was != F.col("hash"), "GEOMETRY_CHANGED").otherwise("UPDATED")
    d = lambda c: c - F.lag(c).over(w)
    return v.select("object_id", "version", kind.alias("kind"), d(F.col("z_max")).alias("d_top"), d(B.area()).alias("d_area"), d(B.volume()).alias("d_volume"))


def append_version(versions: DataFrame, edits: DataFrame) -> DataFrame:
    """versions and, for each edit (a box and band by object_id), the next number; inverted bands are refused."""
    top = versions.groupBy("object_id").agg(F.max("version").alias("top"))
    new = edits.where("z_min < z_max").join(top, "object_id", "left").withColumn("version", F.coalesce(F.col("top"), F.lit(0)) + 1).drop("top")
    return versions.unionByName(new, allowMissingColumns=True)
