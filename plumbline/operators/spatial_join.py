"""Grid-keyed spatial join: a theta join on boxes as an equi-join on cells, without a nested loop.

A grid level has cells of its own width and height, each a power of two of the first level's. A box lives on the level whose cells are no smaller
than it on either axis, so it covers four cells at most however large or long it is, and a long corridor meets only what lies along it. Two boxes meet
on the level that is the larger of theirs on each axis: every box is also keyed on those levels for the ones that the other side has, and a pair
counts only on the level where the two meet, in the cell of the lower left corner of its intersection, so no distinct (and no shuffle for one) is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import boxes as B

AXIS = 64  # a level is one number: that of the x axis times AXIS, and that of the y axis


def axes(level: Column) -> tuple[Column, Column]:
    return F.floor(level / AXIS).cast("int"), (level % AXIS).cast("int")


def meeting(a: Column, b: Column) -> Column:
    (ax, ay), (bx, by) = axes(a), axes(b)
    return (F.greatest(ax, bx) * AXIS + F.greatest(ay, by)).cast("int")


def level_of(cell: float, margin: float = 0.0) -> Column:
    """The least level whose cells are as large as the box (x0, y0, x1, y1) with a margin about it."""

    def one(axis: str) -> Column:
        size = F.col(f"{axis}1") - F.col(f"{axis}0") + 2 * margin
        return F.when(size > cell, F.ceil(F.log2(size / cell))).otherwise(F.lit(0)).cast("int")

    return (one("x") * AXIS + one("y")).cast("int")


def sides(cell: float, level: Column) -> tuple[Column, Column]:
    """Width and height of a level's cells."""
    x, y = (cell * F.pow(F.lit(2.0), k) for k in axes(level))
    return x, y


def levels_in(df: DataFrame, cell: float, margin: float = 0.0) -> Column:
    """The levels that occur, a few numbers, as a scalar subquery."""
    return df.select(F.collect_set(level_of(cell, margin))).scalar()


def keyed(df: DataFrame, cell: float, levels: Column, margin: float = 0.0) -> DataFrame:
    """df with its home level gl, and a row for each cell (gk, gx, gy) on that level and on those where it meets ``levels``."""
    df = df.withColumns({"gl": level_of(cell, margin), "gk": levels})
    df = df.withColumn("gk", F.explode(F.array_union(F.array("gl"), F.transform("gk", lambda v: meeting(F.col("gl"), v)))))
    w, h = sides(cell, F.col("gk"))
    at = lambda c, off, size: F.floor((F.col(c) + off) / size)
    return df.withColumn("gx", F.explode(F.sequence(at("x0", -margin, w), at("x1", margin, w)))).withColumn("gy", F.explode(F.sequence(at("y0", -margin, h), at("y1", margin, h))))


def grid_pairs(left: DataFrame, right: DataFrame, cell: float, also: Column | None = None, keys: list[str] = ()) -> DataFrame:
    """Pairs of rows whose boxes touch, with the sides aliased a and b. keys are equated null-safely;
    ``also`` is a further condition over a and b. A cell near the boxes' usual size keeps both the copies and
    the pairs for each cell small; a crowded cell is a skewed join key, which adaptive execution splits."""
    a, b = keyed(left, cell, levels_in(right, cell)).alias("a"), keyed(right, cell, levels_in(left, cell)).alias("b")
    on = (F.col("a.gk") == F.col("b.gk")) & (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy")) & (F.col("a.gk") == meeting(F.col("a.gl"), F.col("b.gl"))) & B.touches_box("a", "b")
    for k in keys:
        on &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    w, h = sides(cell, F.col("a.gk"))
    on &= (F.col("a.gx") == F.floor(F.greatest("a.x0", "b.x0") / w)) & (F.col("a.gy") == F.floor(F.greatest("a.y0", "b.y0") / h))
    return a.join(b, on if also is None else on & also)


def class_pairs(many: DataFrame, few: DataFrame, cls: Column) -> DataFrame:
    """All pairs of rows of a class, with the sides aliased a and b: by nature as many as the product of the two. The rows of a class of ``many`` are dealt by
    their id to as many shares as the session has shuffle partitions, and ``few`` is there in each share that its class has, so that one class is no task's alone.
    The copies meet their shares in a shuffle: their number is unknown to the planner, which would broadcast them by the size of ``few``."""
    n = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = ["id", "x0", "y0", "x1", "y1"]
    a = many.select(*cols, cls.alias("class_"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("share_")).alias("a")
    shares = a.select("class_", "share_").distinct()
    b = shares.join(few.select(*cols, cls.alias("class_")), "class_").hint("shuffle_hash").alias("b")
    return a.join(b, (F.col("a.class_") == F.col("b.class_")) & (F.col("a.share_") == F.col("b.share_")))


def first_containing(inner: DataFrame, outer: DataFrame, cell: float) -> DataFrame:
    """For each inner row the outer one with the least seq that contains it: (inner_id, outer_id)."""
    p = grid_pairs(inner, outer, cell, B.contains("b", "a"))
    return p.groupBy(F.col("a.id").alias("inner_id")).agg(F.min_by("b.id", "b.seq").alias("outer_id"))


def probe(df: DataFrame, box: tuple[float, float, float, float], relation: str) -> DataFrame:
    """Rows whose box stands in a relation to the probe: intersects, contains (the probe contains the row),
    within (the row contains the probe), overlaps (they share area, neither contains the other)."""
    x0, y0, x1, y1 = box
    c = F.col
    touch = (c("x0") <= x1) & (c("x1") >= x0) & (c("y0") <= y1) & (c("y1") >= y0)
    row_in = (c("x0") >= x0) & (c("x1") <= x1) & (c("y0") >= y0) & (c("y1") <= y1)
    probe_in = (c("x0") <= x0) & (c("x1") >= x1) & (c("y0") <= y0) & (c("y1") >= y1)
    inside = (c("x0") < x1) & (c("x1") > x0) & (c("y0") < y1) & (c("y1") > y0)
    return df.where({"intersects": touch, "contains": row_in, "within": probe_in, "overlaps": inside & ~row_in & ~probe_in}[relation])
