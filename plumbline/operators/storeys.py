"""Storey levels to storeys: datum, snapping, thin levels, points by storey, scores, and what a person should check.

Levels are arrays of STRUCT<z, snapped, evidence>, the base first. All of it is column arithmetic over one row a
building or storey; points meet their building's levels by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares and bounds of the storey checks.
SNAP_SHARE, SPARSE, DENSE, FEW_POINTS, MIN_COVERAGE, DENSITY_TARGET, TOP_TOLERANCE = 0.45, 0.25, 4.0, 20, 0.15, 8.0, 0.25


def base_datum(points: DataFrame, boxes: DataFrame, reach: float = 2.0, low: float = 0.02) -> DataFrame:
    """(building, base_z): a low percentile of z near the footprint's centre (the median place without one), else of all."""
    mid = points.groupBy("building").agg(F.expr("percentile(x, 0.5)").alias("mx"), F.expr("percentile(y, 0.5)").alias("my"))
    at = mid.join(boxes.select(F.col("id").alias("building"), ((F.col("x0") + F.col("x1")) / 2).alias("bx"), ((F.col("y0") + F.col("y1")) / 2).alias("by")), "building", "left")
    p = points.join(at, "building")
    near = (F.abs(F.col("x") - F.coalesce("bx", "mx")) <= reach) & (F.abs(F.col("y") - F.coalesce("by", "my")) <= reach)
    return p.withColumn("near_z", F.when(near, F.col("z"))).groupBy("building").agg(F.coalesce(F.expr(f"percentile(near_z, {low})"), F.expr(f"percentile(z, {low})")).alias("base_z"))


def snap(expected: Column, peaks: Column, tolerance: Column) -> Column:
    """STRUCT<z, evidence> of the peak (STRUCT of the same) nearest to the expected height within the tolerance, the later of
    equally near ones; null if there is none."""
    start = F.struct(tolerance.cast("double").alias("off"), F.lit(None).cast("double").alias("z"), F.lit(0.0).alias("evidence"))
    step = lambda best, p: F.when(F.abs(p["z"] - expected) <= best["off"], F.struct(F.abs(p["z"] - expected).alias("off"), p["z"].alias("z"), p["evidence"].alias("evidence"))).otherwise(best)
    got = F.aggregate(peaks, start, step)
    return F.when(got["z"].isNotNull(), F.struct(got["z"].alias("z"), got["evidence"].alias("evidence")))


def without_thin(levels: Column, minimum: Column) -> Column:
    """Levels less than the minimum above the last kept one go, except next to the base."""
    first = F.slice(levels, 1, 1)

    def step(kept: Column, x: Column) -> Column:
        thin = (x["z"] - F.element_at(kept, -1)["z"] < minimum) & (F.size(kept) > 1)
        return F.when(thin, kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(F.slice(levels, 2, F.greatest(F.size(levels) - 1, F.lit(0))), first, step)


def storey_of(height: Column, levels: Column) -> Column:
    """The storey (from 1) of a height: the boundaries are the middles between neighbouring levels, a point on one belongs below;
    null without storeys."""
    z = F.transform(levels, lambda x: x["z"])
    n = F.size(levels) - 1
    middles = F.zip_with(F.slice(z, 1, F.greatest(n, F.lit(0))), F.slice(z, 2, F.greatest(n, F.lit(0))), lambda a, b: (a + b) / 2)
    below = F.size(F.filter(middles, lambda b: b < height))
    return F.when(n > 0, F.least(below, n - 1) + 1).cast("int")


def assigned(points: DataFrame, levels: DataFrame) -> DataFrame:
    """Points (building, height, ...) with their storey. levels: building, levels."""
    return points.join(levels.select("building", "levels"), "building").withColumn("storey", storey_of(F.col("height"), F.col("levels"))).drop("levels").where("storey is not null")


def records(points: DataFrame, levels: DataFrame, boxes: DataFrame, cell: float = 1.0) -> DataFrame:
    """One row for each storey: band, area, volume, four scores and their mean. points: building, storey, x, y; levels: building,
    levels, storey_height; boxes: id and footprint."""
    seen = points.groupBy("building", "storey").agg(F.count(F.lit(1)).alias("points"), F.count_distinct(F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)).alias("cells"))
    each = levels.select("building", "levels", "storey_height", F.explode(F.sequence(F.lit(1), F.size("levels") - 1)).alias("storey")).where("size(levels) > 1")
    lo, hi = F.element_at("levels", F.col("storey")), F.element_at("levels", F.col("storey") + 1)
    out = each.select("building", "storey", "storey_height", lo.alias("lower"), hi.alias("upper")).join(seen, ["building", "storey"], "left").na.fill(0, ["points", "cells"])
    out = out.join(boxes.select(F.col("id").alias("building"), "x0", "y0", "x1", "y1"), "building")
    out = out.withColumns({"z_min": F.round("lower.z", 3), "z_max": F.round("upper.z", 3), "area_m2": (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))}).where("z_max > z_min and area_m2 > 0")
    height = F.col("upper.z") - F.col("lower.z")
    share = F.least(F.lit(1.0), F.col("cells") * cell * cell / F.col("area_m2"))
    out = out.withColumns({"height": height, "coverage": F.round(share, 4), "volume_m3": F.round(F.col("area_m2") * height, 2)})
    scores = {
        "density": F.least(F.lit(1.0), F.col("points") / F.col("area_m2") / DENSITY_TARGET),
        "plan": F.least(F.lit(1.0), F.col("coverage") / 0.6),
        "height_agreement": F.when(F.col("storey_height") > 0, 1 / (1 + F.abs(F.col("height") - F.col("storey_height")) / F.greatest("storey_height", F.lit(1e-6)))).otherwise(0.0),
        "boundary_evidence": (F.col("lower.evidence") + F.col("upper.evidence")) / 2,
    }
    out = out.withColumns({k: F.round(v, 4) for k, v in scores.items()})
    return out.withColumn("quality", F.round(sum((F.col(k) for k in scores), F.lit(0.0)) / len(scores), 4))


def top_ambiguous(levels: Column, storey_height: Column) -> Column:
    """Whether the top level may be a roof: it has no peak, its storey is off by over a quarter, or there is only one storey."""
    top, below = F.element_at(levels, -1), F.element_at(levels, -2)
    off = F.abs(top["z"] - below["z"] - storey_height) / storey_height > TOP_TOLERANCE
    return F.when(F.size(levels) < 3, True).otherwise(~top["snapped"] | ((storey_height > 0) & off))


def _said(*reasons: tuple[Column, Column | str]) -> Column:
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.filter(F.array(*(F.when(c, text(t)) for c, t in reasons)), lambda x: x.isNotNull())


def _numbers(at: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(at, lambda i: i.cast("string")), ", "), F.lit("]"))


def building_reasons(df: DataFrame) -> DataFrame:
    """df with ``reasons``. df: levels, storey_height, supplied, level_warnings (array), irregular (array of texts), counts
    (points of each storey, in order)."""
    n = F.size("levels") - 1
    bare = F.filter(F.transform("levels", lambda x, i: F.when(~x["snapped"] & (i > 0), i)), lambda i: i.isNotNull())
    ranked = F.array_sort("counts")
    m = F.size("counts")
    mid = (F.element_at(ranked, F.floor((m + 1) / 2).cast("int")) + F.element_at(ranked, F.floor((m + 2) / 2).cast("int"))) / 2
    mid = F.when(m > 0, mid).otherwise(0.0)
    which = lambda test: F.filter(F.transform("counts", lambda c, i: F.when(test(c), i + 1)), lambda i: i.isNotNull())
    sparse, dense, few = which(lambda c: (mid > 0) & (c < mid * SPARSE)), which(lambda c: (mid > 0) & (c > mid * DENSE)), which(lambda c: c < FEW_POINTS)
    reasons = F.concat(
        _said((F.col("supplied"), "LEVELS_SUPPLIED: levels were given, not detected")),
        F.transform("level_warnings", lambda w: F.concat(F.lit("LEVEL_WARNING: "), w)),
        _said((F.size(bare) > 0, F.concat(F.lit("NO_LEVEL_EVIDENCE: levels "), _numbers(bare), F.lit(" have no peak")))),
        F.transform("irregular", lambda w: F.concat(F.lit("IRREGULAR_SPACING: "), w)),
        _said(
            (top_ambiguous(F.col("levels"), F.col("storey_height")), "TOP_LEVEL_AMBIGUOUS: the top level may be a roof"),
            (F.size(sparse) > 0, F.concat(F.lit("SPARSE_FLOOR: storeys "), _numbers(sparse))),
            (F.size(dense) > 0, F.concat(F.lit("DENSE_OUTLIER: storeys "), _numbers(dense))),
            (F.size(few) > 0, F.concat(F.lit("TOO_FEW_POINTS: storeys "), _numbers(few))),
        ),
    )
    return df.withColumn("reasons", F.when(n <= 0, F.array(F.lit("NO_FLOORS_DETECTED: no storey could be resolved"))).otherwise(reasons))


def storey_reasons(df: DataFrame) -> DataFrame:
    """df with ``reasons``. df: storey, height, storey_height, coverage, points, lower and upper level."""
    off = F.abs(F.col("height") - F.col("storey_height")) / F.col("storey_height")
    low, up = (F.col("storey") > 1) & ~F.col("lower.snapped"), ~F.col("upper.snapped")
    return df.withColumn("reasons", _said(
        ((F.col("storey_height") > 0) & (off > 0.15), F.concat(F.lit("IRREGULAR_SPACING: "), F.format_number("height", 2), F.lit(" m"))),
        (F.col("coverage") < MIN_COVERAGE, F.concat(F.lit("SPARSE_PLAN_COVERAGE: "), F.format_number(F.col("coverage") * 100, 0), F.lit(" %"))),
        (F.col("points") < FEW_POINTS, F.concat(F.lit("TOO_FEW_POINTS: "), F.col("points").cast("string"))),
        (low | up, F.concat(F.lit("UNSUPPORTED_BOUNDARY: the "), F.when(low, "lower").otherwise("upper"), F.lit(" level has no peak"))),
    ))


def segmented(points: DataFrame, boxes: DataFrame, levels: DataFrame) -> DataFrame:
    """From points (x, y, height) and buildings (boxes with id) to storeys with their reasons: the points in each box, their
    storeys by the building's levels, records and checks."""
    from .lookups import points_in

    own = points_in(points, boxes).withColumnRenamed("box_id", "building")
    return storey_reasons(records(assigned(own, levels), levels, boxes)).withColumn("requires_review", F.size("reasons") > 0)
