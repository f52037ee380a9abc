"""Planar arrangements of line segments, many at once: overlay of polygons, and plates divided by walls.

A *shape* is an array of closed rings read by the even-odd rule, so holes and several parts need no order and no
direction. Each row (a pair of polygons, a storey) has an arrangement of its own, so all is a column of the row and nothing
is shuffled: ``planar.py`` builds the arrangements of an Arrow batch together.

1. The shapes' edges are taken relative to a corner of the row's bounds, so that nothing is lost in large coordinates.
2. Edges of a row that meet cut each other, ends on the other's inside included, and equal pieces fold into one that counts
   how often each side runs along it.
3. For each piece, whether its left and its right lie in shape a and in shape b, by the pieces that a ray crosses.
4. Areas are sums over the pieces that bound a result; rings and faces come from tracing half-edges.

A row's edges meet each other in pairs, so a row is meant to be one polygon or storey, not a map.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rings as R

from . import planar
from .planar import OPS

SHAPE = f"array<{R.RING}>"
PART = f"struct<shape:{SHAPE},area:double>"
_AREAS = "struct<" + ",".join(f"{c}:double" for c in ("area_a", "area_b", *OPS)) + ">"

# UDFs are made when they are called, since workers import this module without a session. They count as not deterministic, so that a
# filter on a result doesn't compute it a second time.


def shape_of(ring: Column) -> Column:
    return F.array(ring)


def shape_areas(a: Column, b: Column, digits: int = 6) -> Column:
    """area_a, area_b, intersection, union, difference, symmetric of two shapes; null if neither has an edge."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return planar.areas(a, b, digits)

    return F.arrow_udf(run, _AREAS).asNondeterministic()(a, b)


def shape_result(a: Column, b: Column, op: str, digits: int = 6) -> Column:
    """shape and area of an operation of ``OPS``; null if the result is empty."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return planar.results(a, b, op, digits)

    return F.arrow_udf(run, PART).asNondeterministic()(a, b)


def shape_faces(plate: Column, walls: Column, grid: int = 3, tolerance: float = 0.05, shapes: bool = True) -> Column:
    """The faces of a plate between its walls: an array of shape and area, or of areas alone."""

    def run(plate: pa.Array, walls: pa.Array) -> pa.Array:
        return planar.divided(plate, walls, grid, tolerance, 6, shapes)

    return F.arrow_udf(run, f"array<{PART if shapes else 'struct<area:double>'}>").asNondeterministic()(plate, walls)


def shape_units(plate: Column, walls: Column, outlines: Column, least: float, grid: int = 3, tolerance: float = 0.05, shapes: bool = True) -> Column:
    """plate_area, clips and faces of a storey, see ``planar.units``: one pass over its plan. Without shapes they have areas alone."""

    def run(plate: pa.Array, walls: pa.Array, outlines: pa.Array) -> pa.Array:
        return planar.units(plate, walls, outlines, least, grid, tolerance, 6, shapes)

    one = f"shape:{SHAPE}," if shapes else ""
    kind = f"struct<plate_area:double,clips:array<struct<own:double,{one}area:double>>,faces:array<struct<{one}area:double>>>"
    return F.arrow_udf(run, kind).asNondeterministic()(plate, walls, outlines)


def shape_clips(rings: Column, shape: Column, digits: int = 6) -> Column:
    """Of each ring of an array its own area, and shape and area of what lies in the shape (null if nothing does)."""

    def run(rings: pa.Array, shape: pa.Array) -> pa.Array:
        return planar.clipped(rings, shape, digits)

    return F.arrow_udf(run, f"array<struct<own:double,shape:{SHAPE},area:double>>").asNondeterministic()(rings, shape)


def overlay_areas(df: DataFrame, a: str = "a", b: str = "b", digits: int = 6) -> DataFrame:
    """key, area_a, area_b, intersection, union, difference, symmetric for each key's two shapes. Null shapes are empty; keys
    without any edge are left out."""
    return df.select("key", shape_areas(F.col(a), F.col(b), digits).alias("r")).where("r is not null").select("key", "r.*")


def overlay(df: DataFrame, op: str, a: str = "a", b: str = "b", digits: int = 6) -> DataFrame:
    """key, shape, area: the result of an operation of ``OPS`` as rings, outer ones counter-clockwise and holes clockwise. Keys with an
    empty result are left out."""
    return df.select("key", shape_result(F.col(a), F.col(b), op, digits).alias("r")).where("r is not null").select("key", "r.*")


def faces(df: DataFrame, plate: str = "plate", walls: str = "walls", grid: int = 3, tolerance: float = 0.05, shapes: bool = True) -> DataFrame:
    """key, face (from 1, by decreasing area, then bounds), shape, area: the faces of each plate (a shape) between its walls (an array of
    polylines), in whatever order they come. Both are snapped to the grid (digits). Stubs, doubles and walls outside divide nothing, and the faces
    always tile the plate. A closed ring of walls within a face is a hole of that face. Where shapes aren't wanted, workers don't send them."""
    f = df.select("key", shape_faces(F.col(plate), F.col(walls), grid, tolerance, shapes).alias("f")).select("key", F.posexplode("f").alias("face", "f"))
    return f.select("key", (F.col("face") + 1).alias("face"), "f.*")
