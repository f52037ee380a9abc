"""Column expressions over boxes (x0, y0, x1, y1) with a vertical band (z_min, z_max).

``at`` names the side of a join: ``area("a")`` reads a.x0 and so on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS_AREA, EPS_GAP, HEIGHT_TOLERANCE = 0.01, 0.05, 0.30


def _c(name: str, at: str | None) -> Column:
    return F.col(f"{at}.{name}" if at else name)


def area(at: str | None = None) -> Column:
    return (_c("x1", at) - _c("x0", at)) * (_c("y1", at) - _c("y0", at))


def height(at: str | None = None) -> Column:
    return _c("z_max", at) - _c("z_min", at)


def volume(at: str | None = None) -> Column:
    """Signed: an inverted band gives a negative volume."""
    return area(at) * height(at)


def measured_volume(at: str | None = None) -> Column:
    return F.when(height(at) > 0, volume(at)).otherwise(F.lit(0.0))


def _overlap(lo: str, hi: str, a: str, b: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(_c(hi, a), _c(hi, b)) - F.greatest(_c(lo, a), _c(lo, b)))


def plan_overlap(a: str, b: str) -> Column:
    return _overlap("x0", "x1", a, b) * _overlap("y0", "y1", a, b)


def vertical_overlap(a: str, b: str) -> Column:
    return _overlap("z_min", "z_max", a, b)


def volume_overlap(a: str, b: str) -> Column:
    return plan_overlap(a, b) * vertical_overlap(a, b)


def outside_area(inner: str, outer: str) -> Column:
    return area(inner) - plan_overlap(inner, outer)


def contains(outer: str, inner: str) -> Column:
    return outside_area(inner, outer) == 0


def touches_box(a: str, b: str) -> Column:
    """Bounding boxes share at least a point."""
    return (_c("x0", a) <= _c("x1", b)) & (_c("x1", a) >= _c("x0", b)) & (_c("y0", a) <= _c("y1", b)) & (_c("y1", a) >= _c("y0", b))


def text(*cols: Column) -> Column:
    """Millimetre-exact text of coordinates, the canonical form behind a geometry hash."""
    return F.concat_ws(",", *(F.round(c * 1000).cast("long").cast("string") for c in cols))


def geometry_hash(at: str | None = None) -> Column:
    """First 12 hexadecimal digits of SHA-256 over ring and band in millimetres; upper case."""
    return F.upper(F.substring(F.sha2(text(*(_c(n, at) for n in ("x0", "y0", "x1", "y1", "z_min", "z_max"))), 256), 1, 12))


def spatial_code(at: str | None = None) -> Column:
    """Centroid grid code: five digits each of x and y."""
    cell = lambda lo, hi: F.lpad(F.floor((_c(lo, at) + _c(hi, at)) / 2).cast("long").cast("string"), 5, "0")
    return F.concat(cell("x0", "x1"), F.lit("-"), cell("y0", "y1"))


def ring(at: str | None = None) -> Column:
    """The box as a closed counter-clockwise ring."""
    p = lambda x, y: F.struct(_c(x, at).alias("x"), _c(y, at).alias("y"))
    return F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0"))


def _gap(lo: str, hi: str, a: str, b: str) -> Column:
    return F.greatest(F.lit(0.0), _c(lo, a) - _c(hi, b), _c(lo, b) - _c(hi, a))


def distance(a: str, b: str) -> Column:
    """Least distance between two footprints; 0 if they touch."""
    return F.sqrt(_gap("x0", "x1", a, b) ** 2 + _gap("y0", "y1", a, b) ** 2)


def centroid_distance(a: str, b: str) -> Column:
    mid = lambda lo, hi, at: (_c(lo, at) + _c(hi, at)) / 2
    return F.sqrt((mid("x0", "x1", a) - mid("x0", "x1", b)) ** 2 + (mid("y0", "y1", a) - mid("y0", "y1", b)) ** 2)


def hausdorff_distance(a: str, b: str) -> Column:
    """The largest distance from a point of either footprint to the other; for boxes a corner takes it."""
    off = lambda p, lo, hi, at: F.greatest(F.lit(0.0), _c(lo, at) - p, p - _c(hi, at))
    far = lambda s, t: F.greatest(*(F.sqrt(off(_c(x, s), "x0", "x1", t) ** 2 + off(_c(y, s), "y0", "y1", t) ** 2) for x in ("x0", "x1") for y in ("y0", "y1")))
    return F.greatest(far(a, b), far(b, a))


def difference_area(a: str, b: str) -> Column:
    """Area of the symmetric difference of the footprints."""
    return area(a) + area(b) - 2 * plan_overlap(a, b)


def clipped(a: str, b: str) -> Column:
    """The intersection of the footprints as a box, or null without area."""
    c = [F.greatest(_c("x0", a), _c("x0", b)), F.greatest(_c("y0", a), _c("y0", b)), F.least(_c("x1", a), _c("x1", b)), F.least(_c("y1", a), _c("y1", b))]
    return F.when((c[2] > c[0]) & (c[3] > c[1]), F.struct(*(x.alias(n) for x, n in zip(c, ("x0", "y0", "x1", "y1")))))
