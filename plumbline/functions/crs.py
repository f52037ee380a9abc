"""Coordinate reference systems as column expressions: EPSG 4326, 326zz, 327zz, 3413, 3031 and (to name, not to measure in) 3857.

The polar projections are the ellipsoidal stereographic ones with a standard parallel. The UTM projection is the transverse Mercator of WGS 84 by Krueger's series to the sixth order in n.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLATTENING, K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
#: Krueger's series in powers of n, rows by harmonic, columns from n**1.
_ALPHA = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600],
    [0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840],
    [0, 0, 0, 0, 0, 212378941 / 319334400],
]
_BETA = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600],
    [0, 0, 0, 0, 4583 / 161280, -108847 / 3991680],
    [0, 0, 0, 0, 0, 20648693 / 638668800],
]
_sum = lambda t: [sum(c * _N ** (k + 1) for k, c in enumerate(r)) for r in t]
ALPHA, BETA = _sum(_ALPHA), _sum(_BETA)


def resolve(code: Column) -> Column:
    """EPSG:n of the usual spellings, or null."""
    t = F.upper(F.trim(code))
    n = F.regexp_extract(t, r"(?:^|[:/ ])([0-9]{4,5})$", 1)
    return F.when(t.isin("WGS84", "WGS 84", "CRS84", "URN:OGC:DEF:CRS:OGC:1.3:CRS84"), "EPSG:4326").when(n != "", F.concat(F.lit("EPSG:"), n))


def number(code: Column) -> Column:
    return F.expr("cast(null as int)") if code is None else F.substring_index(resolve(code), ":", -1).cast("int")


def is_metric(code: Column) -> Column:
    n = number(code)
    return F.coalesce(n.between(32601, 32660) | n.between(32701, 32760) | n.isin(3413, 3031), F.lit(False))


def utm_zone(lon: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(60), (F.floor((lon + 180) / 6) + 1).cast("int")))


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def processing_crs(source: Column, lon: Column, lat: Column, explicit: Column | None = None) -> Column:
    """Explicit, else the source's if it is metric, else polar or UTM by place."""
    by_place = F.concat(F.lit("EPSG:"), F.when(lat >= 84, 3413).when(lat <= -80, 3031).otherwise(utm_epsg(lon, lat)).cast("string"))
    own = F.when(is_metric(source), resolve(source))
    return F.coalesce(*([resolve(explicit)] if explicit is not None else []), own, by_place)


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def to_utm(lon: Column, lat: Column, zone: Column, north: Column) -> Column:
    """STRUCT<x, y> in metres."""
    e = (2 * _N**0.5) / (1 + _N)
    lam = F.radians(lon - (zone * 6 - 183))
    conformal = let(F.sin(F.radians(lat)), lambda s: F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s)))

    def series(p: Column) -> Column:
        y, x = p["a"], p["b"]
        for k, c in enumerate(ALPHA, 1):
            y = y + F.lit(c) * F.sin(2 * k * p["a"]) * F.cosh(2 * k * p["b"])
            x = x + F.lit(c) * F.cos(2 * k * p["a"]) * F.sinh(2 * k * p["b"])
        return F.struct((500000 + K0 * _RADIUS * x).alias("x"), (F.when(north, 0.0).otherwise(1e7) + K0 * _RADIUS * y).alias("y"))

    return let(let(conformal, lambda t: _pair(F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t)))), series)


def from_utm(x: Column, y: Column, zone: Column, north: Column) -> Column:
    """STRUCT<lon, lat> in degrees."""

    def series(p: Column) -> Column:
        xi, eta = p["a"], p["b"]
        for k, c in enumerate(BETA, 1):
            xi = xi - F.lit(c) * F.sin(2 * k * p["a"]) * F.cosh(2 * k * p["b"])
            eta = eta - F.lit(c) * F.cos(2 * k * p["a"]) * F.sinh(2 * k * p["b"])
        return _pair(xi, eta)

    e2 = 1 - (1 - FLATTENING) ** 2
    e = F.lit(e2**0.5)

    def geographic(p: Column) -> Column:
        # latitude from the conformal one by Newton steps
        t0 = F.sin(p["a"]) / F.sqrt(F.sinh(p["b"]) ** 2 + F.cos(p["a"]) ** 2)

        def step(t: Column, _: Column) -> Column:
            ti = let(F.sinh(e * F.atanh(e * t / F.sqrt(1 + t * t))), lambda sig: t * F.sqrt(1 + sig * sig) - sig * F.sqrt(1 + t * t))
            return let(ti, lambda i: t + (t0 - i) / F.sqrt(1 + i * i) * (1 + (1 - e2) * t * t) / ((1 - e2) * F.sqrt(1 + t * t)))

        t = F.aggregate(F.sequence(F.lit(1), F.lit(3)), t0, step)
        return F.struct((F.degrees(F.atan2(F.sinh(p["b"]), F.cos(p["a"]))) + (zone * 6 - 183)).alias("lon"), F.degrees(F.atan(t)).alias("lat"))

    start = _pair((y - F.when(north, 0.0).otherwise(1e7)) / (K0 * _RADIUS), (x - 500000) / (K0 * _RADIUS))
    return let(let(start, series), geographic)


UNKNOWN = "UNKNOWN"


def is_projected(code: Column) -> Column:
    return is_metric(code) | F.coalesce(number(code) == 3857, F.lit(False))


def units(code: Column) -> Column:
    """The unit of the first axis; 'unknown' for a code that isn't supported."""
    return F.when(is_projected(code), "metre").when(number(code) == 4326, "degree").otherwise("unknown")


def is_suitable(code: Column) -> Column:
    """Whether lengths and areas may be measured in it: metric axes, and not the web map's."""
    return is_metric(code)


def source_crs(*declared: Column) -> Column:
    """The first of the declared codes that can be resolved, in order of precedence; UNKNOWN if there is none."""
    return F.coalesce(*(resolve(c) for c in declared), F.lit(UNKNOWN))


def context(source: Column, lon: Column, lat: Column, explicit: Column | None = None) -> Column:
    """STRUCT of the three roles; an unknown source has no processing CRS."""
    own = F.coalesce(resolve(source), F.lit(UNKNOWN))
    return F.struct(own.alias("source_crs"), F.when(own != UNKNOWN, processing_crs(own, lon, lat, explicit)).alias("processing_crs"), F.lit("EPSG:4326").alias("display_crs"))


_E2 = FLATTENING * (2 - FLATTENING)
_E = _E2**0.5
#: (EPSG, sign of the pole, latitude of true scale, central meridian).
POLAR = [(3413, 1, 70.0, -45.0), (3031, -1, -71.0, 0.0)]


def _colatitude(phi: Column) -> Column:
    """tan of half the conformal colatitude."""
    s = F.lit(_E) * F.sin(phi)
    return F.tan(F.lit(0.7853981633974483) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(_E / 2))


def _polar_scale(true: float) -> Column:
    phi = F.radians(F.lit(abs(true)))
    return F.lit(A) * F.cos(phi) / F.sqrt(1 - F.lit(_E2) * F.sin(phi) ** 2) / _colatitude(phi)


def to_polar(lon: Column, lat: Column, sign: int, true: float, meridian: float) -> Column:
    """STRUCT<x, y> in metres."""
    rho = _polar_scale(true) * _colatitude(F.radians(lat * sign))
    turn = F.radians(lon - meridian)
    return F.struct((rho * F.sin(turn)).alias("x"), (F.lit(-sign) * rho * F.cos(turn)).alias("y"))


def from_polar(x: Column, y: Column, sign: int, true: float, meridian: float) -> Column:
    """STRUCT<lon, lat>; the latitude by fixed-point steps, each some 300 times nearer."""
    t = F.sqrt(x * x + y * y) / _polar_scale(true)
    start = F.lit(1.5707963267948966) - 2 * F.atan(t)

    def nearer(phi: Column, _: Column) -> Column:
        s = F.lit(_E) * F.sin(phi)
        return F.lit(1.5707963267948966) - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(_E / 2)))

    phi = F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, nearer)
    lon = F.degrees(F.atan2(x, F.lit(-sign) * y)) + meridian
    return F.struct((F.pmod(lon + 180, F.lit(360.0)) - 180).alias("lon"), (F.degrees(phi) * sign).alias("lat"))


def to_wgs84(x: Column, y: Column, code: Column) -> Column:
    """STRUCT<lon, lat> of a point in any supported CRS but 3857; null for others."""
    return let(number(code), lambda n: _to_wgs84(x, y, n))


def _to_wgs84(x: Column, y: Column, n: Column) -> Column:
    out = F.when(n == 4326, F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))).when(n.between(32601, 32660) | n.between(32701, 32760), from_utm(x, y, n % 100, n < 32700))
    for epsg, *p in POLAR:
        out = out.when(n == epsg, from_polar(x, y, *p))
    return out


def from_wgs84(lon: Column, lat: Column, code: Column) -> Column:
    """STRUCT<x, y> of a place in any supported CRS but 3857; null for others."""
    return let(number(code), lambda n: _from_wgs84(lon, lat, n))


def _from_wgs84(lon: Column, lat: Column, n: Column) -> Column:
    out = F.when(n == 4326, F.struct(lon.cast("double").alias("x"), lat.cast("double").alias("y"))).when(n.between(32601, 32660) | n.between(32701, 32760), to_utm(lon, lat, n % 100, n < 32700))
    for epsg, *p in POLAR:
        out = out.when(n == epsg, to_polar(lon, lat, *p))
    return out


def transform(x: Column, y: Column, source: Column, target: Column) -> Column:
    """STRUCT<x, y>; always (x, y) or (lon, lat), never (lat, lon). Equal codes change nothing."""
    given = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), number(source).alias("s"), number(target).alias("t"))

    def moved(v: Column) -> Column:
        there = let(_to_wgs84(v["x"], v["y"], v["s"]), lambda g: _from_wgs84(g["lon"], g["lat"], v["t"]))
        return F.when(v["s"] == v["t"], F.struct(v["x"].alias("x"), v["y"].alias("y"))).otherwise(there)

    return let(given, moved)


def transform_ring(ring: Column, source: Column, target: Column) -> Column:
    """A ring, point by point."""
    return F.transform(ring, lambda p: transform(p["x"], p["y"], source, target))


def _open_area(points: list[Column]) -> Column:
    turn = sum((p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(points, [*points[1:], points[0]])), F.lit(0.0))
    return F.abs(turn) / 2


def processing_crs_of_bounds(x0: Column, y0: Column, x1: Column, y1: Column, source: Column) -> Column:
    """By the middle of the extent; null if the source is unknown or the extent isn't defined."""
    mid = let(to_wgs84((x0 + x1) / 2, (y0 + y1) / 2, source), lambda g: processing_crs(source, g["lon"], g["lat"]))
    return F.when(resolve(source).isNotNull(), F.coalesce(F.when(is_metric(source), resolve(source)), mid))


def _corners(x0, y0, x1, y1, source, target) -> Column:
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    codes = F.struct(source.cast("string").alias("s"), target.cast("string").alias("t"))
    return let(codes, lambda c: F.transform(F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1)), lambda q: transform(q["x"], q["y"], c["s"], c["t"])))


def bounds_area(x0: Column, y0: Column, x1: Column, y1: Column, source: Column, target: Column) -> Column:
    """Area of the four corners once they are transformed; null if it isn't positive."""
    area = let(_corners(x0, y0, x1, y1, source, target), lambda c: _open_area([c[i] for i in range(4)]))
    return F.when(area > 0, area)


def density(n: Column, x0: Column, y0: Column, x1: Column, y1: Column, source: Column) -> Column:
    """Points a square metre of the extent; null where that isn't defined."""
    area = let(processing_crs_of_bounds(x0, y0, x1, y1, source), lambda t: bounds_area(x0, y0, x1, y1, source, t))
    return F.when(n > 0, n / area)


def display_bounds(x0: Column, y0: Column, x1: Column, y1: Column, source: Column, digits: int = 7) -> Column:
    """STRUCT<x0, y0, x1, y1> in degrees, from all four corners."""
    pick = lambda c, f, k: F.round(f(F.transform(c, lambda p: p[k])), digits)
    box = let(_corners(x0, y0, x1, y1, source, F.lit("EPSG:4326")), lambda c: F.struct(pick(c, F.array_min, "x").alias("x0"), pick(c, F.array_min, "y").alias("y0"), pick(c, F.array_max, "x").alias("x1"), pick(c, F.array_max, "y").alias("y1")))
    return F.when(resolve(source).isNotNull(), box)
