"""Identifiers and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slug(c: Column) -> Column:
    """Upper case, letters and digits only; empty for null."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", "")


def ulpin(prefix: str, parent: Column, unit: Column, slugged: bool = False) -> Column:
    """VC-{prefix}-{parent}-{unit or LAND}; an empty parent is dropped. Parts that are slugs already can be given as such."""
    part = lambda c: F.nullif(c if slugged else slug(c), F.lit(""))
    return F.concat_ws("-", F.lit("VC"), F.lit(prefix), part(parent), F.coalesce(part(unit), F.lit("LAND")))


def assign_missing(df: DataFrame, derived: Column, overwrite: bool = False) -> DataFrame:
    old = F.nullif(F.col("ulpin"), F.lit(""))
    return df.withColumn("assigned", old.isNull() | F.lit(overwrite)).withColumn("ulpin", derived if overwrite else F.coalesce(old, derived))


def floor_label(n: Column) -> Column:
    return F.when(n < 0, F.concat(F.lit("B"), F.abs(n).cast("string"))).when(n == 0, F.lit("B1")).when(n == 1, F.lit("GF")).otherwise(n.cast("string"))


def vertical_position(z_min: Column, z_max: Column, ground: Column) -> Column:
    return F.when(z_min.isNull() | z_max.isNull() | ground.isNull(), F.lit("UNDETERMINED")).when(z_max <= ground, F.lit("UNDERGROUND")).when(z_min >= ground, F.lit("ELEVATED")).otherwise(F.lit("AT_GRADE"))


def two_digits(n: Column) -> Column:
    """At least two digits."""
    s = n.cast("string")
    return F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s)


def volume_key(ref: Column, floor: Column, label: Column) -> Column:
    return F.concat_ws("-", ref, F.concat(F.lit("F"), two_digits(floor)), label)


def building_ref(source: Column, ordinal: Column) -> Column:
    return F.concat(source, F.lit("-B"), two_digits(ordinal))


def version_id(object_id: Column, version: Column) -> Column:
    return F.concat(F.lit("GV-"), object_id, F.lit("-v"), version.cast("string"))


def object_type(object_id: Column) -> Column:
    return F.when(object_id.startswith("PV-"), "PROPERTY").when(object_id.startswith("V-"), "PROPERTY").when(object_id.startswith("B-"), "BUILDING").when(object_id.startswith("P-"), "PARCEL").when(object_id.startswith("INF-") | object_id.startswith("I-"), "INFRASTRUCTURE").otherwise("UNKNOWN")


def next_source_id(sources: DataFrame, col: str = "id") -> DataFrame:
    """DS-nnn, one past the largest well-formed id."""
    n = F.coalesce(F.max(F.regexp_extract(col, r"^DS-(\d+)$", 1).try_cast("long") if hasattr(Column, "try_cast") else F.expr(f"try_cast(regexp_extract({col}, '^DS-([0-9]+)$', 1) as long)")), F.lit(0)) + 1
    return sources.agg(F.concat(F.lit("DS-"), F.lpad(n.cast("string"), 3, "0")).alias("next_id"))


def unit_label(building_id: Column, floor: Column, label: Column) -> Column:
    """A plan's own label, told apart by building and storey."""
    return F.concat_ws("-", building_id, F.concat(F.lit("F"), two_digits(floor)), label)


def extraction_ordinal(building_id: Column, fallback: Column) -> Column:
    """The number that an id ends with after its last hyphen, else the fallback."""
    tail = F.regexp_extract(building_id, r"(?:^|-)([0-9]+)$", 1)
    return F.when(tail != "", tail.cast("long")).otherwise(fallback.cast("long"))


def type_by_fields(**has: Column) -> Column:
    """The kind of a record without a telling id, by which fields it carries; a field that isn't given is missing."""
    there = lambda *names: F.lit(True) if not names else (has[names[0]].isNotNull() if names[0] in has else F.lit(False)) & there(*names[1:])
    return F.when(there("floor_number", "unit_label"), "PROPERTY_VOLUME").when(there("parcel_id", "floor_count"), "BUILDING").when(there("parcel_id", "geometry"), "PARCEL").when(there("type"), "INFRASTRUCTURE").otherwise("PROPERTY_VOLUME")


def event_id(prefix: str, at: Column, *parts: Column, digits: int = 8) -> Column:
    """{prefix}-{UTC microseconds}-{so many hex digits of the parts}: ids sort by time, and a retried task gives the same."""
    return F.concat(F.lit(f"{prefix}-"), F.date_format(at, "yyyyMMddHHmmssSSSSSS"), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits))


def iso(at: Column) -> Column:
    """A timestamp as ISO text to the second; fractions only where there are any."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_trunc("second", at) == at, whole).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def day(text: Column) -> Column:
    """The date that the first ten characters name; null if they name none."""
    return F.to_date(F.when(F.substring(text, 1, 10).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.substring(text, 1, 10)), "yyyy-MM-dd")


def now_utc() -> Column:
    """The query's start as ISO text in the session's time zone, which is UTC in this library's sessions."""
    return iso(F.current_timestamp())
