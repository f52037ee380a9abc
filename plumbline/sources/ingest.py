"""Point-cloud files to registered sources: checks, CRS, metadata, retained bytes, audit and provenance, as appended rows.

Files are read by Spark's ``binaryFile`` source and stay where they are or go to a retained folder under their hash. A file that
can't be used becomes a row with its problems; it stops no other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import crs as C
from plumbline.functions import identifiers as I
from plumbline.functions import rings as R

from . import pointfiles, pointsource

UPLOAD_BYTES = 10_000_000


def refused(spark: SparkSession, path: str, most_bytes: int = UPLOAD_BYTES) -> DataFrame:
    """(path, bytes, why) of files of other kinds or beyond the limit; the bytes of none are read."""
    f = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    why = F.when(~ext.isin(*pointfiles.EXTENSIONS), "unsupported extension").when(F.col("bytes") > most_bytes, "file too large").when(F.col("bytes") == 0, "file is empty")
    return f.withColumn("why", why).where("why is not null")


def metadata(headers: DataFrame, crs_override: str | None = None) -> DataFrame:
    """Headers with what follows from them. A CRS given by the caller counts only where the file states none."""
    declared = F.coalesce(C.resolve(F.col("crs")), F.lit(C.UNKNOWN))
    given = F.when(declared != C.UNKNOWN, "file").when(F.lit(crs_override is not None), "caller_supplied").otherwise("unknown")
    out = headers.withColumns({"crs_source": given, "crs": F.when(declared != C.UNKNOWN, declared).otherwise(C.resolve(F.lit(crs_override))) if crs_override else declared})
    b = [F.col(k) for k in ("x0", "y0", "x1", "y1")]
    return out.withColumns({
        "crs": F.coalesce("crs", F.lit(C.UNKNOWN)),
        "processing_crs": C.processing_crs_of_bounds(*b, F.col("crs")),
        "density": C.density(F.col("point_count"), *b, F.col("crs")),
        "display_bounds": C.display_bounds(*b, F.col("crs")),
        "compressed": F.lower("format") == "laz",
        "valid": F.size("problems") == 0,
    })


def ingested(headers: DataFrame, taken: DataFrame, at: Column, actor: str, crs_override: str | None = None) -> dict[str, DataFrame]:
    """Rows to append for the usable files that aren't registered yet (by hash): sources, jobs, audit, links. Source ids go on from the
    largest there is, in the order of the hashes. taken: sources (id, sha256)."""
    from pyspark.sql.window import Window

    m = metadata(headers, crs_override).where("valid").dropDuplicates(["sha256"]).join(taken.select("sha256"), "sha256", "left_anti")
    top = taken.agg(F.coalesce(F.max(F.expr("try_cast(regexp_extract(id, '^DS-([0-9]+)$', 1) as long)")), F.lit(0)).alias("top"))
    # numbers within hash prefixes, and the prefixes' offsets, so that no task holds all files
    m = m.withColumn("prefix", F.substring("sha256", 1, 2)).withColumn("k", F.row_number().over(Window.partitionBy("prefix").orderBy("sha256")))
    before = m.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("prefix", (F.sum("n").over(Window.orderBy("prefix")) - F.col("n")).alias("before"))  # at most 256 rows
    number = F.col("top") + F.col("before") + F.col("k")
    src = m.join(before, "prefix").crossJoin(F.broadcast(top)).withColumn("id", F.concat(F.lit("DS-"), F.lpad(number.cast("string"), 3, "0"))).drop("prefix", "k", "n", "before", "top")
    src = src.withColumns({"source_type": F.lit("POINT_CLOUD"), "filename": F.element_at(F.split("path", "/"), -1), "created_by": F.lit(actor)})
    job = F.concat(F.lit("JOB-"), F.upper(F.substring("sha256", 1, 12)))
    return {
        "sources": src,
        "jobs": src.select(job.alias("id"), F.col("id").alias("source_id"), F.lit("METADATA_EXTRACTION").alias("job_type"), F.lit("DONE").alias("status"), at.alias("created_at")),
        "audit": src.select(I.event_id("AE", at, F.col("sha256")).alias("id"), at.alias("ts"), F.lit("SOURCE_INGESTED").alias("action"), F.lit(actor).alias("actor"), F.col("id").alias("object_id")),
        "links": src.select(F.col("id").alias("object_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("DATA_SOURCE").alias("stage")).unionAll(src.select(job, "id", F.lit("PROCESSING_JOB"))),
    }


def retain(spark: SparkSession, path: str, folder: str, most_bytes: int = UPLOAD_BYTES) -> DataFrame:
    """Keeps the bytes of usable files in a table in the folder, once for each hash; gives (sha256, bytes, new)."""
    f = spark.read.format("binaryFile").load(path).where(F.col("length").between(1, most_bytes))
    f = f.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*pointfiles.EXTENSIONS)).select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])
    try:
        have = spark.read.parquet(folder).select("sha256").distinct()
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        have = spark.createDataFrame([], "sha256 string")
    from plumbline.operators.store import cut

    have = cut(have)
    new = f.join(have, "sha256", "left_anti")
    new.write.mode("append").parquet(folder)
    return f.select("sha256", F.octet_length("content").alias("bytes")).join(have.withColumn("had", F.lit(True)), "sha256", "left").select("sha256", "bytes", F.col("had").isNull().alias("new"))


def retained(spark: SparkSession, folder: str, sha256: str) -> DataFrame:
    return spark.read.parquet(folder).where(F.col("sha256") == sha256)


#: How buildings are found: name -> function from points to buildings. Others can be registered.
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def extractor(name: str):
    def add(f):
        EXTRACTORS[name] = f
        return f

    return add


@extractor("density-clusters")
def density_clusters(points: DataFrame) -> DataFrame:
    from plumbline.operators import pointcloud

    return pointcloud.buildings(points)


def extract(points: DataFrame, method: str = "density-clusters", source_id: str | None = None) -> DataFrame:
    """Buildings of a source's points by a registered method, with the method and source beside them."""
    if method not in EXTRACTORS:
        raise KeyError(f"no extractor {method!r}; there are {', '.join(sorted(EXTRACTORS))}")
    return EXTRACTORS[method](points).withColumns({"method": F.lit(method), "source_id": F.lit(source_id)})


class TooManyPoints(ValueError):
    pass


def scan(spark: SparkSession, path: str, most_points: int | None = 2_000_000) -> DataFrame:
    """(path, id, x, y, z) of the usable files, each read by ranges of records. A file with more points than the limit is refused with
    an error that names it; None sets no limit. A bad file gives no points and stops no other; ``refused_scan`` tells why."""
    if most_points is not None:
        large = pointfiles.headers(spark, path).where("size(problems) = 0").where(F.col("point_count") > most_points).select("path", "point_count").head(1)
        if large:
            raise TooManyPoints(f"{large[0].path} has {large[0].point_count} points, more than {most_points}")
    return pointsource.read(spark, path).where("problem is null").drop("problem")


def refused_scan(spark: SparkSession, path: str, most_points: int = 2_000_000) -> DataFrame:
    """(path, why) of files whose points ``scan`` doesn't give."""
    h = pointfiles.headers(spark, path)
    why = F.when(F.size("problems") > 0, F.array_join("problems", "; ")).when(F.col("point_count") > most_points, "too many points")
    return h.select("path", why.alias("why")).where("why is not null")


def encoded(df: DataFrame, geometry: str | None = None, dates: tuple[str, ...] = ()) -> DataFrame:
    """Records as they are stored: a ring as GeoJSON text, structs and maps as JSON, date texts as dates, stamps as ISO text."""
    out = {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if f.name == geometry:
            out[f.name] = R.to_geojson(F.col(f.name))
        elif f.name in dates:
            out[f.name] = I.day(F.col(f.name))
        elif kind.startswith(("struct", "map", "array")):
            out[f.name] = F.to_json(f.name)
        elif kind.startswith("timestamp"):
            out[f.name] = I.iso(F.col(f.name))
    return df.withColumns(out) if out else df


def answers(df: DataFrame) -> DataFrame:
    """One JSON text a row, nulls included, as an interface would send it."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
