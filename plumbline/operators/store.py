"""Writes as new DataFrames, searches over collections, and where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class DuplicateRecord(ValueError):
    pass


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is set only where there is none (tests, local mode)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plumbline-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder (reliable checkpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def temporary(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; what is there goes when the JVM ends."""
    path = f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run in here go when their job ends, not when the JVM's collector comes by. A DataFrame that is made in here should
    run once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a compressed Parquet table there, for wide or large rows of which few columns are
    read again. The table goes when the JVM ends, the shuffle files behind it when it is written."""
    spark = df.sparkSession
    path = temporary(spark, "tables")
    with swept(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def insert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Appends; refuses ids that are there already or twice in rows."""
    if not rows.join(table.select(key), key, "left_semi").isEmpty() or not rows.groupBy(key).count().where("count > 1").isEmpty():
        raise DuplicateRecord(key)
    return table.unionByName(rows, allowMissingColumns=True)


def update(table: DataFrame, changes: DataFrame, allowed: list[str], key: str = "id") -> DataFrame:
    """Sets the allowed fields that aren't null in changes; others stay."""
    fields = [c for c in changes.columns if c in allowed and c in table.columns]
    new = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in fields))
    out = table.join(new, key, "left")
    return out.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns))


def delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def truncate(table: DataFrame) -> DataFrame:
    return table.limit(0)


def replace(path: str, df: DataFrame) -> None:
    df.write.mode("overwrite").parquet(path)


def tagged(collections: dict[str, DataFrame]) -> DataFrame:
    """All collections with their kind and priority."""
    out = None
    for k, (name, df) in enumerate(collections.items()):
        df = df.withColumns({"kind_": F.lit(name), "priority_": F.lit(k)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def find_by_id(collections: dict[str, DataFrame], wanted: str) -> DataFrame:
    """The first hit by collection; each collection is filtered before the union."""
    return tagged({k: v.where(F.col("id") == wanted) for k, v in collections.items()}).orderBy("priority_").limit(1)


def search(collections: dict[str, DataFrame], text: str, fields: list[str], n: int | None = 1) -> DataFrame:
    """Records whose fields, joined and in lower case, contain the text; nulls count as empty."""
    hit = lambda df: F.instr(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in fields if c in df.columns))), text.lower()) > 0
    out = tagged({k: v.where(hit(v)) for k, v in collections.items()})
    return out.orderBy("priority_", "seq").limit(n) if n else out


def status_rollup(jobs: DataFrame) -> DataFrame:
    """Of each source: any failure dominates, else what runs, else done when the last job of every type is."""
    last = jobs.groupBy("source_id", "job_type").agg(F.max_by("status", F.struct("created_at", "id")).alias("status"))
    any_ = lambda s: F.bool_or(F.col("status") == s)
    return last.groupBy("source_id").agg(F.when(any_("FAILED"), "FAILED").when(any_("RUNNING"), "RUNNING").when(F.bool_and(F.col("status") == "DONE"), "DONE").otherwise("PENDING").alias("status"))
