"""Structured Streaming over the append-only logs; an extension, the collections themselves are batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tail(spark: SparkSession, path: str, schema: str, files: int = 64) -> DataFrame:
    """New files of a Parquet log as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def actions_by_window(log: DataFrame, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts of actions in tumbling (or sliding) event-time windows; later events than ``late`` are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return log.withWatermark("ts", late).groupBy(w.alias("w"), "action").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "action", "n")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each actor: first and last time, actions."""
    return log.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "actor").agg(F.count(F.lit(1)).alias("n")).select("actor", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def once_only(log: DataFrame, late: str = "2 hours") -> DataFrame:
    """Without repeated ids within the watermark."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def append(stream: DataFrame, path: str, checkpoint: str):
    """Everything that is there now, appended to a Parquet log; started again it goes on where it ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
