"""Reading the corpus tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def sf_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"
