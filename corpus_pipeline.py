"""The corpus pipeline: quality, line dedup, near-duplicate documents, decontamination, packing.

Each stage reads all that the one before kept, from Parquet, and all but the last return the columns of
``documents``, extra ones included, whatever their names. The rows that a stage returns are its decision.

Rows are chosen by ``doc_id``: rows that share an id, or have none, are one document; they stay if any of them passes, and
go if any of them holds a benchmark passage. Of equal rows of one id the near-duplicate stage keeps one. Null and empty texts are judged
as such by each operator: they pass where it finds nothing against them. Of linked documents the least id stays, so
ties cannot arise. An empty table gives an empty one at every stage. Without labels nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.op01_quality import quality
from plumbline.llm.op05_packing import pack_documents
from plumbline.llm.op07_line_dedup import line_dedup
from plumbline.llm.op09_decontamination import decontaminate
from plumbline.llm.op10_jaccard_join import jaccard_join
from plumbline.llm.store import fresh, sf_table
from plumbline.operators.store import temporary


def _chosen(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows whose doc_id is among the ids (left_semi) or isn't (left_anti); a null id equals a null id."""
    key = fresh("key")
    picked = ids.select(F.col("doc_id").alias(key)).distinct()
    return docs.join(picked, F.col("doc_id").eqNullSafe(F.col(key)), how)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return _chosen(docs, quality(docs, sf_table(spark, sf_dir, "labels")).where("kept"), "left_semi")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of near copies stays; n_chars, if there is one, follows the text."""
    out = line_dedup(docs, every=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of linked ones stays, once."""
    out = _chosen(docs, jaccard_join(docs).where("doc_id <=> component_id"), "left_semi")
    text = fresh("text")
    return out.withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text]).drop(text)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return _chosen(docs, decontaminate(docs, sf_table(spark, sf_dir, "benchmark")).where("n_hit > 0"), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack_documents(docs, keep_ids=False)


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_stage), ("benchmark decontamination", benchmark_stage), ("packing", packing_stage)]
#: Most stages can't be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    base = temporary(spark, "pipeline")
    docs = sf_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
