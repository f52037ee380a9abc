"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op01_quality import quality
from .op02_substring_dedup import substring_dedup
from .op03_perplexity import quality_rules
from .op04_licenses import license_scan
from .op04_licenses import sql as license_sql
from .op05_packing import pack_documents
from .op06_suffix_dedup import suffix_dedup
from .op07_line_dedup import near_lines
from .op08_toxicity import toxicity
from .op09_decontamination import decontaminate
from .op10_jaccard_join import jaccard_join
from .op11_search import index, search, vocabulary
from .op11_search import sql as search_sql
from .op12_manifest import manifest, proof_text
from .op12_manifest import sql as manifest_sql
from .op13_chosen_path import near_dedup
from .store import sf_table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sf_table(spark, sf_dir, "documents")


def op1_quality_classifier(spark, sf_dir):
    return quality(_docs(spark, sf_dir), sf_table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup(_docs(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_spans")


def op3_perplexity(spark, sf_dir):
    return quality_rules(_docs(spark, sf_dir))


def op4_license_scan(spark, sf_dir):
    return license_scan(_docs(spark, sf_dir))


def op5_packing(spark, sf_dir):
    return pack_documents(_docs(spark, sf_dir), keep_ids=False)


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup(_docs(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


def op7_line_dedup(spark, sf_dir):
    """One row per document with a line: its lines, how many go, and which."""
    docs = _docs(spark, sf_dir)
    gone = near_lines(docs, every=True).groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("removed_lines"))
    all_lines = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    return all_lines.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed_lines", F.expr("array()").cast("array<int>")).alias("removed_lines"))


def op8_toxicity(spark, sf_dir):
    return toxicity(_docs(spark, sf_dir), sf_table(spark, sf_dir, "labels"))


def op9_decontamination(spark, sf_dir):
    got = decontaminate(_docs(spark, sf_dir), sf_table(spark, sf_dir, "benchmark"))
    names = F.concat_ws(",", "items")
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest", "longest_at")


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join(_docs(spark, sf_dir))


def op11_ranked_search(spark, sf_dir):
    """Every benchmark item against all documents; the index keeps the postings of the items' terms."""
    items = sf_table(spark, sf_dir, "benchmark")
    shards = index(_docs(spark, sf_dir), vocabulary(items))
    return search(shards, items).withColumnRenamed("item", "item_id")


def op12_manifest(spark, sf_dir):
    """A drill: rows whose id's crc32 is a multiple of seven are folded with one character more."""
    got = manifest(_docs(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    return got.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"), "folded_root", "verified")


def op13_minhash_dedup(spark, sf_dir):
    return near_dedup(_docs(spark, sf_dir))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit() and callable(v) and v.__module__ == __name__}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": license_sql(), "op11_ranked_search": search_sql(), "op12_manifest": manifest_sql()}
