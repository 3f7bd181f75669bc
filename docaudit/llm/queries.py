"""Registered queries of this package, with check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm import oracles, oracles_vectors
from docaudit.llm.boosted_trees import score_quality
from docaudit.llm.hidden_markov import score_texts
from docaudit.llm.importance import importance_resample
from docaudit.llm.lattice_dedup import near_embeddings
from docaudit.llm.license_scan import default_templates, scan_licenses
from docaudit.llm.line_runs import dedup_lines
from docaudit.llm.ngram_join import similar_documents
from docaudit.llm.packing import pack_documents
from docaudit.llm.quality_rules import apply_quality_rules
from docaudit.llm.training_order import training_order
from docaudit.llm.vector_codes import compress_vectors
from docaudit.llm.warc import read_warc, write_warc
from docaudit.llm.winnowing import contamination
from docaudit.shared import SESSION_CONF, new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for key, value in SESSION_CONF.items():
        if key.startswith("spark.sql.adaptive"):
            spark.conf.set(key, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _remainder(n: int) -> Column:
    """crc32 of the document id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).drop("set_hash")


def op4_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _remainder(4) == 2
    )


def op5_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), _remainder(5) == 1)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).drop("loss_tokens")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(table(spark, sf_dir, "pages"), new_path(spark, "warc"))).drop("url")


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(spark, table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"), default_templates(spark))
    return found.select("doc_id", "n_licenses", F.array_join("licenses", ",").alias("licenses"), "best_share")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(table(spark, sf_dir, "documents")).drop("row_key", "left", "gone_lines")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("n_words")


def op12_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings")).codes


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_join, op2_decontaminate, op3_line_dedup, op4_quality_trees, op5_hidden_markov, op6_packing,
        op7_warc, op8_training_order, op9_quality_rules, op10_license_scan,
        op11_importance_resampling, op12_lattice_dedup, op13_vector_codes,
    )
}
ORACLE_SQL: dict[str, str] = oracles.SQL | oracles_vectors.SQL
