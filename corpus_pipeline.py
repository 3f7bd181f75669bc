"""Pipeline from raw documents to packed training sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.columns import ID, KEY, carried, join_keyed, unpacked
from docaudit.llm.line_runs import dedup_lines
from docaudit.llm.ngram_join import JoinSettings, similar_documents
from docaudit.llm.packing import pack_documents
from docaudit.llm.quality_rules import apply_quality_rules, without_boilerplate
from docaudit.llm.queries import table
from docaudit.llm.winnowing import contamination
from docaudit.shared import new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the boilerplate lines of their host."""
    kept = without_boilerplate(docs, apply_quality_rules(docs))
    return kept.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of similar texts stays, and every text without words.

    Five-word shingles and a similarity of 0.8. Rows of one id are one document; rows without an id stay.
    """
    found = similar_documents(docs, settings=JoinSettings(words=5, percent=80))
    firsts = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("first_id")).distinct()
    rows = carried(docs, "doc_id", "text")
    joined = rows.join(firsts, F.col(ID) == F.col("first_id"), "left")
    return unpacked(joined.where(F.col("first_id").isNotNull() | F.col(ID).isNull()), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    clean = found.where(~F.col("contaminated")).select(F.col("row_key").alias(KEY), F.col("doc_id").alias(ID)).distinct()
    return unpacked(join_keyed(carried(docs, "doc_id", "text"), clean, "left_semi"), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", packing),
]
# Packing depends on a tokenizer, which SQL cannot express; the tests use a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
