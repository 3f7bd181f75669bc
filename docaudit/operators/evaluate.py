"""Score the triage against a labelled set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.triage import AUTO, GOOD, LABELS, MANUAL

# Folder names and the label they stand for.
LABEL_ALIASES = {
    "good_to_go": GOOD, "good": GOOD, "go": GOOD,
    "fit_for_automated_tagging": AUTO, "fit": AUTO, "auto": AUTO,
    "needs_manual_remediation": MANUAL, "manual": MANUAL,
}
ERROR = "error"


def folder_label(folder: Column) -> Column:
    """Expected label of a folder name in any case; null for unknown folders."""
    name = F.lower(folder)
    return F.coalesce(
        *[
            F.when(name.isin([a for a, l in LABEL_ALIASES.items() if l == label]), F.lit(label))
            for label in LABELS
        ]
    )


def labelled(rows: DataFrame, folder_column: str = "folder") -> DataFrame:
    """Rows with a known label, as ``expected``."""
    return rows.withColumn("expected", folder_label(F.col(folder_column))).where(
        F.col("expected").isNotNull()
    )


def predict(expected: DataFrame, triaged: DataFrame) -> DataFrame:
    """Predictions for labelled rows (pdf_hash, expected); no report means ``error``."""
    verdicts = triaged.select(
        "pdf_hash", "classification", "confidence", "classification_reason",
        "violations", "tagged", "image_only", "has_form", "complex_graphic", "page_count",
    )
    joined = expected.join(verdicts, "pdf_hash", "left")
    missing = F.col("classification").isNull()
    return (
        joined.withColumn("predicted", F.coalesce("classification", F.lit(ERROR)))
        .withColumn("confidence", F.coalesce("confidence", F.lit("high")))
        .withColumn(
            "reason",
            F.when(missing, "classification failed: no report").otherwise(
                F.col("classification_reason")
            ),
        )
        .withColumn("correct", F.col("expected") == F.col("predicted"))
        .drop("classification", "classification_reason")
    )


def accuracy(pairs: DataFrame) -> DataFrame:
    """Total and share of right predictions (0 on an empty set)."""
    hit = F.when(F.col("expected") == F.col("predicted"), 1.0).otherwise(0.0)
    return pairs.agg(
        F.count("*").alias("total"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy")
    )


def confusion(pairs: DataFrame) -> DataFrame:
    """Expected x predicted counts over the three labels, zero-filled.

    Nine conditional counts in one pass, then one row per cell.
    """
    cells = [(e, p) for e in LABELS for p in LABELS]
    counts = pairs.agg(
        *[
            F.count_if((F.col("expected") == e) & (F.col("predicted") == p)).alias(f"c{i}")
            for i, (e, p) in enumerate(cells)
        ]
    )
    rows = [
        F.struct(F.lit(e).alias("expected"), F.lit(p).alias("predicted"), F.col(f"c{i}").alias("n"))
        for i, (e, p) in enumerate(cells)
    ]
    return counts.select(F.inline(F.array(*rows)))


def per_class(pairs: DataFrame) -> DataFrame:
    """Precision, recall (0 when undefined) and support per label."""
    expected, predicted = F.col("expected"), F.col("predicted")
    aggs = []
    for i, label in enumerate(LABELS):
        aggs += [
            F.count_if(expected == label).alias(f"s{i}"),
            F.count_if(predicted == label).alias(f"p{i}"),
            F.count_if((expected == label) & (predicted == label)).alias(f"t{i}"),
        ]
    zero = F.lit(0.0)
    rows = [
        F.struct(
            F.lit(label).alias("label"),
            F.coalesce(F.try_divide(F.col(f"t{i}"), F.col(f"p{i}")), zero).alias("precision"),
            F.coalesce(F.try_divide(F.col(f"t{i}"), F.col(f"s{i}")), zero).alias("recall"),
            F.col(f"s{i}").alias("support"),
        )
        for i, label in enumerate(LABELS)
    ]
    return pairs.agg(*aggs).select(F.inline(F.array(*rows)))


def mismatches(predictions: DataFrame) -> DataFrame:
    return predictions.where(~F.col("correct"))
