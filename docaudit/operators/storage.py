"""Copy manifest of content-addressed storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.functions.storage import DEFAULT_TEMPLATE, storage_path
from docaudit.shared import written


def _destinations(files: DataFrame) -> DataFrame:
    """(path, file_hash, dest, pdf_id, pdf_url): where the content of each rendered path goes, and its lowest file id."""
    contents = (
        files.where(F.col("file_hash").isNotNull())
        .groupBy("path", "file_hash")
        .agg(F.min("pdf_id").alias("pdf_id"), F.min_by("pdf_url", "pdf_id").alias("pdf_url"))
    )
    owners = contents.groupBy("path").agg(F.min("pdf_id").alias("_first"))
    hashed = F.concat(
        F.regexp_replace("path", r"\.[^./]*$", ""), F.lit("-"), "file_hash", F.regexp_extract("path", r"(\.[^./]*)$", 1)
    )
    dest = F.when(F.col("pdf_id") == F.col("_first"), F.col("path")).otherwise(hashed)
    return contents.join(owners, "path").select("path", "file_hash", dest.alias("dest"), "pdf_id", "pdf_url")


def _rendered(files: DataFrame, root: str, date: str, template: str) -> DataFrame:
    path = storage_path(
        F.col("pdf_url"), F.col("site"), F.col("file_hash"), root=root, date=date, template=template
    )
    return files.withColumn("path", path)


def storage_plan(
    files: DataFrame,
    stored: DataFrame,
    *,
    root: str,
    date: str,
    template: str = DEFAULT_TEMPLATE,
) -> DataFrame:
    """One row per destination that does not exist yet, with the file to copy.

    ``files`` has pdf_id, pdf_url, site and file_hash; ``stored`` the existing paths. Where a template gives
    different contents one destination (equal or cut names), the content with the lowest id has it, and
    the others get their hash before the ending, so no content is left out.
    """
    planned = _destinations(_rendered(files, root, date, template)).select("dest", "pdf_id", "pdf_url")
    return planned.join(stored.select(F.col("path").alias("dest")), "dest", "left_anti")


def stored_paths(files: DataFrame, *, root: str, date: str, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """(pdf_id, file_hash, local_path) of every file with a hash: where :func:`storage_plan` of the same files puts its content.

    A file with several contents has a row for each. The destinations are written, so that a content which a third of the files share can be split in the join.
    """
    rows = _rendered(files.where(F.col("file_hash").isNotNull()), root, date, template)
    known = written(_destinations(rows).select("path", "file_hash", F.col("dest").alias("local_path")), "stored")
    rows = rows.select("pdf_id", "path", "file_hash").distinct()
    return rows.join(known, ["path", "file_hash"]).select("pdf_id", "file_hash", "local_path")
