"""Export rows and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.functions.text import drop_nulls
from docaudit.operators.inventory import export_rows
from docaudit.operators.merge import lookup_hash
from docaudit.operators.status import pending_if_missing
from docaudit.shared import written
from docaudit.sources.schemas import EXPORT_COLUMNS


def collect_rows(files: DataFrame, contacts: DataFrame, triaged: DataFrame) -> DataFrame:
    """Export rows with their classification, in the fixed column order."""
    return pending_if_missing(export_rows(files, contacts, triaged)).select(*EXPORT_COLUMNS)


def in_export_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("site", "pdf_url", "parent_url")


# One file in so many is a possible cut of its site; so many of these make a cut.
_SAMPLED, _PER_CUT = 4096, 16


def export_in_order(files: DataFrame, contacts: DataFrame, reports: DataFrame) -> DataFrame:
    """The rows of ``export_rows`` in export order; an owner's emails are shuffled once per site, not in each row.

    Files travel without contacts to the range of their site and meet there one contact row per site. A site of many
    files is cut at sampled files into ranges of about ``_SAMPLED * _PER_CUT``, each with its contact row, so no list grows
    with the site; the cuts steer where rows go, never which. Only export columns travel, and the site's name from the last
    join on.
    """
    contacts = written(contacts.select("site_id", "site", "owner", "responsible"), "contacts")
    names = contacts.select("site_id", "site")
    place = F.struct("pdf_url", "parent_url")
    # By the id: on a derived inventory the test then reaches the scan.
    sampled = files.where(F.pmod(F.xxhash64("pdf_id"), F.lit(_SAMPLED)) == 0).select("site_id", place.alias("_at"))
    cuts = (
        sampled.join(names, "site_id")
        .groupBy("site")
        .agg(F.sort_array(F.collect_list("_at")).alias("_cuts"))
        .where(F.size("_cuts") >= _PER_CUT)
        .withColumn("_cuts", F.filter("_cuts", lambda _, i: (i + 1) % _PER_CUT == 0))
    )
    sites = written(names.join(cuts, "site", "left").select("site_id", "site", "_cuts"), "sites")
    passed = F.size(F.filter("_cuts", lambda c: c <= place))
    found = lookup_hash(files, reports)
    own = [c for c in EXPORT_COLUMNS if c in found.columns and c not in ("pdf_url", "parent_url")]
    body = found.join(sites, "site_id").select(
        "site",
        F.when(F.col("_cuts").isNull(), 0).otherwise(passed).alias("_range"),
        F.struct("pdf_url", "parent_url", *own, "site_id").alias("_row"),
    )
    ranges = F.explode(F.sequence(F.lit(0), F.coalesce(F.when(F.col("_cuts").isNotNull(), F.size("_cuts")), F.lit(0))))
    heads = contacts.join(sites.select("site_id", ranges.alias("_range")), "site_id").select(
        "site", "_range", F.struct("site_id", "owner", "responsible").alias("_contact")
    )
    lists = (
        body.unionByName(heads, allowMissingColumns=True)
        .repartitionByRange("site", "_range")
        .groupBy("site", "_range")  # in place: ranges of the keys hold whole groups
        .agg(F.sort_array(F.collect_list("_row")).alias("_rows"), F.collect_list("_contact").alias("_contacts"))
        .sortWithinPartitions("site", "_range")
    )
    # Sites of one name share their ranges, as the order goes by name.
    contact = F.get(F.filter("_contacts", lambda c: c["site_id"] == F.col("_row.site_id")), F.lit(0))
    each = lists.select("site", "_contacts", F.explode("_rows").alias("_row"))
    return each.select("site", contact["owner"].alias("owner"), contact["responsible"].alias("responsible"), "_row.*").drop("site_id")


def class_sections(rows: DataFrame) -> DataFrame:
    """Size of each class section of the report."""
    return rows.groupBy("classification").agg(F.count("*").alias("n"))


def section_rows(rows: DataFrame) -> DataFrame:
    """Rows of the class sections with their flag list."""
    flags = drop_nulls(
        F.when(F.col("image_only"), F.lit("image-only")),
        F.when(F.col("has_form"), F.lit("form")),
        F.when(F.col("complex_graphic"), F.lit("complex graphic")),
        F.when(~F.col("tagged"), F.lit("untagged")),
    )
    return rows.select(
        "classification", "site", "pdf_url", "parent_url", F.array_join(flags, ", ").alias("flags"),
        "classification_reason",
    )


def write_csv(rows: DataFrame, path: str, compression: str = "none") -> None:
    """CSV with header, in the fixed column order. Existing output is an error.

    Every row repeats the emails of its owner, which are most of the bytes. ``compression`` (``gzip``) is for large exports.
    """
    writer = rows.select(*EXPORT_COLUMNS).write.option("header", True).option("escape", '"')
    writer.option("compression", compression).csv(path)


def write_json(rows: DataFrame, path: str, compression: str = "none") -> None:
    """JSON Lines with every key present and non-ASCII text kept. ``compression`` as in :func:`write_csv`."""
    writer = rows.select(*EXPORT_COLUMNS).write.option("ignoreNullFields", False)
    writer.option("compression", compression).json(path)


def append_failures(failures: DataFrame, path: str) -> None:
    failures.select("site_id", "pdf_id", "error_message").write.mode("append").parquet(path)
