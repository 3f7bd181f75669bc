"""Dead links: HTTP status of files and of the pages that link to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.shared import written


def link_health(files: DataFrame, statuses: DataFrame) -> DataFrame:
    """404 flags of every active file. Only status 404 counts; others clear the flag.

    ``statuses`` (url, status) keeps only its dead links before the joins, so what
    meets the inventory is the small set of URLs that answered 404. It is written first:
    Spark then knows its size, and where it is too large to broadcast, a page that links a
    third of all files can still be split.
    """
    dead = written(statuses.where(F.col("status") == 404).select("url").distinct(), "dead")
    gone_pdf = dead.select(F.col("url").alias("pdf_url"), F.lit(True).alias("_pdf"))
    gone_parent = dead.select(F.col("url").alias("parent_url"), F.lit(True).alias("_parent"))
    active = files.where(~F.col("removed")).drop("pdf_404", "parent_404")
    return (
        active.join(gone_pdf, "pdf_url", "left")
        .join(gone_parent, "parent_url", "left")
        .withColumn("pdf_404", F.coalesce("_pdf", F.lit(False)))
        .withColumn("parent_404", F.coalesce("_parent", F.lit(False)))
        .drop("_pdf", "_parent")
    )


def with_health(files: DataFrame, statuses: DataFrame) -> DataFrame:
    """The whole inventory with the 404 flags of :func:`link_health`; removed files keep theirs.

    No join by id brings the flags back: the rows carry their columns along. Pages are far fewer than files, so the dead
    ones among them are a small table of their own, which mostly spares the inventory the second shuffle.
    """
    dead = written(statuses.where(F.col("status") == 404).select("url").distinct(), "dead")
    pages = files.where(~F.col("removed")).select(F.col("parent_url").alias("url")).distinct()
    dead_pages = written(dead.join(pages, "url", "left_semi"), "dead-pages")
    gone_pdf = dead.select(F.col("url").alias("pdf_url"), F.lit(True).alias("_pdf"))
    gone_parent = dead_pages.select(F.col("url").alias("parent_url"), F.lit(True).alias("_parent"))
    active = ~F.col("removed")
    flags = {
        "pdf_404": F.when(active, F.col("_pdf").isNotNull()).otherwise(F.col("pdf_404")),
        "parent_404": F.when(active, F.col("_parent").isNotNull()).otherwise(F.col("parent_404")),
    }
    joined = files.join(gone_parent, "parent_url", "left").join(gone_pdf, "pdf_url", "left")
    return joined.withColumns(flags).select(*files.columns)


def health_counts(checked: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Checked files and dead links per site; ``sites`` adds a row of zeros for those without."""
    counts = checked.groupBy("site_id").agg(
        F.count("*").alias("checked"),
        F.count_if("pdf_404").alias("pdf_404"),
        F.count_if("parent_404").alias("parent_404"),
    )
    return counts if sites is None else with_zeros(counts, sites)


def with_zeros(counts: DataFrame, sites: DataFrame) -> DataFrame:
    """Counts per site_id for every site; what has no count is zero."""
    numbers = [c for c in counts.columns if c != "site_id"]
    return sites.select("site_id").join(counts, "site_id", "left").select(
        "site_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers]
    )
