"""Share links to inventory rows or failure rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.functions.share_pages import resolve_share, resolver_name
from docaudit.shared import written

NO_URLS = "no pdf urls"


def join_share_pages(links: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Share links with the page they point to, if it was fetched.

    The page text travels only once per distinct share URL: links are many, share
    pages few.
    """
    pages = snapshots.select(F.col("url").alias("share_url"), F.col("html").alias("share_html"))
    wanted = links.select("share_url").distinct()
    return wanted.join(pages, "share_url", "left")


def resolve_links(
    links: DataFrame, snapshots: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Resolve (site_id, parent_url, share_url, via_resolver, offsite) rows.

    Returns discovered files and failures. Share pages are resolved where they are read,
    so the page text never reaches a shuffle; only the short result is joined to the links. The joined rows are written,
    as both results start from them.
    """
    url = F.col("url")
    resolved = snapshots.where(resolver_name(url).isNotNull()).select(
        url.alias("share_url"), resolve_share(url, F.col("html")).alias("r")
    )
    fetched = links.join(resolved, "share_url", "left")
    # A link without a snapshot resolves like a page that could not be fetched.
    missing = resolve_share(F.col("share_url"), F.lit(None).cast("string"))
    rows = fetched.select("site_id", "parent_url", "share_url", "via_resolver", "offsite", F.coalesce("r", missing).alias("r"))
    joined = written(rows, "resolved")
    ok = F.col("r.error").isNull() & F.col("r.pdf_url").isNotNull()
    files = (
        joined.where(ok)
        .select(F.col("r.pdf_url").alias("pdf_url"), "parent_url", "site_id", "via_resolver", "offsite")
        .dropDuplicates(["pdf_url", "parent_url"])
    )
    failures = joined.where(~ok).select(
        "site_id",
        F.lit(None).cast("bigint").alias("pdf_id"),
        F.concat(
            F.lit("resolve "),
            F.col("share_url"),
            F.lit(": "),
            F.coalesce("r.error", F.lit(NO_URLS)),
        ).alias("error_message"),
    )
    return files, failures
