"""Status of the inventory: triage, counts per site, filters and sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.triage import AUTO, GOOD, LABELS, MANUAL, PENDING, triage
from docaudit.operators.merge import lookup_hash
from docaudit.operators.ordering import number_rows
from docaudit.operators.rules import Policy, clause_profile
from docaudit.shared import written
from docaudit.sources.policy import TriageProfile, TriageProfileTable, as_profile


def triage_reports(
    reports: DataFrame,
    rules: DataFrame,
    policy: Policy,
    profile: TriageProfile | TriageProfileTable | DataFrame,
    clauses: DataFrame | None = None,
) -> DataFrame:
    """Reports with classification, reason and confidence.

    ``clauses`` is a stored clause profile of the rules; a stream of reports needs one, or every
    micro-batch would aggregate all rules.

    Everything triage looks at hangs on the content hash, so documents are classified
    once per hash and files only pick the label up.
    """
    profile = as_profile(profile)
    if clauses is None:
        clauses = clause_profile(rules, policy, profile)
    joined = reports.join(clauses, "pdf_hash", "left")
    verdict = triage(
        **{
            name: F.col(name)
            for name in (
                "violations", "tagged", "image_only", "has_form", "complex_graphic", "title_set",
                "language_set", "page_count", "manual_clauses", "neutral_clauses",
            )
        },
        profile=profile.routes,
    )
    return joined.withColumn("_v", verdict).select(
        *reports.columns,
        F.col("_v.label").alias("classification"),
        F.col("_v.reason").alias("classification_reason"),
        F.col("_v.confidence").alias("confidence"),
    )


def pending_if_missing(rows: DataFrame) -> DataFrame:
    """Fill the triage columns of rows that found no report."""
    return (
        rows.withColumn("classification", F.coalesce("classification", F.lit(PENDING)))
        .withColumn(
            "classification_reason",
            F.coalesce("classification_reason", F.lit("not yet verified")),
        )
        .withColumn("confidence", F.coalesce("confidence", F.lit("high")))
    )


def classify_files(files: DataFrame, triaged: DataFrame) -> DataFrame:
    """Classification per file row; files without a report are pending."""
    verdicts = triaged.select(
        "pdf_hash", "violations", "classification", "classification_reason", "confidence"
    )
    return pending_if_missing(lookup_hash(files, verdicts))


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def site_counts_of_files(files: DataFrame, triaged: DataFrame) -> DataFrame:
    """Counts per site over all its files, removed ones included.

    Files are first counted per (content hash, site). That keeps the join with the
    reports free of skew: a hash that a third of all files share arrives there as one
    row per site.
    """
    grouped = files.groupBy("file_hash", "site_id").agg(
        F.count("*").alias("n"),
        _count(F.col("offsite")).alias("n_offsite"),
        _count(F.coalesce(F.col("via_resolver"), F.lit("")) != "").alias("n_resolver"),
        _count(F.col("archived")).alias("n_archived"),
    )
    verdicts = triaged.select("pdf_hash", "violations", "tagged", "image_only", "classification")
    joined = lookup_hash(grouped, verdicts, row="site_id")
    verified = F.col("violations").isNotNull()

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return joined.groupBy("site_id").agg(
        F.sum("n").alias("discovered"),
        F.sum("n_offsite").alias("offsite"),
        F.sum("n_resolver").alias("via_resolver"),
        F.sum("n_archived").alias("archived"),
        total(verified).alias("verified"),
        total(verified & ~F.col("tagged")).alias("untagged"),
        total(verified & F.col("image_only")).alias("image_only"),
        total(F.col("violations") > 0).alias("with_violations"),
        total((F.col("violations") == 0) & F.col("tagged")).alias("likely_passing"),
        *[total(F.col("classification") == label).alias(label) for label in LABELS],
    )


def changed_hashes(old_triaged: DataFrame, new_triaged: DataFrame) -> DataFrame:
    """Content hashes whose counted columns differ between two states of the triaged reports, or are in one of them only."""
    columns = ["pdf_hash", "violations", "tagged", "image_only", "classification"]
    old, new = old_triaged.select(*columns), new_triaged.select(*columns)
    return written(old.exceptAll(new).union(new.exceptAll(old)).select("pdf_hash").distinct(), "changed-hashes")


def update_site_counts(
    counts: DataFrame,
    old_files: DataFrame,
    new_files: DataFrame,
    old_triaged: DataFrame,
    new_triaged: DataFrame,
) -> DataFrame:
    """Counts of :func:`site_counts_of_files` after a change, from the counts before and the rows that changed.

    ``old_files`` and ``new_files`` are the changed files before and after (added ones only after, deleted ones only
    before); where the verdict of a hash changed, all its files are among both. ``old_triaged`` and ``new_triaged`` need to
    hold the reports of these files only. Counts are sums over files, so the difference of two
    small counts is all that is added. Sites whose last file went drop out.
    """
    numbers = [c for c in counts.columns if c != "site_id"]
    added = site_counts_of_files(new_files, new_triaged)
    gone = site_counts_of_files(old_files, old_triaged)
    negative = gone.select("site_id", *[(-F.col(c)).alias(c) for c in numbers])
    every = counts.unionByName(added).unionByName(negative)
    return every.groupBy("site_id").agg(*[F.sum(c).cast("bigint").alias(c) for c in numbers]).where(F.col("discovered") != 0)


def failure_list(failures: DataFrame, site_id: int | None = None) -> DataFrame:
    """Failures by id with their time stamp, of one site or of all."""
    rows = failures if site_id is None else failures.where(F.col("site_id") == site_id)
    return rows.select("failure_id", "site_id", "pdf_id", "error_message", "created_at").orderBy("failure_id")


def number_failures(failures: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """New failures with ids after the highest stored one and a time stamp."""
    highest = stored.agg(F.coalesce(F.max("failure_id"), F.lit(0)).alias("id")).first()["id"]
    order = ["site_id", "pdf_id", "error_message"]
    rows = number_rows(failures.select(*order), *[F.col(c) for c in order])
    return rows.select((F.col("row_no") + highest).alias("failure_id"), *order, now.alias("created_at"))


def failure_counts(failures: DataFrame) -> DataFrame:
    return failures.groupBy("site_id").agg(F.count("*").alias("failures"))


def site_status(
    sites: DataFrame,
    owners: DataFrame,
    files: DataFrame,
    triaged: DataFrame,
    failures: DataFrame,
) -> DataFrame:
    """The status summary of every site, sites without files included."""
    counts = site_counts_of_files(files, triaged)
    numbers = [c for c in counts.columns if c != "site_id"]
    return (
        sites.select("site_id", F.col("name").alias("site"), "owner_id")
        .join(counts, "site_id", "left")
        .join(failure_counts(failures), "site_id", "left")
        .join(
            owners.select("owner_id", F.col("owner_key").alias("owner"), F.col("label").alias("owner_label")),
            "owner_id",
            "left",
        )
        .select(
            "site",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers],
            "owner",
            "owner_label",
            F.coalesce("failures", F.lit(0)).alias("failures"),
        )
    )


def active_counts(sites: DataFrame, files: DataFrame) -> DataFrame:
    """Active files per site, zero kept."""
    counts = files.where(~F.col("removed")).groupBy("site_id").agg(F.count("*").alias("pdfs"))
    return sites.join(counts, "site_id", "left").withColumn("pdfs", F.coalesce("pdfs", F.lit(0)))


def _verified() -> Column:
    return F.col("violations").isNotNull()


STATUS_FILTERS = {
    "all": lambda: F.lit(True),
    "verified": _verified,
    "pending": lambda: ~_verified(),
    "issues": lambda: _verified()
    & ((F.col("violations") > 0) | ~F.col("tagged") | F.col("image_only")),
    "offsite": lambda: F.col("offsite"),
    "archived": lambda: F.col("archived"),
    "broken": lambda: F.col("pdf_404") | F.col("parent_404"),
    "good_to_go": lambda: F.col("classification") == GOOD,
    "auto": lambda: F.col("classification") == AUTO,
    "manual": lambda: F.col("classification") == MANUAL,
}


def filter_rows(rows: DataFrame, name: str) -> DataFrame:
    """One of the named status filters."""
    return rows.where(STATUS_FILTERS[name]())


def sort_rows(rows: DataFrame, by: str = "url") -> DataFrame:
    """``url``, or ``violations``: most first, pending rows last.

    The parent breaks ties, so that one URL on very many pages still splits over tasks.
    """
    ties = [c for c in ("pdf_url", "parent_url") if c in rows.columns]
    if by == "violations":
        return rows.orderBy(
            F.col("violations").isNull(), F.col("violations").desc_nulls_last(), *ties
        )
    return rows.orderBy(*ties)


def status_table(rows: DataFrame, filter_name: str, by: str, limit: int) -> DataFrame:
    """Filter, sort, then keep the first rows (0 keeps all)."""
    table = sort_rows(filter_rows(rows, filter_name), by)
    return table.limit(limit) if limit > 0 else table
