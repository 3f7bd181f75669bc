"""The whole scan of a set of sites as optional steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.storage import DEFAULT_TEMPLATE
from docaudit.operators.export import collect_rows, write_csv, write_json
from docaudit.operators.health import health_counts, with_health, with_zeros
from docaudit.operators.inventory import (
    apply_archive,
    flagged_counts,
    replace_rules,
    unverified_files,
    upsert_files_written,
    upsert_reports,
    with_archive_hit,
)
from docaudit.operators.links import crawl_counts
from docaudit.operators.merge import take, update
from docaudit.operators.rules import Policy
from docaudit.operators.status import number_failures, triage_reports
from docaudit.operators.storage import stored_paths
from docaudit.operators.verify import VerifyResult
from docaudit.shared import written
from docaudit.sources.policy import (
    DEFAULT_RULE_POLICY,
    DEFAULT_TRIAGE_PROFILE,
    TriageProfile,
    TriageProfileTable,
)
from docaudit.sources.schemas import FAILURE, align_schema

_WRITERS = {"csv": write_csv, "json": write_json}


@dataclass(frozen=True)
class ScanInputs:
    files: DataFrame
    contacts: DataFrame
    reports: DataFrame
    rules: DataFrame
    found: DataFrame | None = None  # discovered links
    # Results of files known before the run, or a function that checks files: the verify step calls it with the files that
    # need a report, as the steps before left them, and with the stored reports. None: no checker results.
    verification: VerifyResult | Callable[[DataFrame, DataFrame], VerifyResult] | None = None
    statuses: DataFrame | None = None
    policy: Policy = field(default=DEFAULT_RULE_POLICY)  # as table: a DataFrame of any size
    profile: TriageProfile | TriageProfileTable | DataFrame = field(default=DEFAULT_TRIAGE_PROFILE)
    sites: DataFrame | None = None  # site_id and name of all sites of the run; None: those with files
    stored_failures: DataFrame | None = None  # failures of earlier runs, for the next id


@dataclass(frozen=True)
class Storage:
    """Where checked contents are kept."""

    root: str
    date: str
    template: str = DEFAULT_TEMPLATE


def _melt(counts: DataFrame, step: str) -> DataFrame:
    numbers = [c for c in counts.columns if c != "site_id"]
    rows = F.explode(
        F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in numbers])
    )
    return counts.select(
        F.col("site_id").cast("bigint").alias("site_id"), F.lit(step).alias("step"), rows.alias("x")
    ).select("site_id", "step", "x.counter", F.col("x.n").cast("bigint").alias("n"))


@dataclass(frozen=True)
class ScanResult:
    """The tables after the run, and its (site_id, step, counter, n) rows."""

    files: DataFrame
    reports: DataFrame
    rules: DataFrame
    failures: DataFrame | None  # of this run's verification, numbered and stamped
    counts: DataFrame
    # pdf_id, file_hash and local_path of every checked content; a file with several downloads has several
    stored: DataFrame | None = None
    outcomes: DataFrame | None = None  # of this run's verification; a file with several downloads has several


def run_steps(
    inputs: ScanInputs,
    *,
    crawl: bool = True,
    verify: bool = True,
    archive: bool = True,
    check_404: bool = False,
    exports: dict[str, str] | None = None,
    export_compression: str = "none",
    storage: Storage | None = None,
    now: Column | None = None,
) -> ScanResult:
    """Run the steps in order, each on the tables that the steps before it left.

    A verify step without checker results is reported as ``skipped``. ``exports`` maps
    a format to its output path; exported rows show the state after the run, in files with ``export_compression`` (``gzip`` for
    large exports, as every row repeats the emails of its owner). With the run's ``sites`` every step has a
    row of counts for each of them, zeros where a site has no file. ``storage`` (it needs the sites' names) fills
    ``local_path`` of the files whose content was checked. Without any step the tables stay and there are no counts.
    """
    now = F.current_timestamp() if now is None else now
    sites = inputs.sites

    def every_site(counts: DataFrame) -> DataFrame:
        return counts if sites is None else with_zeros(counts, sites)

    files, reports, rules, results = inputs.files, inputs.reports, inputs.rules, []
    failures = stored = outcomes = None
    if crawl and inputs.found is not None:
        after = upsert_files_written(files, inputs.found, now)
        results.append(_melt(crawl_counts(files, after, sites), "crawl"))
        files = after
    if verify and inputs.verification is None:
        skipped = (files if sites is None else sites).select("site_id").distinct().withColumn("skipped", F.lit(1))
        results.append(_melt(skipped, "verify"))
    elif verify:
        done = inputs.verification
        if not isinstance(done, VerifyResult):
            done = done(written(unverified_files(files, reports), "queue"), reports)
        outcomes = written(done.outcomes, "outcomes")
        o = F.col("outcome")
        counts = outcomes.groupBy("site_id").agg(
            *[F.count_if(o == name).alias(name) for name in ("verified", "reused", "failed")]
        )
        results.append(_melt(every_site(counts), "verify"))
        hashed = outcomes.where(F.col("file_hash").isNotNull()).select("pdf_id", "file_hash")
        if storage is None:
            files = update(files, hashed, ["pdf_id"], take("file_hash"))
        else:
            if sites is None:
                raise ValueError("storage paths need the names of the sites")
            named = files.select("pdf_id", "pdf_url", "site_id").join(hashed, "pdf_id")
            named = named.join(sites.select("site_id", F.col("name").alias("site")), "site_id", "left")
            paths = stored_paths(named, root=storage.root, date=storage.date, template=storage.template)
            stored = written(hashed.distinct().join(paths, ["pdf_id", "file_hash"], "left"), "stored-files")
            files = update(files, stored, ["pdf_id"], take("file_hash", "local_path"))
        rules = written(replace_rules(rules, done.rules, done.reports), "rules")
        reports = written(upsert_reports(reports, align_schema(done.reports, reports.schema)), "reports")
        known = inputs.stored_failures
        if known is None:
            known = files.sparkSession.createDataFrame([], FAILURE)
        failures = written(number_failures(done.failures, known, now), "failures")
    # Rules and flags are worked out once, in the pass that writes the files; the counts read a few columns of that table.
    columns, checked = files.columns, check_404 and inputs.statuses is not None
    if archive:
        files = apply_archive(with_archive_hit(files), hit=F.col("_hit"))
    if checked:
        files = with_health(files, inputs.statuses)
    after = written(files, "files")
    files = after.select(*columns)
    if archive:
        results.append(_melt(flagged_counts(after, F.col("_hit"), sites), "archived"))
    if checked:
        results.append(_melt(health_counts(files.where(~F.col("removed")), sites), "check_404"))
    if exports:
        triaged = written(triage_reports(reports, rules, inputs.policy, inputs.profile), "triaged")
        rows = collect_rows(files, inputs.contacts, triaged)
        for fmt, path in exports.items():
            _WRITERS[fmt](rows, path, export_compression)
            counts = files.groupBy("site_id").agg(F.count("*").alias("rows"))
            results.append(_melt(every_site(counts), f"export_{fmt}"))
    counts = files.sparkSession.createDataFrame([], "site_id bigint, step string, counter string, n bigint")
    for r in results:
        counts = counts.unionByName(r)
    return ScanResult(files, reports, rules, failures, counts, stored, outcomes)
