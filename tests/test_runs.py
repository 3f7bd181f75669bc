"""Runs read the inventory once and work out flags in one pass."""

import os

import pytest
from docaudit.functions.archive import archive_reason, is_archived
from docaudit.operators import inventory as I
from docaudit.operators.health import link_health, with_health
from docaudit.operators.verify import VerifyResult
from docaudit.plans import jobs
from docaudit.plans import queries_jobs as Q
from docaudit.plans.catalog import QUERIES
from docaudit.plans.fixtures import Fixtures
from docaudit.plans.jobs import ScanInputs, run_steps
from docaudit.plans.queries_verify import verify_run
from docaudit.shared import new_path
from docaudit.sources.schemas import EXPORT_COLUMNS
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"

FILE = (
    "pdf_id bigint, pdf_url string, parent_url string, site_id bigint, file_hash string, via_resolver string, offsite boolean, "
    "scanned_at timestamp, pdf_404 boolean, parent_404 boolean, archived boolean, removed boolean"
)


def _files(spark):
    def row(i, url, parent, removed, flag=True):
        return (i, url, parent, 1, None, None, False, None, flag, flag, False, removed)

    return spark.createDataFrame(
        [row(1, "a", "p", False), row(2, "b", "p", False), row(3, "a", "q", True), row(4, "c", "a", None), row(5, None, None, False),
         row(6, "d", "b", False, None)], FILE,
    )


def test_stored_view_is_read_by_later_queries(spark):
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    before = sorted(map(tuple, fx.view("v_http_status").collect()))
    stored = fx.stored("v_pdf_files")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (stored, fx.files, fx.view("v_http_status"))]
    leaves = [set(df.inputFiles()) for df in (stored, fx.files, fx.view("v_http_status"))]
    assert all(plans) and all(not any("lineitem" in f for f in files) for files in leaves)
    assert sorted(map(tuple, fx.view("v_http_status").collect())) == before


def test_health_in_one_pass_equals_health_by_id(spark):
    files = _files(spark)
    dead = spark.createDataFrame([("a", 404), ("a", 404), ("p", 404), ("b", 200), ("d", None), (None, 404)], "url string, status int")
    want = I.set_404(files, link_health(files, dead).select("pdf_id", "pdf_404", "parent_404"))
    got = with_health(files, dead)
    assert got.columns == files.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_upsert_with_one_join_equals_upsert(spark):
    files = _files(spark)
    links = [("a", "q", 1, "x", True), ("a", "q", 1, "y", False), ("n", "p", 1, None, True), ("m", "p", 1, None, False), (None, None, 1, "z", True)]
    found = spark.createDataFrame(links, "pdf_url string, parent_url string, site_id bigint, via_resolver string, offsite boolean")
    now = F.expr("TIMESTAMP '2026-01-31 12:00:00'")
    want, got = I.upsert_files(files, found, now), I.upsert_files_written(files, found, now)
    assert got.columns == files.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_archived_without_a_look_at_the_path(each):
    urls = [
        "https://x/ARCHIVE.pdf", "https://x/a?b=legacy", "https://x/a%3Flegacy", "https://x/%6cegacy", "https://x/Doc%20a.pdf", "https://old/a.pdf",
        "https://x/old/a.pdf", "https://x/a_old.pdf", "https://x/a%5fold.pdf", "https://x/Past%20-events", "https://x/%zzlegacy", None, "",
    ]
    want = each(urls, archive_reason(F.col("x")).isNotNull())
    assert each(urls, is_archived(F.col("x"))) == want


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_a_run_writes_its_export_compressed_and_whole(spark, monkeypatch):
    made = []
    monkeypatch.setattr(Q, "new_path", lambda s, label: made.append(new_path(s, label)) or made[-1])
    counts = QUERIES["run_steps_verify"].run(spark, SF_DIR)
    exported = sum(r["n"] for r in counts.where("step = 'export_csv'").collect())
    (path,) = made
    parts = [p for p in os.listdir(path) if p.startswith("part-")]
    assert parts and all(p.endswith(".csv.gz") for p in parts)
    rows = spark.read.csv(path, header=True, escape='"')
    fx = Fixtures(spark, SF_DIR)
    assert rows.columns == EXPORT_COLUMNS and rows.count() == exported == fx.files.count()
    columns = ["pdf_url", "parent_url", "site", "responsible"]
    contacts = I.site_contacts(fx.sites, fx.owners, fx.people, fx.memberships)
    want = fx.files.join(contacts, "site_id").select(*columns)
    assert rows.select(*columns).exceptAll(want).count() == want.exceptAll(rows.select(*columns)).count() == 0


def test_exports_of_a_run_stay_plain_unless_asked(spark, tmp_path):
    files = _files(spark).limit(2).withColumn("local_path", F.lit(None).cast("string"))
    contacts = spark.createDataFrame([(1, "hr", "grp", "p@example.edu")], "site_id bigint, site string, owner string, responsible string")
    fx = Fixtures(spark, SF_DIR)
    inputs = ScanInputs(files, contacts, fx.report_plan.limit(0), fx.rules.limit(0))
    paths = {c: {f: str(tmp_path / f"{c}-{f}") for f in ("csv", "json")} for c in ("none", "gzip")}
    run_steps(inputs, crawl=False, verify=False, archive=False, exports=paths["none"])
    run_steps(inputs, crawl=False, verify=False, archive=False, exports=paths["gzip"], export_compression="gzip")
    for fmt in ("csv", "json"):
        plain, packed = (spark.read.text(paths[c][fmt]).collect() for c in ("none", "gzip"))
        assert sorted(plain) == sorted(packed) and len(set(plain)) >= 2
        assert any(p.endswith(f".{fmt}") for p in os.listdir(paths["none"][fmt]))
        assert not any(p.endswith(f".{fmt}") for p in os.listdir(paths["gzip"][fmt]))


def test_the_verify_step_checks_what_the_steps_before_left(spark):
    def file(i, url, file_hash, dead=False, removed=False):
        return (i, url, "p", 1, file_hash, None, False, None, dead, False, False, removed)

    files = spark.createDataFrame(
        [file(1, "old", None), file(2, "known", "h"), file(3, "lost", "x"), file(4, "dead", None, dead=True),
         file(5, "gone", None, removed=True), file(6, "back", None, removed=True)], FILE,
    )
    found = spark.createDataFrame([("new", "p", 1, None, False), ("back", "p", 1, None, False)], (
        "pdf_url string, parent_url string, site_id bigint, via_resolver string, offsite boolean"
    ))
    fx = Fixtures(spark, SF_DIR)
    reports, rules = fx.report_plan, fx.rules.limit(0)
    empty = reports.limit(0)
    stored = spark.createDataFrame([("h",)], "pdf_hash string").join(empty, "pdf_hash", "left").select(*reports.columns)
    asked = []

    def check(queue, known):
        asked.extend([{r["pdf_url"] for r in queue.collect()}, {r["pdf_hash"] for r in known.collect()}])
        ok = F.col("pdf_url") != "old"
        outcomes = queue.select(
            "pdf_id", "site_id", F.when(ok, F.concat(F.lit("h-"), "pdf_url")).alias("file_hash"),
            F.when(ok, "verified").otherwise("failed").alias("outcome"), F.when(~ok, "broken").alias("error"),
        )
        bad = outcomes.where("error IS NOT NULL").select("site_id", "pdf_id", F.col("error").alias("error_message"))
        return VerifyResult(outcomes, empty, rules, bad)

    done = run_steps(ScanInputs(files, files, stored, rules, found=found, verification=check), archive=False)
    assert asked == [{"old", "lost", "back", "new"}, {"h"}]
    hashes = {r["pdf_url"]: r["file_hash"] for r in done.files.collect()}
    assert hashes == {"old": None, "known": "h", "lost": "h-lost", "dead": None, "gone": None, "back": "h-back", "new": "h-new"}
    counts = {r["counter"]: r["n"] for r in done.counts.where("step = 'verify'").collect()}
    assert counts == {"verified": 3, "reused": 0, "failed": 1} and done.outcomes.count() == 4
    assert [r["error_message"] for r in done.failures.collect()] == ["broken"]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_the_files_query_shows_the_hashes_that_the_verify_step_left(spark, monkeypatch):
    want = sorted(map(str, QUERIES["run_steps_files"].run(spark, SF_DIR).collect()))
    monkeypatch.setattr(jobs, "update", lambda files, *_: files)
    got = sorted(map(str, QUERIES["run_steps_files"].run(spark, SF_DIR).collect()))
    assert any("file_hash='" in row for row in want) and got != want


def test_export_meets_the_site_ids_without_a_shuffle_of_the_inventory(spark):
    fx = Fixtures(spark, SF_DIR)
    contacts = I.site_contacts(fx.sites, fx.owners, fx.people, fx.memberships)
    files, triaged, name = fx.stored("v_pdf_files"), fx.triaged, "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "4k")
    try:
        plan = I.export_rows(files, contacts, triaged)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    semi = [x for x in plan.splitlines() if "LeftSemi" in x]
    assert semi and all("BroadcastHashJoin" in x for x in semi)


def test_verification_groups_the_texts_once(spark):
    fx = Fixtures(spark, SF_DIR)
    verify_run(fx)
    views = ("v_doc_known", "v_doc_rule", "v_doc_analysis")
    assert not any("documents" in f for v in views for f in fx.view(v).inputFiles())
