"""Pages that share a URL: downloads of one URL, each counted as the check SQL counts it."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from docaudit.operators import verify as V
from docaudit.plans.catalog import QUERIES
from docaudit.plans.jobs import ScanInputs, Storage, run_steps
from docaudit.sources.policy import DEFAULT_RULE_POLICY

SF_DIR = "/root/testdata/sf0.001"
QUERIES_ON_DOWNLOADS = [
    "src_pdf_bytes", "pdf_magic", "verify_outcome", "verify_counts", "verify_failures", "run_steps_verify", "run_steps_files",
    "run_steps_storage", "run_steps_failures",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables, but every third page has the URL of the page before, with another text, the same one or a PDF's."""
    root = tmp_path_factory.mktemp("repeated")
    for name in os.listdir(SF_DIR):
        if name != "pages.parquet":
            os.symlink(f"{SF_DIR}/{name}", root / name)
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    rows, before = [], None
    for row in pages.orderBy("page_id").collect():
        i, url, html = row["page_id"], row["url"], row["html"]
        if i % 3 == 1:
            url = before["url"]
            html = before["html"] if i % 9 == 1 else "%PDF-1.4 " + html if i % 12 == 4 else html + "x" * 4000
        rows.append((i, url, html))
        before = row
    spark.createDataFrame(rows, pages.schema).write.parquet(str(root / "pages.parquet"))
    return str(root)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", QUERIES_ON_DOWNLOADS)
def test_matches_check_sql(spark, folder, name):
    import duckdb

    from check import compare
    from docaudit.plans.fixtures import BASE_TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    ok, note = compare(QUERIES[name].run(spark, folder), con, QUERIES[name].sql)
    assert ok, note


def test_a_run_keeps_every_content_of_a_url(spark):
    a, b = b"%PDF-1.7 a", b"%PDF-1.7 b"
    hashes = [hashlib.sha256(x).hexdigest() for x in (a, b)]
    files = spark.createDataFrame([(1, 1, "u"), (2, 1, "v")], "pdf_id long, site_id long, pdf_url string")
    files = files.select("*", *[F.lit(None).cast("string").alias(c) for c in ("file_hash", "local_path")])
    downloads = spark.createDataFrame(
        [("u", bytearray(a), None), ("u", bytearray(b), None), ("u", None, "gone"), ("v", bytearray(b), None)],
        "pdf_url string, content binary, error string",
    )
    rules = json.dumps({"details": {"ruleSummaries": [{"clause": "7.1", "testNumber": "11", "failedChecks": 2}]}})
    jobs = spark.createDataFrame([(f"{h}.pdf", rules) for h in hashes], "job_name string, validation_result string")
    analysis = spark.createDataFrame(
        [], "pdf_hash string, text_type string, title_set boolean, language_set boolean, page_count bigint, has_form boolean, "
        "complex_graphic boolean, encrypted boolean",
    )
    known = spark.createDataFrame([], "pdf_hash string")
    result = V.verify(files, downloads, jobs, analysis, known, DEFAULT_RULE_POLICY, every_download=True)
    got = sorted((r["pdf_id"], r["outcome"], r["file_hash"] or "") for r in result.outcomes.collect())
    want = [(1, "failed", ""), (1, "verified", hashes[0]), (1, "verified", hashes[1]), (2, "reused", hashes[1])]
    assert got == sorted(want)
    sites = spark.createDataFrame([(1, "hr")], "site_id long, name string")
    stored_rules = result.rules.limit(0)
    inputs = ScanInputs(files, sites, result.reports.limit(0), stored_rules, verification=result, sites=sites)
    done = run_steps(inputs, crawl=False, archive=False, storage=Storage("/data", "2026-01-31"))
    paths = {(r["pdf_id"], r["file_hash"]): r["local_path"] for r in done.stored.collect()}
    assert paths == {(i, h): f"/data/hr/{h}.pdf" for i, h in ((1, hashes[0]), (1, hashes[1]), (2, hashes[1]))}
    kept = {r["pdf_id"]: (r["file_hash"], r["local_path"]) for r in done.files.collect()}
    assert kept == {i: (h, f"/data/hr/{h}.pdf") for i, h in ((1, max(hashes)), (2, hashes[1]))}
