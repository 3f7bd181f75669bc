import hashlib
import json

from docaudit.operators import verify as V
from docaudit.operators.health import health_counts, link_health
from docaudit.sources.policy import DEFAULT_RULE_POLICY

RULES = {"details": {"ruleSummaries": [{"clause": "7.1", "testNumber": "11", "failedChecks": 2}]}}
ANALYSIS = (
    "pdf_hash string, text_type string, title_set boolean, language_set boolean, page_count bigint, "
    "has_form boolean, complex_graphic boolean, encrypted boolean"
)


def _sha(data):
    return hashlib.sha256(data).hexdigest()


def _verify(spark, files, downloads, jobs, analysis=(), known=(), **kwargs):
    return V.verify(
        spark.createDataFrame(files, "pdf_id bigint, site_id bigint, pdf_url string"),
        spark.createDataFrame([(u, bytearray(c) if c is not None else None, e) for u, c, e in downloads], "pdf_url string, content binary, error string"),
        spark.createDataFrame([(f"{h}.pdf", json.dumps(RULES)) for h in jobs], "job_name string, validation_result string"),
        spark.createDataFrame(list(analysis), ANALYSIS),
        spark.createDataFrame([(k,) for k in known], "pdf_hash string"),
        DEFAULT_RULE_POLICY, **kwargs,
    )


def test_outcomes(spark):
    a, b = b"%PDF-1.7 a", b"\xef\xbb\xbf%PDF-1.7 b"
    files = [(1, 1, "u1"), (2, 1, "u2"), (3, 1, "u3"), (4, 1, "u4"), (5, 1, "u5")]
    downloads = [("u1", a, None), ("u2", a, None), ("u3", b, None), ("u4", b"<html>login</html>", None), ("u5", None, "boom")]
    r = _verify(spark, files, downloads, [_sha(a), _sha(b)], [(_sha(a), "Text", True, False, 4, False, False, False)])
    assert V.outcome_counts(r.outcomes).collect() == [(2, 1, 2)]
    assert {f["error_message"] for f in r.failures.collect()} == {"not a PDF (content): u4", "download u5: boom"}
    reports = {x["pdf_hash"]: (x["violations"], x["tagged"], x["page_count"]) for x in r.reports.collect()}
    assert reports == {_sha(a): (1, False, 4), _sha(b): (1, False, None)}
    assert r.rules.count() == 2


def test_failures_fan_out_and_encrypted_note(spark):
    lost, locked, known = b"%PDF-lost", b"%PDF-locked", b"%PDF-known"
    files = [(1, 1, "a"), (2, 1, "a"), (3, 2, "b"), (4, 2, "c"), (5, 2, "d"), (6, 2, "e")]
    downloads = [("a", lost, None), ("b", locked, None), ("c", locked, None), ("d", known, None), ("e", b"%PDF-" + b"x" * 40, None)]
    r = _verify(
        spark, files, downloads, [_sha(locked)], [(_sha(locked), None, None, None, None, None, None, True)],
        [_sha(known)], max_bytes=30,
    )
    got = {o["pdf_id"]: o["outcome"] for o in r.outcomes.collect()}
    assert got == {1: "failed", 2: "failed", 3: "verified", 4: "reused", 5: "reused", 6: "failed"}
    notes = sorted((f["pdf_id"], f["error_message"]) for f in r.failures.collect())
    message = "verapdf a: veraPDF returned no result for this file"
    assert notes == [
        (1, message), (2, message), (3, "encrypted (structural analysis skipped): b"), (6, "download e: PDF exceeds max_bytes (30)"),
    ]
    row = r.reports.collect()[0]
    assert (row["title_set"], row["page_count"], row["has_form"]) == (False, None, False)


def test_marker_window(spark):
    rows = [(bytearray(b"x" * 1019 + b"%PDF-"),), (bytearray(b"x" * 1020 + b"%PDF-"),), (None,), (bytearray(b""),)]
    df = spark.createDataFrame(rows, "content binary")
    assert [r[0] for r in df.select(V.looks_like_pdf(df.content)).collect()] == [True, False, False, False]


def test_dead_links(spark):
    files = spark.createDataFrame(
        [(1, 1, "u", "p", False, True, True), (2, 1, "v", "q", False, False, False), (3, 1, "w", "q", True, False, False)],
        "pdf_id bigint, site_id bigint, pdf_url string, parent_url string, removed boolean, pdf_404 boolean, parent_404 boolean",
    )
    statuses = spark.createDataFrame([("u", 500), ("v", 404), ("q", 404), ("p", None)], "url string, status int")
    checked = link_health(files, statuses)
    assert {r["pdf_id"]: (r["pdf_404"], r["parent_404"]) for r in checked.collect()} == {1: (False, False), 2: (True, True)}
    assert health_counts(checked).collect() == [(1, 2, 1, 1)]
