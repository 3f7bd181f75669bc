import dataclasses

from docaudit.operators.evaluate import accuracy, confusion, per_class
from docaudit.operators.status import classify_files, filter_rows, sort_rows, triage_reports
from docaudit.sources.policy import DEFAULT_RULE_POLICY, DEFAULT_TRIAGE_PROFILE, RulePolicy

GOOD, AUTO, MANUAL = "good_to_go", "fit_for_automated_tagging", "needs_manual_remediation"
REPORT = (
    "pdf_hash string, violations bigint, tagged boolean, image_only boolean, has_form boolean, "
    "complex_graphic boolean, title_set boolean, language_set boolean, page_count bigint"
)
RULE = "pdf_hash string, clause string, test_number string, failed_checks bigint"


def _triage(spark, rules=(), profile=DEFAULT_TRIAGE_PROFILE, policy=DEFAULT_RULE_POLICY, **fields):
    base = dict(
        pdf_hash="h", violations=0, tagged=True, image_only=False, has_form=False, complex_graphic=False,
        title_set=True, language_set=True, page_count=3,
    )
    base.update(fields)
    reports = spark.createDataFrame([tuple(base.values())], REPORT)
    rows = spark.createDataFrame([("h", c, t, 1) for c, t in rules], RULE)
    r = triage_reports(reports, rows, policy, profile).collect()[0]
    return r["classification"], r["confidence"], r["classification_reason"]


def test_routes(spark):
    assert _triage(spark) == (GOOD, "high", "tagged, no counted violations")
    assert _triage(spark, image_only=True)[:2] == (MANUAL, "high")
    assert _triage(spark, has_form=True)[2] == "interactive form needs manual field labels"
    assert _triage(spark, complex_graphic=True)[:2] == (MANUAL, "borderline")
    assert _triage(spark, [("7.3", "1"), ("7.18.6.2", "9"), ("7.1", "1")], violations=3)[2] == (
        "manual-only clause(s): 7.18.6.2, 7.3"
    )
    assert _triage(spark, violations=None)[0] == "pending"


def test_score_boundary(spark):
    assert _triage(spark, violations=12, tagged=False)[:2] == (AUTO, "borderline")
    label, confidence, reason = _triage(spark, violations=13, tagged=False)
    assert (label, confidence) == (MANUAL, "borderline")
    assert reason == "score 48 < 50 (too many or unknown violations)"
    neutral = [(f"9.{i}", "1") for i in range(8)]
    assert _triage(spark, neutral, violations=2)[:2] == (MANUAL, "high")


def test_profile_changes(spark):
    strict = dataclasses.replace(DEFAULT_TRIAGE_PROFILE, require_title=True)
    label, _, reason = _triage(spark, profile=strict, title_set=False)
    assert label == AUTO and reason == "missing title"
    loose = dataclasses.replace(DEFAULT_TRIAGE_PROFILE, structural={})
    assert _triage(spark, profile=loose, image_only=True)[0] == GOOD


def test_ignored_rule_is_not_counted(spark):
    policy = RulePolicy(frozenset({("7.3", "1")}))
    assert _triage(spark, [("7.3", "1")], policy=policy)[0] == GOOD


def test_files_without_report_are_pending(spark):
    files = spark.createDataFrame([("u1", "h"), ("u2", None), ("u3", "x")], "pdf_url string, file_hash string")
    triaged = triage_reports(
        spark.createDataFrame([("h", 0, True, False, False, False, True, True, 1)], REPORT),
        spark.createDataFrame([], RULE), DEFAULT_RULE_POLICY, DEFAULT_TRIAGE_PROFILE,
    )
    got = {r["pdf_url"]: r["classification"] for r in classify_files(files, triaged).collect()}
    assert got == {"u1": GOOD, "u2": "pending", "u3": "pending"}


def test_filters_and_sorts(spark):
    rows = spark.createDataFrame(
        [("b", 0, True, False), ("a", None, None, None), ("d", 5, True, False), ("c", 5, False, False)],
        "pdf_url string, violations bigint, tagged boolean, image_only boolean",
    )
    assert [r[0] for r in sort_rows(rows, "violations").collect()] == ["c", "d", "b", "a"]
    assert [r[0] for r in sort_rows(rows, "url").collect()] == ["a", "b", "c", "d"]
    assert {r[0] for r in filter_rows(rows, "issues").collect()} == {"c", "d"}
    assert {r[0] for r in filter_rows(rows, "pending").collect()} == {"a"}


def test_metrics(spark):
    pairs = spark.createDataFrame(
        [(GOOD, GOOD), (GOOD, AUTO), (AUTO, AUTO), (MANUAL, "error")], "expected string, predicted string"
    )
    assert accuracy(pairs).collect()[0][:] == (4, 0.5)
    cells = {(r[0], r[1]): r[2] for r in confusion(pairs).collect()}
    assert len(cells) == 9 and cells[GOOD, AUTO] == 1 and cells[MANUAL, MANUAL] == 0
    stats = {r["label"]: (r["precision"], r["recall"], r["support"]) for r in per_class(pairs).collect()}
    assert stats == {GOOD: (1.0, 0.5, 2), AUTO: (0.5, 1.0, 1), MANUAL: (0.0, 0.0, 1)}
    assert accuracy(pairs.limit(0)).collect()[0][:] == (0, 0.0)
