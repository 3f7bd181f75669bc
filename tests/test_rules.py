import json

from pyspark.sql import functions as F

from docaudit.operators import rules as R
from docaudit.operators.verify import assemble_reports
from docaudit.sources.policy import (
    DEFAULT_RULE_POLICY, DEFAULT_TRIAGE_PROFILE, RulePolicy, join_actions, join_classes, read_rule_policy, read_triage_profile,
    rule_policy, triage_profile,
)

# Two counted rules, one ignored by the shipped policy, one that sets a flag, and a number with a fraction part.
SUMMARIES = [
    {"clause": "8.4.1", "testNumber": 2, "failedChecks": 12, "status": "failed"},
    {"clause": "7.21.4.2", "testNumber": "1", "failedChecks": 50},
    {"clause": "7.18.5", "testNumber": "1", "failedChecks": 7.0},
    {"clause": "7.1", "testNumber": "3", "failedChecks": 2, "ruleStatus": "FAILED", "specification": "spec", "description": "text"},
    {"clause": "9", "testNumber": "1", "failedChecks": "many"},
]


def _report(result):
    return json.dumps({"report": {"jobs": [{"validationResult": result}]}})


def _reports(spark, bodies):
    return spark.createDataFrame(list(bodies.items()), "pdf_hash string, report_json string")


def test_shapes(spark):
    details = {"details": {"ruleSummaries": SUMMARIES}}
    reports = _reports(
        spark,
        {
            "object": _report(details), "list": _report([details]), "empty": _report([]),
            "none": json.dumps({"report": {"jobs": [{}]}}), "nojobs": json.dumps({"report": {"jobs": []}}),
            "norules": _report({"details": {"ruleSummaries": []}}), "bad": "{oops", "nothing": "{}",
        },
    )
    rules = R.extract_rules(reports)
    rows = {(r["pdf_hash"], r["clause"], r["test_number"]): r for r in rules.collect()}
    assert len(rows) == 2 * len(SUMMARIES)
    last = rows["object", "7.1", "3"]
    assert (last["status"], last["failed_checks"], last["specification"], last["description"]) == ("FAILED", 2, "spec", "text")
    assert rows["list", "8.4.1", "2"]["status"] == "failed"
    assert [rows["object", c, "1"]["failed_checks"] for c in ("7.18.5", "9")] == [7, 0]
    summary = {r["pdf_hash"]: r[1:] for r in R.summarize(rules, DEFAULT_RULE_POLICY, reports).collect()}
    clean = (0, 0, True, False)
    assert summary == {
        "object": (4, 21, True, True), "list": (4, 21, True, True), "empty": clean, "none": clean,
        "nojobs": clean, "norules": clean, "bad": clean, "nothing": clean,
    }


def test_batch_names(spark):
    body = {"report": {"jobs": [
        {"itemDetails": {"name": "/tmp/x/a.pdf"}, "validationResult": [{"details": {"ruleSummaries": SUMMARIES[:1]}}]},
        {"itemDetails": {"name": "b.pdf"}, "validationResult": []}, {"itemDetails": {}},
    ]}}
    batches = _reports(spark, {"run": json.dumps(body)})
    files = spark.createDataFrame([("t/a.pdf",), ("t/b.pdf",), ("t/c.pdf",)], "path string")
    got = {r["path"]: r["has_result"] for r in R.match_jobs(files, R.batch_jobs(batches)).collect()}
    assert got == {"t/a.pdf": True, "t/b.pdf": True, "t/c.pdf": False}
    assert [r["job_name"] for r in R.extract_job_rules(batches).collect()] == ["a.pdf"]


def test_later_report_wins(spark):
    def body(*jobs):
        return json.dumps({"report": {"jobs": [{"itemDetails": {"name": n}, "validationResult": {"n": r}} for n, r in jobs]}})

    batches = spark.createDataFrame(
        [(1, body(("x/a.pdf", 1), ("a.pdf", 2), ("b.pdf", 3))), (2, body(("y/a.pdf", 4), ("c/", 5)))], "seq int, report_json string"
    )
    want = [("a.pdf", '{"n":4}'), ("b.pdf", '{"n":3}')]
    for order in (None, F.col("seq")):
        got = R.batch_jobs(batches.coalesce(1), order=order).collect()
        assert sorted((r["job_name"], r["validation_result"].replace(" ", "")) for r in got) == want
    first = R.batch_jobs(batches, order=-F.col("seq")).collect()
    assert {r["job_name"]: r["validation_result"].replace(" ", "") for r in first} == {"a.pdf": '{"n":2}', "b.pdf": '{"n":3}'}


def test_large_policy(spark):
    policy = RulePolicy(
        frozenset((f"1.{i}", "1") for i in range(10_000)), {(f"2.{i}", "1"): ("tagged", "image_only")[i % 2] for i in range(10_000)}
    )
    rows = [("h", "1.9999", "1", 1), ("h", "2.9998", "1", 1), ("h", "2.7", "1", 1), ("h", "3", "1", 1)]
    rules = spark.createDataFrame(rows, "pdf_hash string, clause string, test_number string, failed_checks bigint")
    assert R.summarize(rules, policy).collect()[0][1:] == (3, 3, False, True)
    table = spark.createDataFrame(policy.rows() + [("2.7", "1", "ignore")], "clause string, test_number string, action string")
    got = {r["clause"]: r["action"] for r in join_actions(rules, table).collect()}
    assert got == {"1.9999": "ignored", "2.9998": "tagged", "2.7": "ignored", "3": "counts"}


def test_classes_by_literal_and_by_join(spark):
    classes = {"7": "auto", "7.1": "manual", "7.1.2": "auto"} | {f"8.{i}": "manual" for i in range(3000)}
    clauses = spark.createDataFrame([(c,) for c in ("7.1", "7.1.2.9", "7.12", "8.2999.1", "8", "9", None)], "clause string")
    want = {"7.1": "manual", "7.1.2.9": "auto", "7.12": "auto", "8.2999.1": "manual", "8": None, "9": None, None: None}
    profile = triage_profile([("clause_class", k, v) for k, v in classes.items()])
    assert dict(clauses.select("clause", profile.class_for(F.col("clause"))).collect()) == want
    table = spark.createDataFrame(list(classes.items()), "key string, value string")
    assert {r["clause"]: r["class"] for r in join_classes(clauses, table).collect()} == want


def test_duplicates_count_twice_and_nulls_match_nothing(spark):
    rules = spark.createDataFrame(
        [("h", "7.5", "1", 2), ("h", "7.5", "1", 3), ("h", None, "10", 1), ("h", "7.2", None, 1)],
        "pdf_hash string, clause string, test_number string, failed_checks bigint",
    )
    assert R.summarize(rules, DEFAULT_RULE_POLICY).collect()[0][1:3] == (4, 7)


def test_ignore_beats_flag_and_rescore(spark):
    rules = spark.createDataFrame(
        [("h", "7.1", "11", 1)], "pdf_hash string, clause string, test_number string, failed_checks bigint"
    )
    both = RulePolicy(frozenset({("7.1", "11")}), {("7.1", "11"): "tagged"})
    assert R.summarize(rules, both).collect()[0][1:] == (0, 0, True, False)
    analysis = spark.createDataFrame(
        [], "pdf_hash string, text_type string, title_set boolean, language_set boolean, page_count bigint, "
        "has_form boolean, complex_graphic boolean")
    report = assemble_reports(R.summarize(rules, DEFAULT_RULE_POLICY), analysis)
    row = report.collect()[0]
    assert (row["tagged"], row["title_set"], row["page_count"]) == (False, False, None)
    assert R.rescore(report, rules, both).collect()[0]["tagged"] is True
    # An unchanged policy gives the stored report again.
    assert R.rescore(report, rules, DEFAULT_RULE_POLICY).collect() == report.collect()


def test_clause_prefixes(each):
    p = DEFAULT_TRIAGE_PROFILE
    assert each(["7.18.6.2", "7.1", "7.10", "7.18", "7", "7.2.1", None], p.class_for(F.col("x"))) == [
        "manual", "auto", None, "manual", None, "auto", None,
    ]


def test_policy_tables(spark, tmp_path):
    assert rule_policy(DEFAULT_RULE_POLICY.rows()) == DEFAULT_RULE_POLICY
    assert triage_profile(DEFAULT_TRIAGE_PROFILE.rows()) == DEFAULT_TRIAGE_PROFILE
    assert read_rule_policy(spark, str(tmp_path / "none")) == RulePolicy()
    assert read_triage_profile(spark, str(tmp_path / "none")) == DEFAULT_TRIAGE_PROFILE
    path = str(tmp_path / "policy")
    spark.createDataFrame(DEFAULT_RULE_POLICY.rows(), "clause string, test_number string, action string").write.parquet(path)
    assert read_rule_policy(spark, path) == DEFAULT_RULE_POLICY
    partial = triage_profile([("score", "start", "80"), ("score", "per_violation", "many"), ("good_to_go", "require_title", "true")])
    assert partial.score["start"] == 80 and partial.score["per_violation"] == 4
    assert partial.clause_class == DEFAULT_TRIAGE_PROFILE.clause_class and partial.require_title
