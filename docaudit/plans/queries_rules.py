"""Queries on checker reports, rules and triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.functions.triage import auto_reason, structural_route, triage_score
from docaudit.operators import rules as R
from docaudit.operators.evaluate import (
    accuracy,
    confusion,
    folder_label,
    labelled,
    mismatches,
    per_class,
    predict,
)
from docaudit.operators.status import classify_files, triage_reports
from docaudit.operators.verify import assemble_reports
from docaudit.operators.merge import lookup_hash
from docaudit.plans.fixtures import Fixtures
from docaudit.plans.registry import query
from docaudit.shared import written
from docaudit.sources.policy import (
    DEFAULT_RULE_POLICY,
    DEFAULT_TRIAGE_PROFILE,
    RulePolicy,
    rule_policy,
    triage_profile,
)

POLICY, PROFILE = DEFAULT_RULE_POLICY, DEFAULT_TRIAGE_PROFILE
# Another policy, to rescore with: fewer exceptions, one more flag.
STRICT = RulePolicy(
    ignore=frozenset({("7.2", "10")}), flags={("7.1", "4"): "tagged", ("7.2", "2"): "image_only"}
)
CUSTOM_PROFILE = triage_profile(
    [
        ("clause_class", "9", "manual"),
        ("clause_class", "7.21", "auto"),
        ("clause_class", "7.21.4", "manual"),
        ("score", "start", "90"),
        ("score", "per_violation", "many"),
        ("score", "per_page_over", "0.5"),
        ("good_to_go", "require_title", "true"),
    ]
)


@query(
    "src_checker_json",
    """SELECT pdf_hash, '/scan/' || pdf_hash || '.pdf' AS name, COUNT(*) AS n_rules
       FROM v_report_rule GROUP BY pdf_hash""",
)
def _(fx: Fixtures):
    job = F.get(R.report_jobs(F.col("report_json")), F.lit(0))
    return fx.checker_reports().select("pdf_hash", job.alias("job")).select(
        "pdf_hash",
        F.col("job.itemDetails.name").alias("name"),
        F.size(R.job_rules(F.col("job.validationResult"))).cast("bigint").alias("n_rules"),
    )


@query(
    "extract_rules",
    """SELECT pdf_hash, clause, test_number, status, failed_checks, specification, description
       FROM v_report_rule""",
)
def _(fx: Fixtures):
    return R.extract_rules(fx.checker_reports())


@query(
    "extract_job_rules",
    """SELECT pdf_hash || '.pdf' AS job_name, clause, test_number, failed_checks FROM v_report_rule""",
)
def _(fx: Fixtures):
    return R.extract_job_rules(fx.checker_reports()).select(
        "job_name", "clause", "test_number", "failed_checks"
    )


@query(
    "batch_job_match",
    """SELECT f.file_hash, s.pdf_hash IS NOT NULL AS has_result,
              CASE WHEN s.pdf_hash IS NULL THEN 'verapdf ' || f.pdf_url || ': veraPDF returned no result for this file' END AS error
       FROM (SELECT file_hash, MIN(pdf_url) AS pdf_url FROM v_pdf_files
             WHERE file_hash IS NOT NULL GROUP BY file_hash) f
       LEFT JOIN v_summary s ON s.pdf_hash = f.file_hash""",
)
def _(fx: Fixtures):
    files = (
        fx.files.where(F.col("file_hash").isNotNull())
        .groupBy("file_hash")
        .agg(F.min("pdf_url").alias("pdf_url"))
        .withColumn("path", F.concat(F.lit("tmp/"), F.col("file_hash"), F.lit(".pdf")))
    )
    matched = R.match_jobs(files, R.batch_jobs(fx.checker_reports()))
    return matched.select(
        "file_hash",
        "has_result",
        F.when(
            ~F.col("has_result"),
            F.concat(
                F.lit("verapdf "),
                F.col("pdf_url"),
                F.lit(": veraPDF returned no result for this file"),
            ),
        ).alias("error"),
    )


@query("rule_summary", "SELECT * FROM v_summary")
def _(fx: Fixtures):
    return R.summarize(fx.rules, POLICY)


@query("parse_report", "SELECT * FROM v_summary")
def _(fx: Fixtures):
    reports = fx.checker_reports()
    return R.summarize(R.extract_rules(reports), POLICY, reports)


@query(
    "rescore_reports",
    """SELECT r.pdf_hash, COUNT(CASE WHEN NOT ig THEN 1 END) AS violations,
              CAST(COALESCE(SUM(CASE WHEN NOT ig THEN failed END), 0) AS BIGINT) AS failed_checks,
              COUNT(CASE WHEN clause = '7.1' AND test_number = '4' THEN 1 END) = 0 AS tagged,
              COUNT(CASE WHEN clause = '7.2' AND test_number = '2' THEN 1 END) > 0 AS image_only,
              MAX(r.page_count) AS page_count
       FROM v_report r JOIN (SELECT pdf_hash, clause, test_number, failed_checks AS failed,
                                    clause = '7.2' AND test_number = '10' AS ig
                             FROM v_report_rule) x ON x.pdf_hash = r.pdf_hash
       GROUP BY r.pdf_hash""",
)
def _(fx: Fixtures):
    return R.rescore(fx.reports, fx.rules, STRICT).select(
        "pdf_hash", "violations", "failed_checks", "tagged", "image_only", "page_count"
    )


@query("report_assemble", "SELECT * FROM v_report")
def _(fx: Fixtures):
    return assemble_reports(R.summarize(fx.rules, POLICY), fx.view("v_analysis"))


@query(
    "rule_ignored",
    """SELECT r.pdf_hash, r.clause, r.test_number, p.clause IS NOT NULL AS ignored
       FROM v_report_rule r LEFT JOIN v_policy p
         ON p.clause = r.clause AND p.test_number = r.test_number AND p.action = 'ignore'""",
)
def _(fx: Fixtures):
    return fx.rules.select(
        "pdf_hash",
        "clause",
        "test_number",
        POLICY.ignored(F.col("clause"), F.col("test_number")).alias("ignored"),
    )


@query(
    "rule_flag",
    """SELECT r.pdf_hash, r.clause, r.test_number, p.action AS flag
       FROM v_report_rule r JOIN v_policy p
         ON p.clause = r.clause AND p.test_number = r.test_number AND p.action <> 'ignore'""",
)
def _(fx: Fixtures):
    flagged = fx.rules.withColumn("flag", POLICY.flag(F.col("clause"), F.col("test_number")))
    return flagged.where(F.col("flag").isNotNull()).select(
        "pdf_hash", "clause", "test_number", "flag"
    )


_ACTION = """CASE WHEN p.action IS NULL THEN 'counts' WHEN p.action = 'ignore' THEN 'ignored' ELSE p.action END"""
_POLICY_JOIN = """v_report_rule r LEFT JOIN v_policy p ON p.clause = r.clause AND p.test_number = r.test_number"""


@query(
    "src_ignore_policy",
    f"""SELECT r.clause, r.test_number, {_ACTION} AS action, COUNT(*) AS n
        FROM {_POLICY_JOIN} GROUP BY r.clause, r.test_number, p.action""",
)
def _(fx: Fixtures):
    stored = rule_policy(POLICY.rows())
    return (
        R.with_policy(fx.rules, stored)
        .groupBy("clause", "test_number", F.col("policy").alias("action"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "rule_policy",
    f"""SELECT r.pdf_hash, r.clause, r.test_number, r.failed_checks, {_ACTION} AS policy,
               COUNT(CASE WHEN p.action IS NULL OR p.action <> 'ignore' THEN 1 END) OVER (PARTITION BY r.pdf_hash) AS counted_violations,
               COUNT(*) OVER (PARTITION BY r.pdf_hash) AS total_rules
        FROM {_POLICY_JOIN}""",
)
def _(fx: Fixtures):
    detail = R.with_policy(fx.rules, POLICY).select(
        "pdf_hash", "clause", "test_number", "failed_checks", "policy"
    )
    return detail.join(R.policy_totals(fx.rules, POLICY), "pdf_hash")


@query(
    "pdf_rules",
    """SELECT f.pdf_id, f.pdf_url, f.file_hash IS NOT NULL AS verified,
              COUNT(r.clause) AS total_rules,
              COUNT(CASE WHEN r.clause IS NOT NULL AND p.clause IS NULL THEN 1 END) AS counted_violations
       FROM v_pdf_files f LEFT JOIN v_report_rule r ON r.pdf_hash = f.file_hash
       LEFT JOIN v_policy p ON p.clause = r.clause AND p.test_number = r.test_number AND p.action = 'ignore'
       WHERE NOT f.removed AND lower(f.pdf_url) LIKE '%legacy%'
       GROUP BY f.pdf_id, f.pdf_url, f.file_hash""",
)
def _(fx: Fixtures):
    found = fx.files.where(~F.col("removed") & F.contains(F.lower("pdf_url"), F.lit("legacy")))
    totals = written(R.policy_totals(fx.rules, POLICY), "totals")
    return lookup_hash(found, totals, row="pdf_id").select(
        "pdf_id",
        "pdf_url",
        F.col("file_hash").isNotNull().alias("verified"),
        F.coalesce("total_rules", F.lit(0)).alias("total_rules"),
        F.coalesce("counted_violations", F.lit(0)).alias("counted_violations"),
    )


@query(
    "counted_rules",
    """SELECT f.pdf_id, r.clause, r.test_number, r.failed_checks
       FROM v_pdf_files f JOIN v_report t ON t.pdf_hash = f.file_hash
       JOIN v_report_rule r ON r.pdf_hash = f.file_hash
       WHERE NOT EXISTS (SELECT 1 FROM v_policy p WHERE p.clause = r.clause
                         AND p.test_number = r.test_number AND p.action = 'ignore')""",
)
def _(fx: Fixtures):
    counted = R.counted_rules(fx.rules, POLICY).join(fx.reports.select("pdf_hash"), "pdf_hash", "left_semi")
    hashed = fx.files.where(F.col("file_hash").isNotNull())
    return hashed.select("pdf_id", F.col("file_hash").alias("pdf_hash")).join(
        written(counted, "counted"), "pdf_hash"
    ).select("pdf_id", "clause", "test_number", "failed_checks")


@query(
    "distinct_clauses",
    """SELECT pdf_hash, string_agg(clause, ', ' ORDER BY clause) AS clauses
       FROM v_clause_class GROUP BY pdf_hash""",
)
def _(fx: Fixtures):
    return R.distinct_clauses(fx.rules, POLICY).withColumn("clauses", F.array_join("clauses", ", "))


@query(
    "clause_class",
    """SELECT DISTINCT pdf_hash, clause, clause_class FROM v_clause_class""",
)
def _(fx: Fixtures):
    return (
        R.counted_rules(fx.rules, POLICY)
        .select("pdf_hash", "clause")
        .distinct()
        .withColumn("clause_class", PROFILE.class_for(F.col("clause")))
    )


@query(
    "src_triage_profile",
    """SELECT clause,
              CASE WHEN clause LIKE '9.%' THEN 'manual' WHEN clause LIKE '7.21.4.%' THEN 'manual' END AS clause_class,
              COUNT(*) AS n, CAST(MAX(90.0 - 4.0 * v - 0.5 * greatest(0, coalesce(pages, 0) - 100)) AS DOUBLE) AS best_score
       FROM (SELECT r.clause, t.violations AS v, t.page_count AS pages
             FROM v_report_rule r JOIN v_report t ON t.pdf_hash = r.pdf_hash) x
       GROUP BY clause""",
)
def _(fx: Fixtures):
    score = triage_score(F.col("violations"), F.lit(0), F.col("page_count"), CUSTOM_PROFILE)
    return (
        fx.rules.join(fx.reports.select("pdf_hash", "violations", "page_count"), "pdf_hash")
        .groupBy("clause")
        .agg(F.count("*").alias("n"), F.max(score).alias("best_score"))
        .withColumn("clause_class", CUSTOM_PROFILE.class_for(F.col("clause")))
    )


@query(
    "structural_route",
    """SELECT pdf_hash, signal, 'manual' AS route FROM (
         SELECT pdf_hash, 'image_only' AS signal FROM v_report WHERE image_only
         UNION ALL SELECT pdf_hash, 'has_form' FROM v_report WHERE has_form
         UNION ALL SELECT pdf_hash, 'complex_graphic' FROM v_report WHERE complex_graphic) x""",
)
def _(fx: Fixtures):
    signals = F.array_compact(
        F.array(*[F.when(F.col(s), F.lit(s)) for s in ("image_only", "has_form", "complex_graphic")])
    )
    return fx.reports.select("pdf_hash", F.explode(signals).alias("signal")).withColumn(
        "route", structural_route(F.col("signal"), PROFILE)
    )


@query("triage_score", "SELECT pdf_hash, CAST(score AS DOUBLE) AS score FROM v_triage")
def _(fx: Fixtures):
    clauses = R.clause_profile(fx.rules, POLICY, PROFILE)
    score = triage_score(
        F.col("violations"), F.col("neutral_clauses"), F.col("page_count"), PROFILE
    )
    return fx.reports.join(clauses, "pdf_hash", "left").select("pdf_hash", score.alias("score"))


@query(
    "triage_classify",
    "SELECT pdf_hash, classification, classification_reason, confidence FROM v_triage",
)
def _(fx: Fixtures):
    return fx.triaged.select("pdf_hash", "classification", "classification_reason", "confidence")


@query(
    "triage_custom_profile",
    """SELECT pdf_hash,
         CASE WHEN image_only OR has_form OR complex_graphic OR m > 0 THEN 'needs_manual_remediation'
              WHEN tagged AND violations = 0 AND title_set THEN 'good_to_go'
              WHEN score >= 50 THEN 'fit_for_automated_tagging'
              ELSE 'needs_manual_remediation' END AS classification,
         CASE WHEN image_only OR has_form THEN 'high' WHEN complex_graphic THEN 'borderline'
              WHEN m > 0 OR (tagged AND violations = 0 AND title_set) THEN 'high'
              WHEN abs(score - 50) <= 12 THEN 'borderline' ELSE 'high' END AS confidence
       FROM (SELECT r.*, COALESCE(c.m, 0) AS m,
               90.0 - 4.0 * violations - 8.0 * COALESCE(c.n, 0) - 0.5 * greatest(0, coalesce(page_count, 0) - 100) AS score
             FROM v_report r LEFT JOIN (
               SELECT pdf_hash, COUNT(CASE WHEN clause LIKE '9.%' OR clause LIKE '7.21.4.%' THEN 1 END) AS m,
                      COUNT(CASE WHEN NOT (clause LIKE '9.%' OR clause LIKE '7.21.%') THEN 1 END) AS n
               FROM v_clause_class GROUP BY pdf_hash) c ON c.pdf_hash = r.pdf_hash) x""",
)
def _(fx: Fixtures):
    return triage_reports(fx.reports, fx.rules, POLICY, CUSTOM_PROFILE).select(
        "pdf_hash", "classification", "confidence"
    )


@query(
    "auto_reason",
    """SELECT pdf_hash, COALESCE(NULLIF(concat_ws('; ',
         CASE WHEN NOT tagged THEN 'untagged (auto-tag adds structure)' END,
         CASE WHEN violations > 0 THEN CAST(violations AS STRING) || ' fixable violation(s)' END,
         CASE WHEN NOT language_set THEN 'missing /Lang' END,
         CASE WHEN NOT title_set THEN 'missing title' END), ''), 'auto-remediable') AS reason
       FROM v_report""",
)
def _(fx: Fixtures):
    return fx.reports.select(
        "pdf_hash",
        auto_reason(
            F.col("tagged"), F.col("violations"), F.col("title_set"), F.col("language_set")
        ).alias("reason"),
    )


@query(
    "classify_rows",
    """SELECT pdf_url, parent_url, classification, classification_reason, confidence FROM v_export""",
)
def _(fx: Fixtures):
    return classify_files(fx.files, fx.triaged).select(
        "pdf_url", "parent_url", "classification", "classification_reason", "confidence"
    )


# -- evaluation ----------------------------------------------------------------
_ALIAS = """CASE WHEN lower(folder) IN ('good_to_go', 'good', 'go') THEN 'good_to_go'
 WHEN lower(folder) IN ('fit_for_automated_tagging', 'fit', 'auto') THEN 'fit_for_automated_tagging'
 WHEN lower(folder) IN ('needs_manual_remediation', 'manual') THEN 'needs_manual_remediation' END"""
_PAIRS = f"""(SELECT e.pdf_hash, e.expected, COALESCE(t.classification, 'error') AS predicted
 FROM (SELECT pdf_hash, {_ALIAS} AS expected FROM v_expected) e
 LEFT JOIN v_triage t ON t.pdf_hash = e.pdf_hash WHERE e.expected IS NOT NULL)"""


def _predictions(fx: Fixtures):
    return predict(labelled(fx.view("v_expected")), fx.triaged)


@query("folder_label", f"SELECT pdf_hash, folder, {_ALIAS} AS label FROM v_expected")
def _(fx: Fixtures):
    return fx.view("v_expected").select(
        "pdf_hash", "folder", folder_label(F.col("folder")).alias("label")
    )


@query(
    "src_labelled_set",
    f"""SELECT folder || '/' || pdf_hash || '.pdf' AS path, {_ALIAS} AS expected
        FROM v_expected WHERE folder <> 'junk'""",
)
def _(fx: Fixtures):
    rows = fx.view("v_expected").withColumn(
        "path", F.concat("folder", F.lit("/"), "pdf_hash", F.lit(".pdf"))
    )
    return labelled(rows).select("path", "expected").orderBy("expected", "path")


@query(
    "evaluate",
    f"""SELECT p.pdf_hash, p.expected, p.predicted, p.expected = p.predicted AS correct,
               COALESCE(t.confidence, 'high') AS confidence,
               COALESCE(t.classification_reason, 'classification failed: no report') AS reason,
               c.clauses
        FROM {_PAIRS} p LEFT JOIN v_triage t ON t.pdf_hash = p.pdf_hash
        LEFT JOIN (SELECT pdf_hash, string_agg(clause, ', ' ORDER BY clause) AS clauses
                   FROM v_clause_class GROUP BY pdf_hash) c ON c.pdf_hash = p.pdf_hash""",
)
def _(fx: Fixtures):
    clauses = R.distinct_clauses(fx.rules, POLICY).withColumn(
        "clauses", F.array_join("clauses", ", ")
    )
    return _predictions(fx).join(clauses, "pdf_hash", "left").select(
        "pdf_hash", "expected", "predicted", "correct", "confidence", "reason", "clauses"
    )


@query(
    "eval_mismatches",
    f"SELECT pdf_hash, expected, predicted FROM {_PAIRS} p WHERE expected <> predicted",
)
def _(fx: Fixtures):
    return mismatches(_predictions(fx)).select("pdf_hash", "expected", "predicted")


@query(
    "eval_accuracy",
    f"""SELECT COUNT(*) AS total,
               round(AVG(CASE WHEN expected = predicted THEN 1.0 ELSE 0.0 END), 9) AS accuracy
        FROM {_PAIRS} p""",
)
def _(fx: Fixtures):
    return accuracy(_predictions(fx)).withColumn("accuracy", F.round("accuracy", 9))


_LABELS = """(SELECT * FROM (VALUES ('good_to_go'), ('fit_for_automated_tagging'),
 ('needs_manual_remediation')) AS l(label))"""


@query(
    "eval_confusion",
    f"""SELECT a.label AS expected, b.label AS predicted,
               (SELECT COUNT(*) FROM {_PAIRS} p WHERE p.expected = a.label AND p.predicted = b.label) AS n
        FROM {_LABELS} a CROSS JOIN {_LABELS} b""",
)
def _(fx: Fixtures):
    return confusion(_predictions(fx))


@query(
    "eval_per_class",
    f"""SELECT l.label, round(COALESCE(COUNT(CASE WHEN expected = label AND predicted = label THEN 1 END) * 1.0
                / NULLIF(COUNT(CASE WHEN predicted = label THEN 1 END), 0), 0), 9) AS precision,
               round(COALESCE(COUNT(CASE WHEN expected = label AND predicted = label THEN 1 END) * 1.0
                / NULLIF(COUNT(CASE WHEN expected = label THEN 1 END), 0), 0), 9) AS recall,
               COUNT(CASE WHEN expected = label THEN 1 END) AS support
        FROM {_LABELS} l CROSS JOIN {_PAIRS} p GROUP BY l.label""",
)
def _(fx: Fixtures):
    return (
        per_class(_predictions(fx))
        .withColumn("precision", F.round("precision", 9))
        .withColumn("recall", F.round("recall", 9))
    )
