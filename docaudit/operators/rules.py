"""Checker reports to rule rows, and rule rows to report summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.shared import written
from docaudit.sources.policy import RulePolicy, RulePolicyTable, as_policy, as_profile, policy_changes

Policy = RulePolicy | RulePolicyTable | DataFrame

_RULE = (
    "struct<clause:string,testNumber:string,failedChecks:string,ruleStatus:string,"
    "status:string,specification:string,description:string>"
)
_RESULT = f"struct<details:struct<ruleSummaries:array<{_RULE}>>>"
# validationResult is read as text because it may be an object or a list.
_REPORT = (
    "struct<report:struct<jobs:array<struct<"
    "itemDetails:struct<name:string>,validationResult:string>>>>"
)


def report_jobs(report_json: Column) -> Column:
    """Array of job structs; null when a level is missing."""
    return F.from_json(report_json, _REPORT)["report"]["jobs"]


def job_rules(validation_result: Column) -> Column:
    """Array of rule structs of one job: the object itself or the first list element."""
    is_list = F.startswith(F.ltrim(validation_result), F.lit("["))
    result = F.when(
        is_list, F.get(F.from_json(validation_result, f"array<{_RESULT}>"), F.lit(0))
    ).otherwise(F.from_json(validation_result, _RESULT))
    return F.transform(
        result["details"]["ruleSummaries"],
        lambda r: F.struct(
            r["clause"].alias("clause"),
            r["testNumber"].alias("test_number"),
            F.coalesce(F.nullif(r["ruleStatus"], F.lit("")), r["status"]).alias("status"),
            F.coalesce(
                r["failedChecks"].try_cast("bigint"), r["failedChecks"].try_cast("double").try_cast("bigint"), F.lit(0)
            ).alias("failed_checks"),
            r["specification"].alias("specification"),
            r["description"].alias("description"),
        ),
    )


def extract_rules(
    reports: DataFrame, key: str = "pdf_hash", json_column: str = "report_json"
) -> DataFrame:
    """All rules of the first job of each report, verbatim (no policy)."""
    first = F.get(report_jobs(F.col(json_column)), F.lit(0))
    return reports.select(key, F.explode(job_rules(first["validationResult"])).alias("r")).select(
        key, "r.*"
    )


def read_rules(reports: DataFrame, key: str = "pdf_hash", json_column: str = "report_json") -> DataFrame:
    """One row per report with the rules of :func:`extract_rules` as a list; null where a level is missing.

    For several uses it is to be written first. The result of the job is a column of its own, as the whole report would
    be parsed for each mention of it.
    """
    first = F.get(report_jobs(F.col(json_column)), F.lit(0))
    results = reports.select(key, first["validationResult"].alias("_result"))
    return results.select(key, job_rules(F.col("_result")).alias("rules"))


def list_rules(read: DataFrame, key: str = "pdf_hash") -> DataFrame:
    """Rule rows of the written :func:`read_rules`."""
    return read.select(key, F.explode("rules").alias("r")).select(key, "r.*")


def base_name(path: Column) -> Column:
    """What follows the last slash; nothing for a path that ends with one."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)$", 1)


def batch_jobs(
    batches: DataFrame, json_column: str = "report_json", order: Column | None = None
) -> DataFrame:
    """One row per named job of the batch reports, with the base name of the reported path.

    Two jobs of one name keep the one of the later report, then the later one in it. ``order`` tells
    reports apart by time; without it their text decides, by a hash, so that the result hangs on the rows alone.
    """
    placed = batches.select(
        (F.xxhash64(json_column) if order is None else order).alias("_report"), F.col(json_column).alias("_json")
    )
    jobs = placed.select("_report", F.posexplode(report_jobs(F.col("_json"))).alias("at", "job"))
    named = jobs.select(
        base_name(F.col("job.itemDetails.name")).alias("job_name"),
        F.struct("_report", "at").alias("pos"),
        F.col("job.validationResult").alias("validation_result"),
    ).where(F.col("job_name") != "")
    return named.groupBy("job_name").agg(
        F.max_by("validation_result", "pos").alias("validation_result")
    )


def extract_job_rules(batches: DataFrame, json_column: str = "report_json") -> DataFrame:
    """All rules of every job of the batch reports, with the job's base name."""
    jobs = batches.select(F.explode(report_jobs(F.col(json_column))).alias("job"))
    return jobs.select(
        base_name(F.col("job.itemDetails.name")).alias("job_name"),
        F.explode(job_rules(F.col("job.validationResult"))).alias("r"),
    ).select("job_name", "r.*")


def match_jobs(files: DataFrame, jobs: DataFrame, path_column: str = "path") -> DataFrame:
    """Files with their job by base name; ``has_result`` is false when none was returned."""
    keyed = files.withColumn("job_name", base_name(F.col(path_column)))
    flagged = written(jobs.withColumn("has_result", F.lit(True)), "jobs")
    return keyed.join(flagged, "job_name", "left").withColumn(
        "has_result", F.coalesce("has_result", F.lit(False))
    )


def counted_rules(rules: DataFrame, policy: Policy) -> DataFrame:
    """Rules that survive the ignore policy."""
    return as_policy(policy).judged(rules).where(~F.col("_ignored")).select(*rules.columns)


def with_policy(rules: DataFrame, policy: Policy) -> DataFrame:
    """Rules with what the policy does to them."""
    action = F.when(F.col("_ignored"), "ignored").otherwise(F.coalesce("_flag", F.lit("counts")))
    return as_policy(policy).judged(rules).select(*rules.columns, action.alias("policy"))


def policy_totals(rules: DataFrame, policy: Policy) -> DataFrame:
    """Recorded and counted rules per document."""
    return as_policy(policy).judged(rules).groupBy("pdf_hash").agg(
        F.count("*").alias("total_rules"), F.count_if(~F.col("_ignored")).alias("counted_violations")
    )


def summarize(
    rules: DataFrame, policy: Policy, hashes: DataFrame | None = None
) -> DataFrame:
    """Violations, failed checks and flags per document under a policy.

    One aggregate with map-side combine. Ignored rules contribute nothing but keep
    their document in the result; ``hashes`` adds documents without any rule.
    """
    counted, flag = ~F.col("_ignored"), F.col("_flag")
    summary = as_policy(policy).judged(rules).groupBy("pdf_hash").agg(
        F.count_if(counted).alias("violations"),
        F.coalesce(F.sum(F.when(counted, F.col("failed_checks"))), F.lit(0)).alias("failed_checks"),
        (F.count_if(counted & (flag == "tagged")) == 0).alias("tagged"),
        (F.count_if(counted & (flag == "image_only")) > 0).alias("image_only"),
    )
    if hashes is None:
        return summary
    return (
        hashes.select("pdf_hash")
        .join(summary, "pdf_hash", "left")
        .select(
            "pdf_hash",
            F.coalesce("violations", F.lit(0)).alias("violations"),
            F.coalesce("failed_checks", F.lit(0)).alias("failed_checks"),
            F.coalesce("tagged", F.lit(True)).alias("tagged"),
            F.coalesce("image_only", F.lit(False)).alias("image_only"),
        )
    )


def rescore(reports: DataFrame, rules: DataFrame, policy: Policy) -> DataFrame:
    """Reports with the rule figures of another policy; nothing is validated again."""
    defaults = {"violations": 0, "failed_checks": 0, "tagged": True, "image_only": False}
    fresh = summarize(rules, policy).withColumnsRenamed({c: f"_{c}" for c in defaults})
    renewed = {c: F.coalesce(F.col(f"_{c}"), F.lit(v)) for c, v in defaults.items()}
    return reports.join(fresh, "pdf_hash", "left").withColumns(renewed).select(*reports.columns)


def rescore_changes(reports: DataFrame, rules: DataFrame, old: Policy, new: Policy) -> DataFrame:
    """As :func:`rescore`, for reports that hold the figures of policy ``old``: only what differs is computed.

    Rules on pairs that both policies judge alike drop out before any shuffle. The others give signed differences of the
    counts; flags are aggregated again, for the documents of which a flag rule changed.
    """
    changed = policy_changes(reports.sparkSession, old, new)
    hit = rules.join(changed, ["clause", "test_number"])
    step = F.when(F.col("was_ignored") & ~F.col("is_ignored"), 1).when(~F.col("was_ignored") & F.col("is_ignored"), -1).otherwise(0)
    deltas = hit.groupBy(F.col("pdf_hash").alias("_hash")).agg(
        F.sum(step).alias("_violations"), F.coalesce(F.sum(step * F.col("failed_checks")), F.lit(0)).alias("_failed"),
        F.bool_or("flag_changed").alias("_reflag"),
    )
    deltas = written(deltas, "deltas")
    again = deltas.where("_reflag").select(F.col("_hash").alias("pdf_hash"))
    flags = summarize(rules.join(again, "pdf_hash", "left_semi"), new)
    flags = written(flags.select(F.col("pdf_hash").alias("_of"), F.col("tagged").alias("_tagged"), F.col("image_only").alias("_image")), "flags")
    joined = reports.join(deltas, F.col("pdf_hash") == F.col("_hash"), "left").join(flags, F.col("pdf_hash") == F.col("_of"), "left")
    renewed = {
        "violations": F.col("violations") + F.coalesce("_violations", F.lit(0)),
        "failed_checks": F.col("failed_checks") + F.coalesce("_failed", F.lit(0)),
        "tagged": F.coalesce("_tagged", "tagged"),
        "image_only": F.coalesce("_image", "image_only"),
    }
    return joined.withColumns(renewed).select(*reports.columns)


def clause_profile(rules: DataFrame, policy: Policy, profile) -> DataFrame:
    """Counted clauses per document as triage needs them.

    ``manual_clauses`` is sorted text, ``neutral_clauses`` counts clauses without a
    class. The sets hold distinct clauses of one standard, so they stay short.
    """
    clause = F.col("clause")
    label = F.col("_class")
    counted = counted_rules(rules, policy).select("pdf_hash", "clause").where(clause.isNotNull())
    return (
        as_profile(profile).labelled(counted)
        .groupBy("pdf_hash")
        .agg(
            F.array_sort(F.collect_set(F.when(label == "manual", clause))).alias("manual_clauses"),
            F.size(F.collect_set(F.when(label.isNull(), clause))).cast("bigint").alias(
                "neutral_clauses"
            ),
        )
    )


def distinct_clauses(rules: DataFrame, policy: Policy) -> DataFrame:
    """Sorted distinct counted clauses per document."""
    return (
        counted_rules(rules, policy)
        .where(F.col("clause").isNotNull())
        .groupBy("pdf_hash")
        .agg(F.array_sort(F.collect_set("clause")).alias("clauses"))
    )
