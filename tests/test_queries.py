"""Queries against their check SQL, and the shape of their plans."""

import os

import pytest

from docaudit.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")

# One or two of every group; check.py compares all of them.
CHECKED = [
    "extract_rules", "rule_summary", "rescore_reports", "triage_classify", "triage_custom_profile", "evaluate",
    "eval_confusion", "url_normalize", "url_join_absolute", "url_archive_reason", "storage_path", "classify_link",
    "scope_domain", "resolve_links", "crawl_frontier", "collect_rows", "site_status", "status_filter_issues", "top_n",
    "chunk_ids", "upsert_pdf", "upsert_person", "replace_rules", "set_site_owner", "delete_site_cascade", "add_sites",
    "link_404_stats", "whois", "roster_site_match", "import_report", "verify_outcome", "verify_failures",
    "text_type_rollup", "complex_graphic", "stream_discovery", "run_steps", "run_steps_files", "run_steps_reports",
    "stream_merge", "stream_verify_rules", "crawl_scopes", "suffix_rules", "show_owner", "failure_list",
    "upsert_pdf_on_disk", "upsert_slice_on_disk", "set_flags_on_disk", "delete_sites_on_disk", "repeated_changes",
    "run_steps_sites", "run_steps_storage", "run_steps_failures", "policy_table_summary", "policy_table_clauses",
    "triage_policy_table", "stream_triage_versions", "stream_discovery_bounded", "digest_files", "roster_lines_in_cells",
    "rescore_changed", "maintained_site_counts", "src_checker_files", "src_url_files", "src_profile_file", "page_counts",
]


@pytest.fixture(scope="module")
def con():
    from check import duck

    return duck(SF_DIR)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_check_sql(spark, con, name):
    from check import compare

    ok, note = compare(QUERIES[name].run(spark, SF_DIR), con, QUERIES[name].sql)
    assert ok, note


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _lazy():
    """Queries whose plan can be built without running a job first."""
    eager = ("stream_", "sink_", "crawl_frontier", "crawl_unlimited", "verify_", "import_", "run_steps", "chunk_ids", "crawl_scopes", "failure_list")
    # Python runs in the digest source alone; the roster rows need windows within a split.
    eager += ("digest_files", "roster_lines_in_cells")
    return [n for n in QUERIES if not n.startswith(eager) and not n.endswith("_on_disk") or n == "verify_limit"]


@pytest.mark.parametrize("name", _lazy())
def test_plan_has_no_cross_join_and_no_python(spark, name):
    plan = _plan(QUERIES[name].run(spark, SF_DIR))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "SinglePartition, REPARTITION"):
        assert node not in plan, plan
    assert "Window" not in plan, plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from docaudit.operators.inventory import unverified_files
    from docaudit.operators.layout import sampled
    from docaudit.plans.fixtures import Fixtures

    fx = Fixtures(spark, SF_DIR)
    boxes, files, reports = (str(tmp_path / n) for n in ("boxes", "files", "reports"))
    fx.view("v_layout_box").write.parquet(boxes)
    fx.files.write.parquet(files)
    fx.reports.write.parquet(reports)
    plan = _plan(sampled(spark.read.parquet(boxes), 25))
    assert "LessThan(page_no,25)" in plan
    plan = _plan(unverified_files(spark.read.parquet(files), spark.read.parquet(reports)).select("pdf_id"))
    pushed = [p for p in plan.split("PushedFilters: ")[1:] if "removed" in p.split("]")[0]]
    assert pushed and "ReadSchema: struct<pdf_hash:string>" in plan
    assert "parent_url" not in plan


def test_rescore_joins_once(spark):
    from docaudit.operators.rules import rescore
    from docaudit.plans.fixtures import Fixtures
    from docaudit.sources.policy import RulePolicy

    fx = Fixtures(spark, SF_DIR)
    plan = _plan(rescore(fx.reports, fx.rules, RulePolicy()))
    assert plan.count("Join") == 1 and plan.count("Exchange") <= 3, plan


def test_every_query_but_none_has_check_sql():
    assert [n for n, q in QUERIES.items() if q.sql is None] == []


def test_rescore_changes_meets_the_changed_pairs_before_the_shuffle(spark):
    from docaudit.operators.rules import rescore, rescore_changes, summarize
    from docaudit.plans.fixtures import Fixtures
    from docaudit.plans.queries_rules import POLICY, STRICT
    from docaudit.sources.policy import RulePolicy, policy_changes

    fx = Fixtures(spark, SF_DIR)
    for new in (STRICT, RulePolicy(), fx.view("v_large_policy"), POLICY):
        want = rescore(fx.reports, fx.rules, new)
        got = rescore_changes(fx.reports, fx.rules, POLICY, new)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert policy_changes(spark, POLICY, POLICY).count() == 0
    changed = policy_changes(spark, POLICY, STRICT)
    hit = fx.rules.join(changed, ["clause", "test_number"]).groupBy("pdf_hash").count()
    plan = _plan(hit)
    assert "BroadcastHashJoin" in plan and summarize(fx.rules, POLICY).count() > 0, plan
