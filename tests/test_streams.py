from pyspark.sql import functions as F

from docaudit.functions.urls import url_host
from docaudit.plans.fixtures import Fixtures
from docaudit.plans.registry import QUERIES
from docaudit.plans import catalog  # noqa: F401
from docaudit.sources.policy import DEFAULT_RULE_POLICY
from docaudit.streaming import jobs as J
from docaudit.streaming import sinks
from docaudit.streaming.sinks import read_log, write_batch

RULE = "pdf_hash string, clause string, test_number string, failed_checks bigint"
SUMMARY = "pdf_hash string, violations bigint, failed_checks bigint, tagged boolean, image_only boolean"


def _report(clause, checks):
    return (
        '{"report": {"jobs": [{"validationResult": {"details": {"ruleSummaries": '
        f'[{{"clause": "{clause}", "testNumber": 1, "failedChecks": {checks}}}]}}}}}}]}}}}'
    )


def test_verification_resumes_and_keeps_the_latest(spark, tmp_path):
    schema = "pdf_hash string, report_json string"
    folder, root, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([("h", _report("7.5", 1)), ("k", _report("7.6", 2))], schema).coalesce(1).write.parquet(folder)
    struct = spark.read.parquet(folder).schema

    def run():
        stream = J.stream_folder(spark, folder, struct, files_per_trigger=1)
        J.run_verification(stream, DEFAULT_RULE_POLICY, root, state)
        log = read_log(spark, f"{root}/summaries", SUMMARY)
        rules = J.latest_by_hash(read_log(spark, f"{root}/rules", RULE), log)
        found = {r["pdf_hash"]: r["failed_checks"] for r in J.latest_by_hash(log).collect()}
        held = {r["pdf_hash"]: r["failed_checks"] for r in rules.collect()}
        assert held == {h: n for h, n in found.items() if n}
        return found

    assert run() == {"h": 1, "k": 2}
    assert run() == {"h": 1, "k": 2}  # nothing new
    spark.createDataFrame([("h", _report("7.5", 7))], schema).coalesce(1).write.mode("append").parquet(folder)
    assert run() == {"h": 7, "k": 2}
    # Twice in a batch counts once, and a validation without rules takes the old rules away.
    empty = '{"report": {"jobs": [{"validationResult": {"details": {"ruleSummaries": []}}}]}}'
    again = [("h", _report("7.5", 3)), ("h", _report("7.5", 3)), ("k", empty)]
    spark.createDataFrame(again, schema).coalesce(1).write.mode("append").parquet(folder)
    assert run() == {"h": 3, "k": 0}


def test_verification_parses_a_report_once(spark, tmp_path, monkeypatch):
    from docaudit import shared

    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    write, store = sinks.write_batch, shared.written
    monkeypatch.setattr(sinks, "write_batch", lambda rows, *a: write(seen(rows), *a))
    monkeypatch.setattr(J, "written", lambda df, label: store(seen(df), label))
    folder, root, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    empty = '{"report": {"jobs": []}}'
    rows = [("h", _report("7.5", 1)), ("h", _report("7.5", 1)), ("k", empty), ("n", None), ("x", "{")]
    spark.createDataFrame(rows, "pdf_hash string, report_json string").coalesce(1).write.parquet(folder)
    stream = J.stream_folder(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)
    J.run_verification(stream, DEFAULT_RULE_POLICY, root, state)
    assert [r["failed_checks"] for r in read_log(spark, f"{root}/rules", RULE).collect()] == [1]
    assert sorted((r["pdf_hash"], r["violations"]) for r in read_log(spark, f"{root}/summaries", SUMMARY).collect()) == [
        ("h", 1), ("k", 0), ("n", 0), ("x", 0)
    ]
    # The parse of the whole report stands in one of the plans, once.
    assert sum(p.count("from_json(StructField(report,") for p in plans) == 1, plans


def test_replayed_batch_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([("h", 1, 1, True, False)], SUMMARY)
    for _ in range(2):
        write_batch(rows, str(tmp_path / "log"), 0)
    assert read_log(spark, str(tmp_path / "log"), SUMMARY).count() == 1


def test_discovery_dedups_across_batches(spark, tmp_path):
    schema = "page_id bigint, parent_url string, href string"
    folder = str(tmp_path / "links")
    rows = [(1, "http://h.edu/p", "/a.pdf"), (1, "http://h.edu/p", "/a.pdf#x"), (1, "http://h.edu/p", "/n")]
    for _ in range(2):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    settings = spark.createDataFrame(
        [("h.edu", "host", ["h.edu"], None, False, None)],
        "site_id string, scope string, hosts array<string>, path_prefix string, include_external_pdfs boolean, resolvers array<string>",
    )
    stream = J.stream_folder(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)
    found = J.discovery(stream, settings, url_host)
    J.run_discovery(found, str(tmp_path / "log"), str(tmp_path / "state"))
    log = read_log(spark, str(tmp_path / "log"), found.schema)
    assert [r["pdf_url"] for r in log.collect()] == ["http://h.edu/a.pdf"]


def test_partition_count_does_not_matter(spark):
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    want = sorted(map(str, QUERIES["site_status"].build(fx).collect()))
    fx.files = fx.files.repartition(13, F.col("pdf_url"))
    fx.rules = fx.rules.repartition(5)
    assert sorted(map(str, QUERIES["site_status"].build(fx).collect())) == want
