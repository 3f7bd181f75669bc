"""Tables that change in part, policies as tables, and sources that read in pieces."""

import hashlib
import io
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docaudit.operators.inventory import set_archived, upsert_sites
from docaudit.operators.keyed_table import SLICE, KeyedTable
from docaudit.operators.merge import delete, merge, take, update
from docaudit.operators.ordering import last_per_key


def _files(table):
    root = Path(table.path.removeprefix("file:"))
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), F.lit("old").alias("v"), (F.col("id") % 100).alias("site"))
    return KeyedTable.create(rows, ["k"], slices=100, buckets=4)


def test_only_touched_slices_are_written(spark, table):
    before = _files(table)
    changes = spark.createDataFrame([(7, "new"), (5001, "new")], "k long, v string")
    touched = table.change(changes, lambda part: merge(part, changes, ["k"], on_match=take("v")))
    after = _files(table)
    assert 1 <= len(touched) <= 2
    changed = {f.split("/")[0] for f in before.keys() ^ after.keys()} | {f.split("/")[0] for f in before.keys() & after.keys() if before[f] != after[f]}
    assert changed == {f"{SLICE}={n}" for n in touched}
    got = table.read()
    assert got.count() == 5001 and {r["k"] for r in got.where("v = 'new'").collect()} == {7, 5001}


def test_join_by_the_key_does_not_shuffle_the_table(spark, table):
    changes = spark.range(300).select((F.col("id") * 3).alias("k"), F.lit("x").alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(update(table.read([1, 2, 3]), changes, ["k"], take("v")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = plan[: plan.index("FileScan")].rsplit("Join", 1)[1]
    assert "Exchange" not in scan and "SelectedBucketsCount: 4 out of 4" in plan and "PartitionFilters" in plan, plan


def test_slices_without_rows_go(spark, table):
    doomed = table.read([5]).select("k")
    n = doomed.count()
    assert n and table.change(doomed, lambda part: delete(part, doomed, ["k"])) == [5]
    assert table.read([5]).count() == 0 and table.read().count() == 5000 - n
    assert not any(f.startswith(f"{SLICE}=5/") for f in _files(table))


def test_changes_by_another_column(spark, table):
    marks = spark.createDataFrame([(3, "m")], "site long, v string")
    touched = table.change(marks, lambda part: update(part, marks, ["site"], take("v")), by=["site"])
    assert len(touched) <= 50 and table.read().where("v = 'm'").count() == 50


def test_open_again_and_odd_changes(spark, table):
    again = KeyedTable.open(spark, table.path, table.read().schema, ["k"], slices=100, buckets=4)
    assert again.read().count() == 5000
    assert again.change(spark.createDataFrame([], "k long, v string"), lambda part: part.limit(0)) == []
    one = spark.createDataFrame([(1,)], "k long")
    with pytest.raises(ValueError):
        again.change(one, lambda part: part.withColumn("k", F.col("k") + 1))
    nothing = KeyedTable.create(table.read().limit(0), ["k"])
    fresh = spark.createDataFrame([(None, "a", 1), (2, "b", 1)], "k long, v string, site long")
    nothing.change(fresh, lambda part: merge(part, fresh, ["k"], on_match=take("v")))
    assert sorted((r["k"] or 0, r["v"]) for r in nothing.read().collect()) == [(0, "a"), (2, "b")]


def test_the_order_column_decides_whatever_the_files_are(spark, tmp_path):
    """The later change lies in the smaller or in the larger of two files; Spark reads the larger one first."""
    sites = spark.createDataFrame([("s", "{}", True, None)], "name string, config_json string, enabled boolean, notes string")
    for pad_late in (False, True):
        folder = str(tmp_path / str(pad_late))
        for at, late in ((1, False), (2, True)):
            rows = [("s", f"at{at}", False, "x", at)]
            if late == pad_late:
                rows += [(f"p{i}", "y" * 500, True, f"{i}", at) for i in range(3000)]
            spark.createDataFrame(rows, "name string, config_json string, enabled boolean, notes string, at int").coalesce(1).write.mode("append").parquet(folder)
        changes = spark.read.parquet(folder)
        got = upsert_sites(sites, changes, order=F.col("at")).where("name = 's'").collect()
        assert [r["config_json"] for r in got] == ["at2"]
        by_value = last_per_key(changes.select("name", "config_json"), ["name"]).where("name = 's'").collect()
        assert [r["config_json"] for r in by_value] == ["at2"]


def test_ties_in_the_order_go_to_the_greatest_row(spark):
    rows = [(1, None, 5), (1, "a", 5), (1, "b", 5), (1, "z", 4), (2, None, None), (None, "n", 1)]
    df = spark.createDataFrame(rows, "k int, v string, at int")
    got = {(r["k"], r["v"]) for r in last_per_key(df.repartition(4), ["k"], F.col("at")).collect()}
    assert got == {(1, "b"), (2, None), (None, "n")}
    files = spark.createDataFrame([(1, False)], "pdf_id int, archived boolean")
    marks = spark.createDataFrame([(1, True, 1), (1, False, 2)], "pdf_id int, archived boolean, at int")
    assert set_archived(files, marks, F.col("at")).first()["archived"] is False
    assert set_archived(files, marks).first()["archived"] is True


# ---- policies


def test_policy_forms_agree(spark):
    from docaudit.operators.rules import clause_profile, policy_totals, summarize, with_policy
    from docaudit.sources.policy import RulePolicyTable, TriageProfileTable, rule_policy, triage_profile

    rows = [("7.1", "1", "ignore"), ("7.1", "2", "tagged"), ("7.1", "1", "tagged"), ("7.2", "3", "image_only"), ("9", "1", "ignore")]
    table = spark.createDataFrame([*rows, (None, "1", "ignore"), ("7.2", None, "ignore")], "clause string, test_number string, action string")
    classes = [("clause_class", "7.1", "auto"), ("clause_class", "7.1.2", "manual"), ("clause_class", "9", "auto"), ("score", "start", "90"), ("score", "bad", "x")]
    profile = spark.createDataFrame(classes, "kind string, key string, value string")
    rules = spark.createDataFrame(
        [(h, c, t, 2) for h in ("a", "b", None) for c in ("7.1", "7.1.2.3", "7.2", "9", "9.1", "8", None) for t in ("1", "2", "3", None) if (h, c) != ("b", "7.2")],
        "pdf_hash string, clause string, test_number string, failed_checks long",
    )
    small, large = rule_policy(rows), RulePolicyTable.of(table)

    def same(f):
        assert sorted(map(str, f(small, triage_profile(classes)).collect())) == sorted(map(str, f(large, TriageProfileTable.of(profile)).collect()))

    same(lambda p, _: summarize(rules, p))
    same(lambda p, _: with_policy(rules, p))
    same(lambda p, _: policy_totals(rules, p))
    same(lambda p, q: clause_profile(rules, p, q))
    assert TriageProfileTable.of(profile).routes.score["start"] == 90.0
    assert TriageProfileTable.of(profile.where("kind = 'score'")).classes.count() == 5


def test_large_policies_stay_tables(spark, tmp_path):
    from docaudit.sources.policy import RulePolicyTable, TriageProfileTable, read_rule_policy, read_triage_profile

    spark.createDataFrame([(f"{i}", "1", "ignore") for i in range(30)], "clause string, test_number string, action string").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("clause_class", f"{i}", "auto") for i in range(30)], "kind string, key string, value string").write.parquet(str(tmp_path / "q"))
    assert isinstance(read_rule_policy(spark, str(tmp_path / "p"), most=29), RulePolicyTable)
    assert len(read_rule_policy(spark, str(tmp_path / "p"), most=30).ignore) == 30
    assert isinstance(read_triage_profile(spark, str(tmp_path / "q"), most=29), TriageProfileTable)


# ---- sources in pieces


def test_digests_by_pieces(spark, tmp_path):
    from docaudit.operators.verify import gate_digests
    from docaudit.sources.digests import digest, read_digests

    data = {"a.pdf": b"%PDF-1.7 " + bytes(range(256)) * 40, "sub/b.pdf": b"", "sub/c.pdf": b"x" * 1019 + b"%PDF-", "d.pdf": b"x" * 1020 + b"%PDF-", ".hidden.pdf": b"h", "e.txt": b"t"}
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    for piece in (1, 7, 1 << 20):
        rows = read_digests(spark, str(tmp_path), "*.pdf", pieceBytes=piece, groupBytes=1).collect()
        got = {r["path"].split(f"{tmp_path}/")[1]: r for r in rows}
        assert set(got) == {"a.pdf", "sub/b.pdf", "sub/c.pdf", "d.pdf"}
        for name, r in got.items():
            assert (r["length"], bytes(r["head"]), r["file_hash"]) == (len(data[name]), data[name][:1024], hashlib.sha256(data[name]).hexdigest())
    gated = {r["path"].rsplit("/", 1)[1]: r for r in gate_digests(read_digests(spark, f"file://{tmp_path}", "*.pdf"), 5000).collect()}
    assert gated["a.pdf"]["error"].endswith("PDF exceeds max_bytes (5000)") and gated["b.pdf"]["error"].startswith("not a PDF")
    assert gated["c.pdf"]["error"] is None and gated["c.pdf"]["file_hash"] and gated["d.pdf"]["file_hash"] is None
    assert digest(io.BytesIO(b"abc"), 2, 2) == (3, b"ab", hashlib.sha256(b"abc").hexdigest())


@pytest.mark.parametrize("split", ["16b", "41b", "1k", "1m"])
def test_roster_rows_for_every_split_size(spark, tmp_path, split):
    from docaudit.sources.files import read_roster_csv

    text = 'h,i\r\n"two\nlines",c\r\n\n,d,"e ""x\ny"" f"\n' + "".join(f'{i},"a\n\n{i}",z\r\n' for i in range(40)) + 'plain,row\n"one,\n""q""\n",end\nlast "quote\nnext,row'
    (tmp_path / "r.csv").write_bytes(text.encode())
    (tmp_path / "s.csv").write_text("a,b\nc,d")
    (tmp_path / "t.csv").write_text("")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = [spark.conf.get(n, None) for n in names]
    spark.conf.set(names[0], split)
    spark.conf.set(names[1], "0")
    try:
        rows = read_roster_csv(spark, str(tmp_path), multiline=True).orderBy("position").collect()
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)
    want = [["h", "i"], ["two\nlines", "c"], ["", "d", 'e "x\ny" f'], *[[f"{i}", f"a\n\n{i}", "z"] for i in range(40)]]
    want += [["plain", "row"], ['one,\n"q"\n', "end"], ['last "quote'], ["next", "row"], ["a", "b"], ["c", "d"]]
    assert [r["cells"] for r in rows] == want


# ---- runs


def test_run_without_steps(spark):
    from docaudit.plans.jobs import ScanInputs, run_steps

    files = spark.createDataFrame([(1, 2, False)], "pdf_id long, site_id long, removed boolean")
    done = run_steps(ScanInputs(files, files, files, files), crawl=False, verify=False, archive=False)
    assert done.counts.count() == 0 and done.files.collect() == files.collect()


def test_crawl_does_not_shuffle_edges(spark):
    from docaudit.functions.suffixes import DEFAULT_SUFFIXES
    from docaudit.operators.links import _keyed_edges

    edges = spark.range(2000).select(
        F.format_string("https://a.example.edu/%d", F.col("id") % 50).alias("src"), F.format_string("https://b.example.edu/%d", "id").alias("dst")
    )
    links = _keyed_edges(edges, 4, DEFAULT_SUFFIXES)
    frontier = spark.createDataFrame([("s", "https://a.example.edu/3")], "site_id string, src string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = frontier.join(links, "src")
        plan = _plan(joined)
        assert joined.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and links.select("domain").distinct().collect()[0][0] == "example.edu", plan


def test_unlisted_top_level_labels(each):
    from dataclasses import replace

    from docaudit.functions.suffixes import DEFAULT_SUFFIXES
    from docaudit.functions.urls import registrable_domain

    hosts = ["a.foo.internal", "foo.local", "x.example.edu", "local"]
    assert each(hosts, registrable_domain(F.col("x"))) == ["", "", "example.edu", ""]
    listed = replace(DEFAULT_SUFFIXES, unlisted=True)
    assert each(hosts, registrable_domain(F.col("x"), listed)) == ["foo.internal", "foo.local", "example.edu", ""]


def test_buckets_grow_with_the_table(spark, monkeypatch):
    from check import compare, duck
    from docaudit.plans import queries_tables as T
    from docaudit.plans.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    made, create = [], KeyedTable.create
    monkeypatch.setattr(T, "_ROWS_PER_BUCKET", rows // 5 + 1)
    monkeypatch.setattr(KeyedTable, "create", lambda *a, **k: made.append(k["buckets"]) or create(*a, **k))
    con = duck(folder)
    for name in ("upsert_slice_on_disk", "delete_sites_on_disk", "replace_rules_on_disk"):
        ok, note = compare(QUERIES[name].run(spark, folder), con, QUERIES[name].sql)
        assert ok, note
    assert made == [5, 5, 5]


def test_queries_bound_what_a_coalesced_task_reads(spark):
    from docaudit.plans.catalog import QUERIES

    name, before = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set(name, "64m")
    try:
        QUERIES["url_representative"].run(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(name) == "16m"
    finally:
        spark.conf.set(name, before)
