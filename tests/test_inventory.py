from pyspark.sql import functions as F

from docaudit.operators import inventory as I
from docaudit.operators.ordering import chunk_ids, last_per_key, number_rows
from docaudit.sources.schemas import PDF_FILES, PDF_REPORT, SITE, align_schema

FOUND = "pdf_url string, parent_url string, site_id bigint, via_resolver string, offsite boolean"


def _files(spark, rows):
    """Rows of (id, url, parent, site, hash, removed, pdf_404)."""
    full = [(i, u, p, s, h, None, False, None, None, dead, False, False, gone) for i, u, p, s, h, gone, dead in rows]
    return spark.createDataFrame(full, PDF_FILES)


def test_upsert_keeps_site_and_hash(spark):
    files = _files(spark, [(1, "u", "p", 7, "h", True, True), (2, "u", "q", 7, "k", False, False)])
    found = spark.createDataFrame([("u", "p", 8, "box", True), ("n", "p", 8, None, False)], FOUND)
    now = F.expr("TIMESTAMP '2026-01-01 00:00:00'")
    once = I.upsert_files(files, found, now)
    rows = {(r["pdf_url"], r["parent_url"]): r for r in once.collect()}
    old = rows["u", "p"]
    assert (old["pdf_id"], old["site_id"], old["file_hash"], old["removed"], old["pdf_404"]) == (1, 7, "h", False, True)
    assert (old["via_resolver"], old["offsite"]) == ("box", True)
    assert rows["u", "q"]["scanned_at"] is None
    new = rows["n", "p"]
    assert (new["site_id"], new["file_hash"], new["removed"]) == (8, None, False) and new["pdf_id"] is not None
    assert sorted(map(str, I.upsert_files(once, found, now).collect())) == sorted(map(str, once.collect()))


def test_unverified(spark):
    files = _files(
        spark,
        [(1, "a", "p", 1, None, False, False), (2, "b", "p", 1, "h", False, False), (3, "c", "p", 1, "x", False, False),
         (4, "d", "p", 1, None, True, False), (5, "e", "p", 1, None, False, True)],
    )
    reports = spark.createDataFrame([("h",)], "pdf_hash string")
    assert [r["pdf_id"] for r in I.verify_queue(files, reports).collect()] == [1, 3]
    assert [r["pdf_id"] for r in I.verify_queue(files, reports, 1).collect()] == [1]


def test_reports_and_rules(spark):
    base = [("h", 1, 1, True, False, None, True, True, 1, False, False)]
    reports = spark.createDataFrame(base, PDF_REPORT)
    fresh = spark.createDataFrame([(k, 9, 9, False, False, "Text", True, True, 2, True, True) for k in "hk"], PDF_REPORT)
    over = {r["pdf_hash"]: r["violations"] for r in I.upsert_reports(reports, fresh).collect()}
    keep = {r["pdf_hash"]: r["violations"] for r in I.upsert_reports(reports, fresh, overwrite=False).collect()}
    assert over == {"h": 9, "k": 9} and keep == {"h": 1, "k": 9}
    rules = spark.createDataFrame([("h", "1"), ("h", "2"), ("g", "3")], "pdf_hash string, clause string")
    new = spark.createDataFrame([("h", "9")], "pdf_hash string, clause string")
    assert sorted(I.replace_rules(rules, new).collect()) == [("g", "3"), ("h", "9")]
    done = spark.createDataFrame([("h",), ("g",)], "pdf_hash string")
    assert sorted(I.replace_rules(rules, new, done).collect()) == [("h", "9")]


def test_people_keep_manager_flag(spark):
    people = spark.createDataFrame(
        [(1, "e1", "Ann", "a@x", True)], "person_id bigint, employee_id string, full_name string, email string, is_manager boolean"
    )
    changes = spark.createDataFrame(
        [(5, "e1", "Anna", None), (6, "e2", "Bo", "b@x")], "person_id bigint, employee_id string, full_name string, email string"
    )
    rows = sorted(I.upsert_people(people, changes).collect())
    assert [tuple(r) for r in rows] == [(1, "e1", "Anna", None, True), (6, "e2", "Bo", "b@x", False)]


def test_emails_null_when_nobody_has_one(spark):
    people = spark.createDataFrame([(1, "b@x"), (2, "a@x"), (3, None)], "person_id bigint, email string")
    pairs = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (3, 2)], "person_id bigint, owner_id bigint")
    assert dict(tuple(r) for r in I.responsible_emails(people, pairs).collect()) == {1: "a@x; b@x", 2: None}


def test_cascades(spark):
    sites = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "site_id bigint, name string, owner_id bigint")
    files = _files(spark, [(1, "u", "p", 1, None, False, False), (2, "v", "p", 2, None, False, False)])
    failures = spark.createDataFrame([(1, 1, "m"), (2, 2, "n"), (None, None, "o")], "site_id bigint, pdf_id bigint, error_message string")
    s, f, x = I.delete_sites(sites, files, failures, sites.where("site_id = 1"))
    assert [r["site_id"] for r in s.collect()] == [2] and [r["pdf_id"] for r in f.collect()] == [2]
    assert sorted(tuple(map(str, r)) for r in x.collect()) == [("2", "2", "n"), ("None", "None", "m"), ("None", "None", "o")]
    owners = spark.createDataFrame([(5, "k")], "owner_id bigint, owner_key string")
    pairs = spark.createDataFrame([(1, 5), (1, 6)], "person_id bigint, owner_id bigint")
    o, s, m = I.delete_owners(owners, sites, pairs, owners)
    assert o.count() == 0 and [r["owner_id"] for r in s.collect()] == [None, None] and m.collect() == [(1, 6)]


def test_archive_flag_is_sticky(spark):
    files = _files(spark, [(1, "https://x/old/a.pdf", "p", 1, None, False, False), (2, "https://x/old/b.pdf", "p", 1, None, True, False)])
    marked = I.apply_archive(files)
    assert {r["pdf_id"]: r["archived"] for r in marked.collect()} == {1: True, 2: False}
    cleared = marked.withColumn("pdf_url", F.lit("https://x/new.pdf"))
    assert {r["pdf_id"]: r["archived"] for r in I.apply_archive(cleared).collect()} == {1: True, 2: False}


def test_site_requests(spark):
    rows = [("a", [" h.edu/x ", ""], None, "host"), ("b", [" "], None, None), ("c", ["u"], ["Z.edu"], "planet"), ("d", ["https://k.edu"], ["Z.edu"], "path")]
    good, bad = I.prepare_sites(spark.createDataFrame(rows, "name string, seeds array<string>, allowed_hosts array<string>, scope string"))
    configs = {r["name"]: r["config_json"] for r in good.collect()}
    assert configs["a"] == '{"seeds":["https://h.edu/x"],"allowed_hosts":["h.edu"],"scope":"host"}'
    assert '"allowed_hosts":["Z.edu"]' in configs["d"]
    assert {r["name"] for r in bad.collect()} == {"b", "c"}


def test_site_owner_errors(spark):
    sites = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "site_id bigint, name string, owner_id bigint")
    owners = spark.createDataFrame([(6, "k")], "owner_id bigint, owner_key string")
    wanted = spark.createDataFrame([("a", "k"), ("b", None), ("z", "k"), ("a2", "no")], "name string, owner_key string")
    after, errors = I.set_site_owner(sites, owners, wanted)
    assert {r["name"]: r["owner_id"] for r in after.collect()} == {"a": 6, "b": None}
    assert {r["error"] for r in errors.collect()} == {"No such site 'z'", "No such owner 'no'"}


def test_old_layouts(spark):
    old = spark.createDataFrame([("h", 3)], "pdf_hash string, violations int")
    row = align_schema(old, PDF_REPORT).collect()[0]
    assert (row["violations"], row["complex_graphic"], row["page_count"]) == (3, False, None)
    assert align_schema(spark.createDataFrame([("s",)], "name string"), SITE).collect()[0]["owner_id"] is None
    lifted = align_schema(old, PDF_REPORT)
    assert align_schema(lifted, PDF_REPORT).collect() == lifted.collect()


def test_row_numbers_over_many_partitions(spark):
    ids = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    rows = number_rows(ids, F.col("k")).collect()
    assert sorted((r["k"], r["row_no"]) for r in rows) == [(i, i + 1) for i in range(1000)]
    chunks = chunk_ids(ids, 300, F.col("k")).groupBy("chunk_id").count().collect()
    assert sorted(tuple(r) for r in chunks) == [(0, 300), (1, 300), (2, 300), (3, 100)]


def test_last_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, v string")
    assert sorted(last_per_key(df, ["k"], F.col("o")).collect()) == [("a", 2, "x"), ("b", 3, None)]
    # Without an order the greatest row counts, however the rows are cut or read.
    for parts in (1, 3):
        assert sorted(last_per_key(df.repartition(parts), ["k"]).collect()) == [("a", 2, "x"), ("b", 3, None)]


def test_last_change_of_a_key_counts(spark):
    sites = spark.createDataFrame([(1, "a", None), (2, "b", 9)], "site_id bigint, name string, owner_id bigint")
    owners = spark.createDataFrame([(5, "x"), (6, "y")], "owner_id bigint, owner_key string")
    wanted = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "name string, owner_key string")
    after, _ = I.set_site_owner(sites, owners, wanted)
    assert sorted((r["name"], r["owner_id"]) for r in after.collect()) == [("a", 5), ("b", 6)]
    people = spark.createDataFrame([(1, "e1", "N", None, False)], "person_id bigint, employee_id string, full_name string, email string, is_manager boolean")
    changes = spark.createDataFrame(
        [("e1", "Old", None, 1), ("e1", "New", "m", 2), ("e2", "First", None, 1), ("e2", "Second", None, 2)],
        "employee_id string, full_name string, email string, at int",
    )
    for parts in (1, 4):
        after = I.upsert_people(people, changes.repartition(parts), order=F.col("at"))
        assert sorted((r["employee_id"], r["full_name"]) for r in after.collect()) == [("e1", "New"), ("e2", "Second")]
    late = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", None, 3), ("b", "x", 2)], "name string, owner_key string, at int")
    after, _ = I.set_site_owner(sites, owners, late, F.col("at"))
    assert sorted((r["name"], r["owner_id"]) for r in after.collect()) == [("a", 5), ("b", None)]
