from pyspark.sql import functions as F

from docaudit.functions.archive import ArchiveRules, archive_reason
from docaudit.functions.display import class_badge, crawl_flags, text_type_cell
from docaudit.functions.storage import sanitize, storage_path
from docaudit.operators.storage import storage_plan

RULES = ArchiveRules(("/Past/", "/attic/"), ("retired-",), ("-v0", ".bak"), ("sunset", "attic"))


def test_archive_rules(each):
    cases = {
        "http://port.test/attic/minutes.pdf": "path segment '/attic/'",
        "http://port.test/x/PAST/retired-y.pdf": "path segment '/past/'",
        "http://port.test/x/Retired-list.PDF": "filename prefix 'retired-'",
        "http://port.test/x/plan-v0.pdf": "filename suffix '-v0'",
        "http://port.test/x/plan.bak.pdf?dl=1": "filename suffix '.bak'",
        "http://port.test/sunset-2020/plan.pdf": "keyword 'sunset'",
        "http://port.test/x/plan.pdf?from=attic": "keyword 'attic'",
        "http://port.test/x/v0-plan.pdf": None,
        "http://port.test/%50ast/plan.pdf": "path segment '/past/'",
        "http://port.test/q%3F/past/plan.pdf": None,
    }
    assert each(list(cases), archive_reason(F.col("x"), RULES)) == list(cases.values())


def _path(each, url, site="harbour", digest="0f1e2d3c4b5a69788796", template="{root}/{site}/{path}/{filename}", root="/vault", date="2031-03-09"):
    expr = storage_path(F.col("x"), F.lit(site), F.lit(digest), root=root, date=date, template=template)
    return each([url], expr)[0]


def test_storage_paths(each):
    assert _path(each, "http://port.test/tide/tables/spring%20neap.pdf") == "/vault/harbour/tide/tables/spring neap.pdf"
    assert _path(each, "http://port.test/tables.pdf") == "/vault/harbour/tables.pdf"
    assert _path(each, "http://port.test/get?doc=17") == "/vault/harbour/0f1e2d3c4b5a6978.pdf"
    assert _path(each, "http://port.test/get", digest=None) == "/vault/harbour/document.pdf"
    assert _path(each, "http://port.test/q/t.pdf", template="{root}/{date}/{site}-{filename}") == "/vault/2031-03-09/harbour-t.pdf"
    assert _path(each, "http://port.test/t.pdf", template="{root}/{hash}.pdf", digest=None) == "/vault/nohash.pdf"
    # A value never becomes a token of the template.
    assert _path(each, "http://port.test/%7Bdate%7D.pdf") == "/vault/harbour/{date}.pdf"


def test_sanitize(each):
    assert each(['a<b>:"c', " ..x.. ", "y" * 200, "a%2Fb"], sanitize(F.col("x"))) == [
        "a_b___c", "x", "y" * 150, "a_b",
    ]


def test_storage_plan_skips_existing(spark):
    files = spark.createDataFrame(
        [(2, "u2", "s", "H"), (1, "u1", "s", "H"), (3, "u3", "s", "K"), (4, "u4", "s", None)],
        "pdf_id bigint, pdf_url string, site string, file_hash string",
    )
    stored = spark.createDataFrame([("/d/s/K.pdf",)], "path string")
    rows = storage_plan(files, stored, root="/d", date="2026-01-01").collect()
    assert [(r["dest"], r["pdf_id"]) for r in rows] == [("/d/s/H.pdf", 1)]


def test_contents_that_share_a_name(spark):
    long_ = "http://port.test/" + "n" * 200
    files = spark.createDataFrame(
        [(4, long_ + "-b.pdf", "s", "HB"), (3, long_ + "-a.pdf", "s", "HA"), (5, long_ + "-c.pdf", "s", "HA"), (6, "http://port.test/x.pdf", "s", "HX"), (7, "http://q.test/x.pdf", "s", "HY")],
        "pdf_id bigint, pdf_url string, site string, file_hash string",
    )
    stored = spark.createDataFrame([], "path string")
    plan = storage_plan(files, stored, root="/d", date="2026-01-01", template="{root}/{filename}").collect()
    got = {r["pdf_id"]: r["dest"] for r in plan}
    assert got[6] == "/d/x.pdf" and got[7] == "/d/x-HY.pdf" and len(set(got.values())) == 4 and set(got) == {3, 4, 6, 7}


def test_display_codes(each):
    assert each(["good_to_go", "fit_for_automated_tagging", "needs_manual_remediation", "pending"], class_badge(F.col("x"))) == [
        "GO", "AUTO", "MANUAL", "-",
    ]
    assert each([("Image Only", False), ("Image Only", True), (None, True), ("Text", False)],
                text_type_cell(F.col("t"), F.col("x")), "t string, x boolean") == ["Image Only?", "Image Only", "-", "Text"]
    names = ["a", "v", "b", "c", "d", "e"]
    schema = "a boolean, v string, b boolean, c boolean, d boolean, e boolean"
    rows = [(True, "box", True, True, True, True), (False, None, False, False, False, False)]
    assert each(rows, crawl_flags(*[F.col(n) for n in names]), schema) == ["offsite via:box archived 404 p404 removed", "-"]


def test_archive_rules_behind_escapes_and_without_hits(spark, each):
    urls = [
        "http://p.test/%61ttic/a%20b.pdf", "http://p.test/x/a%20b.pdf", "http://p.test/x/plan%2520attic.pdf", "http://p.test/%zz/attic/x.pdf", None,
        "http://p.test/a%2%20/sunset", "http://p.test/ATTIC/%20.pdf",
    ]
    want = ["path segment '/attic/'", None, "keyword 'attic'", "path segment '/attic/'", None, "keyword 'sunset'", "path segment '/attic/'"]
    assert each(urls, archive_reason(F.col("x"), RULES)) == want
    # URLs without an escape but blanks are searched first, before anything is decoded or split.
    plan = spark.range(1).select(archive_reason(F.lit("http://p.test/x/a%20b.pdf"), RULES))._jdf.queryExecution().analyzed().toString()
    assert "get(transform(array(lower(replace(http://p.test/x/a%20b.pdf, %20,  )))" in plan, plan
