from dataclasses import replace

from pyspark.sql import functions as F

from docaudit.functions import share_pages as S
from docaudit.functions.suffixes import DEFAULT_SUFFIXES
from docaudit.operators import links as L
from docaudit.operators.resolve import resolve_links

UNLISTED = replace(DEFAULT_SUFFIXES, unlisted=True)  # .test is no public suffix
PAGE = """<html><head><script>Box.postStreamData = {"k": {"items": [{"name": "a.docx", "extension": "docx"},
{"name": "Annual 'Report'.pdf", "extension": "PDF", "size": 9, "canDownload": true}]}};</script></head></html>"""
LOCKED = '<script>Box.postStreamData = {"x": {"items": [{"name": "L.pdf", "extension": "pdf", "canDownload": false}]}};</script>'


def test_hrefs(spark):
    html = (
        '<a href="/a.pdf">x</a><!-- <a href="/no1"> --><script>var t = "<a href=\'/no2\'>";</script>'
        "<A class=b HREF='/b?x=1&amp;y=2'>y</A><a href=c.html>z</a><area href='/no3'><a name=q>n</a><abbr href='/no4'>"
    )
    pages = spark.createDataFrame([(1, "http://h/p", html)], "page_id bigint, url string, html string")
    assert [r["href"] for r in L.extract_links(pages).collect()] == ["/a.pdf", "/b?x=1&y=2", "c.html"]


def test_attributes_and_references(spark):
    html = (
        '<a title="x > y" href="/a.pdf">1</a><a data-href=q class=b href=\'/c&#46;pdf&eacute;&#38;amp;\'>2</a>'
        '<a href=d?x=1&copy=2&#x1F600;>3</a><a name=z><a\nid=1\nHREF = "e&unknown;&amp;lt;&#0;&#xD800;">4</a>'
    )
    pages = spark.createDataFrame([(1, "http://h/p", html)], "page_id bigint, url string, html string")
    got = [r["href"] for r in L.extract_links(pages).collect()]
    assert got == ["/a.pdf", "/c.pdfé&amp;", "d?x=1&copy=2😀", "e&unknown;&lt;&#0;&#xD800;"]


def test_links_start_at_the_base(spark):
    html = '<head><base href="/root/"></head><a href="a.pdf">'
    pages = spark.createDataFrame([(1, "http://h/x/y", html), (2, "http://h/x/y", '<a href="a.pdf">')], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["url"] for r in L.absolute_links(L.extract_links(pages)).collect()}
    assert got == {1: "http://h/root/a.pdf", 2: "http://h/x/a.pdf"}


def test_all_scripts_of_a_share_page(each):
    url, item = "https://u.box.com/s/abc", '<script>Box.postStreamData={"items": [{"name":"%s","extension":"%s","canDownload":%s}]}</script>'
    other, quoted, locked = item % ("a.doc", "doc", "true"), item % ("b.pdf", "pdf", '"false"'), item % ("b.pdf", "pdf", "false")
    broken = '<script>Box.postStreamData={"items": [{"name":oops}]}</script>'
    got = each([other + quoted, other + locked, broken + quoted, quoted + broken, other], S.BoxShares().resolve(F.lit(url), F.col("x")))
    assert [(r["filename"], r["error"]) for r in got] == [("b.pdf", None), (None, S.LOCKED), (None, S.PARSE_ERROR), ("b.pdf", None), (None, S.NO_ITEM)]


def test_base_tag(each):
    assert each(['<base href="/root/">', "<p>"], L.page_base(F.lit("http://h/x/y"), F.col("x"))) == ["http://h/root/", "http://h/x/y"]


def test_precedence(spark):
    urls = [
        "http://h.edu/a.pdf", "http://o.edu/a.pdf", "https://t.box.com/s/k", "https://t.box.com/s/k.pdf", "http://h.edu/next", "http://o.edu/next",
    ]
    rows = [(u, "host", ["h.edu"], None, ext, res) for u in urls for ext, res in ((False, None), (True, ["other"]))]
    df = spark.createDataFrame(rows, "url string, scope string, hosts array<string>, path_prefix string, include_external_pdfs boolean, resolvers array<string>")
    got = {(r["url"], r["include_external_pdfs"]): (r["action"], r["offsite"], r["via_resolver"]) for r in L.classify_links(df).collect()}
    assert got[urls[0], False] == ("pdf", False, None)
    assert got[urls[1], False] == (None, True, None) and got[urls[1], True] == ("pdf", True, None)
    assert got[urls[2], False] == ("share", True, "box") and got[urls[2], True] == (None, None, None)
    assert got[urls[3], False][0] is None and got[urls[3], True][0] == "pdf"
    assert got[urls[4], False] == ("follow", None, None) and got[urls[5], False][0] is None


def test_share_pages(each):
    url = "https://univ.dept.box.com/s/abc123"
    cases = [
        (url, PAGE), (url, "<html>nothing</html>"), (url, LOCKED), ("https://example.com/x", PAGE), (url, None),
        (url, '<script>Box.postStreamData = {"items": [{"name": oops}]}</script>'),
    ]
    got = each(cases, S.BoxShares().resolve(F.col("u"), F.col("x")), "u string, x string")
    assert tuple(got[0]) == ("https://univ.app.box.com/public/static/abc123.pdf", "Annual Report.pdf", None)
    assert [r["error"] for r in got[1:]] == [S.NO_ITEM, S.LOCKED, S.NOT_SHARE, S.NOT_FETCHED, S.PARSE_ERROR]
    assert all(r["pdf_url"] is None for r in got[1:])
    assert each(["https://example.com/x"], S.resolve_share(F.col("x"), F.lit("")))[0]["error"] == "no resolver"
    assert [r.name for r in S.enabled_resolvers([])] == ["box"] and S.enabled_resolvers(["x"]) == ()


def test_resolve_links(spark):
    links = spark.createDataFrame(
        [(1, "p1", "https://t.box.com/s/a", "box", True), (1, "p2", "https://t.box.com/s/a", "box", True), (2, "p1", "https://t.box.com/s/z", "box", True)],
        "site_id bigint, parent_url string, share_url string, via_resolver string, offsite boolean",
    )
    snapshots = spark.createDataFrame([("https://t.box.com/s/a", PAGE)], "url string, html string")
    files, failures = resolve_links(links, snapshots)
    assert sorted((r["pdf_url"], r["parent_url"]) for r in files.collect()) == [("https://t.app.box.com/public/static/a.pdf", p) for p in ("p1", "p2")]
    assert [r["error_message"] for r in failures.collect()] == ["resolve https://t.box.com/s/z: could not fetch box page"]


def test_crawl_depths_and_cycles(spark):
    edges = spark.createDataFrame(
        [(f"http://h.test/{a}", f"http://{'o' if b == 'z' else 'h'}.test/{b}") for a, b in
         [("s", "a"), ("a", "b"), ("b", "s"), ("s", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("s", "z"), ("s", "s")]],
        "src string, dst string",
    )
    sites = spark.createDataFrame(
        [(1, "host", ["h.test"], None), (2, "host", ["o.test"], None), (3, "path", ["h.test"], "/b"), (4, "domain", ["x.o.test"], None)],
        "site_id bigint, scope string, hosts array<string>, path_prefix string",
    )
    seeds = spark.createDataFrame([(i, "http://h.test/s") for i in (1, 1, 2, 3, 4)], "site_id bigint, url string")
    full = {(r["site_id"], r["url"][7] + r["url"][-1]): r["depth"] for r in L.crawl_frontier(seeds, edges, sites, suffixes=UNLISTED).collect()}
    assert full == {
        (1, "hs"): 0, (1, "ha"): 1, (1, "hb"): 1, (1, "hc"): 2, (1, "hd"): 3, (2, "hs"): 0, (2, "oz"): 1, (3, "hs"): 0, (3, "hb"): 1,
        (4, "hs"): 0, (4, "oz"): 1,
    }
    near = L.crawl_frontier(seeds, edges, sites, max_depth=1).where("site_id = 1").collect()
    assert {r["url"][-1] for r in near} == {"s", "a", "b"}
