import random
from dataclasses import replace
from urllib.parse import unquote, urljoin, urlsplit, urlunsplit

from pyspark.sql import functions as F

from docaudit.functions import urls as U
from docaudit.functions.text import percent_decode


def x():
    return F.col("x")


def test_ensure_scheme(each):
    got = each(
        ["a.example.edu", "a.example.edu/p", "http://a.example.edu", "//a.example.edu", "  a.b  ", "", "  ", None],
        U.ensure_scheme(x()),
    )
    assert got == [
        "https://a.example.edu", "https://a.example.edu/p", "http://a.example.edu",
        "https://a.example.edu", "https://a.b", "", "", "",
    ]


def test_is_pdf(each):
    urls = ["https://a/x.pdf", "https://a/x.pdf?d=1", "https://a/X.PDF", "https://a/x.html", "https://a/pdf/"]
    assert each(urls, U.is_pdf_url(x())) == [True, True, True, False, False]


def test_host(each):
    urls = [
        "https://Ab.Example.edu/x", "https://a.example.edu:8443/x", "not a url",
        "https://u:p@h.example.edu:1/", "http://[::1]:80/x", "a.example.edu", "http://a_b.example.edu/",
    ]
    assert each(urls, U.url_host(x())) == [
        "ab.example.edu", "a.example.edu", "", "h.example.edu", "::1", "", "a_b.example.edu",
    ]


def test_registrable_domain(each):
    values = [
        "https://hr.example.edu/x", "news.hr.example.edu", "www.shop.co.uk", "co.uk", "localhost",
        "10.0.0.12", "edu", "https://a.b.ac.nz:80/", "EXAMPLE.ORG",
    ]
    assert each(values, U.registrable_domain(x())) == [
        "example.edu", "example.edu", "shop.co.uk", "", "", "", "", "b.ac.nz", "example.org",
    ]


def test_suffix_rules(each):
    from docaudit.functions.suffixes import suffix_rules

    hosts = {
        "foo.cloud": "foo.cloud", "a.foo.health": "foo.health", "x.city.nhs.uk": "city.nhs.uk", "nhs.uk": "", "b.me.uk": "b.me.uk",
        "w.foo.lg.jp": "foo.lg.jp", "x.foo.co.de": "co.de", "a.b.any.ck": "b.any.ck", "any.ck": "", "x.www.ck": "www.ck", "www.ck": "www.ck",
        "y.xn--p1ai": "y.xn--p1ai", "a..b": "", "[::1]": "",
    }
    assert each(list(hosts), U.registrable_domain(x())) == list(hosts.values())
    listed = suffix_rules(["com", "github.test"])
    assert each(["b.com", "b.co.uk", "a.b.github.test"], U.registrable_domain(x(), listed)) == ["b.com", "", "b.github.test"]
    rules = replace(suffix_rules(["// comment", "", "com", "github.test // note", "*.wild", "!free.wild"]), unlisted=True)
    own = {"a.b.github.test": "b.github.test", "b.com": "b.com", "c.d.e.wild": "d.e.wild", "q.free.wild": "free.wild", "b.co.uk": "co.uk"}
    assert each(list(own), U.registrable_domain(x(), rules)) == list(own.values())
    inside = U.in_scope(F.concat(F.lit("http://"), x(), F.lit("/p")), "domain", F.array(F.lit("z.b.github.test")), suffixes=rules)
    assert each(list(own), inside) == [True, False, False, False, False]


def test_default_suffixes_are_the_whole_list(spark, each):
    from docaudit.functions import suffixes as S

    hosts = {
        "foo.com.ua": "foo.com.ua", "w.bar.com.ua": "bar.com.ua", "com.ua": "", "a.x.co.id": "x.co.id", "a.x.edu.vn": "x.edu.vn",
        "a.x.com.pl": "x.com.pl", "a.x.co.ke": "x.co.ke", "a.y.x.sch.uk": "y.x.sch.uk", "x.sch.uk": "", "a.b.x.city.kobe.jp": "city.kobe.jp",
        "a.x.公司.cn": "x.公司.cn", "a.x.xn--55qx5d.cn": "x.xn--55qx5d.cn", "me.github.io": "github.io", "a.x.nolist": "",
    }
    assert each(list(hosts), U.registrable_domain(x())) == list(hosts.values())
    inside = U.in_scope(F.concat(F.lit("http://"), x(), F.lit("/")), "domain", F.array(F.lit("w.foo.com.ua")))
    assert each(["a.x.nolist"], U.registrable_domain(x(), replace(S.DEFAULT_SUFFIXES, unlisted=True))) == ["x.nolist"]
    assert each(["foo.com.ua", "bar.com.ua"], inside) == [True, False]
    everything = S.read_suffix_rules(spark, f"file://{S.files(S.__package__).joinpath(S.LIST_FILE)}")
    assert S.DEFAULT_SUFFIXES.normal < everything.normal and "github.io" in everything.normal
    assert each(["a.me.github.io"], U.registrable_domain(x(), everything)) == ["me.github.io"]


def test_normalize_keeps_path_case(each):
    assert each(
        ["HTTPS://Ab.Example.edu/Docs/A.pdf?q=1#frag", "http://h/p?", "mailto:A@b"], U.normalize_url(x())
    ) == ["https://ab.example.edu/Docs/A.pdf?q=1", "http://h/p", "mailto:A@b"]


def test_normalize_against_the_standard_library(each):
    rng = random.Random(3)
    parts = ["http://", "HTTPS://", "//", "", "Host.Example", "u:p@h:80", "/A/b", "?q=1", "?", "#f", "x:y", "a b"]
    urls = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(300)]

    def expected(url):
        p = urlsplit(url)
        return urlunsplit((p.scheme.lower(), p.netloc.lower(), p.path, p.query, ""))

    got = each(urls, U.normalize_url(x()))
    assert [(u, g) for u, g in zip(urls, got) if g != expected(u)] == []


def test_join_against_the_standard_library(each):
    rng = random.Random(5)
    bases = ["http://h.example/a/b/c.html?q#f", "https://h.example", "http://h.example/", "https://h.example/a//b/"]
    pieces = ["..", ".", "a", "b.pdf", "/", "//", "?x=1", "#y", "c d", "http://o.example/z", "mailto:m@x", ""]
    pairs = [
        (rng.choice(bases), "/".join(rng.choice(pieces) for _ in range(rng.randint(1, 4)))) for _ in range(400)
    ] + [(b, p) for b in bases for p in pieces]
    got = each(pairs, U.url_join(F.col("b"), x()), "b string, x string")

    def same(base, href, value):
        # Only the identity of the URL matters; it is compared after normalisation.
        a, b = urlsplit(urljoin(base, href)), urlsplit(value)
        return (a.scheme, a.netloc, a.path or "/", a.query, a.fragment) == (
            b.scheme, b.netloc, b.path or "/", b.query, b.fragment,
        )

    assert [(p, g, urljoin(*p)) for p, g in zip(pairs, got) if not same(*p, g)] == []


def test_absolute_http_drops_other_schemes(each):
    assert each(["mailto:a@b", "javascript:void(0)", "/x", "ftp://h/x"], U.absolute_http(F.lit("http://h/p"), x())) == [
        None, None, "http://h/x", None,
    ]


def test_scopes(each):
    urls = ["https://a.example.edu/docs/x", "https://sub.a.example.edu/", "https://hr.example.edu/", "https://example.com/"]
    seeds = F.array(F.lit("A.example.edu"))
    assert each(urls, U.in_scope(x(), "host", seeds)) == [True, False, False, False]
    assert each(urls, U.in_scope(x(), "bogus", seeds)) == [True, False, False, False]
    assert each(urls, U.in_scope(x(), "subdomain", seeds)) == [True, True, False, False]
    assert each(urls, U.in_scope(x(), "domain", seeds)) == [True, True, True, False]
    assert each(urls, U.in_scope(x(), "path", seeds, F.lit("/docs/"))) == [True, False, False, False]
    assert each(urls, U.in_scope(x(), "path", seeds, F.lit("/other/"))) == [False] * 4
    none = F.lit(None).cast("string")
    assert each(urls, U.in_scope(x(), F.lit("path"), seeds, none)) == [True, False, False, False]
    assert each(urls, U.in_scope(x(), F.lit("domain"), seeds, none)) == [True, True, True, False]


def test_seed_hosts(each):
    hosts = U.seed_hosts(F.split("a", ","), F.split("x", ","))
    got = each([("HR.e.edu,hr.e.edu,news.e.edu", "https://z.e.edu/")], hosts, "a string, x string")
    assert got == [["hr.e.edu", "news.e.edu"]]
    empty = U.seed_hosts(F.array().cast("array<string>"), F.split("x", ","))
    assert each(["https://A.e.edu/x,https://a.e.edu"], empty) == [["a.e.edu"]]


def test_host_key(each):
    assert each(['"www.A.edu"', "https://www.a.edu/x", " a.edu ", ""], U.host_key(x())) == ["a.edu", "a.edu", "a.edu", ""]


def test_display(each):
    assert each(["https://h/p?q=1#f", "", "x"], U.url_display(x())) == ["h/p?q=1", "", "x"]


def test_percent_decode_leaves_plus_and_bad_escapes(each):
    values = ["a%20b+c", "%zz%2", "plain", "%C3%A9", None, "100%"]
    assert each(values, percent_decode(x())) == [unquote(v) if v is not None else None for v in values]
