"""URL algebra as column expressions.

``parse_url`` is not used: under ANSI mode it raises on text that is not a URL
and gives null for hosts with ``_``. The generic RFC 3986 pattern never fails,
and a missing part is the empty string.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docaudit.functions.suffixes import DEFAULT_SUFFIXES, SuffixRules
from docaudit.functions.text import let, strip

_URL = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"
    r"(?:\?([^#]*))?(?:#(.*))?$"
)
_HIERARCHICAL = ("http", "https", "ftp", "file")

SCOPES = ("host", "subdomain", "domain", "path")

@dataclass(frozen=True)
class UrlParts:
    scheme: Column
    netloc: Column
    path: Column
    query: Column
    fragment: Column


_MARK = "\u0001"


def _clean(url: Column) -> Column:
    """Blanks before a URL and tabs and line ends inside it are dropped."""
    return F.ltrim(F.translate(F.coalesce(url, F.lit("")), f"\t\r\n{_MARK}", ""))


def with_parts(url: Column, body: Callable[[UrlParts], Column]) -> Column:
    """``body`` of the five parts of a URL, found with a single match."""
    split = F.split(
        F.regexp_replace(_clean(url), _URL, _MARK.join(f"${i}" for i in range(1, 6))), _MARK
    )
    return let(split, lambda p: body(UrlParts(F.lower(p[0]), p[1], p[2], p[3], p[4])))


def _join(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    rooted = F.when(
        (path == "") | path.startswith("/"), path
    ).otherwise(F.concat(F.lit("/"), path))
    authority = (
        F.when(netloc != "", F.concat(F.lit("//"), netloc, rooted))
        .when(path.startswith("//"), F.concat(F.lit("//"), path))
        .when(
            scheme.isin(*_HIERARCHICAL) & ((path == "") | path.startswith("/")),
            F.concat(F.lit("//"), path),
        )
        .otherwise(path)
    )
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        authority,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def ensure_scheme(url: Column, default_scheme: str = "https") -> Column:
    def qualify(text: Column) -> Column:
        return (
            F.when((text == "") | text.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), text)
            .when(text.startswith("//"), F.concat(F.lit(f"{default_scheme}:"), text))
            .otherwise(F.concat(F.lit(f"{default_scheme}://"), text))
        )

    return let(strip(F.coalesce(url, F.lit(""))), qualify)


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and authority, drop the fragment, keep path and query."""
    return with_parts(
        url, lambda p: let(F.lower(p.netloc), lambda n: _join(p.scheme, n, p.path, p.query, F.lit("")))
    )


def _host(netloc: Column) -> Column:
    # User info first, then a bracketed address or everything up to the port.
    bare = F.regexp_replace(netloc, r"^.*@", "")
    return F.lower(F.regexp_replace(bare, r"^(?:\[([^\]]*).*|([^:]*).*)$", "$1$2"))


def url_host(url: Column) -> Column:
    """Host in lower case without port or user info; empty when there is none."""
    return _host(url_netloc(url))


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _URL, 2)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _URL, 3)


def is_pdf_url(url: Column) -> Column:
    return F.lower(url_path(url)).endswith(".pdf")


def url_display(url: Column) -> Column:
    """Host, path and query without the scheme; the input when that is empty."""

    def shown(p: UrlParts) -> Column:
        return F.concat(
            p.netloc, p.path, F.when(p.query != "", F.concat(F.lit("?"), p.query)).otherwise("")
        )

    return F.coalesce(F.nullif(with_parts(url, shown), F.lit("")), url)


def registrable_domain(url_or_host: Column, suffixes: SuffixRules = DEFAULT_SUFFIXES) -> Column:
    """Public suffix plus one label of a URL or bare host; empty for addresses and bare suffixes."""

    def host_part(value: Column) -> Column:
        # Bare hosts may still carry user info, a port or a path.
        bare = F.regexp_extract(F.regexp_replace(value, r"^[^/?#]*@", ""), r"^([^/?#:]*)", 1)
        return F.when(F.contains(value, F.lit("://")), url_host(value)).otherwise(F.lower(bare))

    def domain(host: Column) -> Column:
        def cut(labels: Column) -> Column:
            return let(
                suffixes.suffix_start(labels),
                lambda at: F.when(
                    at > 0, F.array_join(F.slice(labels, at, F.size(labels) - at + 1), ".")
                ).otherwise(F.lit("")),
            )

        address = host.rlike(r"^[0-9.]*$|:|\.\.|^\.")
        return F.when(address, F.lit("")).otherwise(let(F.split(host, "\\."), cut))

    host = let(F.coalesce(url_or_host, F.lit("")), host_part)
    return let(F.rtrim(host, F.lit(".")), domain)


def seed_hosts(allowed_hosts: Column, seeds: Column) -> Column:
    """Distinct lower-case hosts, taken from the allow list when it has any."""
    source = F.when(F.size(F.coalesce(allowed_hosts, F.array())) > 0, allowed_hosts).otherwise(
        F.coalesce(seeds, F.array())
    )
    hosts = F.transform(
        source,
        lambda e: F.when(F.contains(e, F.lit("://")), url_host(e)).otherwise(F.lower(e)),
    )
    return F.array_distinct(F.filter(hosts, lambda h: h != ""))


def strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def host_key(cell: Column) -> Column:
    """Comparable host of a roster cell."""

    def key(value: Column) -> Column:
        host = F.nullif(url_host(ensure_scheme(value)), F.lit(""))
        return strip_www(F.coalesce(host, F.lower(value)))

    return let(F.btrim(strip(F.coalesce(cell, F.lit(""))), F.lit('"')), key)


def _resolve_dots(path: Column) -> Column:
    def step(acc: Column, seg: Column) -> Column:
        return (
            F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(seg == ".", acc)
            .otherwise(F.concat(acc, F.array(seg)))
        )

    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    closing = F.when(path.rlike(r"(^|/)\.{1,2}$"), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    joined = F.array_join(F.concat(kept, closing), "/")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("/"))


def _without_dots(path: Column) -> Column:
    return let(
        path,
        lambda p: F.when(p.rlike(r"(^|/)\.{1,2}(/|$)"), _resolve_dots(p)).otherwise(p),
    )


def url_join(base: Column, href: Column) -> Column:
    """Resolve ``href`` against ``base`` (RFC 3986 section 5)."""

    def resolve(b: UrlParts, r: UrlParts, text: Column) -> Column:
        folder = F.coalesce(
            F.nullif(F.regexp_extract(b.path, r"(?s)^(.*/)", 1), F.lit("")), F.lit("/")
        )
        merged = F.when(r.path.startswith("/"), r.path).otherwise(
            F.regexp_replace(F.concat(folder, r.path), "/{2,}", "/")
        )
        same = (r.scheme == "") | (r.scheme == b.scheme)
        here = r.netloc == ""
        empty = r.path == ""
        path = F.when(~here, r.path).when(empty, b.path).otherwise(_without_dots(merged))
        query = F.when(here & empty & (r.query == ""), b.query).otherwise(r.query)
        netloc = F.when(here, b.netloc).otherwise(r.netloc)
        joined = let(
            F.array(b.scheme, netloc, path, query, r.fragment),
            lambda u: _join(u[0], u[1], u[2], u[3], u[4]),
        )
        return F.when(same & b.scheme.isin(*_HIERARCHICAL), joined).otherwise(text)

    def join(text: Column) -> Column:
        return F.when(text == "", base).otherwise(
            with_parts(base, lambda b: with_parts(text, lambda r: resolve(b, r, text)))
        )

    return let(_clean(href), join)


def absolute_http(base: Column, href: Column) -> Column:
    """Absolute URL of a link, or null when it is not http(s)."""
    return let(url_join(base, href), lambda u: F.when(F.lower(u).rlike(r"^https?://"), u))


def host_domains(hosts: Column, suffixes: SuffixRules = DEFAULT_SUFFIXES) -> Column:
    """Distinct registrable domains of an array of hosts: once per site instead of once per link."""
    found = F.transform(hosts, lambda h: registrable_domain(F.lower(h), suffixes))
    return F.array_distinct(F.filter(found, lambda d: d != ""))


def in_scope(
    url: Column,
    scope: Column | str,
    hosts: Column,
    path_prefix: Column | None = None,
    suffixes: SuffixRules = DEFAULT_SUFFIXES,
    domains: Column | None = None,
    domain: Column | None = None,
) -> Column:
    """Crawl scope test against an array of seed hosts. An unknown scope acts as ``host``.

    A scope given as text picks its test while the plan is built; a column picks it per
    row, and only the test of that row's scope runs. ``domains`` are the registrable domains of the seed hosts
    (:func:`host_domains`) and ``domain`` that of the URL, where they are known already; looking them up is the dearest part.
    """
    lowered = F.transform(hosts, F.lower)
    no = F.lit(False)

    def host_test() -> Column:
        return F.array_contains(lowered, url_host(url))

    def subdomain_test() -> Column:
        return let(
            url_host(url),
            lambda h: F.exists(lowered, lambda s: (h == s) | h.endswith(F.concat(F.lit("."), s))),
        )

    def domain_test() -> Column:
        own = registrable_domain(url, suffixes) if domain is None else domain
        if domains is not None:
            return let(own, lambda d: (d != "") & F.array_contains(domains, d))
        return let(
            own, lambda d: (d != "") & F.exists(lowered, lambda s: registrable_domain(s, suffixes) == d)
        )

    def path_test() -> Column:
        if path_prefix is None:
            return host_test()
        return host_test() & (path_prefix.isNull() | F.startswith(url_path(url), path_prefix))

    tests = {"subdomain": subdomain_test, "domain": domain_test, "path": path_test}
    if isinstance(scope, str):
        return F.coalesce(tests.get(scope, host_test)(), no)
    chosen = F.when(scope == "subdomain", subdomain_test())
    for name in ("domain", "path"):
        chosen = chosen.when(scope == name, tests[name]())
    return F.coalesce(chosen.otherwise(host_test()), no)
