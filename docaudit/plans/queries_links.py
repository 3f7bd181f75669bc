"""Queries on URLs, links, crawls and share pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions import share_pages as S
from docaudit.functions import urls as U
from docaudit.functions.archive import archive_reason, is_archived
from docaudit.functions.display import class_badge, crawl_flags, text_type_cell
from docaudit.functions.storage import sanitize, storage_path
from docaudit.operators import links as L
from docaudit.operators.inventory import dedup_discovery
from docaudit.operators.resolve import join_share_pages, resolve_links
from docaudit.operators.status import classify_files
from docaudit.plans.fixtures import Fixtures
from docaudit.plans.registry import query
from docaudit.sources.site_config import with_config

_HOST = r"lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#:]*)', 1))"


# -- scalars -------------------------------------------------------------------
def _raw_urls(fx: Fixtures, cases: str) -> DataFrame:
    return fx.sql(f"SELECT page_id, {cases} AS raw FROM pages")


_BARE = "regexp_replace(url, '^https?:', '')"
_SCHEMES = f"""CASE WHEN length(url) % 3 = 0 THEN url WHEN length(url) % 3 = 1 THEN {_BARE}
 ELSE '  ' || substr({_BARE}, 3) || ' ' END"""


@query(
    "url_ensure_scheme",
    """SELECT page_id, CASE WHEN length(url) % 3 = 0 THEN url
              ELSE 'https://' || regexp_replace(url, '^https?://', '') END AS url FROM pages""",
)
def _(fx: Fixtures):
    return _raw_urls(fx, _SCHEMES).select("page_id", U.ensure_scheme(F.col("raw")).alias("url"))


_MIXED = """CASE WHEN length(url) % 2 = 0 THEN url
 ELSE upper(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) || '#Top?x' END"""


@query(
    "url_normalize",
    """SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) ||
              regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]*(.*)$', 1), '#.*$', ''), '\\?$', '') AS url
       FROM pages""",
)
def _(fx: Fixtures):
    return _raw_urls(fx, _MIXED).select("page_id", U.normalize_url(F.col("raw")).alias("url"))


_PORTS = """CASE WHEN length(url) % 3 = 0 THEN regexp_replace(url, '^(https?://[^/?#]*)', '$1:8443')
 WHEN length(url) % 3 = 1 THEN regexp_replace(url, '^(https?)://', '$1://user:pw@')
 ELSE 'not a url ' || substr(url, 9) END"""


@query(
    "url_host",
    """SELECT page_id, CASE WHEN length(url) % 3 < 2 THEN lower(regexp_extract(url, '^https?://([^/?#]*)', 1))
              ELSE '' END AS host FROM pages""",
)
def _(fx: Fixtures):
    return _raw_urls(fx, _PORTS).select("page_id", U.url_host(F.col("raw")).alias("host"))


@query(
    "url_registrable_domain",
    """SELECT DISTINCT host, domain, domain AS bare_domain FROM (
         SELECT lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host,
                lower(regexp_extract(url, '([^/.]+\\.[^/.?#]+)([/?#].*)?$', 1)) AS unused,
                split_part(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '.', -2) || '.' ||
                split_part(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '.', -1) AS domain
         FROM pages) x""",
)
def _(fx: Fixtures):
    hosts = fx.table("pages").select(U.url_host(F.col("url")).alias("host"), "url")
    return hosts.select(
        "host",
        U.registrable_domain(F.col("url")).alias("domain"),
        U.registrable_domain(F.col("host")).alias("bare_domain"),
    ).distinct()


@query(
    "url_is_pdf",
    """SELECT page_id, href, lower(regexp_replace(regexp_replace(href, '#.*$', ''), '\\?.*$', '')) LIKE '%.pdf' AS is_pdf
       FROM v_link""",
)
def _(fx: Fixtures):
    return fx.view("v_link").select("page_id", "href", U.is_pdf_url(F.col("href")).alias("is_pdf"))


@query(
    "url_seed_hosts",
    """SELECT site_id, host || ',portal.dept' || regexp_extract(host, 'dept([0-9]+)', 1) || '.example.edu' AS hosts
       FROM v_site""",
)
def _(fx: Fixtures):
    return with_config(fx.sites).select(
        "site_id",
        F.array_join(
            U.seed_hosts(F.col("config.allowed_hosts"), F.col("config.seeds")), ","
        ).alias("hosts"),
    )


@query(
    "url_host_key",
    """SELECT site_id, regexp_replace(host, '^www\\.', '') AS from_host,
              regexp_replace(host, '^www\\.', '') AS from_cell FROM v_site""",
)
def _(fx: Fixtures):
    cell = F.concat(F.lit(' "HTTPS://'), F.upper("host"), F.lit(':80/x" '))
    return fx.sites.select(
        "site_id",
        U.host_key(F.col("host")).alias("from_host"),
        U.host_key(F.regexp_replace(cell, "HTTPS://", "https://")).alias("from_cell"),
    )


_JOINED = """CASE WHEN href LIKE 'https://%' THEN href
 ELSE regexp_extract(parent_url, '^(https?://[^/?#]*)', 1) || href END"""
_NORMAL = f"""lower(regexp_extract({_JOINED}, '^(https?://[^/?#]*)', 1)) ||
 regexp_replace(regexp_replace(regexp_extract({_JOINED}, '^https?://[^/?#]*(.*)$', 1), '#.*$', ''), '\\?$', '')"""


@query("url_join_absolute", f"SELECT page_id, href, {_JOINED} AS url FROM v_link")
def _(fx: Fixtures):
    return fx.view("v_link").select(
        "page_id", "href", U.absolute_http(F.col("parent_url"), F.col("href")).alias("url")
    )


@query(
    "url_join_relative",
    """SELECT page_id, root || '/x/y/doc.pdf?a=1' AS child, root || '/x/doc.pdf' AS parent,
              root || '/doc.pdf' AS above, 'http://cdn.example.org/a' AS other, root || '/x/y/z.html?q' AS only_query
       FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root FROM pages) p
       """.replace("'http://cdn.example.org/a'", "regexp_extract(root, '^(https?)', 1) || '://cdn.example.org/a'"),
)
def _(fx: Fixtures):
    base = F.concat(F.regexp_extract("url", r"^(https?://[^/?#]*)", 1), F.lit("/x/y/z.html?old#f"))
    refs = {
        "child": "./doc.pdf?a=1", "parent": "../doc.pdf", "above": "../../../doc.pdf",
        "other": "//cdn.example.org/a", "only_query": "?q",
    }
    return fx.table("pages").select(
        "page_id", *[U.url_join(base, F.lit(ref)).alias(name) for name, ref in refs.items()]
    )


@query(
    "url_display",
    """SELECT pdf_id, regexp_replace(pdf_url, '^https://', '') AS shown FROM v_pdf_files""",
)
def _(fx: Fixtures):
    return fx.files.select("pdf_id", U.url_display(F.col("pdf_url")).alias("shown"))


_ARCHIVE = """CASE
 WHEN lower(path) LIKE '%/old/%' THEN 'path segment ''/old/'''
 WHEN lower(path) LIKE '%/archive/%' THEN 'path segment ''/archive/'''
 WHEN name LIKE 'legacy!_%' ESCAPE '!' THEN 'filename prefix ''legacy_'''
 WHEN regexp_replace(name, '\\.pdf$', '') LIKE '%!_old' ESCAPE '!' THEN 'filename suffix ''_old'''
 WHEN lower(pdf_url) LIKE '%archive%' THEN 'keyword ''archive'''
 WHEN lower(pdf_url) LIKE '%legacy%' THEN 'keyword ''legacy''' END"""
_ARCHIVE_FROM = """(SELECT f.*, lower(regexp_replace(replace(pdf_url, '%20', ' '), '\\?.*$', '')) AS path,
   lower(regexp_extract(regexp_replace(replace(pdf_url, '%20', ' '), '\\?.*$', ''), '([^/]*)$', 1)) AS name
 FROM v_pdf_files f) x"""


@query("url_archive_reason", f"SELECT pdf_id, {_ARCHIVE} AS reason FROM {_ARCHIVE_FROM}")
def _(fx: Fixtures):
    return fx.files.select("pdf_id", archive_reason(F.col("pdf_url")).alias("reason"))


@query(
    "archive_test",
    f"""SELECT DISTINCT pdf_url AS url, {_ARCHIVE} IS NOT NULL AS archived, {_ARCHIVE} AS reason
        FROM {_ARCHIVE_FROM}""",
)
def _(fx: Fixtures):
    reason = archive_reason(F.col("url"))
    return (
        fx.files.select(F.col("pdf_url").alias("url"))
        .distinct()
        .select("url", reason.isNotNull().alias("archived"), reason.alias("reason"))
    )


@query("is_archived", f"SELECT pdf_id FROM {_ARCHIVE_FROM} WHERE {_ARCHIVE} IS NOT NULL")
def _(fx: Fixtures):
    return fx.files.where(is_archived(F.col("pdf_url"))).select("pdf_id")


@query(
    "path_sanitize",
    r"""SELECT doc_id, substr(trim(trim(regexp_replace(text, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), ' '), '.'), 1, 150) AS part
        FROM documents""",
)
def _(fx: Fixtures):
    # Percent signs in prose are no escapes the check engine would leave alone.
    return fx.table("documents").select("doc_id", sanitize(F.replace("text", F.lit("%"), F.lit("%25"))).alias("part"))


@query(
    "storage_path",
    r"""SELECT f.pdf_id,
          '/data/' || s.name || '/2026-01-31/' || regexp_replace(
            CASE WHEN lower(u) LIKE '%.pdf' THEN replace(u, '%20', ' ')
                 ELSE u END, '^https?://[^/]*/', '') AS mirrored,
          '/data/' || s.name || '/' || COALESCE(f.file_hash, 'nohash') || '.pdf' AS addressed
        FROM (SELECT *, regexp_replace(pdf_url, '\?.*$', '') AS u FROM v_pdf_files) f
        JOIN v_site s ON s.site_id = f.site_id""",
)
def _(fx: Fixtures):
    rows = fx.files.join(fx.sites.select("site_id", "name"), "site_id")
    args = (F.col("pdf_url"), F.col("name"), F.col("file_hash"))
    mirror = "{root}/{site}/{date}/{path}/{filename}"
    return rows.select(
        "pdf_id",
        storage_path(*args, root="/data", date="2026-01-31", template=mirror).alias("mirrored"),
        storage_path(*args, root="/data", date="2026-01-31").alias("addressed"),
    )


@query(
    "class_badge",
    """SELECT pdf_url, parent_url, CASE classification WHEN 'good_to_go' THEN 'GO'
              WHEN 'fit_for_automated_tagging' THEN 'AUTO'
              WHEN 'needs_manual_remediation' THEN 'MANUAL' ELSE '-' END AS badge FROM v_export""",
)
def _(fx: Fixtures):
    return classify_files(fx.files, fx.triaged).select(
        "pdf_url", "parent_url", class_badge(F.col("classification")).alias("badge")
    )


@query(
    "text_type_cell",
    """SELECT pdf_hash, CASE WHEN text_type IS NULL THEN '-'
              WHEN text_type = 'Image Only' AND NOT image_only THEN 'Image Only?' ELSE text_type END AS cell
       FROM v_report""",
)
def _(fx: Fixtures):
    return fx.reports.select(
        "pdf_hash", text_type_cell(F.col("text_type"), F.col("image_only")).alias("cell")
    )


@query(
    "crawl_flags",
    """SELECT pdf_id, COALESCE(NULLIF(concat_ws(' ', CASE WHEN offsite THEN 'offsite' END,
              'via:' || via_resolver, CASE WHEN archived THEN 'archived' END, CASE WHEN pdf_404 THEN '404' END,
              CASE WHEN parent_404 THEN 'p404' END, CASE WHEN removed THEN 'removed' END), ''), '-') AS flags
       FROM v_pdf_files""",
)
def _(fx: Fixtures):
    names = ("offsite", "via_resolver", "archived", "pdf_404", "parent_404", "removed")
    return fx.files.select("pdf_id", crawl_flags(*[F.col(n) for n in names]).alias("flags"))


# -- scope ---------------------------------------------------------------------
def _seeds() -> Column:
    return F.array(F.lit("Thther.example.org"), F.lit("www.ththhe.example.com"))


def _scoped(fx: Fixtures, scope: str, hosts: Column, prefix=None) -> DataFrame:
    pages = fx.table("pages")
    return pages.where(U.in_scope(F.col("url"), scope, hosts, prefix)).select("page_id", "url")


_PAGE_HOST = "lower(regexp_extract(url, '^https?://([^/?#]*)', 1))"
_SEED_LIST = "('thther.example.org', 'www.ththhe.example.com')"


@query("scope_host", f"SELECT page_id, url FROM pages WHERE {_PAGE_HOST} IN {_SEED_LIST}")
def _(fx: Fixtures):
    return _scoped(fx, "host", _seeds())


@query("scope_unknown", f"SELECT page_id, url FROM pages WHERE {_PAGE_HOST} IN {_SEED_LIST}")
def _(fx: Fixtures):
    return _scoped(fx, "everything", _seeds())


@query(
    "scope_subdomain",
    f"""SELECT page_id, url FROM pages WHERE {_PAGE_HOST} = 'example.org'
        OR {_PAGE_HOST} LIKE '%.example.org' OR {_PAGE_HOST} = 'm.ththth.example.net'""",
)
def _(fx: Fixtures):
    return _scoped(fx, "subdomain", F.array(F.lit("example.org"), F.lit("m.ththth.example.net")))


@query(
    "scope_domain",
    f"SELECT page_id, url FROM pages WHERE {_PAGE_HOST} LIKE '%.example.com' OR {_PAGE_HOST} = 'example.com'",
)
def _(fx: Fixtures):
    return _scoped(fx, "domain", F.array(F.lit("any.thing.example.com")))


@query(
    "scope_path",
    f"SELECT page_id, url FROM pages WHERE {_PAGE_HOST} IN {_SEED_LIST} AND url LIKE 'http%//%/en/%'",
)
def _(fx: Fixtures):
    return _scoped(fx, "path", _seeds(), F.lit("/en/"))


@query(
    "html_only",
    """SELECT page_id FROM pages WHERE length(url) % 4 <> 2""",
)
def _(fx: Fixtures):
    kind = (
        F.when(F.length("url") % 4 == 0, "TEXT/HTML; charset=utf-8")
        .when(F.length("url") % 4 == 1, "")
        .when(F.length("url") % 4 == 2, "application/pdf")
    )
    return L.html_only(fx.table("pages").withColumn("content_type", kind)).select("page_id")


# -- links ---------------------------------------------------------------------
@query(
    "extract_links",
    """SELECT page_id, parent_url, href FROM (
         SELECT page_id, url AS parent_url,
                unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) x""",
)
def _(fx: Fixtures):
    return L.extract_links(fx.table("pages")).drop("base_url")


def _crawl_links(fx: Fixtures) -> DataFrame:
    """Links of every page with the crawl settings of the page's site."""
    sites = fx.view("v_crawl_site").select(
        "site_id",
        "scope",
        F.array("host").alias("hosts"),
        F.lit("/en/").alias("path_prefix"),
        "include_external_pdfs",
        F.lit(None).cast("array<string>").alias("resolvers"),
    )
    links = L.absolute_links(fx.view("v_link"))
    return links.withColumn("site_id", U.url_host(F.col("parent_url"))).join(L.with_domains(sites), "site_id")


def _classified(fx: Fixtures) -> DataFrame:
    return L.classify_links(_crawl_links(fx))


_TARGET = "lower(regexp_extract(u, '^https?://([^/?#]*)', 1))"
_CLASSIFIED = f"""(
 SELECT y.*, CASE WHEN is_pdf AND (inside OR include_external_pdfs) THEN 'pdf' WHEN is_pdf THEN NULL
                  WHEN is_share THEN 'share' WHEN inside THEN 'follow' END AS action,
        CASE WHEN is_pdf OR is_share THEN NOT inside END AS offsite,
        CASE WHEN is_share AND NOT is_pdf THEN 'box' END AS via_resolver
 FROM (SELECT x.*, lower(regexp_replace(u, '\\?.*$', '')) LIKE '%.pdf' AS is_pdf,
              u LIKE 'https://t%.box.com/s/k%' AS is_share,
              CASE scope WHEN 'subdomain' THEN {_TARGET} = host OR {_TARGET} LIKE '%.' || host
                   WHEN 'domain' THEN split_part({_TARGET}, '.', -2) || split_part({_TARGET}, '.', -1)
                                      = split_part(host, '.', -2) || split_part(host, '.', -1)
                   WHEN 'path' THEN {_TARGET} = host AND regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1) LIKE '/en/%'
                   ELSE {_TARGET} = host END AS inside
       FROM (SELECT l.*, {_NORMAL} AS u, s.site_id, s.host, s.scope, s.include_external_pdfs
             FROM v_link l JOIN v_crawl_site s
               ON s.host = lower(regexp_extract(l.parent_url, '^https?://([^/?#]*)', 1))) x) y) z"""


@query(
    "classify_link",
    f"""SELECT page_id, parent_url, href, u AS url, action, offsite, via_resolver FROM {_CLASSIFIED}""",
)
def _(fx: Fixtures):
    return _classified(fx).select(
        "page_id", "parent_url", "href", "url", "action", "offsite", "via_resolver"
    )


@query(
    "dedup_discovery",
    f"""SELECT DISTINCT site_id, u AS pdf_url, parent_url, offsite FROM {_CLASSIFIED} WHERE action = 'pdf'""",
)
def _(fx: Fixtures):
    return dedup_discovery(L.discovered_files(_classified(fx))).select(
        "site_id", "pdf_url", "parent_url", "offsite"
    )


@query(
    "resolver_match",
    f"""SELECT page_id, href, CASE WHEN u LIKE 'https://t%.box.com/s/k%' THEN 'box' END AS resolver
        FROM {_CLASSIFIED}""",
)
def _(fx: Fixtures):
    return L.absolute_links(fx.view("v_link")).select(
        "page_id", "href", S.resolver_name(F.col("url"), S.enabled_resolvers()).alias("resolver")
    )


_SHARES = f"(SELECT * FROM {_CLASSIFIED} WHERE action = 'share') s"
_ERROR = """CASE WHEN p.url IS NULL OR p.html IS NULL THEN 'could not fetch box page'
 WHEN n % 7 = 0 OR (n % 11 = 0 AND n % 3 <> 0) THEN 'no downloadable pdf item found'
 WHEN n % 4 = 0 THEN 'box file is not downloadable' END"""


def _share_links(fx: Fixtures) -> DataFrame:
    return _classified(fx).where(F.col("action") == "share").select(
        "site_id", "parent_url", F.col("url").alias("share_url"), "via_resolver", "offsite"
    )


@query(
    "resolve_join",
    f"""SELECT DISTINCT s.u AS share_url, p.html AS share_html FROM {_SHARES}
        LEFT JOIN v_share_page p ON p.url = s.u""",
)
def _(fx: Fixtures):
    return join_share_pages(_share_links(fx), fx.view("v_share_page"))


@query(
    "share_items",
    """SELECT url, CASE WHEN n % 5 = 0 OR n % 7 = 0 THEN NULL ELSE 1 END AS n_items,
              CASE WHEN n % 5 = 0 OR n % 7 = 0 THEN NULL ELSE 'Fees ' || CAST(n AS STRING) || '.pdf' END AS name,
              CASE WHEN n % 5 = 0 OR n % 7 = 0 THEN NULL ELSE n * 10 END AS size
       FROM v_share_page""",
)
def _(fx: Fixtures):
    items = fx.view("v_share_page").select("url", S.share_items(F.col("html")).alias("items"))
    first = F.get("items", F.lit(0))
    return items.select(
        "url",
        F.nullif(F.size("items"), F.lit(-1)).alias("n_items"),
        first["name"].alias("name"),
        first["size"].alias("size"),
    )


@query(
    "first_pdf_item",
    """SELECT url, 'Fees ' || CAST(n AS STRING) || '.pdf' AS name FROM v_share_page
       WHERE n % 5 <> 0 AND n % 7 <> 0 AND NOT (n % 11 = 0 AND n % 3 <> 0)""",
)
def _(fx: Fixtures):
    item = S.first_pdf_item(S.share_items(F.col("html")))
    found = fx.view("v_share_page").select("url", item.alias("item"))
    return found.where(F.col("item").isNotNull()).select("url", F.col("item.name").alias("name"))


@query(
    "share_resolve",
    f"""SELECT p.url, CASE WHEN {_ERROR} IS NULL THEN regexp_replace(replace(p.url, '.box.com/s/', '.app.box.com/public/static/'), '$', '.pdf') END AS pdf_url,
               CASE WHEN {_ERROR} IS NULL THEN 'Fees ' || CAST(n AS STRING) || '.pdf' END AS filename, {_ERROR} AS error
        FROM v_share_page p""",
)
def _(fx: Fixtures):
    return (
        fx.view("v_share_page")
        .select("url", S.resolve_share(F.col("url"), F.col("html")).alias("r"))
        .select("url", "r.*")
    )


@query(
    "resolve_links",
    f"""SELECT DISTINCT 'file' AS kind, s.parent_url AS parent_url, p.url || '' AS share,
               replace(p.url, '.box.com/s/', '.app.box.com/public/static/') || '.pdf' AS value
        FROM {_SHARES} JOIN v_share_page p ON p.url = s.u WHERE {_ERROR} IS NULL
        UNION ALL
        SELECT 'failure', NULL, NULL, 'resolve ' || s.u || ': ' || {_ERROR}
        FROM {_SHARES} LEFT JOIN v_share_page p ON p.url = s.u WHERE {_ERROR} IS NOT NULL""",
)
def _(fx: Fixtures):
    files, failures = resolve_links(_share_links(fx), fx.view("v_share_page"))
    none = F.lit(None).cast("string")
    share = F.regexp_replace(
        F.regexp_replace("pdf_url", r"\.app\.box\.com/public/static/", ".box.com/s/"), r"\.pdf$", ""
    )
    return files.select(
        F.lit("file").alias("kind"), "parent_url", share.alias("share"), F.col("pdf_url").alias("value")
    ).unionByName(
        failures.select(
            F.lit("failure").alias("kind"),
            none.alias("parent_url"),
            none.alias("share"),
            F.col("error_message").alias("value"),
        )
    )


# -- crawl ---------------------------------------------------------------------
_DOMAIN = "split_part({h}, '.', -2) || '.' || split_part({h}, '.', -1)"
_CRAWL_SEEDS = f"""(SELECT {_DOMAIN.format(h=_PAGE_HOST)} AS site_id, min_by(url, page_id) AS url
  FROM pages GROUP BY {_DOMAIN.format(h=_PAGE_HOST)})"""


_DST = "lower(regexp_extract(e.dst, '^https?://([^/?#]*)', 1))"
_IN_SCOPE = f"{_DOMAIN.format(h=_DST)} IN (r.site_id, 'example.com', 'example.net', 'example.org')"


def _crawl_inputs(fx: Fixtures) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One crawl per registrable domain; each may enter its own and three shared ones."""
    pages = fx.table("pages").withColumn("site_id", U.registrable_domain(F.col("url")))
    seeds = pages.groupBy("site_id").agg(F.min_by("url", "page_id").alias("url"))
    shared = [F.lit(f"example.{t}") for t in ("com", "net", "org")]
    sites = seeds.select(
        "site_id", F.lit("domain").alias("scope"), F.array_distinct(F.array("site_id", *shared)).alias("hosts"),
        F.lit(None).cast("string").alias("path_prefix"),
    )
    return seeds, fx.view("v_page_edge"), sites


@query(
    "crawl_frontier",
    f"""WITH RECURSIVE reach(site_id, url, depth) AS (
          SELECT site_id, url, 0 FROM {_CRAWL_SEEDS} s
          UNION
          SELECT r.site_id, e.dst, r.depth + 1 FROM reach r JOIN v_page_edge e ON e.src = r.url
          WHERE r.depth < 4 AND ({_IN_SCOPE}))
        SELECT site_id, url, MIN(depth) AS depth FROM reach GROUP BY site_id, url""",
)
def _(fx: Fixtures):
    return L.crawl_frontier(*_crawl_inputs(fx), max_depth=4)


@query(
    "crawl_unlimited",
    f"""WITH RECURSIVE reach(site_id, url) AS (
          SELECT site_id, url FROM {_CRAWL_SEEDS} s
          UNION
          SELECT r.site_id, e.dst FROM reach r JOIN v_page_edge e ON e.src = r.url
          WHERE ({_IN_SCOPE}))
        SELECT site_id, url FROM reach""",
)
def _(fx: Fixtures):
    return L.crawl_frontier(*_crawl_inputs(fx)).select("site_id", "url")


_SCOPE_TEST = f"""CASE c.scope WHEN 'subdomain' THEN {_DST} = c.host OR {_DST} LIKE '%.' || c.host
  WHEN 'domain' THEN {_DOMAIN.format(h=_DST)} = {_DOMAIN.format(h="c.host")}
  WHEN 'path' THEN {_DST} = c.host AND regexp_extract(e.dst, '^https?://[^/?#]*([^?#]*)', 1) LIKE '/en/%'
  ELSE {_DST} = c.host END"""


@query(
    "crawl_scopes",
    f"""WITH RECURSIVE reach(site_id, url, depth) AS (
          SELECT {_PAGE_HOST}, min_by(url, page_id), 0 FROM pages GROUP BY {_PAGE_HOST}
          UNION
          SELECT r.site_id, e.dst, r.depth + 1 FROM reach r JOIN v_page_edge e ON e.src = r.url
          JOIN v_crawl_site c ON c.site_id = r.site_id
          WHERE r.depth < 3 AND ({_SCOPE_TEST}))
        SELECT site_id, url, MIN(depth) AS depth FROM reach GROUP BY site_id, url""",
)
def _(fx: Fixtures):
    """One crawl per host; sites have each of the four scopes."""
    pages = fx.table("pages").withColumn("site_id", U.url_host(F.col("url")))
    seeds = pages.groupBy("site_id").agg(F.min_by("url", "page_id").alias("url"))
    sites = fx.view("v_crawl_site").select(
        "site_id", "scope", F.array("host").alias("hosts"), F.lit("/en/").alias("path_prefix")
    )
    return L.crawl_frontier(seeds, fx.view("v_page_edge"), sites, max_depth=3)


_ODD_HOST = """CASE page_id % 9 WHEN 0 THEN 'a.b' || CAST(page_id AS STRING) || '.co.uk' WHEN 1 THEN 'w.c' || CAST(page_id AS STRING) || '.nhs.uk'
  WHEN 2 THEN 'x.d' || CAST(page_id AS STRING) || '.cloud' WHEN 3 THEN 'e' || CAST(page_id AS STRING) || '.any.ck' WHEN 4 THEN 'f' || CAST(page_id AS STRING) || '.www.ck'
  WHEN 5 THEN 'g' || CAST(page_id AS STRING) || '.h.lg.jp' WHEN 6 THEN 'co.uk' WHEN 7 THEN 'i' || CAST(page_id AS STRING) || '.co.de' ELSE '10.0.0.1' END"""


@query(
    "suffix_rules",
    f"""SELECT page_id, h AS host, CASE page_id % 9 WHEN 6 THEN '' WHEN 8 THEN '' WHEN 4 THEN 'www.ck' WHEN 7 THEN 'co.de'
               WHEN 3 THEN h WHEN 2 THEN split_part(h, '.', -2) || '.' || split_part(h, '.', -1)
               ELSE split_part(h, '.', -3) || '.' || split_part(h, '.', -2) || '.' || split_part(h, '.', -1) END AS domain
        FROM (SELECT page_id, {_ODD_HOST} AS h FROM pages) x""",
)
def _(fx: Fixtures):
    """Hosts under long, wildcard, exception and unlisted suffixes."""
    hosts = fx.sql(f"SELECT page_id, {_ODD_HOST} AS host FROM pages")
    return hosts.select("page_id", "host", U.registrable_domain(F.col("host")).alias("domain"))
