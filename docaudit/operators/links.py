"""Links of page snapshots: extraction, classification and breadth-first reach."""

from __future__ import annotations

import uuid
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from docaudit.functions.share_pages import resolver_name
from docaudit.functions.suffixes import DEFAULT_SUFFIXES, SuffixRules
from docaudit.functions.text import drop_nulls, let, strip
from docaudit.functions.urls import (
    absolute_http, host_domains, in_scope, is_pdf_url, normalize_url, registrable_domain, url_host,
)
from docaudit.operators.health import with_zeros
from docaudit.shared import discard, new_path, written

# Markup whose text must not be read as links.
_NOT_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
# Attributes before ``href`` are stepped over whole, with their quoted values.
_ATTRIBUTE = r"""\s+(?!href\s*=)[^\s=>]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
_HREF = rf"""(?is)<a(?:{_ATTRIBUTE})*+\s+href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_BASE = r"""(?is)<base\s(?:[^>]*?\s)?href\s*=\s*["']?([^\s"'>]+)"""

# The names that HTML 4 defines, from the standard library, and the one XML adds.
ENTITY_NAMES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
_REFERENCE = r"(?s)^(?:#0*([0-9]{1,7});?|#[xX]0*([0-9a-fA-F]{1,6});?|([A-Za-z][A-Za-z0-9]*);)(.*)$"


def decode_entities(col: Column) -> Column:
    """Decode numeric and named references, each once; what is no reference stays as it is."""
    known = F.map_from_arrays(F.lit(list(ENTITY_NAMES)), F.lit(list(ENTITY_NAMES.values())))

    def character(code: Column) -> Column:
        # ``char`` knows 256 characters only.
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def reference(part: Column) -> Column:
        def group(n: int) -> Column:
            return F.regexp_extract(part, _REFERENCE, n)

        decimal, base16, name = group(1), group(2), group(3)
        found = (
            F.when(decimal != "", character(decimal.cast("bigint")))
            .when(base16 != "", character(F.conv(base16, 16, 10).cast("bigint")))
            .when(name != "", F.try_element_at(known, name))
        )
        return F.coalesce(F.concat(found, group(4)), F.concat(F.lit("&"), part))

    def decode(text: Column) -> Column:
        parts = F.split(text, "&")
        decoded = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), reference)
        return F.when(
            F.contains(text, F.lit("&")), F.concat(F.get(parts, F.lit(0)), F.array_join(decoded, ""))
        ).otherwise(text)

    return let(col, decode)


def page_hrefs(html: Column) -> Column:
    """Array of the ``href`` values of all anchors, in page order."""
    markup = F.regexp_replace(html, _NOT_MARKUP, "")
    quoted = F.regexp_extract_all(markup, F.lit(_HREF), F.lit(1))
    return F.transform(quoted, lambda h: decode_entities(strip(F.btrim(h, F.lit("\"'")))))


def page_base(url: Column, html: Column) -> Column:
    """URL that relative links of the page start from."""
    base = F.regexp_extract(html, _BASE, 1)
    return F.when(base != "", absolute_http(url, base)).otherwise(url)


def html_only(pages: DataFrame, column: str = "content_type") -> DataFrame:
    """Pages whose content type is HTML or unknown."""
    kind = F.lower(F.coalesce(column, F.lit("")))
    return pages.where((kind == "") | F.contains(kind, F.lit("text/html")))


def extract_links(pages: DataFrame) -> DataFrame:
    """One row per anchor: page_id, parent_url, href, base_url (where relative links start)."""
    return pages.select(
        "page_id",
        F.col("url").alias("parent_url"),
        page_base(F.col("url"), F.col("html")).alias("base_url"),
        F.explode(page_hrefs(F.col("html"))).alias("href"),
    ).select("page_id", "parent_url", "href", "base_url")


def absolute_links(links: DataFrame) -> DataFrame:
    """Links with their normalised absolute URL; other schemes are dropped.

    Relative links start at ``base_url`` where the links have one, else at the page.
    """
    # Exploding the compacted array drops the nulls without a filter, which Catalyst would
    # push below the projection and so compute the URL twice.
    start = F.coalesce("base_url", "parent_url") if "base_url" in links.columns else F.col("parent_url")
    absolute = normalize_url_or_null(absolute_http(start, F.col("href")))
    return links.select("*", F.explode(drop_nulls(absolute)).alias("url"))


def normalize_url_or_null(url: Column) -> Column:
    return let(url, lambda u: F.when(u.isNotNull(), normalize_url(u)))


def with_domains(settings: DataFrame, suffixes: SuffixRules = DEFAULT_SUFFIXES) -> DataFrame:
    """Crawl settings with the registrable domains of their hosts, for sites that need them."""
    needed = F.when(F.col("scope") == "domain", host_domains(F.col("hosts"), suffixes))
    return settings.withColumn("domains", F.coalesce(needed, F.array().cast("array<string>")))


def classify_links(links: DataFrame, suffixes: SuffixRules = DEFAULT_SUFFIXES) -> DataFrame:
    """What a crawl does with each link: ``pdf``, ``share``, ``follow`` or null (dropped).

    Rows carry url and the crawl settings scope, hosts, path_prefix, include_external_pdfs
    and resolvers, and of :func:`with_domains` the domains of the hosts; without these they are looked up for every row. The PDF test comes first: an out-of-scope PDF is dropped without
    asking the resolvers.
    """
    url = F.col("url")
    domains = F.col("domains") if "domains" in links.columns else None
    inside = in_scope(url, F.col("scope"), F.col("hosts"), F.col("path_prefix"), suffixes, domains)
    resolver = resolver_name(url, enabled=F.col("resolvers"))
    tested = links.select(
        "*", is_pdf_url(url).alias("_pdf"), inside.alias("_in"), resolver.alias("_resolver")
    )
    pdf, here, share = F.col("_pdf"), F.col("_in"), F.col("_resolver").isNotNull()
    action = (
        F.when(pdf & (here | F.col("include_external_pdfs")), "pdf")
        .when(pdf, None)
        .when(share, "share")
        .when(here, "follow")
    )
    return tested.select(
        *[c for c in links.columns if c != "domains"],
        action.alias("action"),
        (F.when(pdf | share, ~here)).alias("offsite"),
        F.when(~pdf, F.col("_resolver")).alias("via_resolver"),
    )


def discovered_files(classified: DataFrame, site_column: str = "site_id") -> DataFrame:
    """PDF links as inventory rows, one per (pdf_url, parent_url)."""
    return (
        classified.where(F.col("action") == "pdf")
        .select(
            F.col("url").alias("pdf_url"),
            "parent_url",
            site_column,
            F.lit(None).cast("string").alias("via_resolver"),
            "offsite",
        )
        .dropDuplicates(["pdf_url", "parent_url"])
    )


def crawl_frontier(
    seeds: DataFrame,
    edges: DataFrame,
    sites: DataFrame,
    max_depth: int = 0,
    suffixes: SuffixRules = DEFAULT_SUFFIXES,
) -> DataFrame:
    """Pages reachable from the seeds, with their depth; each page once per site.

    ``seeds`` has (site_id, url), ``edges`` all links (src, dst), ``sites`` the crawl settings site_id, scope, hosts
    and path_prefix, each of them with any of the four scopes. ``max_depth`` 0 means no limit.

    Edges are written once, bucketed by ``src``, with host and registrable domain of ``dst``; a domain is looked up once for
    each distinct host. Levels are partitions of one table bucketed by (site_id, url), so what a level shuffles is its
    frontier and the links that leave it, never the edges or the pages reached before. Only those links are tested
    against their site's scope. Each level is written to the shared folder, so the plan does not grow with the depth and a
    lost executor costs one level at most.
    """
    spark = seeds.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = written(with_domains(sites.select("site_id", "scope", "hosts", "path_prefix"), suffixes), "scopes")
    links = _keyed_edges(edges, buckets, suffixes)
    kind = seeds.select("site_id", "url", F.lit(0).alias("depth")).schema
    path, levels = new_path(spark, "reach"), f"levels_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {levels} (site_id {kind['site_id'].dataType.simpleString()}, url STRING, depth INT) USING parquet "
        f"OPTIONS (path '{path}') PARTITIONED BY (depth) CLUSTERED BY (site_id, url) INTO {buckets} BUCKETS"
    )

    def add_level(rows: DataFrame, depth: int) -> int:
        """Write one level as its own partition and return its size."""
        seen = Observation()
        level = rows.select("site_id", "url", F.lit(depth).alias("depth")).observe(seen, F.count(F.lit(1)).alias("n"))
        level.write.insertInto(levels)
        spark.catalog.refreshTable(levels)
        return seen.get["n"]

    def shuffled(rows: DataFrame) -> DataFrame:
        """As the levels are cut, so that each bucket of a level is one file."""
        return rows.select("site_id", "url").repartition(buckets, "site_id", "url").distinct()

    found = add_level(shuffled(seeds), 0)
    depth = 0
    while found and (max_depth == 0 or depth < max_depth):
        known = spark.table(levels)
        frontier = known.where(F.col("depth") == depth).select("site_id", F.col("url").alias("src"))
        leaving = frontier.join(links, "src").select("site_id", F.col("dst").alias("url"), "domain")
        inside = in_scope(
            F.col("url"), F.col("scope"), F.col("hosts"), F.col("path_prefix"), suffixes, F.col("domains"), F.col("domain")
        )
        step = shuffled(leaving.join(rules, "site_id").where(inside))
        depth += 1
        found = add_level(step.join(known.select("site_id", "url"), ["site_id", "url"], "left_anti"), depth)
    spark.sql(f"DROP TABLE {levels}")  # the table's name only: its files lie in the shared folder
    return spark.read.schema(kind).parquet(path)


def _keyed_edges(edges: DataFrame, buckets: int, suffixes: SuffixRules) -> DataFrame:
    """(src, dst, domain of dst) bucketed by ``src``."""
    spark = edges.sparkSession
    pairs = written(edges.select("src", "dst").distinct().withColumn("host", url_host(F.col("dst"))), "edges")
    hosts = pairs.select("host").distinct().select("host", registrable_domain(F.col("host"), suffixes).alias("domain"))
    cut = pairs.join(written(hosts, "hosts"), "host").select("src", "dst", "domain")
    name = f"edges_{uuid.uuid4().hex}"
    keyed = cut.repartition(buckets, "src").write.bucketBy(buckets, "src").sortBy("src")
    keyed.option("path", new_path(spark, "edges")).saveAsTable(name)
    discard(pairs)
    return spark.table(name)


def crawl_counts(before: DataFrame, after: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Active files per site after a crawl and how many are new (never negative).

    Every site with a file has a row, also where all its files are removed; with ``sites`` each of these has one.
    """

    def active(files: DataFrame, name: str) -> DataFrame:
        return files.groupBy("site_id").agg(F.count_if(~F.col("removed")).alias(name))

    counts = (
        active(after, "total")
        .join(active(before, "_before"), "site_id", "left")
        .select(
            "site_id",
            "total",
            F.greatest(F.lit(0), F.col("total") - F.coalesce("_before", F.lit(0))).alias("new"),
        )
    )
    return counts if sites is None else with_zeros(counts, sites)
