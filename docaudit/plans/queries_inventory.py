"""Queries on the inventory: selections, joins, upserts, flags, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.operators import inventory as I
from docaudit.operators.export import (
    append_failures,
    class_sections,
    collect_rows,
    export_in_order,
    section_rows,
    write_csv,
    write_json,
)
from docaudit.operators.health import health_counts, link_health
from docaudit.operators.links import crawl_counts
from docaudit.operators.ordering import chunk_ids
from docaudit.operators.status import (
    STATUS_FILTERS,
    active_counts,
    failure_counts,
    failure_list,
    number_failures,
    filter_rows,
    pending_if_missing,
    site_status,
    sort_rows,
    status_table,
)
from docaudit.operators.storage import storage_plan
from docaudit.plans.fixtures import Fixtures
from docaudit.plans.registry import query
from docaudit.shared import new_path
from docaudit.sources.files import split_by_size, url_lines
from docaudit.sources.schemas import EXPORT_COLUMNS, PDF_REPORT, SITE, align_schema
from docaudit.sources.site_config import with_config

_NOW = "TIMESTAMP '2026-01-31 12:00:00'"


def _now():
    return F.expr(_NOW)


def _contacts(fx: Fixtures) -> DataFrame:
    return I.site_contacts(fx.sites, fx.owners, fx.people, fx.memberships)


def _status_rows(fx: Fixtures) -> DataFrame:
    """Export rows without the contact columns."""
    names = fx.sites.select("site_id", F.col("name").alias("site"))
    return pending_if_missing(I.export_rows(fx.files, names, fx.triaged))


# -- sources -------------------------------------------------------------------
@query(
    "src_site_config",
    """SELECT site_id, 2 AS n_seeds, 'https://' || host || '/start' AS first_seed, 0 AS n_allowed, scope,
              CAST(regexp_extract(host, 'dept([0-9]+)', 1) AS INTEGER) AS max_depth, enabled AS render_js,
              FALSE AS include_external_pdfs, TRUE AS no_resolvers
       FROM v_site""",
)
def _(fx: Fixtures):
    c = "config."
    return with_config(fx.sites).select(
        "site_id",
        F.size(c + "seeds").alias("n_seeds"),
        F.get(c + "seeds", F.lit(0)).alias("first_seed"),
        F.size(c + "allowed_hosts").alias("n_allowed"),
        F.col(c + "scope"),
        F.col(c + "max_depth"),
        F.col(c + "render_js"),
        F.col(c + "include_external_pdfs"),
        F.col(c + "resolvers").isNull().alias("no_resolvers"),
    )


@query(
    "align_schema",
    """SELECT pdf_hash AS key, violations AS number, FALSE AS complex_graphic, CAST(NULL AS BIGINT) AS owner_id FROM v_report
       UNION ALL SELECT name, site_id, NULL, NULL FROM v_site""",
)
def _(fx: Fixtures):
    reports = align_schema(fx.reports.drop("complex_graphic"), PDF_REPORT)
    sites = align_schema(fx.sites.drop("owner_id", "host", "scope"), SITE)
    return reports.select(
        F.col("pdf_hash").alias("key"),
        F.col("violations").alias("number"),
        "complex_graphic",
        F.lit(None).cast("bigint").alias("owner_id"),
    ).unionByName(
        sites.select(
            F.col("name").alias("key"),
            F.col("site_id").alias("number"),
            F.lit(None).cast("boolean").alias("complex_graphic"),
            "owner_id",
        )
    )


@query(
    "src_url_list",
    r"""SELECT url, COUNT(*) AS n FROM (
          SELECT trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS url
          FROM documents) x WHERE url <> '' GROUP BY url""",
)
def _(fx: Fixtures):
    lines = fx.table("documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return url_lines(lines, "line").groupBy("url").agg(F.count("*").alias("n"))


_CAP = 3000


@query(
    "src_pdf_bytes",
    f"""SELECT pdf_url AS path, octet_length(encode(content)) AS length,
               CASE WHEN octet_length(encode(content)) > {_CAP}
                    THEN 'download ' || pdf_url || ': PDF exceeds max_bytes ({_CAP})' END AS error_message
        FROM v_download""",
)
def _(fx: Fixtures):
    content = F.col("content").cast("binary")
    rows = fx.view("v_download").select(
        F.col("pdf_url").alias("path"),
        F.octet_length(content).cast("bigint").alias("length"),
        content.alias("content"),
    )
    fitting, oversized = split_by_size(rows, _CAP)
    return fitting.select("path", "length", F.lit(None).cast("string").alias("error_message")).unionByName(oversized)


# -- selections ----------------------------------------------------------------
@query("pdf_active", "SELECT pdf_id, site_id, pdf_url, parent_url FROM v_pdf_files WHERE NOT removed")
def _(fx: Fixtures):
    return I.active_files(fx.files).select("pdf_id", "site_id", "pdf_url", "parent_url")


@query(
    "pdf_unverified",
    """SELECT f.pdf_id, f.site_id, f.file_hash FROM v_pdf_files f LEFT JOIN v_report r ON r.pdf_hash = f.file_hash
       WHERE NOT f.removed AND NOT f.pdf_404 AND (f.file_hash IS NULL OR r.pdf_hash IS NULL)""",
)
def _(fx: Fixtures):
    return I.unverified_files(fx.files, fx.reports).select("pdf_id", "site_id", "file_hash")


@query(
    "verify_limit",
    """SELECT f.pdf_id, f.file_hash FROM v_pdf_files f LEFT JOIN v_report r ON r.pdf_hash = f.file_hash
       WHERE NOT f.removed AND NOT f.pdf_404 AND r.pdf_hash IS NULL ORDER BY f.pdf_id LIMIT 500""",
)
def _(fx: Fixtures):
    return I.verify_queue(fx.files, fx.reports, 500).select("pdf_id", "file_hash")


@query(
    "url_contains",
    """SELECT pdf_id, pdf_url FROM v_pdf_files WHERE NOT removed AND lower(pdf_url) LIKE '%/old/legacy%'""",
)
def _(fx: Fixtures):
    return I.find_by_url(fx.files, "/OLD/Legacy").select("pdf_id", "pdf_url")


@query(
    "url_contains_first",
    """SELECT pdf_id, pdf_url FROM v_pdf_files WHERE NOT removed AND lower(pdf_url) LIKE '%archive%'
       ORDER BY pdf_id LIMIT 5""",
)
def _(fx: Fixtures):
    return I.find_by_url(fx.files, "Archive", limit=5).select("pdf_id", "pdf_url")


@query(
    "enabled_sites",
    """SELECT 'site' AS kind, name AS key FROM v_site WHERE enabled
       UNION ALL SELECT 'owner', owner_key FROM v_site_owner
       UNION ALL SELECT 'person', full_name FROM v_person""",
)
def _(fx: Fixtures):
    def listing(kind: str, rows: DataFrame, key: str) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), F.col(key).alias("key"))

    return (
        listing("site", fx.sites.where("enabled"), "name")
        .unionByName(listing("owner", fx.owners, "owner_key"))
        .unionByName(listing("person", fx.people, "full_name"))
        .orderBy("kind", "key")
    )


@query(
    "point_lookup",
    """SELECT f.pdf_id, f.pdf_url FROM v_pdf_files f
       WHERE EXISTS (SELECT 1 FROM v_http_status h WHERE h.url = f.pdf_url AND h.status = 404)""",
)
def _(fx: Fixtures):
    wanted = fx.view("v_http_status").where("status = 404").select(F.col("url").alias("pdf_url"))
    return I.lookup(fx.files, wanted, ["pdf_url"]).select("pdf_id", "pdf_url")


@query(
    "point_lookup_hash",
    """SELECT r.pdf_hash, r.violations FROM v_report r
       WHERE r.pdf_hash IN (SELECT file_hash FROM v_pdf_files WHERE offsite)""",
)
def _(fx: Fixtures):
    wanted = fx.files.where("offsite").select(F.col("file_hash").alias("pdf_hash"))
    return I.lookup(fx.reports, wanted, ["pdf_hash"]).select("pdf_hash", "violations")


@query(
    "chunk_ids",
    """SELECT pdf_id, (row_number() OVER (ORDER BY pdf_id) - 1) // 50 AS chunk_id FROM v_pdf_files WHERE NOT removed""",
)
def _(fx: Fixtures):
    active = fx.files.where(~F.col("removed")).select("pdf_id")
    return chunk_ids(active, 50, F.col("pdf_id")).select("pdf_id", "chunk_id")


# -- joins and exports ---------------------------------------------------------
_EXPORT = ", ".join(EXPORT_COLUMNS)


@query("responsible_emails", """SELECT m.owner_id, string_agg(p.email, '; ' ORDER BY p.email) AS responsible
       FROM v_person_owner m JOIN v_person p ON p.person_id = m.person_id GROUP BY m.owner_id""")
def _(fx: Fixtures):
    return I.responsible_emails(fx.people, fx.memberships)


_RAW = [c for c in EXPORT_COLUMNS if not c.startswith("classification")]


@query("export_rows", f"SELECT {', '.join(_RAW)} FROM v_export")
def _(fx: Fixtures):
    return export_in_order(fx.files, _contacts(fx), fx.reports).select(*_RAW)


@query("collect_rows", f"SELECT {_EXPORT} FROM v_export")
def _(fx: Fixtures):
    return collect_rows(fx.files, _contacts(fx), fx.triaged)


@query("class_report_sections", "SELECT classification, COUNT(*) AS n FROM v_export GROUP BY classification")
def _(fx: Fixtures):
    return class_sections(_status_rows(fx))


@query(
    "class_report_rows",
    """SELECT classification, pdf_url, parent_url, concat_ws(', ', CASE WHEN image_only THEN 'image-only' END,
              CASE WHEN has_form THEN 'form' END, CASE WHEN complex_graphic THEN 'complex graphic' END,
              CASE WHEN NOT tagged THEN 'untagged' END) AS flags FROM v_export""",
)
def _(fx: Fixtures):
    return section_rows(_status_rows(fx)).select("classification", "pdf_url", "parent_url", "flags")


@query(
    "sink_csv",
    """SELECT site, COUNT(*) AS n, SUM(violations) AS violations, COUNT(responsible) AS with_contact,
              COUNT(DISTINCT pdf_url) AS urls FROM v_export GROUP BY site""".replace(
        "SUM(violations)", "CAST(SUM(violations) AS BIGINT)"
    ),
)
def _(fx: Fixtures):
    path = new_path(fx.spark, "csv")
    write_csv(collect_rows(fx.files, _contacts(fx), fx.triaged), path, "gzip")
    back = fx.spark.read.csv(path, header=True, escape='"')
    return back.groupBy("site").agg(
        F.count("*").alias("n"),
        F.sum(F.col("violations").cast("bigint")).alias("violations"),
        F.count("responsible").alias("with_contact"),
        F.count_distinct("pdf_url").alias("urls"),
    )


@query(
    "sink_json",
    "SELECT site, pdf_url, parent_url, violations, classification_reason, owner FROM v_export",
)
def _(fx: Fixtures):
    path = new_path(fx.spark, "json")
    write_json(collect_rows(fx.files, _contacts(fx), fx.triaged), path, "gzip")
    schema = (
        "site string, pdf_url string, parent_url string, violations bigint, "
        "classification_reason string, owner string"
    )
    return fx.spark.read.schema(schema).json(path)


@query(
    "sink_failures",
    """SELECT site_id, error_message, 2 * COUNT(*) AS n FROM v_failure GROUP BY site_id, error_message""",
)
def _(fx: Fixtures):
    path = new_path(fx.spark, "failures")
    append_failures(fx.failures, path)
    append_failures(fx.failures, path)
    return fx.spark.read.parquet(path).groupBy("site_id", "error_message").agg(F.count("*").alias("n"))


@query(
    "sink_storage_plan",
    """SELECT dest, MIN(pdf_id) AS pdf_id FROM (
         SELECT f.pdf_id, '/data/' || s.name || '/' || f.file_hash || '.pdf' AS dest
         FROM v_pdf_files f JOIN v_site s ON s.site_id = f.site_id WHERE f.file_hash IS NOT NULL) x
       WHERE dest NOT IN (SELECT '/data/' || s.name || '/' || f.file_hash || '.pdf'
                          FROM v_pdf_files f JOIN v_site s ON s.site_id = f.site_id
                          WHERE f.offsite AND f.file_hash IS NOT NULL)
       GROUP BY dest""",
)
def _(fx: Fixtures):
    rows = fx.files.join(fx.sites.select("site_id", F.col("name").alias("site")), "site_id")
    stored = rows.where(F.col("offsite") & F.col("file_hash").isNotNull()).select(
        F.concat(F.lit("/data/"), "site", F.lit("/"), "file_hash", F.lit(".pdf")).alias("path")
    ).distinct()
    return storage_plan(rows, stored, root="/data", date="2026-01-31").select("dest", "pdf_id")


# -- status --------------------------------------------------------------------
_STATUS = """
SELECT s.name AS site, COUNT(e.pdf_id) AS discovered, COUNT(CASE WHEN e.offsite THEN 1 END) AS offsite,
       COUNT(e.via_resolver) AS via_resolver, COUNT(CASE WHEN e.archived THEN 1 END) AS archived,
       COUNT(e.violations) AS verified, COUNT(CASE WHEN NOT e.tagged THEN 1 END) AS untagged,
       COUNT(CASE WHEN e.image_only THEN 1 END) AS image_only,
       COUNT(CASE WHEN e.violations > 0 THEN 1 END) AS with_violations,
       COUNT(CASE WHEN e.violations = 0 AND e.tagged THEN 1 END) AS likely_passing,
       COUNT(CASE WHEN e.classification = 'good_to_go' THEN 1 END) AS good_to_go,
       COUNT(CASE WHEN e.classification = 'fit_for_automated_tagging' THEN 1 END) AS fit_for_automated_tagging,
       COUNT(CASE WHEN e.classification = 'needs_manual_remediation' THEN 1 END) AS needs_manual_remediation,
       MAX(o.owner_key) AS owner, MAX(o.label) AS owner_label,
       COALESCE(MAX(f.n), 0) AS failures
FROM v_site s LEFT JOIN v_export e ON e.site_id = s.site_id
LEFT JOIN v_site_owner o ON o.owner_id = s.owner_id
LEFT JOIN (SELECT site_id, COUNT(*) AS n FROM v_failure GROUP BY site_id) f ON f.site_id = s.site_id
GROUP BY s.name"""


@query("site_status", _STATUS)
def _(fx: Fixtures):
    return site_status(fx.sites, fx.owners, fx.files, fx.triaged, fx.failures)


@query(
    "site_counts",
    """SELECT s.name, s.enabled, COUNT(f.pdf_id) AS pdfs FROM v_site s
       LEFT JOIN v_pdf_files f ON f.site_id = s.site_id AND NOT f.removed GROUP BY s.name, s.enabled""",
)
def _(fx: Fixtures):
    return active_counts(fx.sites, fx.files).select("name", "enabled", "pdfs").orderBy("name")


@query("failure_count", "SELECT site_id, COUNT(*) AS failures FROM v_failure GROUP BY site_id")
def _(fx: Fixtures):
    return failure_counts(fx.failures)


@query(
    "failure_list",
    """SELECT CAST(1000 + row_number() OVER (ORDER BY site_id, pdf_id, error_message) AS BIGINT) AS failure_id, site_id, pdf_id,
              error_message, TIMESTAMP '2026-01-31 12:00:00' AS created_at
       FROM v_failure ORDER BY 1""",
)
def _(fx: Fixtures):
    stored = fx.sql("SELECT CAST(1000 AS BIGINT) AS failure_id")
    return failure_list(number_failures(fx.failures, stored, _now()))


_FILTER_SQL = {
    "all": "TRUE",
    "verified": "violations IS NOT NULL",
    "pending": "violations IS NULL",
    "issues": "violations IS NOT NULL AND (violations > 0 OR NOT tagged OR image_only)",
    "offsite": "offsite",
    "archived": "archived",
    "broken": "pdf_404 OR parent_404",
    "good_to_go": "classification = 'good_to_go'",
    "auto": "classification = 'fit_for_automated_tagging'",
    "manual": "classification = 'needs_manual_remediation'",
}


def _register_filter(name: str) -> None:
    @query(
        f"status_filter_{name}",
        f"SELECT pdf_id, classification, violations FROM v_export WHERE {_FILTER_SQL[name]}",
    )
    def _(fx: Fixtures):
        return filter_rows(_status_rows(fx), name).select("pdf_id", "classification", "violations")


for _name in STATUS_FILTERS:
    _register_filter(_name)


@query("sort_violations", "SELECT pdf_url, parent_url, violations FROM v_export")
def _(fx: Fixtures):
    rows = _status_rows(fx).select("pdf_url", "parent_url", "violations")
    return sort_rows(rows, "violations")


@query("sort_url", "SELECT pdf_url, parent_url FROM v_export")
def _(fx: Fixtures):
    return sort_rows(_status_rows(fx).select("pdf_url", "parent_url"), "url")


@query(
    "top_n",
    """SELECT pdf_url, parent_url, violations FROM v_export
       WHERE violations IS NOT NULL AND (violations > 0 OR NOT tagged OR image_only)
       ORDER BY violations DESC, pdf_url, parent_url LIMIT 50""",
)
def _(fx: Fixtures):
    return status_table(_status_rows(fx), "issues", "violations", 50).select(
        "pdf_url", "parent_url", "violations"
    )


# -- upserts -------------------------------------------------------------------
# Rediscovery: every known file in the section pages again, by the next site, plus new ones.
_FOUND = """SELECT pdf_url, CASE WHEN offsite THEN parent_url || '/new' ELSE parent_url END AS parent_url,
       site_id + 1 AS site_id, 'again' AS via_resolver, NOT offsite AS offsite
FROM v_pdf_files WHERE offsite OR archived"""


@query(
    "upsert_pdf",
    f"""SELECT f.pdf_url, f.parent_url, f.site_id, f.file_hash,
               CASE WHEN d.pdf_url IS NULL THEN f.via_resolver ELSE d.via_resolver END AS via_resolver,
               CASE WHEN d.pdf_url IS NULL THEN f.offsite ELSE d.offsite END AS offsite,
               CASE WHEN d.pdf_url IS NULL THEN f.removed ELSE FALSE END AS removed,
               f.archived, d.pdf_url IS NOT NULL AS seen
        FROM v_pdf_files f LEFT JOIN ({_FOUND}) d ON d.pdf_url = f.pdf_url AND d.parent_url = f.parent_url
        UNION ALL
        SELECT d.pdf_url, d.parent_url, d.site_id, NULL, d.via_resolver, d.offsite, FALSE, FALSE, TRUE
        FROM ({_FOUND}) d LEFT JOIN v_pdf_files f ON d.pdf_url = f.pdf_url AND d.parent_url = f.parent_url
        WHERE f.pdf_url IS NULL""",
)
def _(fx: Fixtures):
    merged = I.upsert_files(fx.files, fx.sql(_FOUND), _now())
    return merged.select(
        "pdf_url", "parent_url", "site_id", "file_hash", "via_resolver", "offsite", "removed",
        "archived", (F.col("scanned_at") == _now()).alias("seen"),
    )


_FRESH = """SELECT CASE WHEN p_size < 10 THEN 'x' ELSE 'h' END || CAST(p_partkey AS STRING) AS pdf_hash,
  CAST(p_size AS BIGINT) AS violations, CAST(1 AS BIGINT) AS failed_checks, TRUE AS tagged, FALSE AS image_only,
  'Text' AS text_type, TRUE AS title_set, TRUE AS language_set, CAST(1 AS BIGINT) AS page_count,
  FALSE AS has_form, FALSE AS complex_graphic FROM part WHERE p_brand < 'Brand#2'"""


@query(
    "upsert_report",
    f"""SELECT pdf_hash, violations, text_type, page_count, has_form FROM v_report
        WHERE pdf_hash NOT IN (SELECT pdf_hash FROM ({_FRESH}) n)
        UNION ALL SELECT pdf_hash, violations, text_type, page_count, has_form FROM ({_FRESH}) n""",
)
def _(fx: Fixtures):
    return I.upsert_reports(fx.reports, fx.sql(_FRESH)).select(
        "pdf_hash", "violations", "text_type", "page_count", "has_form"
    )


@query(
    "upsert_report_insert_only",
    f"""SELECT pdf_hash, violations, page_count FROM v_report
        UNION ALL SELECT pdf_hash, violations, page_count FROM ({_FRESH}) n
        WHERE pdf_hash NOT IN (SELECT pdf_hash FROM v_report)""",
)
def _(fx: Fixtures):
    return I.upsert_reports(fx.reports, fx.sql(_FRESH), overwrite=False).select(
        "pdf_hash", "violations", "page_count"
    )


_NEW_RULES = """SELECT 'h' || CAST(p_partkey AS STRING) AS pdf_hash, '8.1' AS clause, '1' AS test_number,
  'failed' AS status, CAST(p_size AS BIGINT) AS failed_checks, CAST(NULL AS STRING) AS specification,
  CAST(NULL AS STRING) AS description FROM part WHERE p_size > 40"""


@query(
    "replace_rules",
    f"""SELECT pdf_hash, clause, test_number, failed_checks FROM v_report_rule
        WHERE pdf_hash NOT IN (SELECT pdf_hash FROM ({_NEW_RULES}) n)
        UNION ALL SELECT pdf_hash, clause, test_number, failed_checks FROM ({_NEW_RULES}) n""",
)
def _(fx: Fixtures):
    return I.replace_rules(fx.rules, fx.sql(_NEW_RULES)).select(
        "pdf_hash", "clause", "test_number", "failed_checks"
    )


_SITE_CHANGES = """SELECT CASE WHEN s_acctbal > 5000 THEN 's' ELSE 't' END || CAST(s_suppkey AS STRING) AS name,
  '{}' AS config_json, FALSE AS enabled, s_name AS notes FROM supplier WHERE s_acctbal > 2500"""


@query(
    "upsert_site",
    f"""SELECT s.name, COALESCE(c.config_json, s.config_json) AS config_json,
               CASE WHEN c.name IS NULL THEN s.enabled ELSE c.enabled END AS enabled, c.notes, s.owner_id
        FROM v_site s LEFT JOIN ({_SITE_CHANGES}) c ON c.name = s.name
        UNION ALL SELECT name, config_json, enabled, notes, NULL FROM ({_SITE_CHANGES}) c WHERE name LIKE 't%'""",
)
def _(fx: Fixtures):
    sites = fx.sites.drop("host", "scope")
    return I.upsert_sites(sites, fx.sql(_SITE_CHANGES)).select(
        "name", "config_json", "enabled", "notes", "owner_id"
    )


_OWNER_CHANGES = """SELECT DISTINCT 'grp-' || CAST(s_nationkey * 2 AS STRING) AS owner_key, 'changed' AS label,
  'n' AS notes FROM supplier"""


@query(
    "upsert_owner",
    f"""SELECT o.owner_key, COALESCE(c.label, o.label) AS label, COALESCE(c.notes, o.notes) AS notes
        FROM v_site_owner o LEFT JOIN ({_OWNER_CHANGES}) c ON c.owner_key = o.owner_key
        UNION ALL SELECT owner_key, label, notes FROM ({_OWNER_CHANGES}) c
        WHERE owner_key NOT IN (SELECT owner_key FROM v_site_owner)""",
)
def _(fx: Fixtures):
    return I.upsert_owners(fx.owners, fx.sql(_OWNER_CHANGES)).select("owner_key", "label", "notes")


_PERSON_CHANGES = """SELECT CASE WHEN c_acctbal < 3000 THEN '7' ELSE '' END || CAST(100000 + c_custkey AS STRING) AS employee_id,
  'New ' || c_name AS full_name, CAST(NULL AS STRING) AS email FROM customer WHERE c_mktsegment <> 'MACHINERY'"""


@query(
    "upsert_person",
    f"""SELECT p.employee_id, COALESCE(c.full_name, p.full_name) AS full_name,
               CASE WHEN c.employee_id IS NULL THEN p.email END AS email, p.is_manager
        FROM v_person p LEFT JOIN ({_PERSON_CHANGES}) c ON c.employee_id = p.employee_id
        UNION ALL SELECT employee_id, full_name, email, FALSE FROM ({_PERSON_CHANGES}) c
        WHERE employee_id NOT IN (SELECT employee_id FROM v_person)""",
)
def _(fx: Fixtures):
    return I.upsert_people(fx.people, fx.sql(_PERSON_CHANGES)).select(
        "employee_id", "full_name", "email", "is_manager"
    )


_PAIRS = """SELECT o_custkey AS person_id, o_custkey % (SELECT COUNT(*) FROM v_site_owner) AS owner_id FROM orders
  UNION ALL SELECT o_custkey, CAST(0 AS BIGINT) FROM orders WHERE o_orderstatus = 'F'"""


@query(
    "add_membership",
    f"SELECT person_id, owner_id FROM v_person_owner UNION SELECT person_id, owner_id FROM ({_PAIRS}) p",
)
def _(fx: Fixtures):
    return I.add_memberships(fx.memberships, fx.sql(_PAIRS))


@query(
    "new_membership",
    f"SELECT person_id, owner_id FROM ({_PAIRS}) p EXCEPT SELECT person_id, owner_id FROM v_person_owner",
)
def _(fx: Fixtures):
    return I.new_memberships(fx.memberships, fx.sql(_PAIRS))


@query(
    "remove_membership",
    f"""SELECT person_id, owner_id FROM v_person_owner m WHERE NOT EXISTS (
          SELECT 1 FROM ({_PAIRS}) p WHERE p.person_id = m.person_id AND p.owner_id = m.owner_id)""",
)
def _(fx: Fixtures):
    return I.remove_memberships(fx.memberships, fx.sql(_PAIRS))


# -- flags ---------------------------------------------------------------------
_MARKS = """SELECT pdf_id, 'z' || CAST(site_id AS STRING) AS file_hash, '/data/' || CAST(pdf_id AS STRING) AS local_path,
  offsite AS pdf_404, archived AS parent_404, offsite AS archived, archived AS removed
  FROM v_pdf_files WHERE offsite OR archived"""


@query(
    "set_flags",
    f"""SELECT f.pdf_id, COALESCE(m.file_hash, f.file_hash) AS file_hash, m.local_path,
               COALESCE(m.pdf_404, f.pdf_404) AS pdf_404, COALESCE(m.parent_404, f.parent_404) AS parent_404,
               COALESCE(m.archived, f.archived) AS archived, COALESCE(m.removed, f.removed) AS removed
        FROM v_pdf_files f LEFT JOIN ({_MARKS}) m ON m.pdf_id = f.pdf_id""",
)
def _(fx: Fixtures):
    marks = fx.sql(_MARKS)
    flagged = I.set_removed(
        I.set_archived(I.set_404(I.set_verified(fx.files, marks), marks), marks), marks
    )
    return flagged.select(
        "pdf_id", "file_hash", "local_path", "pdf_404", "parent_404", "archived", "removed"
    )


@query(
    "set_manager",
    """SELECT p.employee_id, p.is_manager OR p.person_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS is_manager
       FROM v_person p""",
)
def _(fx: Fixtures):
    marks = fx.sql(
        """SELECT CAST(100000 + c_custkey AS STRING) AS employee_id, TRUE AS is_manager
           FROM customer WHERE c_acctbal > 5000"""
    )
    return I.set_manager(fx.people, marks).select("employee_id", "is_manager")


_ASSIGN = """SELECT 's' || CAST(s_suppkey + 10 AS STRING) AS name,
  CASE WHEN s_acctbal < 2000 THEN NULL WHEN s_acctbal < 7000 THEN 'grp-' || CAST(s_suppkey % 9 AS STRING)
       ELSE 'nobody' END AS owner_key FROM supplier"""


@query(
    "set_site_owner",
    f"""SELECT s.name, CASE WHEN a.name IS NULL OR a.owner_key = 'nobody' THEN s.owner_id ELSE o.owner_id END AS owner_id,
               CAST(NULL AS STRING) AS error
        FROM v_site s LEFT JOIN ({_ASSIGN}) a ON a.name = s.name LEFT JOIN v_site_owner o ON o.owner_key = a.owner_key
        UNION ALL
        SELECT a.name, NULL, CASE WHEN a.owner_key IS NOT NULL AND o.owner_id IS NULL
                                  THEN 'No such owner ''' || a.owner_key || ''''
                                  ELSE 'No such site ''' || a.name || '''' END
        FROM ({_ASSIGN}) a LEFT JOIN v_site_owner o ON o.owner_key = a.owner_key LEFT JOIN v_site s ON s.name = a.name
        WHERE (a.owner_key IS NOT NULL AND o.owner_id IS NULL) OR s.name IS NULL""",
)
def _(fx: Fixtures):
    sites, errors = I.set_site_owner(fx.sites, fx.owners, fx.sql(_ASSIGN))
    return sites.select("name", "owner_id", F.lit(None).cast("string").alias("error")).unionByName(
        errors.select("name", F.lit(None).cast("bigint").alias("owner_id"), "error")
    )


@query(
    "apply_archive",
    """SELECT pdf_id, archived OR (NOT removed AND (lower(pdf_url) LIKE '%/archive/%' OR lower(pdf_url) LIKE '%/old/%'
              OR lower(pdf_url) LIKE '%legacy%' OR lower(pdf_url) LIKE '%!_old.pdf%' ESCAPE '!')) AS archived
       FROM v_pdf_files""",
)
def _(fx: Fixtures):
    return I.apply_archive(fx.files).select("pdf_id", "archived")


@query(
    "archive_counts",
    """SELECT site_id, COUNT(CASE WHEN NOT removed AND (lower(pdf_url) LIKE '%/archive/%' OR lower(pdf_url) LIKE '%/old/%'
              OR lower(pdf_url) LIKE '%legacy%' OR lower(pdf_url) LIKE '%!_old.pdf%' ESCAPE '!') THEN 1 END) AS flagged
       FROM v_pdf_files GROUP BY site_id""",
)
def _(fx: Fixtures):
    return I.archive_counts(fx.files)


# -- cascades ------------------------------------------------------------------
@query(
    "delete_site_cascade",
    """SELECT 'site' AS kind, site_id AS a, CAST(NULL AS BIGINT) AS b FROM v_site WHERE enabled
       UNION ALL SELECT 'file', f.pdf_id, f.site_id FROM v_pdf_files f JOIN v_site s ON s.site_id = f.site_id AND s.enabled
       UNION ALL SELECT 'failure', CASE WHEN s.enabled THEN x.site_id END, CASE WHEN s.enabled THEN x.pdf_id END
       FROM v_failure x JOIN v_site s ON s.site_id = x.site_id""",
)
def _(fx: Fixtures):
    doomed = fx.sites.where(~F.col("enabled"))
    sites, files, failures = I.delete_sites(fx.sites, fx.files, fx.failures, doomed)

    def rows(kind: str, df: DataFrame, a: str, b: str | None) -> DataFrame:
        second = F.col(b) if b else F.lit(None).cast("bigint")
        return df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), second.alias("b"))

    return (
        rows("site", sites, "site_id", None)
        .unionByName(rows("file", files, "pdf_id", "site_id"))
        .unionByName(rows("failure", failures, "site_id", "pdf_id"))
    )


_DOOMED_OWNERS = "(SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)"


@query(
    "delete_owner_setnull",
    f"""SELECT 'owner' AS kind, owner_id AS a, CAST(NULL AS BIGINT) AS b FROM v_site_owner WHERE owner_id NOT IN {_DOOMED_OWNERS}
        UNION ALL SELECT 'site', site_id, CASE WHEN owner_id NOT IN {_DOOMED_OWNERS} THEN owner_id END FROM v_site
        UNION ALL SELECT 'member', person_id, owner_id FROM v_person_owner WHERE owner_id NOT IN {_DOOMED_OWNERS}""",
)
def _(fx: Fixtures):
    doomed = fx.sql(
        f"""SELECT owner_id, owner_key FROM v_site_owner
            WHERE owner_id IN {_DOOMED_OWNERS}"""
    )
    owners, sites, memberships = I.delete_owners(fx.owners, fx.sites, fx.memberships, doomed)
    none = F.lit(None).cast("bigint")
    return (
        owners.select(F.lit("owner").alias("kind"), F.col("owner_id").alias("a"), none.alias("b"))
        .union(sites.select(F.lit("site"), "site_id", "owner_id"))
        .union(memberships.select(F.lit("member"), "person_id", "owner_id"))
    )


@query(
    "delete_person_cascade",
    """SELECT p.person_id, m.owner_id FROM v_person p LEFT JOIN v_person_owner m ON m.person_id = p.person_id
       WHERE p.email IS NOT NULL""",
)
def _(fx: Fixtures):
    doomed = fx.people.where(F.col("email").isNull())
    people, memberships = I.delete_people(fx.people, fx.memberships, doomed)
    return people.select("person_id").join(memberships, "person_id", "full")


@query(
    "delete_report_cascade",
    """SELECT r.pdf_hash, COUNT(x.pdf_hash) AS rules FROM v_report r LEFT JOIN v_report_rule x ON x.pdf_hash = r.pdf_hash
       WHERE NOT r.has_form GROUP BY r.pdf_hash""",
)
def _(fx: Fixtures):
    reports, rules = I.delete_reports(fx.reports, fx.rules, fx.reports.where("has_form"))
    left = rules.groupBy("pdf_hash").agg(F.count("*").alias("rules"))
    return reports.select("pdf_hash").join(left, "pdf_hash", "full")


# -- health and crawl counts ---------------------------------------------------
_HEALTH = """v_pdf_files f LEFT JOIN v_http_status a ON a.url = f.pdf_url
 LEFT JOIN v_http_status b ON b.url = f.parent_url WHERE NOT f.removed"""


@query(
    "http_status_join",
    f"""SELECT f.pdf_id, COALESCE(a.status = 404, FALSE) AS pdf_404, COALESCE(b.status = 404, FALSE) AS parent_404
        FROM {_HEALTH}""",
)
def _(fx: Fixtures):
    return link_health(fx.files, fx.view("v_http_status")).select("pdf_id", "pdf_404", "parent_404")


@query(
    "link_404_stats",
    f"""SELECT f.site_id, COUNT(*) AS checked, COUNT(CASE WHEN a.status = 404 THEN 1 END) AS pdf_404,
               COUNT(CASE WHEN b.status = 404 THEN 1 END) AS parent_404 FROM {_HEALTH} GROUP BY f.site_id
        UNION ALL SELECT site_id, 0, 0, 0 FROM v_site
        WHERE site_id NOT IN (SELECT site_id FROM v_pdf_files WHERE NOT removed)""",
)
def _(fx: Fixtures):
    return health_counts(link_health(fx.files, fx.view("v_http_status")), fx.sites)


@query(
    "crawl_stats",
    """SELECT a.site_id, a.total, greatest(0, a.total - COALESCE(b.n, 0)) AS new FROM
         (SELECT site_id, COUNT(CASE WHEN NOT removed THEN 1 END) AS total FROM v_pdf_files GROUP BY site_id) a
       LEFT JOIN (SELECT site_id, COUNT(*) AS n FROM v_pdf_files WHERE NOT removed AND NOT archived
                  GROUP BY site_id) b ON b.site_id = a.site_id""",
)
def _(fx: Fixtures):
    return crawl_counts(fx.files.where(~F.col("archived")), fx.files)


# -- new sites -----------------------------------------------------------------
_REQUESTS = """SELECT 'new' || CAST(s_suppkey AS STRING) AS name, s_name AS notes,
  CASE WHEN s_acctbal < 0 THEN 'planet' WHEN s_acctbal < 3000 THEN 'domain' END AS scope,
  CASE WHEN s_acctbal > 9000 THEN '' ELSE ' s' || CAST(s_suppkey AS STRING) || '.example.edu/a ' END AS seed,
  CASE WHEN s_acctbal > 5000 THEN 'allowed.example.edu' END AS allowed FROM supplier"""


@query(
    "add_sites",
    f"""SELECT name, CASE WHEN scope = 'planet' THEN 'scope must be host|subdomain|domain|path'
                          WHEN seed = '' THEN 'at least one non-empty seed URL is required' END AS error,
               CASE WHEN COALESCE(scope, '') <> 'planet' AND seed <> '' THEN 'https://' || trim(seed) END AS first_seed,
               CASE WHEN COALESCE(scope, '') <> 'planet' AND seed <> ''
                    THEN COALESCE(allowed, regexp_extract(trim(seed), '^([^/]*)', 1)) END AS hosts,
               CASE WHEN COALESCE(scope, '') <> 'planet' AND seed <> '' THEN COALESCE(scope, 'host') END AS scope
        FROM ({_REQUESTS}) r""",
)
def _(fx: Fixtures):
    requests = fx.sql(_REQUESTS).select(
        "name",
        "notes",
        "scope",
        F.array(F.lit(" "), "seed").alias("seeds"),
        F.array_compact(F.array("allowed")).alias("allowed_hosts"),
    )
    good, bad = I.prepare_sites(requests)
    none = F.lit(None).cast("string")
    parsed = with_config(good)
    return parsed.select(
        "name",
        none.alias("error"),
        F.get("config.seeds", F.lit(0)).alias("first_seed"),
        F.array_join("config.allowed_hosts", ",").alias("hosts"),
        F.col("config.scope"),
    ).unionByName(
        bad.select("name", "error", none.alias("first_seed"), none.alias("hosts"), none.alias("scope"))
    )
