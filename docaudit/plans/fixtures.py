"""Inventory-shaped tables derived from the analytics tables.

Every view is portable SQL over whole tables and grows with them. The same text runs in
Spark (here) and as common table expressions in front of the check queries, so both
sides start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.operators.rules import summarize
from docaudit.operators.status import triage_reports
from docaudit.operators.verify import assemble_reports
from docaudit.shared import written
from docaudit.sources.policy import (
    DEFAULT_RULE_POLICY,
    DEFAULT_TRIAGE_PROFILE,
)

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str | dict[str, str]] = {}

VIEWS["v_site_owner"] = """
SELECT DISTINCT CAST(floor(s_suppkey / 4) AS BIGINT) AS owner_id,
       'grp-' || CAST(CAST(floor(s_suppkey / 4) AS BIGINT) AS STRING) AS owner_key,
       'Group ' || CAST(CAST(floor(s_suppkey / 4) AS BIGINT) AS STRING) AS label,
       CAST(NULL AS STRING) AS notes
FROM supplier"""

VIEWS["v_site"] = """
SELECT site_id, name, host, enabled, owner_id, CAST(NULL AS STRING) AS notes, scope,
       '{"seeds": ["https://' || host || '/start", "http://portal.dept' || dept ||
       '.example.edu"], "scope": "' || scope || '", "max_depth": ' || dept ||
       ', "render_js": ' || CASE WHEN enabled THEN 'true' ELSE 'false' END ||
       ', "retired_key": [1]}' AS config_json
FROM (SELECT s_suppkey AS site_id, 's' || CAST(s_suppkey AS STRING) AS name,
             CASE WHEN s_suppkey % 2 = 0 THEN 'www.' ELSE '' END || 's' || CAST(s_suppkey AS STRING)
             || '.dept' || CAST(s_nationkey AS STRING) || '.example.edu' AS host,
             CAST(s_nationkey AS STRING) AS dept,
             s_acctbal < 8500 AS enabled,
             CASE WHEN s_acctbal < 500 THEN NULL ELSE CAST(floor(s_suppkey / 4) AS BIGINT) END AS owner_id,
             CASE s_nationkey % 5 WHEN 0 THEN 'host' WHEN 1 THEN 'subdomain' WHEN 2 THEN 'domain'
                  WHEN 3 THEN 'path' ELSE 'everything' END AS scope
      FROM supplier) s"""

VIEWS["v_person"] = """
SELECT c_custkey AS person_id, CAST(100000 + c_custkey AS STRING) AS employee_id, c_name AS full_name,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE 'p' || CAST(c_custkey AS STRING) || '@example.edu' END AS email,
       c_mktsegment = 'BUILDING' AS is_manager
FROM customer"""

VIEWS["v_person_owner"] = """
SELECT c_custkey AS person_id, c_custkey % (SELECT COUNT(*) FROM v_site_owner) AS owner_id
FROM customer
UNION
SELECT c_custkey, c_nationkey % (SELECT COUNT(*) FROM v_site_owner)
FROM customer WHERE c_mktsegment = 'MACHINERY'"""

VIEWS["v_pdf_files"] = """
SELECT (l.pk * 3 + l.pn) * 100000000 + l.sk AS pdf_id,
       'https://' || s.host ||
       CASE WHEN l.pk % 31 = 0 THEN '/archive/' WHEN l.pk % 37 = 0 THEN '/Old/' ELSE '/docs/' END ||
       CASE WHEN l.pk % 41 = 0 THEN 'legacy_' ELSE '' END || 'Doc%20' || CAST(l.pk AS STRING) ||
       CASE WHEN l.pk % 43 = 0 THEN '_old' ELSE '' END ||
       CASE WHEN l.pk % 59 = 0 THEN '.PDF?v=2' ELSE '.pdf' END AS pdf_url,
       'https://' || s.host || '/page/' || CAST(l.pn AS STRING) AS parent_url,
       s.site_id AS site_id,
       CASE WHEN l.pk % 10 = 0 THEN NULL WHEN l.pk % 10 = 1 THEN 'n' || CAST(l.pk AS STRING)
            ELSE 'h' || CAST(l.pk AS STRING) END AS file_hash,
       CASE WHEN l.pk % 19 = 0 THEN 'box' END AS via_resolver,
       l.pk % 29 = 0 AS offsite,
       CAST(NULL AS STRING) AS local_path,
       l.shipped AS scanned_at,
       l.pk % 17 = 0 AS pdf_404,
       l.pk % 67 = 0 AS parent_404,
       l.pk % 61 = 0 AS archived,
       l.pk % 53 = 0 AS removed
FROM (SELECT l_partkey AS pk, l_suppkey AS sk, l_orderkey % 3 AS pn, MAX(l_shipdate) AS shipped
      FROM lineitem GROUP BY l_partkey, l_suppkey, l_orderkey % 3) l
JOIN v_site s ON s.site_id = l.sk"""

VIEWS["v_report_rule"] = """
SELECT 'h' || CAST(pk AS STRING) AS pdf_hash, clause, test_number,
       CASE WHEN clause = '7.2' THEN NULL ELSE 'failed' END AS status,
       CAST(SUM(CAST(quantity AS BIGINT)) AS BIGINT) AS failed_checks,
       'ISO 14289-1' AS specification, 'rule ' || clause || '/' || test_number AS description
FROM (SELECT l_partkey AS pk, l_quantity AS quantity,
             CASE WHEN l_partkey % 8 = 3 THEN '7.1'
                  WHEN l_orderkey % 20 >= l_partkey % 20 THEN '7.2'
                  WHEN l_partkey % 4 = 0 AND l_orderkey % 5 = 0 THEN '7.3'
                  WHEN l_partkey % 4 = 1 AND l_orderkey % 5 = 0 THEN '7.18.6.2'
                  WHEN l_orderkey % 5 IN (0, 1) THEN '7.1'
                  WHEN l_orderkey % 5 = 2 THEN '7.2'
                  WHEN l_orderkey % 5 = 3 THEN '7.21.4.1'
                  ELSE '9.' || CAST(l_orderkey % 3 AS STRING) END AS clause,
             CASE WHEN l_partkey % 8 = 3 THEN '4'
                  WHEN l_orderkey % 20 >= l_partkey % 20 THEN '10'
                  WHEN l_orderkey % 5 IN (0, 1) AND l_orderkey % 7 = 3 AND l_partkey % 6 <> 0 THEN '2'
                  ELSE CAST(l_orderkey % 12 AS STRING) END AS test_number
      FROM lineitem) x
GROUP BY pk, clause, test_number"""

VIEWS["v_analysis"] = """
SELECT CASE WHEN p_partkey % 47 = 0 THEN 'e' ELSE 'h' END || CAST(p_partkey AS STRING) AS pdf_hash,
       CAST(p_size * 4 AS BIGINT) AS page_count,
       p_partkey % 11 = 0 AS has_form, p_partkey % 13 = 0 AS complex_graphic,
       p_size % 3 <> 0 AS title_set, p_size % 4 <> 0 AS language_set,
       CASE p_size % 4 WHEN 0 THEN 'Text' WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'Image Only' END AS text_type
FROM part"""

VIEWS["v_policy"] = "SELECT * FROM (VALUES {}) AS t(clause, test_number, action)".format(
    ", ".join(f"('{c}', '{t}', '{a}')" for c, t, a in DEFAULT_RULE_POLICY.rows())
)

VIEWS["v_summary"] = """
SELECT r.pdf_hash, COUNT(CASE WHEN i.action IS NULL THEN 1 END) AS violations,
       CAST(COALESCE(SUM(CASE WHEN i.action IS NULL THEN r.failed_checks END), 0) AS BIGINT) AS failed_checks,
       COUNT(CASE WHEN i.action IS NULL AND f.action = 'tagged' THEN 1 END) = 0 AS tagged,
       COUNT(CASE WHEN i.action IS NULL AND f.action = 'image_only' THEN 1 END) > 0 AS image_only
FROM v_report_rule r
LEFT JOIN v_policy i ON i.clause = r.clause AND i.test_number = r.test_number AND i.action = 'ignore'
LEFT JOIN v_policy f ON f.clause = r.clause AND f.test_number = r.test_number AND f.action <> 'ignore'
GROUP BY r.pdf_hash"""

VIEWS["v_report"] = """
SELECT s.pdf_hash, s.violations, s.failed_checks, s.tagged, s.image_only, a.text_type,
       COALESCE(a.title_set, FALSE) AS title_set, COALESCE(a.language_set, FALSE) AS language_set,
       a.page_count, COALESCE(a.has_form, FALSE) AS has_form,
       COALESCE(a.complex_graphic, FALSE) AS complex_graphic
FROM v_summary s LEFT JOIN v_analysis a ON a.pdf_hash = s.pdf_hash"""

VIEWS["v_clause_class"] = """
SELECT DISTINCT r.pdf_hash, r.clause,
       CASE WHEN r.clause = '7.18' OR r.clause LIKE '7.18.%' THEN 'manual'
            WHEN r.clause IN ('7.3', '7.4') OR r.clause LIKE '7.3.%' OR r.clause LIKE '7.4.%' THEN 'manual'
            WHEN r.clause IN ('7.1', '7.2') OR r.clause LIKE '7.1.%' OR r.clause LIKE '7.2.%' THEN 'auto'
       END AS clause_class
FROM v_report_rule r
WHERE NOT EXISTS (SELECT 1 FROM v_policy p WHERE p.clause = r.clause
                  AND p.test_number = r.test_number AND p.action = 'ignore')"""

VIEWS["v_clauses"] = """
SELECT pdf_hash,
       string_agg(CASE WHEN clause_class = 'manual' THEN clause END, ', ' ORDER BY clause) AS manual_clauses,
       COUNT(CASE WHEN clause_class IS NULL THEN 1 END) AS neutral_clauses
FROM v_clause_class GROUP BY pdf_hash"""

VIEWS["v_triage"] = """
SELECT x.*,
  CASE WHEN image_only OR has_form OR complex_graphic OR manual_clauses IS NOT NULL
            THEN 'needs_manual_remediation'
       WHEN tagged AND violations = 0 THEN 'good_to_go'
       WHEN score >= 50 THEN 'fit_for_automated_tagging'
       ELSE 'needs_manual_remediation' END AS classification,
  CASE WHEN image_only THEN 'image-only / scanned PDF needs OCR'
       WHEN has_form THEN 'interactive form needs manual field labels'
       WHEN complex_graphic THEN 'overlapping image+text suggests a complex graphic'
       WHEN manual_clauses IS NOT NULL THEN 'manual-only clause(s): ' || manual_clauses
       WHEN tagged AND violations = 0 THEN 'tagged, no counted violations'
       WHEN score >= 50 THEN COALESCE(NULLIF(concat_ws('; ',
              CASE WHEN NOT tagged THEN 'untagged (auto-tag adds structure)' END,
              CASE WHEN violations > 0 THEN CAST(violations AS STRING) || ' fixable violation(s)' END,
              CASE WHEN NOT language_set THEN 'missing /Lang' END,
              CASE WHEN NOT title_set THEN 'missing title' END), ''),
            'auto-remediable')
       ELSE 'score ' || CAST(CAST(trunc(score) AS BIGINT) AS STRING)
            || ' < 50 (too many or unknown violations)' END AS classification_reason,
  CASE WHEN image_only OR has_form THEN 'high'
       WHEN complex_graphic THEN 'borderline'
       WHEN manual_clauses IS NOT NULL OR (tagged AND violations = 0) THEN 'high'
       WHEN abs(score - 50) <= 12 THEN 'borderline' ELSE 'high' END AS confidence
FROM (SELECT r.*, c.manual_clauses, COALESCE(c.neutral_clauses, 0) AS neutral_clauses,
             100.0 - 4.0 * r.violations - 8.0 * COALESCE(c.neutral_clauses, 0) AS score
      FROM v_report r LEFT JOIN v_clauses c ON c.pdf_hash = r.pdf_hash) x"""

VIEWS["v_contacts"] = """
SELECT s.site_id, s.name AS site, o.owner_key AS owner, e.responsible
FROM v_site s LEFT JOIN v_site_owner o ON o.owner_id = s.owner_id
LEFT JOIN (SELECT m.owner_id, string_agg(p.email, '; ' ORDER BY p.email) AS responsible
           FROM v_person_owner m JOIN v_person p ON p.person_id = m.person_id
           GROUP BY m.owner_id) e ON e.owner_id = s.owner_id"""

VIEWS["v_export"] = """
SELECT c.site, c.owner, c.responsible, f.*, t.violations, t.failed_checks, t.tagged, t.image_only,
       t.text_type, t.title_set, t.language_set, t.page_count, t.has_form, t.complex_graphic,
       COALESCE(t.classification, 'pending') AS classification,
       COALESCE(t.classification_reason, 'not yet verified') AS classification_reason,
       COALESCE(t.confidence, 'high') AS confidence
FROM v_pdf_files f JOIN v_contacts c ON c.site_id = f.site_id
LEFT JOIN v_triage t ON t.pdf_hash = f.file_hash"""

VIEWS["v_http_status"] = """
SELECT url, CASE WHEN n % 17 = 0 THEN 404 WHEN n % 23 = 0 THEN 500 WHEN n % 59 = 0 THEN NULL ELSE 200 END AS status
FROM (SELECT pdf_url AS url, length(pdf_url) * 7 + site_id AS n FROM v_pdf_files
      UNION SELECT parent_url, length(parent_url) + site_id FROM v_pdf_files) u"""

VIEWS["v_failure"] = """
SELECT f.site_id, f.pdf_id, 'download ' || f.pdf_url || ': 404 Client Error' AS error_message
FROM v_pdf_files f WHERE f.pdf_404"""

VIEWS["v_layout_box"] = """
SELECT 'h' || CAST(l_partkey AS STRING) AS pdf_hash, CAST(l_orderkey % 90 AS INT) AS page_no,
       CASE WHEN l_linenumber <= 2 THEN 'figure_image' WHEN l_linenumber = 3 THEN 'image'
            WHEN l_linenumber = 4 THEN 'other' ELSE 'text' END AS kind,
       CAST(0 AS DOUBLE) AS page_x0, CAST(0 AS DOUBLE) AS page_y0,
       CAST(600 AS DOUBLE) AS page_x1, CAST(800 AS DOUBLE) AS page_y1,
       CASE WHEN l_orderkey % 6 = 0 AND l_linenumber <= 4 THEN CAST(0 AS DOUBLE) ELSE l_quantity * 4 END AS x0,
       CASE WHEN l_orderkey % 6 = 0 AND l_linenumber <= 4 THEN CAST(0 AS DOUBLE) ELSE l_quantity * 5 END AS y0,
       CASE WHEN l_orderkey % 6 = 0 AND l_linenumber <= 4 THEN CAST(600 AS DOUBLE)
            WHEN l_linenumber <= 4 THEN l_quantity * 4 + 150 + 20 * l_linenumber
            ELSE l_quantity * 4 + 60 END AS x1,
       CASE WHEN l_orderkey % 6 = 0 AND l_linenumber <= 4 THEN CAST(800 AS DOUBLE)
            WHEN l_linenumber <= 4 THEN l_quantity * 5 + 250
            ELSE l_quantity * 5 + 20 END AS y1
FROM lineitem"""

VIEWS["v_expected"] = """
SELECT 'h' || CAST(p_partkey AS STRING) AS pdf_hash,
       CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR p_partkey % 4 < 2 THEN 'manual'
            WHEN p_partkey % 8 = 3 THEN 'Go' WHEN p_partkey % 5 = 0 THEN 'junk' ELSE 'auto' END AS folder,
       p_name
FROM part"""

VIEWS["v_page_edge"] = """
SELECT a.url AS src, b.url AS dst
FROM (SELECT url, (page_id * 7 + length(html)) % (SELECT COUNT(*) FROM pages) AS next_id FROM pages
      UNION ALL
      SELECT url, (page_id * 11 + length(html) * 3) % (SELECT COUNT(*) FROM pages) FROM pages
      UNION ALL
      SELECT url, (page_id * 13 + length(url)) % (SELECT COUNT(*) FROM pages) FROM pages) a
JOIN pages b ON b.page_id = a.next_id"""

VIEWS["v_crawl_site"] = """
SELECT host AS site_id, host,
       CASE length(host) % 4 WHEN 0 THEN 'host' WHEN 1 THEN 'subdomain' WHEN 2 THEN 'domain' ELSE 'path' END AS scope,
       length(host) % 3 <> 0 AS include_external_pdfs
FROM (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host FROM pages) h"""

# A second policy: everything the first has, and a few frequent rules that do not count either. The views that hang on
# the policy are there once more for it.
VIEWS["v_policy_2"] = """
SELECT clause, test_number, action FROM v_policy
UNION ALL
SELECT DISTINCT clause, test_number, 'ignore' FROM v_report_rule WHERE clause IN ('7.2', '7.3') AND test_number <> '10'"""
_OF_POLICY = ("v_summary", "v_report", "v_clause_class", "v_clauses", "v_triage")
for _view in _OF_POLICY:
    VIEWS[f"{_view}_2"] = re.sub(rf"\b({'|'.join(_OF_POLICY)}|v_policy)\b", r"\1_2", VIEWS[_view])

# A policy and a profile that grow with the data.
VIEWS["v_large_policy"] = """
SELECT clause, test_number, action FROM v_policy
UNION ALL
SELECT DISTINCT '9.' || CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING),
       CASE WHEN l_orderkey % 2 = 0 THEN 'ignore' ELSE 'image_only' END FROM lineitem
UNION ALL
SELECT DISTINCT clause, test_number, CASE WHEN clause = '9.1' THEN 'ignore' ELSE 'image_only' END
FROM v_report_rule WHERE clause LIKE '9.%' AND test_number LIKE '1%'"""
VIEWS["v_large_classes"] = """
SELECT DISTINCT '9.' || CAST(o_orderkey AS STRING) AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'manual' ELSE 'auto' END AS value
FROM orders WHERE o_orderkey > 2
UNION ALL SELECT '7.21.4', 'auto' UNION ALL SELECT '7.21', 'manual' UNION ALL SELECT '9', 'auto' UNION ALL SELECT '9.2', 'manual'
UNION ALL SELECT '7.2', 'auto' UNION ALL SELECT '7.18.6.2', 'auto'"""

_LINK = """
SELECT page_id, parent_url,
       CASE WHEN length(href) % 3 = 0 THEN href || '.pdf'
            WHEN length(href) % 5 = 0 THEN 'https://t' || CAST(page_id % 4 AS STRING) || '.box.com/s/k' || CAST(page_id AS STRING)
            WHEN length(href) % 7 = 0 THEN 'https://other.example.org' || href || '.PDF?x=1#f'
            ELSE href END AS href
FROM (SELECT page_id, url AS parent_url,
             {explode}(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) x"""
VIEWS["v_link"] = {
    "spark": _LINK.format(explode="explode"),
    "duckdb": _LINK.format(explode="unnest"),
}

# Share pages: one per share link target, with different states.
VIEWS["v_share_page"] = """
SELECT share_url AS url,
       CASE WHEN n % 5 = 0 THEN NULL
            WHEN n % 7 = 0 THEN '<html><body>moved</body></html>'
            ELSE '<html><script>var a = 1;</script><script>Box.postStreamData = {"x": {"items": [{"name": "Fee''s '
                 || CAST(n AS STRING) || '.pdf", "extension": "' ||
                 CASE WHEN n % 3 = 0 THEN 'PDF' WHEN n % 11 = 0 THEN 'docx' ELSE 'pdf' END ||
                 '", "canDownload": ' || CASE WHEN n % 4 = 0 THEN 'false' ELSE 'true' END ||
                 ', "size": ' || CAST(n * 10 AS STRING) || '}]}};</script></html>' END AS html,
       n
FROM (SELECT DISTINCT href AS share_url, page_id AS n FROM v_link WHERE href LIKE '%.box.com/s/%') s"""

# Documents as downloaded files: text documents are PDFs, web pages are not.
VIEWS["v_doc_file"] = """
SELECT doc_id * 4 AS pdf_id, CAST(substr(source, 4) AS BIGINT) AS site_id,
       'https://' || source || '.example.edu/files/d' || CAST(doc_id AS STRING) || '.pdf' AS pdf_url,
       'https://' || source || '.example.edu/' AS parent_url
FROM documents
UNION ALL
SELECT doc_id * 4 + 1, CAST(substr(source, 4) AS BIGINT),
       'https://' || source || '.example.edu/files/d' || CAST(doc_id AS STRING) || '.pdf',
       'https://' || source || '.example.edu/more'
FROM documents WHERE lang = 'en'
UNION ALL
SELECT page_id * 4 + 2, CAST(0 AS BIGINT), url || '.pdf', url FROM pages"""

VIEWS["v_download"] = """
SELECT 'https://' || d.source || '.example.edu/files/d' || CAST(d.doc_id AS STRING) || '.pdf' AS pdf_url,
       '%PDF-1.7 ' || d.text AS content,
       CASE WHEN l.toxic = 1 THEN 'timed out' END AS error
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
UNION ALL
SELECT url || '.pdf', html, NULL FROM pages"""

_DOC_HASH = """
SELECT {sha} AS pdf_hash, MIN(lang) AS lang, MIN(n_chars) AS n_chars, MAX(quality) AS quality
FROM (SELECT d.text, d.lang, d.n_chars, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) x
GROUP BY text"""
VIEWS["v_doc_hash"] = {
    "spark": _DOC_HASH.format(sha="sha2('%PDF-1.7 ' || text, 256)"),
    "duckdb": _DOC_HASH.format(sha="sha256('%PDF-1.7 ' || text)"),
}
VIEWS["v_doc_known"] = "SELECT pdf_hash FROM v_doc_hash WHERE quality = 1"
VIEWS["v_doc_rule"] = """
SELECT pdf_hash, CASE lang WHEN 'en' THEN '7.1' WHEN 'fr' THEN '7.2' WHEN 'de' THEN '7.3' ELSE '7.1' END AS clause,
       CASE lang WHEN 'en' THEN '11' WHEN 'fr' THEN '34' WHEN 'de' THEN '1' ELSE '3' END AS test_number,
       n_chars AS failed_checks
FROM v_doc_hash WHERE n_chars <= 8000
UNION ALL
SELECT pdf_hash, '7.21.4.1', CASE WHEN lang = 'en' THEN '2' ELSE '1' END, n_chars * 2
FROM v_doc_hash WHERE n_chars <= 8000"""
VIEWS["v_doc_analysis"] = """
SELECT pdf_hash, 'Text' AS text_type, n_chars % 2 = 0 AS title_set, n_chars % 3 = 0 AS language_set,
       CAST(floor(n_chars / 1800) AS BIGINT) + 1 AS page_count, FALSE AS has_form, FALSE AS complex_graphic,
       n_chars < 400 AS encrypted
FROM v_doc_hash"""

# Rosters as text lines.
VIEWS["v_roster_site"] = """
SELECT CAST(-1 AS BIGINT) AS position, 'Domain,Security_Group' AS line
UNION ALL
SELECT s_suppkey, CASE WHEN s_acctbal > 6000
              THEN '"S' || CAST(s_suppkey AS STRING) || '.Dept' || CAST(s_nationkey AS STRING) || '.example.edu,portal.dept'
                   || CAST(s_nationkey AS STRING) || '.example.edu",'
            WHEN s_acctbal < 1000 THEN 'old' || CAST(s_suppkey AS STRING) || '.example.edu,'
            ELSE 'https://www.s' || CAST(s_suppkey AS STRING) || '.dept' || CAST(s_nationkey AS STRING) || '.example.edu/x,' END
       || CASE WHEN s_acctbal > 4000 THEN 'grp-' ELSE 'new-' END || CAST(s_suppkey % 50 AS STRING)
FROM supplier"""
VIEWS["v_roster_employee"] = """
SELECT CAST(-1 AS BIGINT) AS position, 'Full Name,Employee ID,Email' AS line
UNION ALL
SELECT c_custkey, '"' || c_name || ', Dr.",' || CASE WHEN c_acctbal < 1000 THEN '9' ELSE '' END
       || CAST(100000 + c_custkey AS STRING) || ',' || CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '' ELSE 'e' || CAST(c_custkey AS STRING) || '@example.edu' END
FROM customer"""
VIEWS["v_roster_assignment"] = """
SELECT o_orderkey AS position,
       CASE WHEN o_orderstatus = 'F' THEN 'grp-' ELSE 'team-' END || CAST(o_custkey % 30 AS STRING) || ',' ||
       CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'Person ' || CAST(o_orderkey AS STRING) END || ',' ||
       CASE WHEN o_totalprice > 450000 THEN '8' ELSE '' END || CAST(100000 + o_custkey AS STRING) || ', a'
       || CAST(o_orderkey AS STRING) || '@example.edu' AS line
FROM orders"""
VIEWS["v_roster_manager"] = """
SELECT CAST(-1 AS BIGINT) AS position, 'Manager ID' AS line
UNION ALL
SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN '77' ELSE '' END || CAST(100000 + c_custkey AS STRING)
FROM customer WHERE c_mktsegment = 'MACHINERY'"""


def _text(name: str, dialect: str, stored: Mapping[str, str]) -> str:
    if name in stored:
        return f"SELECT * FROM parquet.`{stored[name]}`"
    body = VIEWS[name]
    return body if isinstance(body, str) else body[dialect]


def _needed(sql: str, dialect: str, found: dict[str, None], stored: Mapping[str, str]) -> None:
    for name in re.findall(r"\bv_\w+", sql):
        if name in VIEWS and name not in found:
            if name not in stored:
                _needed(_text(name, dialect, stored), dialect, found, stored)
            found[name] = None


def with_views(sql: str, dialect: str = "duckdb", stored: Mapping[str, str] | None = None) -> str:
    """Put the views a query names in front of it as common table expressions; ``stored`` ones are read from their path."""
    stored = stored or {}
    found: dict[str, None] = {}
    _needed(sql, dialect, found, stored)
    if not found:
        return sql.strip()
    ctes = ", ".join(f"{n} AS ({_text(n, dialect, stored).strip()})" for n in found)
    body = sql.strip()
    recursive = re.match(r"(?i)with\s+recursive\s+", body)
    if recursive:
        return f"WITH RECURSIVE {ctes}, {body[recursive.end():]}"
    plain = re.match(r"(?i)with\s+", body)
    if plain:
        return f"WITH {ctes}, {body[plain.end():]}"
    return f"WITH {ctes} {body}"


class Fixtures:
    """The derived tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._stored: dict[str, str] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, query: str) -> DataFrame:
        text = with_views(query, "spark", self._stored)
        names = "|".join(BASE_TABLES)
        return self.spark.sql(
            re.sub(rf"\b(FROM|JOIN)\s+({names})\b", rf"\1 parquet.`{self.sf_dir}/\2.parquet`", text)
        )

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    def stored(self, name: str) -> DataFrame:
        """A view as a table, written once; every later query that names the view reads the table."""
        if name not in self._stored:
            self._stored[name] = written(self.view(name), name)._written_at
        return self.view(name)

    @cached_property
    def files(self) -> DataFrame:
        return self.view("v_pdf_files")

    @cached_property
    def rules(self) -> DataFrame:
        return self.view("v_report_rule")

    @cached_property
    def sites(self) -> DataFrame:
        return self.view("v_site")

    @cached_property
    def owners(self) -> DataFrame:
        return self.view("v_site_owner")

    @cached_property
    def people(self) -> DataFrame:
        return self.view("v_person")

    @cached_property
    def memberships(self) -> DataFrame:
        return self.view("v_person_owner")

    @cached_property
    def failures(self) -> DataFrame:
        return self.view("v_failure")

    @property
    def report_plan(self) -> DataFrame:
        """The same without a table, for runs of which no step may read it."""
        return assemble_reports(summarize(self.rules, DEFAULT_RULE_POLICY), self.view("v_analysis"))

    @cached_property
    def reports(self) -> DataFrame:
        """Reports built by the library from rules and analysis, stored as a table like an inventory's."""
        return written(self.report_plan, "reports")

    @cached_property
    def triaged(self) -> DataFrame:
        """Triaged reports as a table, so that joins with files can split a hot hash."""
        triaged = triage_reports(
            self.reports, self.rules, DEFAULT_RULE_POLICY, DEFAULT_TRIAGE_PROFILE
        )
        return written(triaged, "triaged")

    def checker_reports(self) -> DataFrame:
        """Checker JSON per document: the result is an object or a one-element list."""
        rule = F.struct(
            "clause",
            F.col("test_number").cast("int").alias("testNumber"),
            F.col("failed_checks").alias("failedChecks"),
            F.col("status").alias("ruleStatus"),
            "specification",
            "description",
        )
        grouped = self.rules.groupBy("pdf_hash").agg(F.collect_list(rule).alias("rules"))
        result = F.concat(
            F.lit('{"details": {"ruleSummaries": '), F.to_json("rules"), F.lit("}}")
        )
        listed = F.substring("pdf_hash", -1, 1).isin("1", "3", "5", "7", "9")
        shaped = F.when(listed, F.concat(F.lit("["), result, F.lit("]"))).otherwise(result)
        return grouped.select(
            "pdf_hash",
            F.concat(
                F.lit('{"report": {"jobs": [{"itemDetails": {"name": "/scan/'),
                F.col("pdf_hash"),
                F.lit('.pdf"}, "validationResult": '),
                shaped,
                F.lit("}]}}"),
            ).alias("report_json"),
        )
