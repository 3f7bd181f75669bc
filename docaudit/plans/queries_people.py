"""Queries on owners, people and roster imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.operators import ownership as O
from docaudit.plans.fixtures import Fixtures
from docaudit.plans.registry import query
from docaudit.sources.files import roster_rows

_PEOPLE = "p.employee_id, p.full_name, p.email, p.is_manager"


@query(
    "members_of",
    f"""SELECT o.owner_key, {_PEOPLE} FROM v_person_owner m JOIN v_person p ON p.person_id = m.person_id
        JOIN v_site_owner o ON o.owner_id = m.owner_id""",
)
def _(fx: Fixtures):
    return O.members_in_order(fx.owners, fx.people, fx.memberships)


@query(
    "responsible_people",
    f"""SELECT s.name AS site, {_PEOPLE} FROM v_site s JOIN v_person_owner m ON m.owner_id = s.owner_id
        JOIN v_person p ON p.person_id = m.person_id""",
)
def _(fx: Fixtures):
    return O.responsible_people(fx.sites, fx.people, fx.memberships)


@query(
    "whois",
    f"""SELECT s.name AS site, o.owner_key AS owner, o.label AS owner_label, {_PEOPLE}
        FROM v_site s LEFT JOIN v_site_owner o ON o.owner_id = s.owner_id
        LEFT JOIN v_person_owner m ON m.owner_id = s.owner_id
        LEFT JOIN v_person p ON p.person_id = m.person_id""",
)
def _(fx: Fixtures):
    return O.whois(fx.sites, fx.owners, fx.people, fx.memberships)


@query(
    "show_owner",
    """SELECT owner_key, 'owner' AS kind, label AS item, CAST(NULL AS STRING) AS employee_id, notes AS detail FROM v_site_owner
       UNION ALL
       SELECT o.owner_key, 'site', s.name, NULL, NULL
       FROM v_site_owner o JOIN v_site s ON s.owner_id = o.owner_id
       UNION ALL
       SELECT o.owner_key, CASE WHEN p.is_manager THEN 'manager' ELSE 'member' END, p.full_name, p.employee_id, p.email
       FROM v_site_owner o JOIN v_person_owner m ON m.owner_id = o.owner_id JOIN v_person p ON p.person_id = m.person_id""",
)
def _(fx: Fixtures):
    return O.show_owner(fx.owners, fx.sites, fx.people, fx.memberships)


@query(
    "owner_counts",
    """SELECT o.owner_key, o.label,
              (SELECT COUNT(*) FROM v_person_owner m WHERE m.owner_id = o.owner_id) AS members,
              (SELECT COUNT(*) FROM v_site s WHERE s.owner_id = o.owner_id) AS sites
       FROM v_site_owner o""",
)
def _(fx: Fixtures):
    return O.owner_counts(fx.owners, fx.sites, fx.memberships)


# -- rosters -------------------------------------------------------------------
def _rows(fx: Fixtures, view: str) -> DataFrame:
    return roster_rows(fx.view(view))


@query(
    "src_roster_csv",
    """SELECT CAST(-1 AS BIGINT) AS position, 'Full Name|Employee ID|Email' AS cells
       UNION ALL
       SELECT c_custkey, c_name || ', Dr.|' || CASE WHEN c_acctbal < 1000 THEN '9' ELSE '' END || CAST(100000 + c_custkey AS STRING)
              || '|' || CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '' ELSE 'e' || CAST(c_custkey AS STRING) || '@example.edu' END
       FROM customer""",
)
def _(fx: Fixtures):
    return _rows(fx, "v_roster_employee").select("position", F.array_join("cells", "|").alias("cells"))


@query(
    "is_employee_id",
    """SELECT position, position >= 0 AS is_id FROM v_roster_employee""",
)
def _(fx: Fixtures):
    return _rows(fx, "v_roster_employee").select(
        "position", O.is_employee_id(F.get("cells", F.lit(1))).alias("is_id")
    )


_GROUP = "CASE WHEN s_acctbal > 4000 THEN 'grp-' ELSE 'new-' END || CAST(s_suppkey % 50 AS STRING)"
_KEY, _DEPT = "CAST(s_suppkey AS STRING)", "CAST(s_nationkey AS STRING)"
_DOMAINS = f"""(
 SELECT s_suppkey AS position, 0 AS part, {_GROUP} AS grp,
        CASE WHEN s_acctbal > 6000 THEN 'S' || {_KEY} || '.Dept' || {_DEPT} || '.example.edu'
             WHEN s_acctbal < 1000 THEN 'old' || {_KEY} || '.example.edu'
             ELSE 'https://www.s' || {_KEY} || '.dept' || {_DEPT} || '.example.edu/x' END AS domain,
        CASE WHEN s_acctbal < 1000 THEN 'old' || {_KEY} || '.example.edu'
             ELSE 's' || {_KEY} || '.dept' || {_DEPT} || '.example.edu' END AS host
 FROM supplier
 UNION ALL
 SELECT s_suppkey, 1, {_GROUP}, 'portal.dept' || {_DEPT} || '.example.edu', 'portal.dept' || {_DEPT} || '.example.edu'
 FROM supplier WHERE s_acctbal > 6000)"""
_HOSTS = f"""(
 SELECT 's' || {_KEY} || '.dept' || {_DEPT} || '.example.edu' AS host, 's' || {_KEY} AS name FROM supplier
 UNION ALL SELECT 'portal.dept' || {_DEPT} || '.example.edu', 's' || {_KEY} FROM supplier)"""
_MATCH = f"""(
 SELECT d.position, d.part, d.grp, d.domain, d.host, COUNT(h.name) AS n, MIN(h.name) AS name
 FROM {_DOMAINS} d LEFT JOIN {_HOSTS} h ON h.host = d.host
 GROUP BY d.position, d.part, d.grp, d.domain, d.host)"""


@query("roster_domains", f'SELECT position, part, grp AS "group", domain FROM {_DOMAINS} d')
def _(fx: Fixtures):
    return O.roster_domains(_rows(fx, "v_roster_site"))


@query(
    "roster_site_match",
    f"""SELECT position, part, grp AS "group", host,
               CASE WHEN n = 1 THEN 'linked' WHEN n = 0 THEN 'unmatched' ELSE 'ambiguous' END AS outcome,
               CASE WHEN n = 1 THEN name END AS site FROM {_MATCH} m""",
)
def _(fx: Fixtures):
    return O.match_domains(O.roster_domains(_rows(fx, "v_roster_site")), fx.sites).drop("domain")


_EMPLOYEES = """(SELECT c_custkey AS position, 1 AS stage, c_name || ', Dr.' AS full_name,
  CASE WHEN c_acctbal < 1000 THEN '9' ELSE '' END || CAST(100000 + c_custkey AS STRING) AS employee_id,
  CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'e' || CAST(c_custkey AS STRING) || '@example.edu' END AS email FROM customer)"""
_ASSIGNED = """(SELECT o_orderkey AS position, 2 AS stage,
  CASE WHEN o_orderstatus = 'F' THEN 'grp-' ELSE 'team-' END || CAST(o_custkey % 30 AS STRING) AS grp,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'Person ' || CAST(o_orderkey AS STRING) END AS full_name,
  CASE WHEN o_totalprice > 450000 THEN '8' ELSE '' END || CAST(100000 + o_custkey AS STRING) AS employee_id,
  'a' || CAST(o_orderkey AS STRING) || '@example.edu' AS email FROM orders)"""
_STAGED = f"""(SELECT employee_id, full_name, email, stage, position FROM {_EMPLOYEES} e
 UNION ALL SELECT employee_id, COALESCE(full_name, employee_id), email, stage, position FROM {_ASSIGNED} a)"""
_LAST = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY stage DESC, position DESC) AS rn
 FROM {_STAGED} s) t WHERE rn = 1)"""
_MANAGERS = """(SELECT CASE WHEN c_acctbal > 9000 THEN '77' ELSE '' END || CAST(100000 + c_custkey AS STRING) AS employee_id
 FROM customer WHERE c_mktsegment = 'MACHINERY')"""
_GROUPS = f"(SELECT grp FROM {_DOMAINS} d UNION SELECT grp FROM {_ASSIGNED} a)"
_ALL_IDS = f"(SELECT employee_id FROM v_person UNION SELECT employee_id FROM {_STAGED} s)"
_NEW_PAIRS = f"""(SELECT a.employee_id, a.grp FROM {_ASSIGNED} a
 EXCEPT SELECT p.employee_id, o.owner_key FROM v_person_owner m JOIN v_person p ON p.person_id = m.person_id
        JOIN v_site_owner o ON o.owner_id = m.owner_id)"""


def _import(fx: Fixtures) -> O.RosterImport:
    return O.import_roster(
        fx.sites,
        fx.owners,
        fx.people,
        fx.memberships,
        site_rows=_rows(fx, "v_roster_site"),
        employee_rows=_rows(fx, "v_roster_employee"),
        assignment_rows=_rows(fx, "v_roster_assignment"),
        manager_rows=_rows(fx, "v_roster_manager"),
    )


@query(
    "import_owners",
    f"""SELECT owner_key, CASE WHEN g.grp IS NULL THEN label ELSE owner_key END AS label
        FROM v_site_owner o LEFT JOIN {_GROUPS} g ON g.grp = o.owner_key
        UNION ALL SELECT grp, grp FROM {_GROUPS} g WHERE grp NOT IN (SELECT owner_key FROM v_site_owner)""",
)
def _(fx: Fixtures):
    return _import(fx).owners.select("owner_key", "label")


@query(
    "import_roster",
    f"""SELECT i.employee_id, COALESCE(l.full_name, p.full_name) AS full_name,
               CASE WHEN l.employee_id IS NULL THEN p.email ELSE l.email END AS email,
               COALESCE(p.is_manager, FALSE) OR i.employee_id IN (SELECT employee_id FROM {_MANAGERS} m) AS is_manager
        FROM {_ALL_IDS} i LEFT JOIN {_LAST} l ON l.employee_id = i.employee_id
        LEFT JOIN v_person p ON p.employee_id = i.employee_id""",
)
def _(fx: Fixtures):
    return _import(fx).people.select("employee_id", "full_name", "email", "is_manager")


@query("import_memberships", f"SELECT employee_id, grp AS owner_key FROM {_NEW_PAIRS} n")
def _(fx: Fixtures):
    return _import(fx).memberships


@query(
    "import_site_owners",
    f"""SELECT s.name, COALESCE(o.grp, x.owner_key) AS owner_key
        FROM v_site s
        LEFT JOIN (SELECT name, arg_max(grp, position * 10 + part) AS grp FROM {_MATCH} m WHERE n = 1 GROUP BY name) o ON o.name = s.name
        LEFT JOIN v_site_owner x ON x.owner_id = s.owner_id""",
)
def _(fx: Fixtures):
    result = _import(fx)
    sites = O.apply_site_owners(fx.sites, result.owners, result.site_owners)
    keys = result.owners.select("owner_id", "owner_key")
    return sites.join(keys, "owner_id", "left").select("name", "owner_key")


@query(
    "import_report",
    f"""SELECT 'owners_created' AS counter, COUNT(*) AS n FROM {_GROUPS} g WHERE grp NOT IN (SELECT owner_key FROM v_site_owner)
        UNION ALL SELECT 'people_created', COUNT(*) FROM {_ALL_IDS} i WHERE employee_id NOT IN (SELECT employee_id FROM v_person)
        UNION ALL SELECT 'managers_marked', COUNT(*) FROM {_MANAGERS} m WHERE employee_id IN (SELECT employee_id FROM {_ALL_IDS} i)
        UNION ALL SELECT 'memberships_added', COUNT(*) FROM {_NEW_PAIRS} n
        UNION ALL SELECT 'sites_linked', COUNT(*) FROM {_MATCH} m WHERE n = 1""",
)
def _(fx: Fixtures):
    return _import(fx).counters


@query(
    "import_issues",
    f"""SELECT CASE WHEN n = 0 THEN 'unmatched' ELSE 'ambiguous' END AS kind, host AS value FROM {_MATCH} m WHERE n <> 1
        UNION ALL SELECT 'warning', 'manager ' || employee_id || ' not found among people' FROM {_MANAGERS} m
        WHERE employee_id NOT IN (SELECT employee_id FROM {_ALL_IDS} i)""",
)
def _(fx: Fixtures):
    return _import(fx).issues
