"""Owners, people and roster imports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.text import strip
from docaudit.functions.urls import host_key, seed_hosts, strip_www
from docaudit.operators.inventory import set_manager, upsert_owners, upsert_people
from docaudit.operators.merge import missing_keys, take, update
from docaudit.operators.ordering import last_per_key
from docaudit.shared import written
from docaudit.sources.site_config import parse_site_config

PERSON_COLUMNS = ["employee_id", "full_name", "email", "is_manager"]


# -- lookups -------------------------------------------------------------------
def members(
    owners: DataFrame, people: DataFrame, memberships: DataFrame
) -> DataFrame:
    """People of each owner."""
    return (
        memberships.join(people, "person_id")
        .join(owners.select("owner_id", "owner_key"), "owner_id")
        .select("owner_key", *PERSON_COLUMNS)
    )


def members_in_order(
    owners: DataFrame, people: DataFrame, memberships: DataFrame
) -> DataFrame:
    """Members with managers first, then by name."""
    return members(owners, people, memberships).orderBy(
        "owner_key", F.col("is_manager").desc(), "full_name", "employee_id"
    )


def responsible_people(
    sites: DataFrame, people: DataFrame, memberships: DataFrame
) -> DataFrame:
    """People of the owner of each site."""
    return (
        sites.select(F.col("name").alias("site"), "owner_id")
        .join(memberships, "owner_id")
        .join(people, "person_id")
        .select("site", *PERSON_COLUMNS)
    )


def whois(
    sites: DataFrame, owners: DataFrame, people: DataFrame, memberships: DataFrame
) -> DataFrame:
    """Owner and people per site, one row per person; sites without people keep one row."""
    return (
        sites.select(F.col("name").alias("site"), "owner_id")
        .join(owners.select("owner_id", F.col("owner_key").alias("owner"), "label"), "owner_id", "left")
        .join(memberships, "owner_id", "left")
        .join(people, "person_id", "left")
        .select("site", "owner", F.col("label").alias("owner_label"), *PERSON_COLUMNS)
    )


def show_owner(
    owners: DataFrame, sites: DataFrame, people: DataFrame, memberships: DataFrame
) -> DataFrame:
    """Every owner with its sites and members as (owner_key, kind, item, employee_id, detail) rows.

    Kind ``owner`` has the label and the notes, also of an owner without sites and members.
    Rows instead of nested lists: an owner of any size stays spread over tasks.
    """
    none = F.lit(None).cast("string")
    own_rows = owners.select(
        "owner_key", F.lit("owner").alias("kind"), F.col("label").alias("item"), none.alias("employee_id"), F.col("notes").alias("detail")
    )
    named = owners.select("owner_id", "owner_key")
    site_rows = named.join(sites.select("owner_id", "name"), "owner_id").select(
        "owner_key", F.lit("site").alias("kind"), F.col("name").alias("item"), none.alias("employee_id"), none.alias("detail")
    )
    people_rows = members(owners, people, memberships).select(
        "owner_key",
        F.when(F.col("is_manager"), "manager").otherwise("member").alias("kind"),
        F.col("full_name").alias("item"),
        "employee_id",
        F.col("email").alias("detail"),
    )
    return own_rows.unionByName(site_rows).unionByName(people_rows)


def owner_counts(
    owners: DataFrame, sites: DataFrame, memberships: DataFrame
) -> DataFrame:
    """Members and sites per owner, zero kept."""
    m = memberships.groupBy("owner_id").agg(F.count("*").alias("members"))
    s = sites.groupBy("owner_id").agg(F.count("*").alias("sites"))
    return (
        owners.join(m, "owner_id", "left")
        .join(s, "owner_id", "left")
        .select(
            "owner_key",
            "label",
            F.coalesce("members", F.lit(0)).alias("members"),
            F.coalesce("sites", F.lit(0)).alias("sites"),
        )
    )


# -- roster rows ---------------------------------------------------------------
def is_employee_id(cell: Column) -> Column:
    """True when the trimmed cell starts with a digit; header cells do not."""
    return F.coalesce(strip(cell).rlike(r"^[0-9]"), F.lit(False))


def _cell(i: int) -> Column:
    return strip(F.get(F.col("cells"), F.lit(i)))


def _blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def roster_domains(rows: DataFrame) -> DataFrame:
    """(position, part, group, domain): the last cell names the group, all others hold
    domains, several to a cell if quoted."""
    n = F.size("cells")
    named = rows.where(n >= 2)
    domains = F.filter(
        F.transform(
            F.flatten(F.transform(F.slice("cells", F.lit(1), n - 1), lambda c: F.split(c, ","))),
            strip,
        ),
        lambda d: F.contains(d, F.lit(".")),
    )
    return (
        named.select("position", strip(F.get("cells", n - 1)).alias("group"), domains.alias("d"))
        .where(F.col("group") != "")
        .select("position", "group", F.posexplode("d").alias("part", "domain"))
    )


def roster_employees(rows: DataFrame) -> DataFrame:
    """(position, full_name, employee_id, email) of the rows with an id and a name."""
    return rows.where((F.size("cells") >= 2) & is_employee_id(_cell(1)) & (_cell(0) != "")).select(
        "position",
        _cell(0).alias("full_name"),
        _cell(1).alias("employee_id"),
        _blank_to_null(_cell(2)).alias("email"),
    )


def roster_managers(rows: DataFrame) -> DataFrame:
    return rows.where(is_employee_id(_cell(0))).select("position", _cell(0).alias("employee_id"))


def roster_assignments(rows: DataFrame) -> DataFrame:
    """(position, group, full_name, employee_id, email); a blank name becomes the id."""
    return rows.where((F.size("cells") >= 3) & is_employee_id(_cell(2)) & (_cell(0) != "")).select(
        "position",
        _cell(0).alias("group"),
        F.when(_cell(1) != "", _cell(1)).otherwise(_cell(2)).alias("full_name"),
        _cell(2).alias("employee_id"),
        _blank_to_null(_cell(3)).alias("email"),
    )


def site_hosts(sites: DataFrame) -> DataFrame:
    """(site_id, name, host): the seed hosts of each site without ``www.``."""
    config = parse_site_config(F.col("config_json"))
    hosts = F.array_distinct(
        F.transform(seed_hosts(config["allowed_hosts"], config["seeds"]), strip_www)
    )
    return sites.select("site_id", "name", F.explode(hosts).alias("host"))


def match_domains(domains: DataFrame, sites: DataFrame) -> DataFrame:
    """Roster domains with the number of sites that have their host.

    Hosts are counted before the join, so a host shared by very many sites is one row. The counts are
    written, so that a host of very many roster rows can be split.
    ``outcome`` is linked (one site), unmatched (none) or ambiguous (several).
    """
    per_host = written(
        site_hosts(sites).groupBy("host").agg(F.count("*").alias("n_sites"), F.min("name").alias("site")), "hosts"
    )
    n = F.coalesce("n_sites", F.lit(0))
    return (
        domains.withColumn("host", host_key(F.col("domain")))
        .join(per_host, "host", "left")
        .withColumn(
            "outcome", F.when(n == 1, "linked").when(n == 0, "unmatched").otherwise("ambiguous")
        )
        .withColumn("site", F.when(n == 1, F.col("site")))
        .drop("n_sites")
    )


@dataclass(frozen=True)
class RosterImport:
    owners: DataFrame
    people: DataFrame
    memberships: DataFrame  # (employee_id, owner_key) pairs that are new
    site_owners: DataFrame  # (name, owner_key): the owner of each linked site
    counters: DataFrame  # one row
    issues: DataFrame  # (kind, value): unmatched and ambiguous hosts, unknown managers


def import_roster(
    sites: DataFrame,
    owners: DataFrame,
    people: DataFrame,
    memberships: DataFrame,
    *,
    site_rows: DataFrame,
    employee_rows: DataFrame,
    assignment_rows: DataFrame,
    manager_rows: DataFrame,
) -> RosterImport:
    """Import the four rosters: sites, employees, assignments, and managers last.

    The row-by-row order of the files is kept by position: assignments come after
    employees, and the last row of a key wins. Owners and people are keyed by owner_key
    and employee_id; new rows get an id from their key. Lists of problems stay rows, so
    a bad roster never ends up in one cell.
    """
    domains = roster_domains(site_rows)
    # Several results start from the matches and from the last row per person, so both are
    # computed once and written.
    matched = written(match_domains(domains, sites), "matched")
    employees = roster_employees(employee_rows)
    assigned = roster_assignments(assignment_rows)

    # Owners: an import resets the label to the key and the notes to null.
    groups = matched.select("group").union(assigned.select("group")).distinct()
    owner_changes = groups.select(
        F.xxhash64("group").alias("owner_id"),
        F.col("group").alias("owner_key"),
        F.col("group").alias("label"),
        F.lit(None).cast("string").alias("notes"),
    )
    new_owners = missing_keys(owners, owner_changes, ["owner_key"])

    # People: assignments follow employees, the last row of an id wins.
    def staged(rows: DataFrame, stage: int) -> DataFrame:
        return rows.select(
            "employee_id", "full_name", "email",
            F.struct(F.lit(stage).alias("stage"), "position").alias("order"),
        )

    latest = last_per_key(
        staged(employees, 1).unionByName(staged(assigned, 2)), ["employee_id"], F.col("order")
    )
    person_changes = written(
        latest.select(
            F.xxhash64("employee_id").alias("person_id"), "employee_id", "full_name", "email"
        ),
        "people",
    )
    new_people = missing_keys(people, person_changes, ["employee_id"])

    managers = roster_managers(manager_rows)
    marks = managers.select("employee_id").distinct().withColumn("is_manager", F.lit(True))
    all_people = set_manager(upsert_people(people, person_changes), marks)
    all_owners = upsert_owners(owners, owner_changes)

    # Every assigned person and group exists by now: under the old id or the one from the key.
    pairs = (
        assigned.select("employee_id", F.col("group").alias("owner_key"))
        .distinct()
        .join(people.select("employee_id", "person_id"), "employee_id", "left")
        .join(owners.select("owner_key", "owner_id"), "owner_key", "left")
        .select(
            "employee_id",
            "owner_key",
            F.coalesce("person_id", F.xxhash64("employee_id")).alias("person_id"),
            F.coalesce("owner_id", F.xxhash64("owner_key")).alias("owner_id"),
        )
    )
    new_pairs = pairs.join(
        memberships.select("person_id", "owner_id"), ["person_id", "owner_id"], "left_anti"
    ).select("employee_id", "owner_key")

    linked = matched.where(F.col("outcome") == "linked")
    order = F.struct("position", "part")
    site_owners = linked.groupBy(F.col("site").alias("name")).agg(
        F.max_by("group", order).alias("owner_key")
    )

    known_ids = people.select("employee_id").union(person_changes.select("employee_id"))
    found = managers.join(known_ids, "employee_id", "left_semi")
    lost = managers.join(known_ids, "employee_id", "left_anti")

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")

    counters = (
        count(new_owners, "owners_created")
        .unionByName(count(new_people, "people_created"))
        .unionByName(count(found, "managers_marked"))
        .unionByName(count(new_pairs, "memberships_added"))
        .unionByName(count(linked, "sites_linked"))
    )
    issues = (
        matched.where(F.col("outcome") != "linked")
        .select(F.col("outcome").alias("kind"), F.col("host").alias("value"))
        .unionByName(
            lost.select(
                F.lit("warning").alias("kind"),
                F.concat(
                    F.lit("manager "), F.col("employee_id"), F.lit(" not found among people")
                ).alias("value"),
            )
        )
    )
    return RosterImport(all_owners, all_people, new_pairs, site_owners, counters, issues)


def apply_site_owners(sites: DataFrame, owners: DataFrame, links: DataFrame) -> DataFrame:
    """Write the owners that an import found for sites."""
    ids = links.join(owners.select("owner_key", "owner_id"), "owner_key")
    return update(sites, ids, ["name"], take("owner_id"))
