"""The document inventory: selections, joins, upserts, flags and cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.archive import DEFAULT_ARCHIVE_RULES, ArchiveRules, is_archived
from docaudit.functions.text import strip
from docaudit.functions.urls import SCOPES, ensure_scheme, url_host
from docaudit.operators.health import with_zeros
from docaudit.operators.merge import (
    delete,
    lookup_hash,
    merge,
    missing_keys,
    set_null,
    take,
    update,
)
from docaudit.operators.ordering import last_per_key, number_rows
from docaudit.shared import written

FILE_KEY = ["pdf_url", "parent_url"]


# -- selections ----------------------------------------------------------------
def active_files(files: DataFrame, include_removed: bool = False) -> DataFrame:
    """Files in id order, removed ones left out unless asked for."""
    kept = files if include_removed else files.where(~F.col("removed"))
    return kept.orderBy("pdf_id")


def unverified_files(files: DataFrame, reports: DataFrame) -> DataFrame:
    """Active files that need a report: no hash, or a hash without one.

    Known 404s are skipped. A null hash survives the anti join.
    """
    wanted = files.where(~F.col("removed") & ~F.col("pdf_404"))
    return lookup_hash(wanted, reports.select("pdf_hash"), "left_anti", row="pdf_id")


def verify_queue(files: DataFrame, reports: DataFrame, limit: int | None = None) -> DataFrame:
    """Unverified files by id; ``limit`` keeps the first ones."""
    queue = unverified_files(files, reports).orderBy("pdf_id")
    return queue.limit(limit) if limit else queue


def find_by_url(files: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Active files whose URL contains ``text``, in any case, by id."""
    found = active_files(files).where(F.contains(F.lower("pdf_url"), F.lit(text.lower())))
    return found.limit(limit) if limit else found


def lookup(table: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``table`` whose key is wanted."""
    return table.join(wanted.select(*keys), keys, "left_semi")


# -- joins ---------------------------------------------------------------------
def responsible_emails(people: DataFrame, memberships: DataFrame) -> DataFrame:
    """Emails per owner, joined with ``; `` in order; null when nobody has one."""
    return (
        memberships.join(people.select("person_id", "email"), "person_id")
        .groupBy("owner_id")
        .agg(F.expr("listagg(email, '; ') within group (order by email)").alias("responsible"))
    )


def site_contacts(
    sites: DataFrame, owners: DataFrame, people: DataFrame, memberships: DataFrame
) -> DataFrame:
    """Site name, owner key and emails per site: the small side of the export join."""
    emails = responsible_emails(people, memberships)
    return (
        sites.select("site_id", F.col("name").alias("site"), "owner_id")
        .join(owners.select("owner_id", F.col("owner_key").alias("owner")), "owner_id", "left")
        .join(emails, "owner_id", "left")
        .select("site_id", "site", "owner", "responsible")
    )


def export_rows(files: DataFrame, contacts: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per file with its site, owner, emails and report.

    Removed files are included. Files of unknown sites drop out first, by the narrow site ids; the contacts, with
    an owner's emails in one cell, come last and so are never shuffled by content hash. The ids are written: Spark then
    knows how few they are before it plans, and the inventory is not shuffled to meet them.
    """
    known = files.join(written(contacts.select("site_id"), "site-ids"), "site_id", "left_semi")
    return lookup_hash(known, reports).join(contacts, "site_id")


# -- discovery and upserts -----------------------------------------------------
def dedup_discovery(found: DataFrame) -> DataFrame:
    """One row per (pdf_url, parent_url) of a run."""
    return found.dropDuplicates(FILE_KEY)


def highest_id(files: DataFrame) -> int:
    return files.agg(F.coalesce(F.max("pdf_id"), F.lit(0)).alias("id")).first()["id"]


def upsert_files(
    files: DataFrame, found: DataFrame, now: Column, order: Column | None = None, highest: int | None = None
) -> DataFrame:
    """Merge discovered links into the inventory.

    A known pair gets a new time stamp, resolver and offsite flag and is no longer
    removed; it keeps its hash, flags and the site that found it first. New rows are
    numbered after the highest id, in key order, so a rerun gives the same ids. (A hash
    of the key would collide on an inventory of billions of rows.) ``highest`` is needed where ``files`` is only a part of the
    inventory. Of several links of one pair the last in ``order`` counts, else the greatest.
    """
    found = last_per_key(found, FILE_KEY, order)
    kept = update(
        files,
        found,
        FILE_KEY,
        {**take("via_resolver", "offsite"), "scanned_at": now, "removed": F.lit(False)},
    )
    highest = highest_id(files) if highest is None else highest
    return kept.unionByName(_inserted(files, missing_keys(files, found, FILE_KEY), now, highest))


def _inserted(files: DataFrame, new: DataFrame, now: Column, highest: int) -> DataFrame:
    """New links as rows of the inventory, numbered after ``highest`` in key order."""
    no = F.lit(False)
    values = {
        "pdf_id": F.col("row_no") + highest, "scanned_at": now, "pdf_404": no, "parent_404": no,
        "archived": no, "removed": no, "file_hash": F.lit(None), "local_path": F.lit(None),
    }
    return number_rows(new, *[F.col(k) for k in FILE_KEY]).select(
        *[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in files.schema.fields]
    )


def upsert_files_written(files: DataFrame, found: DataFrame, now: Column, order: Column | None = None) -> DataFrame:
    """As :func:`upsert_files`, as tables: the written rows tell which links were known, so the inventory is joined once."""
    found = written(last_per_key(found, FILE_KEY, order), "found")
    marked = files.withColumn("_known", F.lit(False))
    assign = {**take("via_resolver", "offsite"), "scanned_at": now, "removed": F.lit(False), "_known": F.lit(True)}
    kept = written(update(marked, found, FILE_KEY, assign), "files")
    known = kept.where("_known").select(*FILE_KEY)
    new = found.join(known, FILE_KEY, "left_anti").select(*found.columns)
    inserted = written(_inserted(files, new, now, highest_id(files)), "new-files")
    return kept.drop("_known").unionByName(inserted)


def upsert_reports(
    reports: DataFrame, fresh: DataFrame, overwrite: bool = True, order: Column | None = None
) -> DataFrame:
    fields = [c for c in reports.columns if c != "pdf_hash"]
    return merge(reports, fresh, ["pdf_hash"], on_match=take(*fields) if overwrite else None, order=order)


def replace_rules(rules: DataFrame, fresh: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Drop all rules of the given documents and add the new ones.

    ``hashes`` names the validated documents; without it they are those in ``fresh``.
    """
    renewed = (fresh if hashes is None else hashes).select("pdf_hash").distinct()
    return rules.join(renewed, "pdf_hash", "left_anti").unionByName(
        fresh, allowMissingColumns=True
    ).select(*rules.columns)


def upsert_sites(sites: DataFrame, changes: DataFrame, order: Column | None = None) -> DataFrame:
    """Replace configuration, enabled and notes by name; the owner stays."""
    return merge(sites, changes, ["name"], on_match=take("config_json", "enabled", "notes"), order=order)


def upsert_owners(owners: DataFrame, changes: DataFrame, order: Column | None = None) -> DataFrame:
    return merge(owners, changes, ["owner_key"], on_match=take("label", "notes"), order=order)


def upsert_people(people: DataFrame, changes: DataFrame, order: Column | None = None) -> DataFrame:
    """Replace name and email; the manager flag of a known person is never touched."""
    return merge(
        people,
        changes,
        ["employee_id"],
        on_match=take("full_name", "email"),
        on_insert={} if "is_manager" in changes.columns else {"is_manager": F.lit(False)},
        order=order,
    )


def add_memberships(memberships: DataFrame, pairs: DataFrame) -> DataFrame:
    keys = ["person_id", "owner_id"]
    new = missing_keys(memberships, pairs.select(*keys).distinct(), keys)
    return memberships.unionByName(new)


def new_memberships(memberships: DataFrame, pairs: DataFrame) -> DataFrame:
    keys = ["person_id", "owner_id"]
    return missing_keys(memberships, pairs.select(*keys).distinct(), keys)


def remove_memberships(memberships: DataFrame, pairs: DataFrame) -> DataFrame:
    return delete(memberships, pairs, ["person_id", "owner_id"])


# -- flags ---------------------------------------------------------------------
def set_verified(files: DataFrame, outcomes: DataFrame, order: Column | None = None) -> DataFrame:
    return update(files, outcomes, ["pdf_id"], take("file_hash", "local_path"), order)


def set_404(files: DataFrame, statuses: DataFrame, order: Column | None = None) -> DataFrame:
    return update(files, statuses, ["pdf_id"], take("pdf_404", "parent_404"), order)


def set_archived(files: DataFrame, marks: DataFrame, order: Column | None = None) -> DataFrame:
    return update(files, marks, ["pdf_id"], take("archived"), order)


def set_removed(files: DataFrame, marks: DataFrame, order: Column | None = None) -> DataFrame:
    return update(files, marks, ["pdf_id"], take("removed"), order)


def with_archive_hit(files: DataFrame, rules: ArchiveRules = DEFAULT_ARCHIVE_RULES) -> DataFrame:
    """Files with ``_hit``: whether a rule matches."""
    return files.withColumn("_hit", is_archived(F.col("pdf_url"), rules))


def apply_archive(
    files: DataFrame, rules: ArchiveRules = DEFAULT_ARCHIVE_RULES, hit: Column | None = None
) -> DataFrame:
    """Mark active files that match a rule, which ``hit`` may tell already. The flag is never cleared."""
    hit = is_archived(F.col("pdf_url"), rules) if hit is None else hit
    return files.withColumn("archived", F.col("archived") | (~F.col("removed") & hit))


def archive_counts(
    files: DataFrame, rules: ArchiveRules = DEFAULT_ARCHIVE_RULES, sites: DataFrame | None = None
) -> DataFrame:
    """Active files per site that a rule marks, newly or again. A site without active files has a zero, and with
    ``sites`` also one without any file."""
    return flagged_counts(files, is_archived(F.col("pdf_url"), rules), sites)


def flagged_counts(files: DataFrame, hit: Column, sites: DataFrame | None = None) -> DataFrame:
    """As :func:`archive_counts`, where ``hit`` tells which files a rule matches."""
    counts = files.groupBy("site_id").agg(F.count_if(hit & ~F.col("removed")).alias("flagged"))
    return counts if sites is None else with_zeros(counts, sites)


def set_manager(people: DataFrame, marks: DataFrame, order: Column | None = None) -> DataFrame:
    return update(people, marks, ["employee_id"], take("is_manager"), order)


def set_site_owner(
    sites: DataFrame, owners: DataFrame, assignments: DataFrame, order: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Assign owners to sites by name and key; a null key clears.

    Returns the sites and the rejected assignments with their error text. Of several assignments of one site
    the last in ``order`` that is not rejected counts, else the one of the highest owner id.
    """
    placed = assignments.select("name", "owner_key", (F.lit(0) if order is None else order).alias("_order"))
    keyed = placed.join(
        owners.select(F.col("owner_key").alias("key"), F.col("owner_id").alias("_owner")),
        F.col("owner_key") == F.col("key"),
        "left",
    ).join(sites.select("name", F.lit(True).alias("_site")), "name", "left")
    no_owner = F.col("owner_key").isNotNull() & F.col("_owner").isNull()
    error = F.when(
        no_owner, F.concat(F.lit("No such owner '"), F.col("owner_key"), F.lit("'"))
    ).when(
        F.col("_site").isNull(), F.concat(F.lit("No such site '"), F.col("name"), F.lit("'"))
    )
    checked = keyed.select("name", "owner_key", F.col("_owner").alias("owner_id"), error.alias("error"), "_order")
    good = checked.where(F.col("error").isNull())
    bad = checked.where(F.col("error").isNotNull()).select("name", "owner_key", "error")
    return update(sites, good, ["name"], take("owner_id"), F.col("_order")), bad


# -- sites ---------------------------------------------------------------------
def prepare_sites(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validate new sites: scheme on every seed, blanks dropped, hosts derived.

    ``requests`` has name, seeds, allowed_hosts, scope and any other configuration
    field. Returns the rows for :func:`upsert_sites` and the rejected ones.
    """
    seeds = F.transform(
        F.filter(F.coalesce("seeds", F.array()), lambda s: s.isNotNull() & (strip(s) != "")),
        lambda s: ensure_scheme(s),
    )
    scope = F.coalesce("scope", F.lit("host"))
    error = F.when(~scope.isin(*SCOPES), "scope must be host|subdomain|domain|path").when(
        F.size("_seeds") == 0, "at least one non-empty seed URL is required"
    )
    checked = requests.withColumn("_seeds", seeds).withColumn("error", error)
    derived = F.filter(F.transform("_seeds", url_host), lambda h: h != "")
    allowed = F.when(F.size(F.coalesce("allowed_hosts", F.array())) > 0, F.col("allowed_hosts"))
    config = [
        F.col("_seeds").alias("seeds"),
        F.coalesce(allowed, derived).alias("allowed_hosts"),
        scope.alias("scope"),
    ]
    extra = [c for c in requests.columns if c not in ("name", "notes", "seeds", "allowed_hosts", "scope")]
    notes = F.col("notes") if "notes" in requests.columns else F.lit(None).cast("string")
    good = checked.where(F.col("error").isNull()).select(
        "name",
        F.to_json(F.struct(*config, *extra)).alias("config_json"),
        F.lit(True).alias("enabled"),
        notes.alias("notes"),
    )
    bad = checked.where(F.col("error").isNotNull()).select("name", "error")
    return good, bad


# -- cascades ------------------------------------------------------------------
def delete_sites(
    sites: DataFrame, files: DataFrame, failures: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove sites and their files; failures stay, with a null site and file."""
    gone_files = files.join(doomed.select("site_id"), "site_id", "left_semi")
    kept_failures = set_null(
        set_null(failures, doomed, "site_id", "site_id"), gone_files, "pdf_id", "pdf_id"
    )
    return delete(sites, doomed, ["site_id"]), delete(files, doomed, ["site_id"]), kept_failures


def delete_owners(
    owners: DataFrame, sites: DataFrame, memberships: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove owners and memberships; their sites stay without an owner."""
    return (
        delete(owners, doomed, ["owner_id"]),
        set_null(sites, doomed, "owner_id", "owner_id"),
        delete(memberships, doomed, ["owner_id"]),
    )


def delete_people(
    people: DataFrame, memberships: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    return delete(people, doomed, ["person_id"]), delete(memberships, doomed, ["person_id"])


def delete_reports(
    reports: DataFrame, rules: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    return delete(reports, doomed, ["pdf_hash"]), delete(rules, doomed, ["pdf_hash"])
