"""Archive heuristics: which rule, if any, marks a URL as archived."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from docaudit.functions.text import let, percent_decode
from docaudit.functions.urls import url_path


@dataclass(frozen=True)
class ArchiveRules:
    # The default rule lists, in match order.
    path_segments: tuple[str, ...] = (
        "/old/", "/archive/", "/archived/", "/legacy/", "/backup/", "/previous/",
    )
    filename_prefixes: tuple[str, ...] = ("archived_", "old_", "legacy_", "deprecated_")
    filename_suffixes: tuple[str, ...] = ("_archived", "_old", "_legacy", "_deprecated")
    keywords: tuple[str, ...] = (
        "archive", "archived", "legacy", "deprecated", "obsolete", "historical",
        "outdated", "past-events",
    )


DEFAULT_ARCHIVE_RULES = ArchiveRules()


def file_name(path: Column) -> Column:
    """Last component of a path, ignoring trailing slashes and dots."""
    return F.regexp_extract(F.regexp_replace(path, r"(?:/\.?)+$", ""), r"([^/]*)$", 1)


def drop_params(path: Column) -> Column:
    """Cut the ``;params`` of the last path segment."""
    return F.regexp_replace(path, r";[^/]*$", "")


def archive_reason(url: Column, rules: ArchiveRules = DEFAULT_ARCHIVE_RULES) -> Column:
    """Text of the first matching rule, or null.

    The URL is decoded before it is split, so an escaped ``?`` ends the path.
    Path rules come first, then file prefix, file suffix and keyword. Most URLs hold the text of no rule and no escape but
    blanks; one search tells, and they are neither decoded nor split.
    """

    def first_hit(lower: Column, path: Column, name: Column, stem: Column) -> Column:
        tests = (
            [("path segment", s, F.contains(path, F.lit(s.lower()))) for s in rules.path_segments]
            + [("filename prefix", s, name.startswith(s.lower())) for s in rules.filename_prefixes]
            + [("filename suffix", s, stem.endswith(s.lower())) for s in rules.filename_suffixes]
            + [("keyword", s, F.contains(lower, F.lit(s.lower()))) for s in rules.keywords]
        )
        return F.coalesce(
            *[F.when(hit, F.lit(f"{kind} '{s.lower()}'")) for kind, s, hit in tests],
            F.lit(None).cast("string"),
        )

    def explain(lower: Column) -> Column:
        return let(drop_params(url_path(lower)), lambda path: in_path(lower, path))

    def in_path(lower: Column, path: Column) -> Column:
        return let(
            file_name(path),
            lambda name: first_hit(lower, path, name, F.regexp_replace(name, r"\.pdf$", "")),
        )

    def search(plain: Column) -> Column:
        decoded = F.when(F.contains(plain, F.lit("%")), F.lower(percent_decode(url))).otherwise(plain)
        return let(decoded, explain)

    # The search stands outside of the lambda, so that compiled code runs it; it works out the plain URL once.
    plain = _plain(url)
    return F.when(_holds(plain, ["%", *_least(rules)]), let(plain, search))


def _plain(url: Column) -> Column:
    return F.lower(F.replace(url, F.lit("%20"), F.lit(" ")))


def _least(rules: ArchiveRules) -> list[str]:
    """Texts of the rules; one that holds another one adds nothing to a search."""
    texts = {t.lower() for t in (*rules.path_segments, *rules.filename_prefixes, *rules.filename_suffixes, *rules.keywords)}
    return sorted(t for t in texts if not any(o != t and o in t for o in texts))


def _holds(plain: Column, texts: list[str]) -> Column:
    return reduce(or_, [F.contains(plain, F.lit(t)) for t in texts], F.lit(False))


def is_archived(url: Column, rules: ArchiveRules = DEFAULT_ARCHIVE_RULES) -> Column:
    """Whether a rule matches. A keyword in a URL without escapes but blanks needs no look at the path."""
    plain, exact = _plain(url), archive_reason(url, rules).isNotNull()
    keywords = {k.lower() for k in rules.keywords}
    sure = _holds(plain, [t for t in _least(rules) if t in keywords])
    return F.when(sure, ~F.contains(plain, F.lit("%")) | exact).otherwise(exact)
