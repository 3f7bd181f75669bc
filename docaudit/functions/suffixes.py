"""Public suffix rules as data.

Rules have the form of the public suffix list: ``co.uk``, ``*.ck`` (every label in front of ck),
``!www.ck`` (an exception to such a rule). A top-level label without a rule is no suffix, unless ``unlisted`` says so, as
the list's own default does. The default rules are the registries' section of the public suffix list, which lies
beside this module; its second section, private names such as hosting services, is not part of them.
:func:`read_suffix_rules` reads another list.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from importlib.resources import files
from itertools import takewhile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from docaudit.functions.text import let

LIST_FILE = "public_suffix_list.dat"
_PRIVATE = "// ===BEGIN PRIVATE DOMAINS==="


@lru_cache
def _buckets(names: frozenset[str]) -> str:
    """One line per bucket of names with equal crc32 modulo their number."""
    found: list[list[str]] = [[] for _ in names]
    for name in sorted(names):
        found[zlib.crc32(name.encode()) % len(names)].append(name)
    return "\n".join(f"/{'/'.join(x)}/" for x in found)


def _listed(names: frozenset[str], tail: Column) -> Column:
    """Whether ``tail`` is one of ``names``: a hash table in one literal, as a list of thousands of literals makes slow plans."""
    if not names:
        return F.lit(False)
    bucket = F.get(F.split(F.lit(_buckets(names)), "\n"), F.pmod(F.crc32(tail), F.lit(len(names))).cast("int"))
    return F.contains(bucket, F.concat(F.lit("/"), tail, F.lit("/")))


@dataclass(frozen=True)
class SuffixRules:
    """``wildcard`` holds what follows ``*.``, ``exception`` what follows ``!``. With ``unlisted`` a top-level label without
    any rule is a suffix; otherwise hosts under it have none, and so no registrable domain."""

    normal: frozenset[str] = frozenset()
    wildcard: frozenset[str] = frozenset()
    exception: frozenset[str] = frozenset()
    unlisted: bool = False

    def suffix_start(self, labels: Column) -> Column:
        """Index of the label at which the public suffix of a host begins; null if no rule names one."""

        def starts(tails: Column) -> Column:
            hit = F.filter(
                F.transform(
                    tails,
                    lambda tail, i: F.when(_listed(self.exception, tail), i - 1000)
                    .when(_listed(self.normal, tail), i)
                    .when(_listed(self.wildcard, F.coalesce(F.get(tails, i + 1), F.lit(""))), i),
                ),
                lambda i: i.isNotNull(),
            )
            # An exception beats all others, and its suffix begins one label later.
            best = F.array_min(hit)
            return F.when(best < 0, best + 1001).otherwise(F.coalesce(best, F.size(labels) - 1) if self.unlisted else best)

        n = F.size(labels)
        tails = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, n - i), "."))
        return let(tails, starts)


def _ascii(name: str) -> str:
    return ".".join(x if x.isascii() else f"xn--{x.encode('punycode').decode()}" for x in name.split("."))


def suffix_rules(lines: Iterable[str]) -> SuffixRules:
    """Rules in the notation of the public suffix list; comments and blank lines are skipped.

    A rule with other letters than ASCII counts in its ``xn--`` form as well.
    """
    kinds: dict[str, set[str]] = {"normal": set(), "wildcard": set(), "exception": set()}
    for line in lines:
        rule = (line.split() or [""])[0].lower()
        if not rule or rule.startswith("//"):
            continue
        kind, name = "normal", rule
        if rule.startswith("!"):
            kind, name = "exception", rule[1:]
        elif rule.startswith("*."):
            kind, name = "wildcard", rule[2:]
        kinds[kind] |= {name, _ascii(name)}
    return SuffixRules(**{k: frozenset(v) for k, v in kinds.items()})


_LINES = files(__package__).joinpath(LIST_FILE).read_text("utf-8").split("\n")
DEFAULT_SUFFIXES = suffix_rules(takewhile(lambda line: line.strip() != _PRIVATE, _LINES))


def read_suffix_rules(spark: SparkSession, path: str) -> SuffixRules:
    """The rules of a suffix file with all its sections, some ten thousand lines that become a few literals."""
    return suffix_rules(r["value"] for r in spark.read.text(path).collect())
