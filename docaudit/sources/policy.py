"""Rule and triage policy.

A policy is data: a table that users edit. Operators take it in one of two forms and treat both alike:

* :class:`RulePolicy` and :class:`TriageProfile` are small. Their rows become hashed sets of literals in column
  expressions, so no operator has to join with them.
* :class:`RulePolicyTable` and :class:`TriageProfileTable` stay DataFrames of any size and are joined; no row of a policy
  and no clause of a profile passes through the driver. A bare DataFrame given as policy or profile becomes one of these.

A changed policy needs no new validation either way.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from docaudit.shared import written

_SEP = "\u0001"


def _pick(key: Column, values: Mapping[str, str]) -> Column:
    """The value of a key, or null: one set of keys per distinct value."""
    groups: dict[str, list[str]] = {}
    for k, v in values.items():
        groups.setdefault(v, []).append(k)
    result = F.lit(None).cast("string")
    for v, keys in sorted(groups.items()):
        result = F.when(key.isin(sorted(keys)), F.lit(v)).otherwise(result)
    return result


@dataclass(frozen=True)
class RulePolicy:
    """Rules that do not count, and rules that set a flag on the report."""

    ignore: frozenset[tuple[str, str]] = frozenset()
    flags: Mapping[tuple[str, str], str] = field(default_factory=dict)

    def ignored(self, clause: Column, test: Column) -> Column:
        """True when the pair is in the ignore list; a null never matches."""
        if not self.ignore:
            return F.lit(False)
        keys = sorted(f"{c}{_SEP}{t}" for c, t in self.ignore)
        return F.coalesce(F.concat(clause, F.lit(_SEP), test).isin(keys), F.lit(False))

    def flag(self, clause: Column, test: Column) -> Column:
        """Flag name of the pair, or null."""
        names = {f"{c}{_SEP}{t}": name for (c, t), name in self.flags.items()}
        return _pick(F.concat(clause, F.lit(_SEP), test), names)

    def action(self, clause: Column, test: Column) -> Column:
        """What the policy does with a rule: ``ignored``, a flag name or ``counts``."""
        return F.when(self.ignored(clause, test), F.lit("ignored")).otherwise(
            F.coalesce(self.flag(clause, test), F.lit("counts"))
        )

    def judged(self, rules: DataFrame) -> DataFrame:
        """``rules`` with ``_ignored`` and ``_flag`` (null: none)."""
        pair = F.col("clause"), F.col("test_number")
        return rules.withColumns({"_ignored": self.ignored(*pair), "_flag": self.flag(*pair)})

    def rows(self) -> list[tuple[str, str, str]]:
        """(clause, test_number, action) rows, as stored."""
        listed = [(c, t, "ignore") for c, t in self.ignore]
        return sorted(listed + [(c, t, name) for (c, t), name in self.flags.items()])


# The shipped ignore list and the two flags.
_IGNORED_TESTS = {
    "5": ["1", "2"],
    "7.1": ["4", "6", "7"],
    "7.2": [
        "3", "10", "15", "16", "19", "26", "27", "28", "36", "37", "38", "39", "40", "41", "42", "43",
    ],
    "7.9": ["1"],
    "7.10": ["2"],
    "7.15": ["1"],
    "7.18.1": ["1"],
    "7.18.2": ["1"],
    "7.18.3": ["1"],
    "7.18.4": ["2"],
    "7.18.6.2": ["1"],
    "7.18.8": ["1"],
    "7.20": ["1"],
    "7.21.3.1": ["1"],
    "7.21.3.2": ["1"],
    "7.21.3.3": ["1"],
    "7.21.4.1": ["2"],
    "7.21.4.2": ["1", "2"],
}
DEFAULT_RULE_POLICY = RulePolicy(
    ignore=frozenset((c, t) for c, tests in _IGNORED_TESTS.items() for t in tests),
    flags={("7.1", "11"): "tagged", ("7.1", "3"): "image_only"},
)


def rule_policy(rows: Iterable[tuple[object, object, object]]) -> RulePolicy:
    """Build a policy from (clause, test, action) rows; action ``ignore`` or a flag name."""
    ignore, flags = set(), {}
    for clause, test, action in rows:
        key = (str(clause), str(test))
        if str(action) == "ignore":
            ignore.add(key)
        else:
            flags[key] = str(action)
    return RulePolicy(frozenset(ignore), flags)


@dataclass(frozen=True)
class RulePolicyTable:
    """A policy of any size as a written table with one row per pair: clause, test_number, _ignored, _flag."""

    pairs: DataFrame

    @classmethod
    def of(cls, policy: DataFrame) -> RulePolicyTable:
        """From (clause, test_number, action) rows; of several flags of one pair the greatest name counts.

        Pairs with a null match no rule and are left out. Written, so that Spark knows the size: it broadcasts a
        small policy, and beyond that splits a pair that very many rules share.
        """
        ignore = F.col("action") == "ignore"
        rows = policy.select(F.col("clause").cast("string"), F.col("test_number").cast("string"), "action").dropna()
        pairs = rows.groupBy("clause", "test_number").agg(
            F.bool_or(ignore).alias("_ignored"), F.max(F.when(~ignore, F.col("action"))).alias("_flag")
        )
        return cls(written(pairs, "policy"))

    def judged(self, rules: DataFrame) -> DataFrame:
        joined = rules.join(self.pairs, ["clause", "test_number"], "left")
        return joined.select(*rules.columns, F.coalesce("_ignored", F.lit(False)).alias("_ignored"), "_flag")


def policy_changes(spark: SparkSession, old, new) -> DataFrame:
    """Pairs that two policies judge differently: clause, test_number, was_ignored, is_ignored, flag_changed.

    Either policy may have any form. Written: it is small, and whoever rescores meets all rules with it.
    """

    def pairs(policy, prefix: str) -> DataFrame:
        policy = as_policy(policy)
        if isinstance(policy, RulePolicy):
            policy = RulePolicyTable.of(spark.createDataFrame(policy.rows(), "clause string, test_number string, action string"))
        return policy.pairs.select("clause", "test_number", F.col("_ignored").alias(f"{prefix}_ignored"), F.col("_flag").alias(f"{prefix}_flag"))

    both = pairs(old, "was").join(pairs(new, "is"), ["clause", "test_number"], "full")
    ignored = {c: F.coalesce(c, F.lit(False)) for c in ("was_ignored", "is_ignored")}
    both = both.withColumns(ignored)
    was, now = (F.when(~F.col(f"{x}_ignored"), F.col(f"{x}_flag")) for x in ("was", "is"))
    changed = both.withColumn("flag_changed", ~was.eqNullSafe(now)).where("flag_changed or was_ignored != is_ignored")
    return written(changed.select("clause", "test_number", "was_ignored", "is_ignored", "flag_changed"), "policy-changes")


def as_policy(policy: RulePolicy | RulePolicyTable | DataFrame) -> RulePolicy | RulePolicyTable:
    return RulePolicyTable.of(policy) if isinstance(policy, DataFrame) else policy


def read_rule_policy(
    spark: SparkSession, path: str, fmt: str = "parquet", most: int = 10_000
) -> RulePolicy | RulePolicyTable:
    """Policy stored as (clause, test_number, action) rows. No table, no exceptions:
    the empty policy counts every rule. More than ``most`` rows stay a table."""
    try:
        df = spark.read.format(fmt).load(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return RulePolicy()
        raise
    rows = df.select("clause", "test_number", "action")
    few = rows.limit(most + 1).collect()
    return rule_policy(few) if len(few) <= most else RulePolicyTable.of(rows)


@dataclass(frozen=True)
class TriageProfile:
    # The default routes and score weights.
    clause_class: Mapping[str, str] = field(
        default_factory=lambda: {
            "7.1": "auto", "7.2": "auto", "7.3": "manual", "7.4": "manual", "7.18": "manual",
        }
    )
    structural: Mapping[str, str] = field(
        default_factory=lambda: {
            "image_only": "manual", "has_form": "manual", "complex_graphic": "manual",
        }
    )
    score: Mapping[str, float] = field(
        default_factory=lambda: {
            "start": 100.0, "per_violation": 4.0, "per_neutral_clause": 8.0,
            "per_page_over": 0.0, "big_doc_pages": 100.0, "auto_threshold": 50.0,
            "borderline_band": 12.0,
        }
    )
    require_title: bool = False
    require_language: bool = False

    @property
    def routes(self) -> TriageProfile:
        return self

    def labelled(self, rules: DataFrame) -> DataFrame:
        """``rules`` with ``_class`` of their clause (null: neutral)."""
        return rules.withColumn("_class", self.class_for(F.col("clause")))

    def class_for(self, clause: Column) -> Column:
        """Class of the longest dotted prefix of the clause, or null (neutral)."""
        by_depth: dict[int, dict[str, str]] = {}
        for prefix, name in self.clause_class.items():
            by_depth.setdefault(prefix.count(".") + 1, {})[prefix] = name
        longest_first = sorted(by_depth.items(), reverse=True)
        found = [_pick(F.substring_index(clause, ".", d), classes) for d, classes in longest_first]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def routes_manual(self, signal: str) -> bool:
        return self.structural.get(signal) == "manual"

    def rows(self) -> list[tuple[str, str, str]]:
        """(kind, key, value) rows, as stored."""
        out = [("clause_class", k, v) for k, v in self.clause_class.items()]
        out += [("structural", k, v) for k, v in self.structural.items()]
        out += [("score", k, str(v)) for k, v in self.score.items()]
        out += [("good_to_go", "require_title", str(self.require_title).lower())]
        out += [("good_to_go", "require_language", str(self.require_language).lower())]
        return sorted(out)


DEFAULT_TRIAGE_PROFILE = TriageProfile()


def triage_profile(rows: Iterable[tuple[object, object, object]]) -> TriageProfile:
    """Build a profile from (kind, key, value) rows.

    An empty class or structural map falls back to the default map, scores fall
    back per key, and a score that is not a number is left out.
    """
    by_kind: dict[str, dict[str, str]] = {}
    for kind, key, value in rows:
        by_kind.setdefault(str(kind), {})[str(key)] = str(value)
    score = dict(DEFAULT_TRIAGE_PROFILE.score)
    for key, value in by_kind.get("score", {}).items():
        try:
            score[key] = float(value)
        except ValueError:
            continue
    good = by_kind.get("good_to_go", {})
    return TriageProfile(
        clause_class=by_kind.get("clause_class") or DEFAULT_TRIAGE_PROFILE.clause_class,
        structural=by_kind.get("structural") or DEFAULT_TRIAGE_PROFILE.structural,
        score=score,
        require_title=good.get("require_title", "false").lower() == "true",
        require_language=good.get("require_language", "false").lower() == "true",
    )


@dataclass(frozen=True)
class TriageProfileTable:
    """A profile whose clause classes (key, value) are a table of any size; routes and scores are a handful."""

    routes: TriageProfile
    classes: DataFrame

    @classmethod
    def of(cls, profile: DataFrame) -> TriageProfileTable:
        """From (kind, key, value) rows. Of several classes of one clause the greatest counts."""
        known = {kind for kind, _, _ in DEFAULT_TRIAGE_PROFILE.rows()} - {"clause_class"}
        names = {key for kind, key, _ in DEFAULT_TRIAGE_PROFILE.rows() if kind in known}
        few = profile.where(F.col("kind").isin(*known) & F.col("key").isin(*names)).groupBy("kind", "key").agg(F.max("value"))
        classes = profile.where((F.col("kind") == "clause_class") & F.col("key").isNotNull() & F.col("value").isNotNull())
        classes = written(classes.groupBy("key").agg(F.max("value").alias("value")), "classes")
        routes = triage_profile(few.collect())  # at most one row for each name that has a meaning
        if classes.isEmpty():
            default = [(k, v) for k, v in DEFAULT_TRIAGE_PROFILE.clause_class.items()]
            classes = profile.sparkSession.createDataFrame(default, "key string, value string")
        return cls(routes, classes)

    def labelled(self, rules: DataFrame) -> DataFrame:
        """As :meth:`TriageProfile.labelled`: distinct clauses find the longest of their dotted prefixes, rules their clause."""
        found = join_classes(rules.select("clause").distinct(), self.classes).select("clause", F.col("class").alias("_class"))
        named = written(found.where(F.col("_class").isNotNull()), "clause-classes")
        return rules.join(named, "clause", "left").select(*rules.columns, "_class")


def as_profile(profile: TriageProfile | TriageProfileTable | DataFrame) -> TriageProfile | TriageProfileTable:
    return TriageProfileTable.of(profile) if isinstance(profile, DataFrame) else profile


def read_triage_profile(
    spark: SparkSession, path: str, fmt: str = "parquet", most: int = 10_000
) -> TriageProfile | TriageProfileTable:
    """Profile stored as (kind, key, value) rows; no table gives the default. More than ``most`` rows stay a table."""
    try:
        df = spark.read.format(fmt).load(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return DEFAULT_TRIAGE_PROFILE
        raise
    rows = df.select("kind", "key", "value")
    few = rows.limit(most + 1).collect()
    return triage_profile(few) if len(few) <= most else TriageProfileTable.of(rows)


def join_actions(rules: DataFrame, policy: DataFrame) -> DataFrame:
    """``rules`` with ``action`` from a policy table (clause, test_number, action) of any size."""
    listed = policy.groupBy("clause", "test_number").agg(
        F.when(F.bool_or(F.col("action") == "ignore"), F.lit("ignored")).otherwise(F.max("action")).alias("action")
    )
    return rules.join(listed, ["clause", "test_number"], "left").withColumn(
        "action", F.coalesce("action", F.lit("counts"))
    )


def join_classes(clauses: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct ``clause`` rows with the class of their longest dotted prefix in (key, value) rows of any size."""
    parts = F.split("clause", "\\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    rows = clauses.select("clause").distinct().where("clause is not null").select("clause", F.posexplode(prefixes).alias("depth", "key"))
    found = rows.join(classes.select("key", "value"), "key").groupBy("clause").agg(F.max_by("value", "depth").alias("class"))
    return clauses.join(found, "clause", "left")
