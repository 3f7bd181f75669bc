"""The triage decision of one verified document, as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docaudit.sources.policy import TriageProfile

PENDING = "pending"
GOOD = "good_to_go"
AUTO = "fit_for_automated_tagging"
MANUAL = "needs_manual_remediation"
LABELS = (GOOD, AUTO, MANUAL)

HIGH = "high"
BORDERLINE = "borderline"


def _flag(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def auto_reason(tagged: Column, violations: Column, title: Column, language: Column) -> Column:
    """Why an automatic tagger can fix the document."""
    text = F.concat_ws(
        "; ",
        F.when(~_flag(tagged), F.lit("untagged (auto-tag adds structure)")),
        F.when(
            F.coalesce(violations, F.lit(0)) != 0,
            F.concat(violations.cast("string"), F.lit(" fixable violation(s)")),
        ),
        F.when(~_flag(language), F.lit("missing /Lang")),
        F.when(~_flag(title), F.lit("missing title")),
    )
    return F.when(text == "", "auto-remediable").otherwise(text)


def triage_score(
    violations: Column, neutral_clauses: Column, page_count: Column, profile: TriageProfile
) -> Column:
    s = profile.score
    over = F.greatest(F.lit(0.0), F.coalesce(page_count, F.lit(0)) - F.lit(s["big_doc_pages"]))
    return (
        F.lit(s["start"])
        - F.lit(s["per_violation"]) * F.coalesce(violations, F.lit(0))
        - F.lit(s["per_neutral_clause"]) * F.coalesce(neutral_clauses, F.lit(0))
        - F.lit(s["per_page_over"]) * over
    )


def structural_route(signal: Column, profile: TriageProfile) -> Column:
    """Route of a structural signal name, or null."""
    result = F.lit(None).cast("string")
    for name, route in sorted(profile.structural.items(), reverse=True):
        result = F.when(signal == name, F.lit(route)).otherwise(result)
    return result


def triage(
    *,
    violations: Column,
    tagged: Column,
    image_only: Column,
    has_form: Column,
    complex_graphic: Column,
    title_set: Column,
    language_set: Column,
    page_count: Column,
    manual_clauses: Column,
    neutral_clauses: Column,
    profile: TriageProfile,
) -> Column:
    """Struct of label, reason and confidence.

    The order of the branches is the policy: scanned, form and graphic documents go
    to a person whatever their violation count, clean documents never reach the score.
    ``manual_clauses`` is the sorted array of distinct counted clauses with the class
    manual, ``neutral_clauses`` the number of distinct counted clauses without a class.
    """

    def verdict(label: str, reason: Column | str, confidence: Column | str = HIGH) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
            (F.lit(confidence) if isinstance(confidence, str) else confidence).alias("confidence"),
        )

    s = profile.score
    clean = _flag(tagged) & (violations == 0)
    if profile.require_title:
        clean = clean & _flag(title_set)
    if profile.require_language:
        clean = clean & _flag(language_set)
    score = triage_score(violations, neutral_clauses, page_count, profile)
    threshold = s["auto_threshold"]
    near = F.when(F.abs(score - threshold) <= s["borderline_band"], BORDERLINE).otherwise(HIGH)

    chain = F.when(violations.isNull(), verdict(PENDING, "not yet verified"))
    if profile.routes_manual("image_only"):
        chain = chain.when(_flag(image_only), verdict(MANUAL, "image-only / scanned PDF needs OCR"))
    if profile.routes_manual("has_form"):
        chain = chain.when(
            _flag(has_form), verdict(MANUAL, "interactive form needs manual field labels")
        )
    if profile.routes_manual("complex_graphic"):
        chain = chain.when(
            _flag(complex_graphic),
            verdict(MANUAL, "overlapping image+text suggests a complex graphic", BORDERLINE),
        )
    return (
        chain.when(
            F.coalesce(F.size(manual_clauses), F.lit(0)) > 0,
            verdict(
                MANUAL,
                F.concat(F.lit("manual-only clause(s): "), F.array_join(manual_clauses, ", ")),
            ),
        )
        .when(clean, verdict(GOOD, "tagged, no counted violations"))
        .when(
            score >= threshold,
            verdict(AUTO, auto_reason(tagged, violations, title_set, language_set), near),
        )
        .otherwise(
            verdict(
                MANUAL,
                F.concat(
                    F.lit("score "),
                    score.cast("bigint").cast("string"),
                    F.lit(f" < {int(threshold)} (too many or unknown violations)"),
                ),
                near,
            )
        )
    )
