"""Short display codes of the status table, as plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docaudit.functions.text import drop_nulls

NOTHING = "-"


def class_badge(label: Column) -> Column:
    return (
        F.when(label == "good_to_go", "GO")
        .when(label == "fit_for_automated_tagging", "AUTO")
        .when(label == "needs_manual_remediation", "MANUAL")
        .otherwise(NOTHING)
    )


def text_type_cell(text_type: Column, image_only: Column) -> Column:
    """The diagnostic text type, with ``?`` where the authoritative flag disagrees."""
    flagged = F.coalesce(image_only, F.lit(False))
    return (
        F.when(F.coalesce(text_type, F.lit("")) == "", NOTHING)
        .when((text_type == "Image Only") & ~flagged, "Image Only?")
        .otherwise(text_type)
    )


def crawl_flags(
    offsite: Column,
    via_resolver: Column,
    archived: Column,
    pdf_404: Column,
    parent_404: Column,
    removed: Column,
) -> Column:
    """Badges in fixed order, separated by blanks."""
    badges = F.array_join(
        drop_nulls(
            F.when(offsite, F.lit("offsite")),
            F.when(via_resolver != "", F.concat(F.lit("via:"), via_resolver)),
            F.when(archived, F.lit("archived")),
            F.when(pdf_404, F.lit("404")),
            F.when(parent_404, F.lit("p404")),
            F.when(removed, F.lit("removed")),
        ),
        " ",
    )
    return F.when(badges == "", NOTHING).otherwise(badges)
