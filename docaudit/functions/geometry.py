"""Bounding-box arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Area bands as a share of the page, and the overlap threshold.
FULL_PAGE_BAND = (0.9, 1.1)
GRAPHIC_BAND = (0.05, 0.9)
TEXT_OVERLAP = 0.5


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x1 - x0) * (y1 - y0)


def overlap_fraction(text: tuple[Column, ...], image: tuple[Column, ...]) -> Column:
    """Share of the text box that lies inside the image box; a degenerate box gives 0."""
    tx0, ty0, tx1, ty1 = text
    ix0, iy0, ix1, iy1 = image
    w = F.greatest(F.lit(0.0), F.least(tx1, ix1) - F.greatest(tx0, ix0))
    h = F.greatest(F.lit(0.0), F.least(ty1, iy1) - F.greatest(ty0, iy0))
    size = area(tx0, ty0, tx1, ty1)
    return F.when(size > 0, w * h / size).otherwise(F.lit(0.0))


def area_ratio(box_area: Column, page_area: Column) -> Column:
    """Box area as a share of the page; null when the page has no area."""
    return F.when(page_area > 0, box_area / page_area)


def within(ratio: Column, band: tuple[float, float]) -> Column:
    """Strictly inside the band; a missing ratio is outside."""
    return F.coalesce((ratio > band[0]) & (ratio < band[1]), F.lit(False))
