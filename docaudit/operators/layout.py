"""Page layout: text type, full-page images and complex graphics.

Boxes are rows (pdf_hash, page_no, kind, page box, box). ``kind`` is ``text``,
``image``, ``figure_image`` (a figure that holds an image) or anything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.geometry import (
    FULL_PAGE_BAND,
    GRAPHIC_BAND,
    TEXT_OVERLAP,
    area,
    area_ratio,
    overlap_fraction,
    within,
)

# Cells per page side: finer spreads a crowded page over more tasks but copies an image
# to more cells.
_GRID = 8
_EDGE = 1e-6


def sampled(boxes: DataFrame, max_pages: int | None) -> DataFrame:
    """Boxes of the first pages only; None keeps all pages."""
    return boxes if max_pages is None else boxes.where(F.col("page_no") < max_pages)


def _page_area() -> Column:
    return area(*[F.col(f"page_{c}") for c in ("x0", "y0", "x1", "y1")])


def _ratio() -> Column:
    return area_ratio(area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), _page_area())


def page_kinds(boxes: DataFrame) -> DataFrame:
    """Per page: any text, any full-page image."""
    text = F.col("kind") == "text"
    full = (F.col("kind") == "figure_image") & within(_ratio(), FULL_PAGE_BAND)
    return boxes.groupBy("pdf_hash", "page_no").agg(
        F.bool_or(text).alias("has_text"), F.bool_or(full).alias("has_page_image")
    )


def page_counts(boxes: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages with text and with a full-page image per document; pages are combined first, so this shuffles twice."""
    some = F.lit(True) if max_pages is None else F.col("page_no") < max_pages
    return page_kinds(boxes).groupBy("pdf_hash").agg(
        F.count_if(F.col("has_text") & some).alias("text_pages"),
        F.count_if(F.col("has_page_image") & some).alias("image_pages"),
    )


def text_type(boxes: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Hybrid, Text, Image Only or null per document, over all pages or the first ``max_pages``.

    Pages are combined first, then documents, so a document of any number of pages is a few counters; its pages with text
    and with a full-page image come along. Every document of ``boxes`` has a row.
    """
    text, image = F.col("text_pages") > 0, F.col("image_pages") > 0
    return page_counts(boxes, max_pages).withColumn(
        "text_type", F.when(text & image, "Hybrid").when(text, "Text").when(image, "Image Only")
    )


def _cell(value: Column, low: Column, high: Column) -> Column:
    """Grid index of a coordinate; clamping keeps the order, so containment survives."""
    share = (value - low) / (high - low)
    return F.greatest(F.lit(0), F.least(F.lit(_GRID - 1), F.floor(share * _GRID))).cast("int")


def overlapping_texts(boxes: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Text boxes that lie on a substantial image of their page, on all pages or the first ``max_pages``.

    An overlap of at least half the text box always covers the centre of that box. So a
    text goes to the one grid cell of its centre, an image to the cells it touches, and
    the equi join on (document, page, cell) meets every pair that can qualify. The semi
    join stops at the first hit and never emits pairs.
    """
    px = [F.col(f"page_{c}") for c in ("x0", "y0", "x1", "y1")]
    page_boxes = sampled(boxes, max_pages).where(_page_area() > 0)
    texts = page_boxes.where(
        (F.col("kind") == "text") & (area(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]) > 0)
    ).select(
        "pdf_hash",
        "page_no",
        _cell((F.col("x0") + F.col("x1")) / 2, px[0], px[2]).alias("cx"),
        _cell((F.col("y0") + F.col("y1")) / 2, px[1], px[3]).alias("cy"),
        "x0", "y0", "x1", "y1",
    )
    slack_x, slack_y = (px[2] - px[0]) * _EDGE, (px[3] - px[1]) * _EDGE
    images = (
        page_boxes.where(F.col("kind").isin("image", "figure_image"))
        .where(within(_ratio(), GRAPHIC_BAND))
        .select(
            "pdf_hash",
            "page_no",
            _cell(F.col("x0") - slack_x, px[0], px[2]).alias("cx0"),
            _cell(F.col("x1") + slack_x, px[0], px[2]).alias("cx1"),
            _cell(F.col("y0") - slack_y, px[1], px[3]).alias("cy0"),
            _cell(F.col("y1") + slack_y, px[1], px[3]).alias("cy1"),
            F.col("x0").alias("ix0"), F.col("y0").alias("iy0"),
            F.col("x1").alias("ix1"), F.col("y1").alias("iy1"),
        )
        .distinct()
        .withColumn("cx", F.explode(F.sequence("cx0", "cx1")))
        .withColumn("cy", F.explode(F.sequence("cy0", "cy1")))
        .drop("cx0", "cx1", "cy0", "cy1")
    )
    keys = ["pdf_hash", "page_no", "cx", "cy"]
    t, i = texts.alias("t"), images.alias("i")
    same_cell = [F.col(f"t.{k}") == F.col(f"i.{k}") for k in keys]
    overlap = overlap_fraction(
        tuple(F.col(f"t.{c}") for c in ("x0", "y0", "x1", "y1")),
        tuple(F.col(f"i.{c}") for c in ("ix0", "iy0", "ix1", "iy1")),
    )
    condition = overlap >= TEXT_OVERLAP
    for c in same_cell:
        condition = condition & c
    return t.join(i, condition, "left_semi").drop("cx", "cy")


def complex_graphic(boxes: DataFrame, max_pages: int | None = None) -> DataFrame:
    """All documents with their complex-graphic flag, by all pages or the first ``max_pages``."""
    hits = overlapping_texts(boxes, max_pages).select("pdf_hash").distinct()
    flagged = hits.withColumn("complex_graphic", F.lit(True))
    documents = boxes.select("pdf_hash").distinct()
    return documents.join(flagged, "pdf_hash", "left").withColumn(
        "complex_graphic", F.coalesce("complex_graphic", F.lit(False))
    )


def catalog_flags(catalogs: DataFrame) -> DataFrame:
    """Structural flags of parsed document catalogs.

    ``catalog`` is the map of catalog keys, ``annotation_keys`` the array of key arrays
    of all page annotations, ``xmp_title`` and ``info_title`` the two title sources.
    """
    filled = lambda c: F.coalesce(F.btrim(c, F.lit(" \t\r\n")) != "", F.lit(False))
    return catalogs.select(
        "pdf_hash",
        F.coalesce(F.map_contains_key("catalog", "/StructTreeRoot"), F.lit(False)).alias("tagged"),
        F.coalesce(
            F.exists("annotation_keys", lambda keys: F.array_contains(keys, "/FT")), F.lit(False)
        ).alias("has_form"),
        (filled(F.col("xmp_title")) | filled(F.col("info_title"))).alias("title_set"),
        filled(F.try_element_at("catalog", F.lit("/Lang"))).alias("language_set"),
        "page_count",
    )
