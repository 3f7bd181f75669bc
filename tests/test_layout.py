import random

from pyspark.sql import functions as F

from docaudit.functions.geometry import overlap_fraction
from docaudit.operators import layout as L

BOX = "pdf_hash string, page_no int, kind string, page_x0 double, page_y0 double, page_x1 double, page_y1 double, x0 double, y0 double, x1 double, y1 double"


def _boxes(spark, rows, page=(0.0, 0.0, 100.0, 100.0)):
    return spark.createDataFrame([(h, p, k, *page, *map(float, b)) for h, p, k, b in rows], BOX)


def test_overlap_fraction(each):
    schema = "a double, b double, c double, d double, x double"
    names = ["a", "b", "c", "d"]
    image = tuple(F.lit(v) for v in (0.0, 0.0, 10.0, 10.0))
    rows = [(1.0, 1.0, 2.0, 2.0, 0.0), (20.0, 20.0, 30.0, 30.0, 0.0), (5.0, 0.0, 15.0, 10.0, 0.0), (1.0, 1.0, 1.0, 5.0, 0.0)]
    assert each(rows, overlap_fraction(tuple(F.col(n) for n in names), image), schema) == [1.0, 0.0, 0.5, 0.0]


def test_text_types(spark):
    full, small = (0, 0, 100, 100), (0, 0, 20, 20)
    boxes = _boxes(
        spark,
        [("hy", 0, "figure_image", full), ("hy", 3, "text", small), ("tx", 1, "text", small), ("im", 0, "figure_image", full),
         ("no", 0, "figure_image", small), ("bare", 0, "image", full), ("late", 70, "text", small), ("late", 2, "other", small), ("late", 134, "figure_image", full)],
    )
    got = {r["pdf_hash"]: r["text_type"] for r in L.text_type(boxes).collect()}
    assert got == {"hy": "Hybrid", "tx": "Text", "im": "Image Only", "no": None, "bare": None, "late": "Hybrid"}
    got = {r["pdf_hash"]: r["text_type"] for r in L.text_type(boxes, max_pages=25).collect()}
    assert got["late"] is None and got["hy"] == "Hybrid"


def test_overlap_matches_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for doc in range(6):
        for _ in range(60):
            kind = rng.choice(["text", "text", "image", "figure_image", "other"])
            x0, y0 = rng.uniform(-20, 100), rng.uniform(-20, 100)
            w, h = (rng.uniform(-2, 25), rng.uniform(1, 20)) if kind == "text" else (rng.uniform(5, 110), rng.uniform(5, 60))
            rows.append((f"d{doc}", rng.choice([0, 1, 24, 90]), kind, (x0, y0, x0 + w, y0 + h)))
    # Exactly half of the text box, on the edge of a grid cell.
    rows += [("edge", 0, "image", (50, 50, 90, 90)), ("edge", 0, "text", (40, 50, 60, 60))]

    def hit(t, i):
        area = (t[2] - t[0]) * (t[3] - t[1])
        if area <= 0:
            return False
        w = max(0.0, min(t[2], i[2]) - max(t[0], i[0]))
        h = max(0.0, min(t[3], i[3]) - max(t[1], i[1]))
        return w * h / area >= 0.5

    images = [
        (h, p, b) for h, p, k, b in rows
        if k in ("image", "figure_image") and 0.05 < (b[2] - b[0]) * (b[3] - b[1]) / 10000 < 0.9
    ]
    want = sorted(
        (h, p, *map(float, b)) for h, p, k, b in rows
        if k == "text" and any(h == ih and p == ip and hit(b, ib) for ih, ip, ib in images)
    )
    got = sorted(tuple(r) for r in L.overlapping_texts(_boxes(spark, rows)).select("pdf_hash", "page_no", "x0", "y0", "x1", "y1").collect())
    assert got == want and ("edge", 0, 40.0, 50.0, 60.0, 60.0) in got and len(want) > 5
    flags = {r["pdf_hash"]: r["complex_graphic"] for r in L.complex_graphic(_boxes(spark, rows)).collect()}
    assert {h for h, on in flags.items() if on} == {w[0] for w in want}


def test_page_without_area(spark):
    rows = [("z", 0, "image", (0, 0, 50, 50)), ("z", 0, "text", (1, 1, 5, 5)), ("z", 0, "figure_image", (0, 0, 1, 1))]
    flat = _boxes(spark, rows, page=(0.0, 0.0, 0.0, 0.0))
    assert L.complex_graphic(flat).collect() == [("z", False)]
    assert L.text_type(flat).collect()[0]["text_type"] == "Text"


def test_catalogs(spark):
    rows = [
        ("a", {"/StructTreeRoot": "1", "/Lang": "en"}, [["/FT"]], " T ", None, 3), ("b", {"/Lang": "  "}, [["/Rect"]], None, "I", 1),
        ("c", {}, [], "  ", "", None),
    ]
    df = spark.createDataFrame(rows, "pdf_hash string, catalog map<string,string>, annotation_keys array<array<string>>, xmp_title string, info_title string, page_count bigint")
    got = {r[0]: tuple(r[1:]) for r in L.catalog_flags(df).collect()}
    assert got == {"a": (True, True, True, True, 3), "b": (False, False, True, False, 1), "c": (False, False, False, False, None)}


def test_text_type_counts_its_pages(spark):
    full, small = (0, 0, 100, 100), (0, 0, 20, 20)
    rows = [("a", 0, "text", small), ("a", 0, "text", full), ("a", 4, "text", small), ("a", 4, "figure_image", full), ("b", 1, "other", small)]
    got = {r["pdf_hash"]: (r["text_pages"], r["image_pages"], r["text_type"]) for r in L.text_type(_boxes(spark, rows)).collect()}
    assert got == {"a": (2, 1, "Hybrid"), "b": (0, 0, None)}
