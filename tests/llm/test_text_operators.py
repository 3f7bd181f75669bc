"""The operators on texts against their plain versions."""

import hashlib
from collections import Counter

import plain
import pytest
from plain import SF
from pyspark.sql import functions as F

from docaudit.llm.license_scan import scan_licenses
from docaudit.llm.line_runs import dedup_lines
from docaudit.llm.ngram_join import JoinSettings, similar_documents
from docaudit.llm.quality_rules import apply_quality_rules
from docaudit.llm.winnowing import contamination

ITEMS = [
    (1, "w1 w2 w3"), (2, None), (3, "?!"), (4, " ".join(f"W{i}," for i in range(30))), (5, "one"),
    (6, "a shared line that is long enough to be counted ünïcode too"), (6, "a second text of the same item"), (7, "w5"),
]


def _counted(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 100)])
@pytest.mark.parametrize("orders", [1, 3])
def test_join_components(odd, odd_rows, n, percent, orders):
    found = similar_documents(odd, settings=JoinSettings(words=n, percent=percent, orders=orders, frequent_least=3))
    want = plain.components(odd_rows, n, percent)
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in found.collect()}
    assert found.count() == sum(d is not None for d, _ in odd_rows)
    # An id with two texts is two nodes here and one in the plain version, which changes no smallest id.
    assert got == want


def test_join_on_documents(documents, document_rows):
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in similar_documents(documents).collect()}
    assert found == plain.components([r[:2] for r in document_rows])


def test_winnowing(spark, odd, odd_rows):
    items = spark.createDataFrame([(*x, "extra") for x in ITEMS], "item_id long, text string, n_words string")
    want = Counter(plain.contamination(odd_rows, ITEMS))
    for small in (200_000, 0):  # broadcast, and joined by hash
        found = contamination(odd, items, broadcast_rows=small).withColumn("sha", F.sha2(F.array_join("items", ","), 256))
        assert _counted(found, "doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated") == want


def test_every_shared_window_is_found(spark):
    words = [f"v{i}" for i in range(40)]
    docs = [(i, " ".join(["x"] * i + words[i : i + 10] + ["y"] * 3)) for i in range(31)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = contamination(df, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"))
    assert [r["n_hit"] for r in found.collect()] == [10] * 31


def test_line_runs(odd, odd_rows):
    want = Counter(plain.dedup_lines(odd_rows))
    for batches, fan_in in ((1, 2), (6, 2), (4, 3)):
        found = dedup_lines(odd, batches=batches, fan_in=fan_in)
        assert set(odd.columns) <= set(found.columns)
        assert _counted(found, "doc_id", "n_lines", "n_dropped", "text") == want


def test_quality_rules(odd, odd_rows):
    rows = [(d, t, f"h{(d or 0) % 2}") for d, t in odd_rows]
    found = apply_quality_rules(odd, max_docs=5)
    assert _counted(found.drop("left", "row_key"), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == Counter(plain.quality(rows, 5))


def test_boilerplate_lines_are_removed(spark):
    import corpus_pipeline as p

    def text(i, menu):
        return "\n".join([menu, " ".join(f"a{i}x{j}" for j in range(40)), "", " ".join(f"b{i}x{j}" for j in range(40)), menu.upper() + " "])

    # A short menu line: the later line dedup does not look at it.
    rows = [(i, text(i, "Home | News"), "s") for i in range(25)] + [(25, text(25, "Home | News"), "other")]
    rows += [(3, text(3, "Home | News"), "s"), (26, "Home | News\ntoo short", "s"), (None, text(27, "Home | News"), "s")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, source string, n_chars long")
    got = p.quality(spark, docs, SF)
    assert got.columns == docs.columns

    def clean(d, t, host):
        return t if host == "other" or d == 0 else "\n".join(x for x in t.split("\n") if plain.line_key(x) != "home | news")

    want = Counter((d, c, s, len(c)) for d, t, s in rows if d != 26 for c in [clean(d, t, s)])
    assert Counter(tuple(r) for r in got.collect()) == want


def test_first_holder_passes_the_word_rules(spark):
    page = "\n".join(" ".join(f"l{k}w{j}" for j in range(12)) for k in range(4))  # 48 words
    failing = {0: page + "\nx", 30: page + "\n" + page}  # too short, and pasted twice
    for d, t in failing.items():
        rows = [(d, t, "s")] + [(i, f"{page}\nmore y{i} z{i}", "s") for i in range(40, 65)]
        found = apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        assert {r["doc_id"] for r in found if r["base_failed"]} == {d}
        assert {r["doc_id"] for r in found if r["kept"]} == {40}


def test_licenses(spark, odd):
    long_ = " ".join(f"term{i}" for i in range(90))
    templates = [("short", "Released under the MIT License."), ("long", long_), ("tiny", "solo"), ("none", None), (None, "x y"), ("long", "another wording " * 3)]
    cut = long_.split()
    texts = [
        (1, "Intro. " * 50 + "released under THE mit license"), (2, long_), (3, " ".join(cut[:85])), (4, " ".join(cut[:40])),
        (5, "Solo"), (6, None), (7, ""), (8, " ".join(f"f{i} " * 7 for i in range(300)) + long_ + " z" * 500 + " released under the mit license"),
        (9, " ".join(x for w in cut for x in (w, "gap"))), (10, "another wording another wording another wording"), (1, "x"), (None, "solo"),
    ]
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, name int")
    known = spark.createDataFrame(templates, "template string, text string")
    want = {(1, "short"), (1, ""), (2, "long"), (3, "long"), (4, ""), (5, "tiny"), (6, ""), (7, ""), (8, "long,short"), (9, ""), (10, "long"), (None, "tiny")}
    for small in (100_000, 0):
        found = scan_licenses(df, known, broadcast_rows=small)
        assert {(r[0], ",".join(r[1])) for r in found.select("doc_id", "licenses").collect()} == want
    nothing = scan_licenses(df, known.limit(0))
    assert nothing.agg(F.sum("n_licenses")).first()[0] == 0 and nothing.count() == len(texts)


def test_empty_tables(spark, empty, odd):
    items = spark.createDataFrame([], "item_id long, text string")
    assert similar_documents(empty).count() == 0
    assert dedup_lines(empty).count() == 0
    assert apply_quality_rules(empty).count() == 0
    assert contamination(empty, items).count() == 0
    assert contamination(odd, items).where("contaminated").count() == 0


def test_pipeline_stages(spark, documents, document_rows):
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    docs, columns = documents, documents.columns
    for name in ("quality_rules", "line_dedup", "ngram_join", "decontamination"):
        rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        if name == "quality_rules":
            want = {(r[0], t) for r, (_, t, _) in zip(plain.quality(rows), rows, strict=True) if r[-1]}
        elif name == "line_dedup":
            want = {(r[0], r[3]) for r in plain.dedup_lines([x[:2] for x in rows])}
        elif name == "ngram_join":
            first = plain.components([x[:2] for x in rows], 5, 80)
            want = {(d, t) for d, t, _ in rows if first[d, len(plain.shingles(plain.blank_words(plain.lower(t)), 5))] == d}
        else:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            bad = plain.contamination([x[:2] for x in rows], items)
            want = {(d, t) for (d, t, _), b in zip(rows, bad, strict=True) if not b[-1]}
        docs = stages[name](spark, docs, SF).cache()
        assert docs.columns == columns
        got = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert set(got) == want and len(got) == len(want), name
    packed = stages["packing"](spark, docs, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_pipeline_on_odd_and_empty_rows(spark, odd, odd_rows, empty):
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        assert stage(spark, empty.withColumn("n_chars", F.lit(0).cast("bigint")), SF).count() == 0, name
    docs = odd.withColumn("n_chars", F.length("text").cast("bigint"))
    kept = dict(p.STAGES)["ngram_join"](spark, docs, SF)
    assert kept.where("doc_id is null").count() == sum(d is None for d, _ in odd_rows)


def test_kept_text_digest(spark):
    from docaudit.llm.queries import op3_line_dedup

    got = {r["doc_id"]: r["kept_sha256"] for r in op3_line_dedup(spark, SF).collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got == {r[0]: hashlib.sha256(r[3].encode()).hexdigest() for r in plain.dedup_lines(rows)}


CLASHING = ("_id", "_key", "_row", "_text", "_drops", "_gone", "_id2", "_key2", "first_id", "row_key", "n_dropped")


def test_columns_named_like_the_operators_own(spark, odd_rows):
    import corpus_pipeline as p

    rows = [(d, t, f"h{(d or 0) % 2}", *([i] * len(CLASHING))) for i, (d, t) in enumerate(odd_rows)]
    kind = "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in CLASHING)
    docs = spark.createDataFrame(rows, kind).withColumn("n_chars", F.lit(0).cast("bigint"))
    found = dedup_lines(docs)
    assert found.columns == [*docs.columns, "n_lines"]
    assert _counted(found, "doc_id", "n_lines", "n_dropped", "text") == Counter(plain.dedup_lines(odd_rows))
    kept = {r[CLASHING.index("_id") + 3] for r in rows}
    for name in ("quality_rules", "ngram_join", "decontamination"):
        stage = dict(p.STAGES)[name](spark, docs, SF)
        assert stage.columns == docs.columns and {r["_key"] for r in stage.collect()} <= kept, name


def test_line_dedup_by_other_kinds_of_ids(spark, odd_rows):
    rows = [(None if d is None else f"{d:06d}", t) for d, t in odd_rows]
    for id_col in ("doc_id", "_id"):
        found = dedup_lines(spark.createDataFrame(rows, f"{id_col} string, text string"), id_col=id_col, batches=5)
        assert _counted(found, id_col, "n_lines", "n_dropped", "text") == Counter(plain.dedup_lines(rows))


def test_repeated_passages_cost_their_length(spark):
    """A passage that document and item both repeat: rows grow with the document, not with the product of the places."""
    from docaudit.llm import winnowing

    passage = [f"p{i}" for i in range(12)]
    docs = [(1, " ".join(passage * 400)), (2, " ".join(passage * 2 + ["x"] * 30 + passage[:9])), (3, " ".join(passage[::-1] * 5))]
    items = [(7, " ".join(passage * 60)), (8, " ".join(passage[3:] + ["end"])), (9, "x x x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    made = []
    kept = winnowing.written

    def counted(table, label="table"):
        out = kept(table, label)
        made.append((label, out.count()))
        return out

    winnowing.written = counted
    try:
        found = contamination(df, bench).withColumn("sha", F.sha2(F.array_join("items", ","), 256))
        assert _counted(found, "doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated") == Counter(plain.contamination(docs, items))
    finally:
        winnowing.written = kept
    assert max(n for _, n in made) < 2 * 4800 + 200, made


def test_license_recall(spark):
    """Every template at random places of random texts, whole and, for the long ones, its first 85 % of words."""
    import random

    from docaudit.llm.license_scan import default_templates
    from docaudit.llm.license_templates import TEMPLATES

    rng, rows, planted = random.Random(11), [], {}
    for name, text in TEMPLATES.items():
        words = text.split()
        for share in (1.0, 0.85) if len(words) >= 60 else (1.0,):
            for _ in range(40):
                body = [f"b{rng.randrange(5000)}" for _ in range(rng.randrange(700))]
                at = rng.randrange(len(body) + 1)
                planted[len(rows)] = (name, share)
                rows.append((len(rows), " ".join(body[:at] + words[: round(share * len(words))] + body[at:])))
    found = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), default_templates(spark))
    held = {r["doc_id"]: r["licenses"] for r in found.collect()}
    for share, least in ((1.0, 0.99), (0.85, 0.95)):
        hits = [name in held[d] for d, (name, s) in planted.items() if s == share]
        assert sum(hits) >= least * len(hits), (share, sum(hits), len(hits))
