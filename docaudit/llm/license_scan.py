"""Licence scan: MinHash bands over overlapping text windows find templates, shingles verify them.

A text is a sequence of five-word shingles. Windows are pairs of neighbouring blocks, so any run of shingles as long
as a block lies whole in one of them; every template is looked for with the block size that fits its length.
A MinHash value is kept for each of 16 bins of the hash range (one-permutation hashing), and every bin is
a band: one equal value makes a candidate. A template fills at least a quarter of its window, so an exact copy is
found with probability over 0.99, and one of which four fifths are left with over 0.96. A template
of at most four shingles is looked for by all of them and is always found. What is found is verified: some
stretch of the text, twice as long as the template, holds at least the asked share of the template's shingles.

All of it is DataFrame code. Templates are broadcast only below ``broadcast_rows`` band rows; more are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.columns import ID, KEY, TEXT, alnum_words, counting, gram_hash, join_keyed, keyed, let
from docaudit.llm.license_templates import TEMPLATES
from docaudit.shared import written

_MAX_LEVEL = 20
_BIN_SHIFT = 60  # the upper four bits


def _shingles(words: Column, n: int) -> Column:
    """Hash of every run of ``n`` words; fewer words are one shingle, none have none."""
    few = F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(words) >= n, F.transform(counting(F.size(words) - (n - 1)), lambda i: gram_hash(words, i, n))).otherwise(few)


def _smallest(values: Column) -> Column:
    """The smallest of a set of hashes in each of 16 bins of equal width; the bins are the bands."""
    return let(
        F.sort_array(values),
        lambda v: F.filter(
            v, lambda x, i: (i == 0) | (F.shiftright(x, _BIN_SHIFT) != F.shiftright(F.get(v, i - 1), _BIN_SHIFT))
        ),
    )


def _level(n: Column) -> Column:
    """0 for at most four shingles; else the power of two, from 3 on, that the shingles fit in."""
    level = F.lit(3)
    for p in range(3, _MAX_LEVEL):
        level = level + (n > (1 << p) + 1).cast("int")
    return F.when(n <= 4, F.lit(0)).otherwise(level)


def _windows(shingles: Column, levels: list[int]) -> Column:
    """(level, at, keys) for the windows of a text at every level that is asked for.

    The values of a window of two blocks are those of a block of the next level, so each level is made
    from the one below; a text of one block has one window.
    """

    def told(p: int, rows: Column, step: int) -> Column:
        return F.transform(
            rows, lambda keys, i: F.struct(F.lit(p).alias("level"), (i * step).alias("at"), keys.alias("keys"))
        )

    def paired(blocks: Column) -> Column:
        return F.transform(blocks, lambda b, i: _smallest(F.concat(b, F.coalesce(F.get(blocks, i + 1), b))))

    def onward(windows: Column, p: int) -> Column:
        own = [told(p, windows, 1 << p)] if p in levels else []
        if p == max(levels):
            return own[0]
        blocks = F.filter(windows, lambda _, i: i % 2 == 0)
        return F.concat(*own, let(blocks, lambda b: let(paired(b), lambda w: onward(w, p + 1))))

    def whole(blocks: Column) -> Column:
        own = [told(0, blocks, 8)] if 0 in levels else []
        large = [let(paired(blocks), lambda w: onward(w, 3))] if max(levels) else []
        return F.concat(*own, *large)

    if not levels:
        return F.array().cast("array<struct<level:int,at:int,keys:array<bigint>>>")
    return let(
        F.transform(counting(F.ceil(F.size(shingles) / 8).cast("int")), lambda i: F.slice(shingles, 8 * i + 1, 8)), whole
    )


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "template string, text string")


def scan_licenses(
    docs: DataFrame,
    templates: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    name_col: str = "template",
    template_col: str = "text",
    words: int = 5,
    share: float = 0.8,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """One row per document row: ``id_col``, n_licenses, licenses (sorted names), best_share, row_key.

    A template is found if a stretch of the text, twice as long, holds at least ``share`` of its shingles. Words are runs of
    ASCII letters, digits and non-ASCII characters, A-Z lower-cased.

    Null and empty texts have no words and no licence; a template without words or name is found nowhere. Rows that repeat
    get a row each, templates of one name are alternatives. No templates or documents give no licences or rows.
    Other columns are not read.
    """
    base = keyed(docs, id_col, text_col)
    known = templates.select(F.col(name_col).alias("name"), let(alnum_words(F.col(template_col)), lambda w: F.array_distinct(_shingles(w, words))).alias("held"))
    known = known.where((F.size("held") > 0) & F.col("name").isNotNull()).withColumn("level", _level(F.size("held")))
    known = written(known.withColumn("number", F.xxhash64("name", "held")).dropDuplicates(["number"]), "templates")
    levels = sorted(r["level"] for r in known.select("level").distinct().collect())
    keys = F.when(F.col("level") == 0, F.col("held")).otherwise(_smallest(F.col("held")))
    bands_of = known.select("number", F.size("held").alias("n"), F.col("level").alias("level2"), F.explode(F.array_distinct(keys)).alias("key2"))
    if len(bands_of.take(broadcast_rows + 1)) <= broadcast_rows:
        bands_of = F.broadcast(bands_of)
    windows = base.select(
        KEY, ID, F.explode(let(alnum_words(F.col(TEXT)), lambda w: let(_shingles(w, words), lambda h: _windows(h, levels)))).alias("b")
    ).select(KEY, ID, "b.*")
    looked = windows.select(KEY, ID, "level", "at", F.explode("keys").alias("key"))
    hits = looked.join(bands_of, (F.col("key") == F.col("key2")) & (F.col("level") == F.col("level2")))
    # Where the template may lie around the window.
    width = F.when(F.col("level") == 0, F.lit(8)).otherwise(F.expr("shiftleft(2, level)"))
    hits = hits.select(KEY, ID, "number", F.greatest(F.lit(0), F.col("at") - F.col("n")).alias("lo"), (F.col("at") + width + F.col("n")).alias("hi"))
    hits = written(hits.groupBy(KEY, ID).agg(F.collect_set(F.struct("number", "lo", "hi")).alias("at")), "license-hits")

    # Only documents with a hit are read again; every hit takes along its part of the text.
    def cut(shingles: Column) -> Column:
        return F.transform("at", lambda a: F.struct(a.number.alias("number"), F.slice(shingles, a.lo + 1, a.hi - a.lo).alias("part")))

    parts = join_keyed(base, hits, "inner").select(
        KEY, ID, F.explode(let(alnum_words(F.col(TEXT)), lambda w: let(_shingles(w, words), cut))).alias("x")
    ).select(KEY, ID, "x.*").join(known, "number")
    n = F.size("held")
    found = F.array_max(F.transform(
        F.filter(counting(F.size("part")), lambda i: F.array_contains("held", F.get("part", i))),
        lambda i: F.size(F.array_intersect("held", F.slice("part", i + 1, 2 * n))),
    ))
    verified = parts.select(KEY, ID, "name", (found / n).alias("share")).where(F.col("share") >= share)
    per_doc = verified.groupBy(KEY, ID).agg(F.array_sort(F.collect_set("name")).alias("licenses"), F.max("share").alias("best_share"))
    return join_keyed(base.select(KEY, ID), per_doc).select(
        F.col(ID).alias(id_col), F.coalesce(F.size("licenses"), F.lit(0)).cast("bigint").alias("n_licenses"),
        F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
        F.coalesce("best_share", F.lit(0.0)).alias("best_share"), F.col(KEY).alias("row_key"),
    )
