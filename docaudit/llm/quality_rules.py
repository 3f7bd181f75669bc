"""Quality rules with cross-document line frequency.

Every line is hashed in a normal form; the distinct documents that hold it are counted per
host. Lines above the limit are boilerplate of that host and count as removed everywhere but
in the first document that holds them and passes the word rules. A document of which almost nothing remains is
depleted and rejected; the others lose the lines.

All of it is DataFrame code. The texts are read once; what leaves that scan is a row of
counts and line hashes per document; lines are removed by hash where a text is passed on. Counts are combined before each shuffle, so a host
or line with a third of all rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.columns import (
    ID, KEY, ROW, TEXT, blank_words, carried, counting, gram_hash, join_keyed, keyed, let, lines, strip, unpacked,
)
from docaudit.shared import written

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def repeated_words(words: Column, n: int = 3) -> Column:
    """Words that lie in an ``n``-word window found at least twice in the text.

    Windows are sorted by hash, so equal ones are neighbours; the positions found are sorted
    again and their windows measured without overlap.
    """

    def found(by_hash: Column) -> Column:
        return F.filter(
            by_hash,
            lambda x, i: F.coalesce(x.h == F.get(by_hash, i - 1).h, F.lit(False))
            | F.coalesce(x.h == F.get(by_hash, i + 1).h, F.lit(False)),
        )

    def covered(at: Column) -> Column:
        widths = F.transform(at, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(at, i + 1) - x, F.lit(n))))
        return F.aggregate(widths, F.lit(0).cast("bigint"), lambda total, x: total + x)

    windows = F.transform(
        counting(F.size(words) - (n - 1)),
        lambda i: F.struct(gram_hash(words, i, n).alias("h"), i.alias("at")),
    )
    positions = let(F.array_sort(windows), lambda s: F.array_sort(F.transform(found(s), lambda x: x.at)))
    return let(positions, covered)


def _word_facts(text: Column) -> Column:
    return let(
        blank_words(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def _normal(line: Column) -> Column:
    return F.lower(strip(line))


def _line_facts(text: Column) -> Column:
    """Repeats of lines, and hash and length of every distinct normal form of a line."""

    def facts(held: Column) -> Column:
        normal = F.transform(held, _normal)
        hashed = F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("h"), F.char_length(x).alias("c")))
        return F.struct(
            (F.size(held) - F.size(F.array_distinct(held))).cast("bigint").alias("n_dup_lines"),
            F.array_distinct(hashed).alias("lines"),
        )

    return let(F.filter(lines(text), lambda x: strip(x) != ""), facts)


def document_facts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """Counts of every document, with the hashes of its lines."""
    base = keyed(docs, id_col, text_col, _host=host_col)
    facts = base.select(
        KEY, ID, "_host", F.xxhash64(TEXT).alias("_same"), _word_facts(F.col(TEXT)).alias("w"),
        _line_facts(F.col(TEXT)).alias("l"),
        F.coalesce(F.regexp_count(TEXT, F.lit(SYMBOLS)), F.lit(0)).cast("bigint").alias("n_symbols"),
    )
    return facts.select(KEY, ID, "_host", "_same", "w.*", "n_symbols", "l.*").withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS)
        | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
    )


def boilerplate(facts: DataFrame, max_docs: int) -> DataFrame:
    """Lines in more than ``max_docs`` documents of a host, with the first of these documents that is not
    base_failed: a rejected document would keep its lines for nothing.

    Exact copies count once, so a copied document does not lose its lines for that.
    """
    able = F.when(~F.col("base_failed"), F.col(ID)).alias("_able")
    held = facts.select("_host", "_same", able, F.explode("lines").alias("x"))
    once = held.groupBy("_host", F.col("x.h").alias("h"), "_same").agg(F.min("_able").alias("first"))
    counts = once.groupBy("_host", "h").agg(F.count("*").alias("n_docs"), F.min("first").alias("first"))
    return counts.where(F.col("n_docs") > max_docs)


def apply_quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = 20,
    min_left: float = 0.2,
) -> DataFrame:
    """One row per input row: ``id_col``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, left (share of line characters that stay), kept, row_key and
    gone_lines (hashes of the lines to be removed, null for none; see :func:`without_boilerplate`).

    ``max_docs``: a line in more distinct documents of a host is boilerplate there.
    ``min_left``: a document keeps at least this share of its characters or is rejected.

    Null and empty text: no words, one empty line, base_failed. A null host is a host of its
    own. A null id is an id that comes first nowhere. Repeated rows each get a row. An empty table gives an empty
    result. Other columns are not read.
    """
    facts = written(document_facts(docs, id_col, text_col, host_col), "quality")
    common = boilerplate(facts, max_docs).withColumnRenamed("_host", "_host2").withColumnRenamed("h", "h2")
    held = facts.where(~F.col("base_failed")).select(KEY, ID, "_host", F.explode("lines").alias("x"))
    held = held.select(KEY, ID, "_host", "x.h", "x.c")
    gone = held.join(common, (held.h == common.h2) & held["_host"].eqNullSafe(common["_host2"])).where(
        ~F.col(ID).eqNullSafe(F.col("first"))
    )
    # A row that is there twice has each line twice: once per line first, then the sum.
    per_doc = gone.groupBy(KEY, ID, "h").agg(F.max("c").alias("c")).groupBy(KEY, ID).agg(
        F.sum("c").alias("gone"), F.collect_list("h").alias("gone_lines")
    )
    total = F.aggregate("lines", F.lit(0).cast("bigint"), lambda s, x: s + x.c)
    scored = join_keyed(facts.withColumn("total", total).drop("lines"), per_doc).withColumn(
        "left", F.when(F.col("total") > 0, 1 - F.coalesce("gone", F.lit(0)) / F.col("total")).otherwise(F.lit(0.0))
    )
    return scored.select(
        F.col(ID).alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "left", (~F.col("base_failed") & (F.col("left") >= min_left)).alias("kept"), F.col(KEY).alias("row_key"),
        "gone_lines",
    )


def without_boilerplate(
    docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` (of :func:`apply_quality_rules`) keeps, ``text_col`` without
    the host's boilerplate lines.

    The first document that holds such a line and passes the word rules keeps it, blank lines and the order of lines stay.
    All input columns are returned; repeated rows stay repeated.
    """
    kept = verdicts.where("kept").select(F.col("row_key").alias(KEY), F.col(id_col).alias(ID), F.col("gone_lines").alias("_gone"))
    joined = join_keyed(carried(docs, id_col, text_col), kept.dropDuplicates([KEY, ID]), "inner")
    text = F.col(ROW)[text_col]
    stay = F.filter(lines(text), lambda x: ~F.array_contains("_gone", F.xxhash64(_normal(x))))
    return unpacked(joined, docs.columns, **{text_col: F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(stay, "\n"))})
