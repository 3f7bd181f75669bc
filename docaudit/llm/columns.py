"""Column expressions on words and lines, and the row key that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.text import let

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
NOT_ALNUM_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

KEY, ID, TEXT, ROW = "_key", "_id", "_text", "_row"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Plain ``lower`` is much faster and the same on ASCII text."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def pieces(text: Column, separators: str) -> Column:
    """Non-empty parts between runs of separators; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda x: x != "")


def blank_words(text: Column) -> Column:
    return pieces(text, BLANK_RUN)


def alnum_words(text: Column) -> Column:
    return pieces(lower_ascii(text), NOT_ALNUM_RUN)


def lines(text: Column) -> Column:
    """Lines between line feeds; null and empty text have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def counting(n: Column) -> Column:
    """0 .. n-1 as an array, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def gram_hash(words: Column, at: Column, n: int) -> Column:
    """Hash of the ``n`` words from position ``at``."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(n)])


def keyed(docs: DataFrame, id_col: str, text_col: str, **more: str) -> DataFrame:
    """Only what an operator reads, under names of its own, with a key for every (id, text).

    Repeated rows share the key, so joins on it must bring one row per key; a null id is
    an id like any other.
    """
    return docs.select(
        F.xxhash64(F.col(id_col), F.col(text_col)).alias(KEY),
        F.col(id_col).alias(ID),
        F.col(text_col).alias(TEXT),
        *[F.col(c).alias(name) for name, c in more.items()],
    )


def carried(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole rows as one column ``_row`` beside their key and id, so that no name in them can clash with an operator's own."""
    row = F.struct(*docs.columns).alias(ROW)
    return docs.select(row, F.xxhash64(id_col, text_col).alias(KEY), F.col(id_col).alias(ID))


def unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The rows of :func:`carried` again, with columns replaced or added."""
    old = [new[c].alias(c) if c in new else F.col(ROW)[c].alias(c) for c in columns]
    return rows.select(*old, *[e.alias(c) for c, e in new.items() if c not in columns])


def join_keyed(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on key and id; ``right`` has one row per pair."""
    right = right.withColumnRenamed(KEY, "_key2").withColumnRenamed(ID, "_id2")
    same = (left[KEY] == right["_key2"]) & left[ID].eqNullSafe(right["_id2"])
    joined = left.join(right, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("_key2", "_id2")


__all__ = [
    "BLANKS", "BLANK_RUN", "ID", "KEY", "NOT_ALNUM_RUN", "ROW", "TEXT", "alnum_words", "blank_words", "carried",
    "counting", "gram_hash", "join_keyed", "keyed", "let", "lines", "lower_ascii", "pieces", "strip", "unpacked",
]
