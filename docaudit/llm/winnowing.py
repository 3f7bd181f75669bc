"""Benchmark decontamination by winnowing.

Of every run of consecutive k-gram hashes the smallest is kept, with its position. Two texts that
share a span of ``window`` words keep the same hash for it, so the fingerprints of the benchmark
mark in each document the spots near which a shared span can be. A hit is extended over all windows
around its spot, and each of these is compared exactly with the distinct windows of the benchmark. So a passage
costs its length, however often documents or items repeat it; places in documents are never paired with places in items.

All of it is DataFrame code. A benchmark is broadcast only below ``broadcast_rows``
fingerprints or windows; a larger one is joined by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.columns import ID, KEY, TEXT, alnum_words, counting, gram_hash, join_keyed, keyed, let
from docaudit.shared import written

# A fingerprint holds a position in its low bits, so that the smallest of a window is one
# comparison of longs. Hits are compared word by word, so the shorter hash costs no accuracy.
_POSITION_BITS = 31  # more than an array can have entries
_POSITION = (1 << _POSITION_BITS) - 1


def _positioned_grams(words: Column, k: int) -> Column:
    """Hash bits over position bits of every run of ``k`` words."""
    return F.transform(
        counting(F.size(words) - (k - 1)),
        lambda i: gram_hash(words, i, k).bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("bigint")),
    )


def fingerprints(words: Column, window: int, k: int) -> Column:
    """Smallest k-gram of every window of ``window`` words, as hash bits over position bits."""
    span = window - k + 1
    return let(
        _positioned_grams(words, k),
        lambda g: F.array_distinct(
            F.transform(
                counting(F.size(g) - (span - 1)), lambda i: F.least(*[F.get(g, i + j) for j in range(span)])
            )
        ),
    )


def _items(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    items = benchmark.select(
        F.xxhash64(item_col, text_col).alias("item_key"), F.col(item_col).alias("item"),
        alnum_words(F.col(text_col)).alias("item_words"),
    ).dropDuplicates(["item_key"])
    size = F.size("item_words")
    return items.where(size > 0).withColumn("span", F.least(size, F.lit(window)))


def _spots(prints: DataFrame, column: str, wanted: DataFrame, span: int) -> DataFrame:
    """(key, id, spot): where a document has one of the wanted hashes; a spot is (span, position)."""
    rows = prints.select(KEY, ID, F.explode(column).alias("f"))
    at = F.col("f").bitwiseAND(F.lit(_POSITION)).cast("int")
    rows = rows.select(KEY, ID, F.shiftright("f", _POSITION_BITS).alias("h"), F.struct(F.lit(span).alias("span"), at.alias("at")).alias("spot"))
    return rows.join(wanted, "h", "left_semi").select(KEY, ID, "spot")


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """Broadcast up to ``most`` rows."""
    return F.broadcast(rows) if len(rows.select(F.lit(1)).take(most + 1)) <= most else rows


def _windows(items: DataFrame) -> DataFrame:
    """(item, window): the text of every window of every item, its words joined by blanks."""
    at = counting(F.size("item_words") - F.col("span") + 1)
    texts = F.array_distinct(F.transform(at, lambda j: F.array_join(F.slice("item_words", j + 1, F.col("span")), " ")))
    return items.select("item", "span", F.explode(texts).alias("window"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    k: int = 5,
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """One row per document row: ``id_col``, n_words, n_hit, n_items, items (ids as sorted
    strings), spans (array of hit word ranges), contaminated, row_key.

    A document word is hit if it lies inside an occurrence of ``window`` consecutive words of an
    item, or of the whole item where that is shorter. Words are runs of ASCII letters, digits
    and non-ASCII characters, A-Z lower-cased.

    Null or empty texts have no words and no hits; an item without words hits nothing. Rows
    that repeat count as one document, and each gets a row. An empty benchmark or table
    gives no hits or no rows. Other columns are not read. Texts of any length.
    """
    base = keyed(docs, id_col, text_col)
    items = written(_items(benchmark, item_col, item_text_col, window), "items")
    shorter = sorted(r["span"] for r in items.where(F.col("span") < window).select("span").distinct().collect())

    def doc_facts(w: Column) -> Column:
        # Items below the window size are looked up by grams of just their length.
        short = {f"short_{n}": _positioned_grams(w, n) for n in shorter}
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"), fingerprints(w, window, k).alias("prints"),
            *[v.alias(n) for n, v in short.items()],
        )

    facts = written(
        base.select(KEY, ID, let(alnum_words(F.col(TEXT)), doc_facts).alias("x")).select(KEY, ID, "x.*"), "prints"
    )
    whole = items.where(F.col("span") == window)
    wanted = whole.select(F.explode(fingerprints(F.col("item_words"), window, k)).alias("f"))
    wanted = written(wanted.select(F.shiftright("f", _POSITION_BITS).alias("h")).distinct(), "fingerprints")
    spots = _spots(facts, "prints", _bounded(wanted, broadcast_rows), window)
    for n in shorter:
        grams = items.where(F.col("span") == n).select(gram_hash(F.col("item_words"), F.lit(0), n).alias("f"))
        grams = written(grams.select(F.shiftright("f", _POSITION_BITS).alias("h")).distinct(), "fingerprints")
        spots = spots.unionByName(_spots(facts, f"short_{n}", _bounded(grams, broadcast_rows), n))
    spots = written(spots.groupBy(KEY, ID).agg(F.collect_set("spot").alias("spots")), "spots")

    # Only documents with a spot are read again; every window that covers a spot's k-gram is looked up.
    def around(words: Column) -> Column:
        def starts(spot: Column) -> Column:
            first = F.when(spot.span == window, F.greatest(spot.at - (window - k), F.lit(0))).otherwise(spot.at)
            last = F.least(spot.at, F.size(words) - spot.span)
            return F.when(first <= last, F.transform(F.sequence(first, last), lambda s: F.struct(spot.span.alias("span"), s.alias("at"))))

        found = F.array_distinct(F.flatten(F.array_compact(F.transform("spots", starts))))
        return F.transform(
            found, lambda x: F.struct(x.at.alias("at"), x.span.alias("span"), F.array_join(F.slice(words, x.at + 1, x.span), " ").alias("window"))
        )

    cut = join_keyed(base, spots, "inner").select(KEY, ID, F.explode(let(alnum_words(F.col(TEXT)), around)).alias("x"))
    held = written(_windows(items), "windows")
    distinct = written(held.select("span", "window").distinct(), "distinct-windows")
    found = cut.select(KEY, ID, "x.*").join(_bounded(distinct, broadcast_rows), ["span", "window"], "left_semi")
    found = written(found.select(KEY, ID, "at", "span", "window"), "found")
    positions = F.sequence(F.col("at"), F.col("at") + F.col("span") - 1)
    hit = found.groupBy(KEY, ID).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(positions)))).alias("hit"))
    named = found.select(KEY, ID, "span", "window").distinct().join(_bounded(held, broadcast_rows), ["span", "window"])
    names = named.groupBy(KEY, ID).agg(F.array_sort(F.collect_set(F.coalesce(F.col("item").cast("string"), F.lit("")))).alias("items"))
    per_doc = join_keyed(hit, names, "inner")
    result = join_keyed(facts.select(KEY, ID, "n_words"), per_doc)
    no_text = F.array().cast("array<string>")
    return result.select(
        F.col(ID).alias(id_col), "n_words",
        F.coalesce(F.size("hit"), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", no_text).alias("items"),
        F.coalesce("hit", F.array().cast("array<int>")).alias("hit_words"),
        F.col("hit").isNotNull().alias("contaminated"), F.col(KEY).alias("row_key"),
    )
