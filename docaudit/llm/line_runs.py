"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches, the highest ids first. A run is a table of line keys, sorted by
key, with the number of documents and the highest id seen. Each batch anti-joins the runs:
keys that a run has settled (enough documents, so the highest id is final) are dropped, the
rest become a new run of level 0. When a level is full its runs are merged into one run of
the next level. What is settled at the end says which lines go.

All of it is DataFrame code. Batches, runs and levels are written tables in the shared
folder, so a lost executor costs one task, not the job. Counts are combined before shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.llm.columns import (
    ID, KEY, ROW, TEXT, carried, counting, join_keyed, keyed, let, lines, lower_ascii, strip, unpacked,
)
from docaudit.shared import written

_LINE = ["h1", "h2"]


class LineRuns:
    """Runs by level. ``add`` takes a batch of (h1, h2, _id) rows with ids below all earlier ones."""

    def __init__(self, min_docs: int, fan_in: int = 3):
        self.min_docs, self.fan_in = min_docs, fan_in
        self.levels: list[list[DataFrame]] = [[]]

    def add(self, batch: DataFrame) -> None:
        fresh = batch.distinct().groupBy(*_LINE).agg(
            F.count(ID).alias("n"), F.max(ID).alias("top")
        )
        for run in (r for level in self.levels for r in level):
            settled = run.where(F.col("n") >= self.min_docs).select(*_LINE)
            fresh = fresh.join(settled.hint("merge"), _LINE, "left_anti")
        self._place(fresh, 0)

    def _place(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(written(run.sortWithinPartitions(*_LINE), f"run-{level}"))
        if len(self.levels[level]) == self.fan_in:
            full, self.levels[level] = self.levels[level], []
            self._place(self._merged(full), level + 1)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for r in runs[1:]:
            rows = rows.unionByName(r)
        return rows.groupBy(*_LINE).agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def settled(self) -> DataFrame:
        """Keys found in enough documents, with the highest id that holds them."""
        runs = [r for level in self.levels for r in level]
        return self._merged(runs).where(F.col("n") >= self.min_docs).select(*_LINE, "top")


def _line_keys(text: Column, min_chars: int) -> Column:
    """Position and hashes of every line that is long enough to be looked at."""

    def hashed(x: Column, at: Column) -> Column:
        # A shorter line cannot have a longer key, and reading its length is cheap.
        normal = F.when(F.octet_length(x) >= min_chars, lower_ascii(strip(x)))
        return let(
            normal,
            lambda k: F.when(
                F.char_length(k) >= min_chars,
                F.struct(at.alias("at"), F.xxhash64(k).alias("h1"), F.hash(k).alias("h2")),
            ),
        )

    return F.array_compact(F.transform(lines(text), hashed))


def _id_cuts(docs: DataFrame, id_col: str, batches: int) -> list:
    """Ids that cut the table in about equal parts. Ids of any type that can be sorted."""
    shares = [i / batches for i in range(1, batches)]
    if isinstance(docs.schema[id_col].dataType, T.NumericType):
        return sorted(set(docs.agg(F.percentile_approx(id_col, shares, 10_000).alias("c")).first()["c"] or []))
    # The ids of the smallest hashes are as good as drawn at random; there are 1,000 at most.
    few = docs.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col)).limit(1000)
    ids = sorted(r[0] for r in few.collect())
    return sorted({ids[int(x * len(ids))] for x in shares}) if ids else []


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int = 4,
    fan_in: int = 3,
) -> DataFrame:
    """The input rows with ``text_col`` without its common lines, and n_lines and n_dropped.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points in at least ``min_docs`` documents stay only in the highest
    ``id_col`` that holds them; all other lines of the key go.

    ``batches``: into how many ranges of ids the table is cut; ``fan_in``: runs of a level
    that are merged into one of the next. Neither changes the result.

    Null and empty text is one empty line and comes back as an empty text. Rows with a null id
    keep their text and count for nothing. Repeated rows of one id are one document. An empty table gives an
    empty result. Ids may be of any type that can be sorted. All input columns
    are returned, whatever their names; columns named n_lines or n_dropped are replaced.
    """
    cuts = _id_cuts(docs, id_col, batches) if batches > 1 else []
    numbered = keyed(docs, id_col, text_col).where(F.col(ID).isNotNull())
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col(ID) < F.lit(c)).cast("int")
    held = written(
        numbered.select(KEY, ID, number.alias("batch"), F.explode(_line_keys(F.col(TEXT), min_chars)).alias("x"))
        .select(KEY, ID, "batch", "x.*"),
        "lines",
    )
    runs = LineRuns(min_docs, fan_in)
    for b in range(len(cuts) + 1):
        runs.add(held.where(F.col("batch") == b).select(*_LINE, ID))
    common = written(runs.settled(), "settled")
    drops = (
        held.join(common, _LINE).where(F.col(ID) != F.col("top")).groupBy(KEY, ID)
        .agg(F.collect_set("at").alias("_drops"))
    )
    joined = join_keyed(carried(docs, id_col, text_col), drops)
    text = F.col(ROW)[text_col]

    def without(all_lines: Column) -> Column:
        stay = F.array_sort(F.array_except(counting(F.size(all_lines)), F.col("_drops")))
        return F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n")

    kept = F.when(F.col("_drops").isNull(), F.coalesce(text, F.lit(""))).otherwise(let(lines(text), without))
    n_lines = F.size(lines(text)).cast("bigint")
    n_dropped = F.coalesce(F.size("_drops"), F.lit(0)).cast("bigint")
    return unpacked(joined, docs.columns, **{text_col: kept, "n_lines": n_lines, "n_dropped": n_dropped})
