"""File sources: checker JSON, document bytes, labelled folders, rosters, URL lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from docaudit.functions.text import strip
from docaudit.operators.evaluate import labelled

# Every cell has a comma before it; the line gets one for its first cell.
_CELL = r'(?s),("[^"]*(?:""[^"]*)*"|[^,]*)'
_BOM = "\ufeff"


def _missing_path(exc: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(exc)


def read_checker_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per report file: path and report_json."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("report_json")
    )


def read_pdf_bytes(
    spark: SparkSession, path: str, max_bytes: int | None = None, glob: str = "*.pdf"
) -> tuple[DataFrame, DataFrame]:
    """Files within an optional size cap with their bytes, and the oversized ones as failures.

    The length filter reaches the source, so bytes beyond the cap are never read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return split_by_size(files, max_bytes)


def split_by_size(files: DataFrame, max_bytes: int | None) -> tuple[DataFrame, DataFrame]:
    """Split (path, length, content) rows at the cap; None lets all pass. Oversized rows are (path, length, error_message)."""
    over = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    fitting = files.where(~over).select("path", "length", "content")
    oversized = files.where(over).select(
        "path",
        "length",
        F.concat(
            F.lit("download "), F.col("path"), F.lit(f": PDF exceeds max_bytes ({max_bytes})")
        ).alias("error_message"),
    )
    return fitting, oversized


def read_labelled_set(spark: SparkSession, root: str) -> DataFrame:
    """PDF files below labelled folders: path, folder, expected. No folder, no rows."""
    try:
        files = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.pdf")
            .option("recursiveFileLookup", "true")
            .load(root)
            .select("path")
        )
    except AnalysisException as exc:
        if not _missing_path(exc):
            raise
        files = spark.createDataFrame([], "path string")
    direct = F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 1) == F.lit(
        root.rstrip("/").rsplit("/", 1)[-1]
    )
    folders = files.where(direct).withColumn(
        "folder", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    )
    return labelled(folders)


def split_cells(line: Column) -> Column:
    """Cells of one CSV line; quoted cells may hold commas and doubled quotes."""
    clean = F.regexp_replace(line, f"^{_BOM}", "")
    raw = F.regexp_extract_all(F.concat(F.lit(","), clean), F.lit(_CELL), F.lit(1))

    def unquote(cell: Column) -> Column:
        inner = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
        return F.when(cell.startswith('"'), inner).otherwise(cell)

    return F.transform(raw, unquote)


def roster_rows(lines: DataFrame, line: str = "line", position: str = "position") -> DataFrame:
    """(position, cells) of the lines that have a non-blank cell."""
    return lines.select(F.col(position).alias("position"), split_cells(F.col(line)).alias("cells")).where(
        F.exists("cells", lambda c: strip(c) != "")
    )


def _joined_rows(lines: DataFrame) -> DataFrame:
    """Rows (file, block, row, line) of a CSV from its physical lines: a line end within quotes does not end a row.

    Whether a line begins within quotes hangs on the quotes before it. They are counted for each split first, summed over
    the splits of a file, and then within a split; so a file of any size is read by as many tasks as it has splits.
    A row that crosses splits goes to where it began. A last quote that nothing closes is an ordinary character.
    """
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    counted = lines.withColumn("quotes", quotes)
    splits = counted.groupBy("file", "block").agg(F.sum("quotes").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        F.col("file").alias("file2"), F.col("block").alias("block2"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"),
        F.sum("n").over(Window.partitionBy("file")).alias("total"),
    )
    inside = Window.partitionBy("file", "block").orderBy("row")
    before = F.col("ahead") + F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.join(splits, (F.col("file") == F.col("file2")) & (F.col("block") == F.col("block2")))
    begins = (F.col("before") % 2 == 0) | (F.col("before") == F.col("total"))
    placed = placed.withColumn("before", before).withColumn("start", F.when(begins, F.col("row")))
    placed = placed.withColumn("start", F.last("start", ignorenulls=True).over(inside)).select("file", "block", "row", "line", "start")
    # Lines in front of the first start of a split belong to the last start before it.
    starts = placed.groupBy(F.col("file").alias("file2"), F.col("block").alias("block2")).agg(F.max("start").alias("last"))
    here = F.when(F.col("last").isNotNull(), F.struct(F.col("block2").alias("block"), F.col("last").alias("row")))
    earlier = Window.partitionBy("file2").orderBy("block2").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("carried", F.last(here, ignorenulls=True).over(earlier)).select("file2", "block2", "carried")
    named = placed.join(starts, (F.col("file") == F.col("file2")) & (F.col("block") == F.col("block2")))
    own = F.when(F.col("start").isNotNull(), F.struct(F.col("block"), F.col("start").alias("row")))
    named = named.select("file", F.coalesce(own, "carried").alias("at"), F.struct("block", "row", "line").alias("x"))
    rows = named.groupBy("file", "at").agg(F.array_sort(F.collect_list("x")).alias("x"))
    text = F.array_join(F.transform("x", lambda x: x["line"]), "\n")
    return rows.select("file", "at.block", "at.row", F.regexp_replace(text, "\r$", "").alias("line"))


def read_roster_csv(spark: SparkSession, path: str | None, multiline: bool = False) -> DataFrame:
    """Roster cells with a position that orders rows as in the file.

    Read as text so that large files split; the position is the file, the offset of
    the split and the row within it. A missing path gives no rows. ``multiline``: quoted cells may
    hold line ends, at the price of a shuffle of the lines.
    """
    empty = spark.createDataFrame(
        [], "position struct<file:string,block:bigint,row:bigint>, cells array<string>"
    )
    if path is None:
        return empty
    try:
        lines = spark.read.text(path, lineSep="\n")
    except AnalysisException as exc:
        if _missing_path(exc):
            return empty
        raise
    placed = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )
    rows = _joined_rows(placed) if multiline else placed.withColumn("line", F.regexp_replace("line", "\r$", ""))
    return roster_rows(rows.select(F.struct("file", "block", "row").alias("position"), "line"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line, trimmed, blank lines dropped."""
    return url_lines(spark.read.text(path), "value")


def url_lines(lines: DataFrame, column: str) -> DataFrame:
    return lines.select(strip(F.col(column)).alias("url")).where(F.col("url") != "")
