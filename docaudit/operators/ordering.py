"""Row numbers and chunks without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.shared import written


def number_rows(df: DataFrame, *order: Column, name: str = "row_no") -> DataFrame:
    """Consecutive numbers from 1 in ``order`` over the whole table.

    A window without partitions would sort everything in one task. Here the rows are
    range-sorted and written with their partition and offset, and only one number per
    partition (the running start) is joined back.
    """
    sorted_rows = written(
        df.orderBy(*order)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_pos", 33)),
        "numbered",
    )
    sizes = sorted_rows.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per sort partition, so this window stays small whatever the table holds.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    offset = F.col("_pos") - F.shiftleft(F.col("_part"), 33)
    return (
        sorted_rows.join(starts, "_part")
        .withColumn(name, F.col("_start") + offset + 1)
        .drop("_part", "_pos", "_start")
    )


def chunk_ids(df: DataFrame, size: int, *order: Column) -> DataFrame:
    """Work split in chunks of ``size`` rows, in order, numbered from 0."""
    numbered = number_rows(df, *order, name="_row")
    chunk = F.floor((F.col("_row") - 1) / F.lit(max(1, size))).cast("bigint")
    return numbered.withColumn("chunk_id", chunk).drop("_row")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """One whole row per key: the highest in ``order``, ties by the greatest row; without an order the greatest row.

    Spark defines no order of reading: large files come first, and after a shuffle anything may. So where it matters
    which of several changes wins, the caller names a column that tells. Rows compare by their values, column by
    column, nulls first, so the result depends on the rows alone. An aggregate with map-side combine reduces a key with
    a third of all rows before the shuffle; a window would send all of them to one task.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.struct(*rest)
    best = F.max(row) if order is None else F.max(F.struct(order.alias("_order"), row.alias("_row")))["_row"]
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*").select(*df.columns)
