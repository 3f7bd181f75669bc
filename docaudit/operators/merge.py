"""Upserts and updates as pure functions: old table and changes in, new table out.

Plain Parquet has no MERGE. The changes of a run are small next to the inventory, so
the inventory is always the left side of a left join: when the changes fit, adaptive
execution broadcasts them by their real size and the inventory is not shuffled. A full
outer join would always shuffle it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.operators.ordering import last_per_key
from docaudit.shared import written


def _on(left: str, right: str, keys: Sequence[str]) -> Column:
    condition = F.col(f"{left}.{keys[0]}") == F.col(f"{right}.{keys[0]}")
    for k in keys[1:]:
        condition = condition & (F.col(f"{left}.{k}") == F.col(f"{right}.{k}"))
    return condition


def spread_null(key: Column, row: Column) -> Column:
    """The key, with nulls replaced by a value per row that matches nothing.

    Rows without a content hash can be a large part of the inventory. A join would send
    all of them to one task, because equal keys meet there even when null matches nothing.
    """
    return F.coalesce(key, F.concat(F.lit("\u0001"), row.cast("string")))


def lookup_hash(
    files: DataFrame, facts: DataFrame, how: str = "left", row: str = "pdf_url"
) -> DataFrame:
    """Join facts keyed by pdf_hash to files by file_hash; ``row`` spreads missing hashes.

    The facts should come from a table (see ``shared.written``): an aggregate or join by
    hash would lend its partitioning to this join, and adaptive execution can split a hot
    hash only where both sides are shuffled for the join itself.
    """
    keyed = files.withColumn("_key", spread_null(F.col("file_hash"), F.col(row)))
    return keyed.join(facts.withColumnRenamed("pdf_hash", "_key"), "_key", how).drop("_key")


def update(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    assign: Mapping[str, Column],
    order: Column | None = None,
) -> DataFrame:
    """Set columns of the matched rows. Expressions name ``t`` (old) and ``u`` (change).

    Of several changes of one key the last in ``order`` counts, without one the greatest (see :func:`last_per_key`).
    """
    marked = last_per_key(changes, keys, order).withColumn("_hit", F.lit(True))
    joined = target.alias("t").join(marked.alias("u"), _on("t", "u", keys), "left")
    hit = F.col("u._hit").isNotNull()
    return joined.select(
        *[
            F.when(hit, assign[c]).otherwise(F.col(f"t.{c}")).alias(c)
            if c in assign
            else F.col(f"t.{c}").alias(c)
            for c in target.columns
        ]
    )


def missing_keys(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changes whose key the target does not hold. Reads only the keys of the target."""
    known = target.select(*keys).join(changes.select(*keys), list(keys), "left_semi").distinct()
    return changes.join(known, list(keys), "left_anti").select(*changes.columns)


def merge(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    *,
    on_match: Mapping[str, Column] | None = None,
    on_insert: Mapping[str, Column] | None = None,
    order: Column | None = None,
) -> DataFrame:
    """Insert new keys, update known ones. Of several changes of one key the last in ``order`` counts, without one the greatest.

    ``on_match`` gives the updated columns (none: insert only). ``on_insert`` gives the
    columns the changes lack; others are taken from the changes, else null.
    """
    on_insert = on_insert or {}
    changes = last_per_key(changes, keys, order)
    kept = update(target, changes, keys, on_match) if on_match else target
    new = missing_keys(target, changes, keys)
    inserted = new.select(
        *[
            (
                on_insert[f.name]
                if f.name in on_insert
                else F.col(f.name) if f.name in changes.columns else F.lit(None)
            )
            .cast(f.dataType)
            .alias(f.name)
            for f in target.schema.fields
        ]
    )
    return kept.unionByName(inserted)


def take(*columns: str) -> dict[str, Column]:
    """Assignments that copy columns of the change."""
    return {c: F.col(f"u.{c}") for c in columns}


def delete(target: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    kept = target.join(doomed.select(*keys), list(keys), "left_anti")
    return kept.select(*target.columns)


def set_null(target: DataFrame, doomed: DataFrame, column: str, key: str) -> DataFrame:
    """Clear references to deleted rows."""
    # Written, so that a reference which very many rows share can be split.
    gone = written(doomed.select(F.col(key).alias("_gone")).distinct(), "gone")
    joined = target.join(gone, F.col(column) == F.col("_gone"), "left")
    kept = F.when(F.col("_gone").isNull(), F.col(column))
    return joined.select(*[(kept.alias(c) if c == column else F.col(c)) for c in target.columns])
