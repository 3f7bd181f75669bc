"""Inventory tables on disk that a change rewrites in part.

A keyed table is a Parquet table in the session's catalog, cut twice by its key: into slices, which are folders, and
within each into buckets, which are files. A change set names the slices of its keys. Only those are read, changed and
written again (dynamic partition overwrite); all other files stay as they are. As the files of a slice are
bucketed by the key, a join by it shuffles the changes at most, never the table.

The operators stay the same pure functions: they get the slices that are touched instead of the whole table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.shared import discard, new_path, written

SLICE = "_slice"


@dataclass(frozen=True)
class KeyedTable:
    """``slices`` bounds how finely changes rewrite; ``buckets`` is the number of files of a slice."""

    spark: SparkSession
    name: str
    path: str
    keys: tuple[str, ...]
    slices: int = 64
    buckets: int = 8

    @classmethod
    def create(
        cls, rows: DataFrame, keys: Sequence[str], path: str | None = None, slices: int = 64, buckets: int = 8
    ) -> KeyedTable:
        """Write ``rows`` as a new table. Null keys are keys like any other."""
        spark = rows.sparkSession
        table = cls(spark, f"keyed_{uuid.uuid4().hex}", path or new_path(spark, "keyed"), tuple(keys), slices, buckets)
        table._register(rows.schema)
        table._store(rows)
        return table

    @classmethod
    def open(
        cls, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], slices: int = 64, buckets: int = 8
    ) -> KeyedTable:
        """A table that another session created, with the numbers it was created with."""
        table = cls(spark, f"keyed_{uuid.uuid4().hex}", path, tuple(keys), slices, buckets)
        table._register(schema)
        spark.catalog.recoverPartitions(table.name)
        return table

    def _register(self, schema: T.StructType) -> None:
        keys = ", ".join(f"`{k}`" for k in self.keys)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self.spark.sql(
            f"CREATE TABLE {self.name} ({fields}, {SLICE} INT) USING parquet OPTIONS (path '{self.path}') "
            f"PARTITIONED BY ({SLICE}) CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS"
        )

    def slice_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.slices)).cast("int")

    def _store(self, rows: DataFrame) -> None:
        """Replace the slices that ``rows`` have; one file for each slice and bucket."""
        cut = rows.withColumn(SLICE, self.slice_of())
        cut = cut.repartition(self.buckets, *self.keys).sortWithinPartitions(SLICE, *self.keys)
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            cut.write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
        self.spark.catalog.refreshTable(self.name)

    def read(self, slices: Sequence[int] | None = None) -> DataFrame:
        """The rows of some slices, or of all of them."""
        table = self.spark.table(self.name)
        return (table if slices is None else table.where(F.col(SLICE).isin(list(slices)))).drop(SLICE)

    def touched(self, changes: DataFrame) -> list[int]:
        """The slices that hold the keys of ``changes``; one number for each, so never more than there are slices.

        Changes that do not carry the table's key but other columns of it, say an id, are looked up by a scan of the
        columns both have.
        """
        if set(self.keys) <= set(changes.columns):
            found = changes.select(self.slice_of().alias(SLICE))
        else:
            table = self.spark.table(self.name)
            shared = [c for c in changes.columns if c in table.columns]
            found = table.join(changes.select(*shared).distinct(), shared, "left_semi").select(SLICE)
        return sorted(r[0] for r in found.distinct().collect())

    def change(self, changes: DataFrame, step: Callable[[DataFrame], DataFrame], by: Sequence[str] | None = None) -> list[int]:
        """Rewrite the slices that ``changes`` touch with what ``step`` makes of their rows; returns them.

        ``by`` names the columns that lead from a change to its rows where that is not the table's key. ``step`` must
        leave rows in their slice, as all merges by the key do. What it returns is written aside first, so
        a job that fails on the way has either changed nothing or can be run again from its changes.
        """
        slices = self.touched(changes.select(*by) if by else changes)
        if not slices:
            return []
        result = written(step(self.read(slices)), "slices")
        left = {r[0] for r in result.select(self.slice_of().alias(SLICE)).distinct().collect()}
        if not left <= set(slices):
            raise ValueError("a change moved rows to slices that it does not touch")
        self._store(result.select(*self.read([]).columns))
        # Dynamic overwrite leaves slices alone that have no row any more.
        for gone in set(slices) - left:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({SLICE} = {gone})")
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{SLICE}={gone}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.spark.catalog.refreshTable(self.name)
        discard(result)
        return slices
