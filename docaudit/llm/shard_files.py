"""Files that tasks write in a shared folder, committed by temporary names and a manifest.

A task writes each file under a name nobody else uses and reports it in its output rows. Only rows of
tasks that succeeded are in the written manifest, so only their files get final names; renaming twice is
harmless. What failed or doubled attempts leave is deleted with the temporary folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.shared import written

MANIFEST = "file string, temporary string, records bigint, bytes bigint"


def location(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain absolute path."""
    return fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{folder}")


def temporary_name(folder: str) -> str:
    return f"{folder}/_temporary/{uuid.uuid4().hex}"


def create(path: str):
    system, inner = location(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)


def commit(manifest: DataFrame, folder: str) -> DataFrame:
    """Give the files of the manifest their final names; returns it with ``path`` instead of the temporary name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for r in batch.to_pylist():
                system, old = location(r["temporary"])
                new = location(f"{folder}/{r['file']}")[1]
                if system.get_file_info(old).type == fs.FileType.File:
                    system.move(old, new)
                elif system.get_file_info(new).type != fs.FileType.File:
                    raise FileNotFoundError(f"neither {old} nor {new} is there")
                paths.append(f"{folder}/{r['file']}")
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), pa.array(paths, pa.string()), batch.column("records"), batch.column("bytes")],
                ["file", "path", "records", "bytes"],
            )

    done = written(manifest.mapInArrow(run, "file string, path string, records bigint, bytes bigint"), "manifest")
    done.orderBy("file").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    system, inner = location(f"{folder}/_temporary")
    if system.get_file_info(inner).type == fs.FileType.Directory:
        system.delete_dir(inner)
    return done


def rank(value: Column, starts: list[int]) -> Column:
    """Index of the last of the sorted ``starts`` that is not above the value, found by halving; -1 if all are."""
    known = F.lit(starts).cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(starts).bit_length()))]

    def step(at: Column, size: Column) -> Column:
        return F.when(F.coalesce(F.get(known, at + size) <= value, F.lit(False)), at + size).otherwise(at)

    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(-1), step)


@dataclass(frozen=True)
class Shards:
    """Consecutive ranges of a key. A range that is one key may be ``parts`` shards, told apart by a second value."""

    starts: list[int]
    first: list[int]  # number of each range's first shard
    parts: list[int]
    null_first: int
    null_parts: int

    @property
    def count(self) -> int:
        return self.null_first + self.null_parts

    def of(self, key: Column, second: Column) -> Column:
        """Shard number of a row. Rows that agree in both values share a shard."""
        spread = F.crc32(second.cast("binary"))
        none = F.lit(self.null_first) + F.pmod(spread, F.lit(max(1, self.null_parts)))
        if not self.starts:
            return none.cast("int")
        at = F.greatest(F.lit(0), rank(key, self.starts))
        own = F.get(F.lit(self.first), at) + F.pmod(spread, F.get(F.lit(self.parts), at))
        return F.when(key.isNull(), none).otherwise(own).cast("int")


def cut_shards(df: DataFrame, key: str, weight: Column, shards: int, weight_per_shard: int, ranges: int = 1 << 14) -> Shards:
    """Shards of about equal weight over an integer key, at least ``shards`` of them and none much above ``weight_per_shard``.

    The range of keys is cut in equal parts whose exact weights are summed up; parts that are too heavy are cut again
    between their own smallest and largest key until they fit or are one key. So a few keys far away from all others do not
    make the cut coarse, and the same rows always get the same shards, unlike with sampled bounds. The driver holds a row for
    each part, at most ``ranges`` new ones a pass; a single key that is too heavy is dealt by a second value.
    """
    rows = df.select(F.col(key).cast("bigint").alias("k"), (weight + 1).alias("w"))
    ends = rows.agg(
        F.min("k").alias("lo"), F.max("k").alias("hi"), F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("w"))), F.lit(0)).alias("w"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("w"))), F.lit(0)).alias("none"),
    ).first()
    each = max(1, min(weight_per_shard, -(-(ends["w"] + ends["none"]) // shards)))
    done = [] if ends["lo"] is None else [(ends["lo"], ends["hi"], ends["w"])]
    while heavy := sorted(r for r in done if r[2] > each and r[0] < r[1]):
        parts = max(2, ranges // len(heavy))
        at = rank(F.col("k"), [lo for lo, _, _ in heavy])
        lo, hi = (F.get(F.lit([r[i] for r in heavy]).cast("array<bigint>"), F.col("at")) for i in (0, 1))
        inside = rows.where(F.col("k").isNotNull()).withColumn("at", at).where((F.col("at") >= 0) & (F.col("k") <= hi))
        # Decimals, as the distance of two keys may leave 64 bits.
        wide = [x.cast("decimal(38,0)") for x in (F.col("k"), lo, hi)]
        part = F.floor((wide[0] - wide[1]) * F.lit(parts) / (wide[2] - wide[1] + 1)).cast("int")
        cut = inside.groupBy("at", part.alias("part")).agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum("w").alias("w"))
        done = [r for r in done if r not in set(heavy)] + [(r["lo"], r["hi"], r["w"]) for r in cut.collect()]
    starts, first, parts_of, number, held = [], [], [], 0, each
    for low, high, w in sorted(done):
        if low == high and w > each:
            starts, first, parts_of = [*starts, low], [*first, number], [*parts_of, -(-w // each)]
            number, held = number + parts_of[-1], each
        elif held + w > each:
            starts, first, parts_of = [*starts, low], [*first, number], [*parts_of, 1]
            number, held = number + 1, w
        else:
            held += w
    return Shards(starts, first, parts_of, number, -(-ends["none"] // each))
