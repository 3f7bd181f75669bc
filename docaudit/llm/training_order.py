"""Training-order materialisation of token ids in fixed-stride binary shards.

Texts become sequences of a fixed number of ids. A keyed Feistel network permutes the sequence numbers: it is a
bijection on a power of four, and cycle-walking brings results beyond the last sequence back into range.
So every sequence has a slot of its own in the training order without any shuffle table. Slots are cut into shards
by range, and each is written in order with a fixed stride, so a reader finds slot n by one
multiplication and can resume anywhere.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.arrays import blocks, mix, ranges
from docaudit.llm.shard_files import MANIFEST, commit, create, location, temporary_name
from docaudit.llm.tokens import WordTokenizer, tokenizer_path
from docaudit.shared import new_path, written


@dataclass(frozen=True)
class OrderSettings:
    """``shard_slots``: most slots in a shard; a small table still gets about ``least_shards`` shards. ``id_bytes``: 2, or 4
    for tokenizers with more than 65,536 ids. ``group``: sequences that are compressed together until they have a slot."""

    sequence: int = 1024
    key: int = 20_240_917
    rounds: int = 6
    shard_slots: int = 1 << 16
    least_shards: int = 64
    end_id: int = 1
    pad_id: int = 0
    block_bytes: int = 4 << 20
    id_bytes: int = 2
    group: int = 16

    def __post_init__(self):
        if self.id_bytes not in (2, 4):
            raise ValueError("ids have 2 or 4 bytes")

    @property
    def id_type(self) -> str:
        return f"<u{self.id_bytes}"


def permuted(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Where the keyed permutation of 0 .. n-1 puts each index."""
    half = np.uint64(max(1, -(-(max(1, n - 1)).bit_length() // 2)))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.uint64(key) + np.arange(rounds, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        return (left << half) | right

    out = network(index.astype(np.uint64))
    while (beyond := out >= np.uint64(n)).any():
        out[beyond] = network(out[beyond])
    return out.astype(np.int64)


def _squeezed(rows: np.ndarray, group: int = 1) -> list[bytes]:
    """Rows of ids, ``group`` at a time, compressed."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    return [squeeze(rows[i : i + group].tobytes()) for i in range(0, len(rows), group)]


def _sequences(docs: DataFrame, id_col: str, text_col: str, path: str, s: OrderSettings) -> DataFrame:
    """(task, number, doc_ids, n_tokens, ids): texts of a block one after another, cut into sequences; the last one of a
    block is padded. A row is a group of consecutive sequences, with the number of the first, and their ids compressed."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, number = WordTokenizer(path), TaskContext.get().partitionId(), 0
        for rows, texts in blocks(batches, "_text", s.block_bytes):
            ids, offsets = encoder.encode(texts, s.end_id)
            if len(ids) and ids.max() >= 1 << 8 * s.id_bytes:
                raise ValueError(f"ids do not fit in {s.id_bytes} bytes")
            n = -(-len(ids) // s.sequence)
            full = np.full(n * s.sequence, s.pad_id, s.id_type)
            full[: len(ids)] = ids
            begin = np.arange(n) * s.sequence
            used = np.minimum(s.sequence, len(ids) - begin)
            first = np.searchsorted(offsets, begin, "right") - 1
            last = np.searchsorted(offsets, begin + used, "left") - 1
            who = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)] or [np.zeros(0, int)])
            ends = np.concatenate([[0], np.cumsum(last - first + 1)]).astype(np.int32)
            by_sequence = pa.ListArray.from_arrays(pa.array(ends), rows["_id"].combine_chunks().take(pa.array(who)))
            begins = np.arange(0, n, s.group)
            groups = pa.array(np.append(begins, n).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(begins), task, np.int32)), pa.array(number + begins),
                    pa.ListArray.from_arrays(groups, by_sequence), pa.ListArray.from_arrays(groups, pa.array(used)),
                    pa.array(_squeezed(full.reshape(n, s.sequence), s.group), pa.binary()),
                ],
                ["task", "number", "doc_ids", "n_tokens", "ids"],
            )
            number += n

    return source.mapInArrow(run, f"task int, number bigint, doc_ids array<array<{id_type}>>, n_tokens array<bigint>, ids binary")


def materialise(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    settings: OrderSettings = OrderSettings(),
) -> tuple[DataFrame, DataFrame]:
    """Write all texts as shards below ``folder``; returns the slots and the manifest.

    Slots: slot, shard, byte_offset, n_tokens, ids_crc32 (of the stored bytes), doc_ids (in reading order).

    Null and empty texts are the end id alone. Null ids and rows that repeat are written like any other.
    An empty table writes nothing. Other columns are not read. The sequences are numbered by scan task and place in it
    before they are permuted, so the same files give the same order, and other files or scan settings another one.
    """
    s, spark = settings, docs.sparkSession
    made = new_path(spark, "sequences")
    made_rows = _sequences(docs, id_col, text_col, tokenizer or tokenizer_path("word_bpe_49k.json"), s)
    made_rows.write.option("compression", "uncompressed").parquet(made)
    sequences = spark.read.parquet(made)
    per_task = sequences.groupBy("task").agg(F.sum(F.size("n_tokens")).alias("n")).orderBy("task").collect()  # a row per scan task
    n = sum(r["n"] for r in per_task)
    begins = itertools.accumulate((r["n"] for r in per_task), initial=0)
    sent = spark.sparkContext.broadcast({r["task"]: b for r, b in zip(per_task, begins)})  # a number per scan task
    per_shard = max(1, min(s.shard_slots, -(-n // s.least_shards)))
    stride = s.sequence * s.id_bytes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = np.array([sent.value[t] for t in batch.column("task").to_pylist()], np.int64)
            used = batch.column("n_tokens")
            count = used.value_lengths().to_numpy()
            number = ranges(begin + batch.column("number").to_numpy(), count)
            slot = permuted(number, n, s.key, s.rounds)
            rows: list[bytes] = []
            for group in batch.column("ids"):
                ids = np.frombuffer(zstandard.decompress(group.as_py()), s.id_type)
                rows += _squeezed(ids.reshape(-1, s.sequence))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(slot), pa.array((slot // per_shard).astype(np.int32)), used.flatten(),
                    batch.column("doc_ids").flatten(), pa.array(rows, pa.binary()),
                ],
                ["slot", "shard", "n_tokens", "doc_ids", "ids"],
            )

    id_list = sequences.schema["doc_ids"].dataType.elementType.simpleString()
    placed = sequences.mapInArrow(place, f"slot bigint, shard int, n_tokens bigint, doc_ids {id_list}, ids binary")
    shards = max(1, -(-n // per_shard))
    ordered = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")  # one shard a task
    kinds = f"slot bigint, shard int, byte_offset bigint, n_tokens bigint, ids_crc32 bigint, doc_ids {id_list}, {MANIFEST}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, count, temporary = None, None, 0, ""

        def finished() -> pa.RecordBatch:
            out.close()
            row = {"file": f"shard-{shard:06d}.bin", "temporary": temporary, "records": count, "bytes": count * stride}
            return pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        def whole(part: pa.RecordBatch, names: list[str], n_rows: int, id_kind: pa.DataType) -> pa.RecordBatch:
            types = {
                "slot": pa.int64(), "shard": pa.int32(), "byte_offset": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64(),
                "doc_ids": id_kind, "file": pa.string(), "temporary": pa.string(), "records": pa.int64(), "bytes": pa.int64(),
            }
            return pa.RecordBatch.from_arrays(
                [part.column(c) if c in names else pa.nulls(n_rows, t) for c, t in types.items()], list(types)
            )

        for batch in batches:
            kind = batch.schema.field("doc_ids").type
            slot, where = batch.column("slot").to_numpy(), batch.column("shard").to_numpy()
            crc = np.zeros(len(slot), np.int64)
            for i, data in enumerate(batch.column("ids")):
                if where[i] != shard:
                    if out is not None:
                        yield whole(finished(), ["file", "temporary", "records", "bytes"], 1, kind)
                    shard, count, temporary = int(where[i]), 0, temporary_name(folder)
                    out = create(temporary)
                data = zstandard.decompress(data.as_py())
                if slot[i] != shard * per_shard + count:
                    raise ValueError(f"slot {slot[i]} is out of order")
                out.write(data)
                crc[i] = zlib.crc32(data)
                count += 1
            told = pa.RecordBatch.from_arrays(
                [batch.column("slot"), batch.column("shard"), pa.array(slot % per_shard * stride), batch.column("n_tokens"), pa.array(crc), batch.column("doc_ids")],
                ["slot", "shard", "byte_offset", "n_tokens", "ids_crc32", "doc_ids"],
            )
            yield whole(told, told.schema.names, told.num_rows, kind)
        if out is not None:
            yield whole(finished(), ["file", "temporary", "records", "bytes"], 1, kind)

    # One partition may hold several shards: each is written whole before the next, as slots are sorted.
    report = written(ordered.mapInArrow(write, kinds), "slots")
    manifest = commit(report.where("file is not null").select("file", "temporary", "records", "bytes"), folder)
    slots = report.where("slot is not null").drop("file", "temporary", "records", "bytes")
    return slots, manifest


def read_slots(
    folder: str, first: int, count: int, per_shard: int, sequence: int = 1024, id_bytes: int = 2
) -> np.ndarray:
    """Sequences ``first`` .. ``first + count - 1`` of the training order, read from their place."""
    stride, rows, kind = sequence * id_bytes, [], f"<u{id_bytes}"
    while count > 0:
        shard, at = divmod(first, per_shard)
        system, path = location(f"{folder}/shard-{shard:06d}.bin")
        take = min(count, per_shard - at)
        with system.open_input_file(path) as f:
            f.seek(at * stride)
            data = f.read(take * stride)
        rows.append(np.frombuffer(data, kind).reshape(-1, sequence))
        if len(data) < take * stride:
            break
        first, count = first + take, count - take
    return np.concatenate(rows) if rows else np.zeros((0, sequence), kind)


def training_order(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Slots of all documents, after the shards are written to the shared folder."""
    slots, _ = materialise(docs, new_path(spark, "training-order"))
    return slots
