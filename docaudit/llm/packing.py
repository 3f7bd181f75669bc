"""Vector bin packing of token sequences under several limits at once.

A piece of a document takes up tokens, one segment, and loss-bearing tokens. A sequence is filled by the
dot-product rule: of all pieces that fit, the one with the largest dot product of its
demand and what the sequence has left, both in parts of the limits. When none fits, the best one
is cut to the room that is left, so that little of a sequence is padding.

Each task packs the documents it reads, in groups of bounded size, and a lost task is packed again with the same result.
Only the last sequence of a group may stay short. These tails are packed once more, whole, again in groups of bounded size and by
the same rule; what is shuffled for that is one narrow row per tail and the pieces of the tails.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.arrays import blocks
from docaudit.llm.tokens import WordTokenizer, tokenizer_path
from docaudit.shared import written


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold; ``least_piece``: no shorter piece is cut off to fill a gap."""

    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048
    least_piece: int = 16

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss_tokens, self.least_piece) < 1:
            raise ValueError("limits must be positive")


def _loss(start: np.ndarray, end: np.ndarray, loss_from: np.ndarray) -> np.ndarray:
    return np.maximum(0, end - np.maximum(start, loss_from))


def pack(lengths: np.ndarray, loss_from: np.ndarray, limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that together hold each token once.

    ``loss_from``: a document's first loss-bearing token; those before it (a prompt) bear none.
    """
    done: list[list[tuple[int, int, int]]] = []
    start = np.zeros(len(lengths), np.int64)
    # What is longer than a sequence fills whole ones first.
    for i in np.flatnonzero(lengths >= limits.tokens):
        while lengths[i] - start[i] >= limits.tokens:
            size = _most(start[i], limits.tokens, loss_from[i], limits.loss_tokens)
            if size < limits.tokens:
                break
            done.append([(int(i), int(start[i]), limits.tokens)])
            start[i] += limits.tokens
    doc = np.flatnonzero(lengths > start)
    while len(doc):
        left = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.int64)
        bounds = left.astype(float)
        open_: list[tuple[int, int, int]] = []
        while len(doc) and left[0] and left[1]:
            size = lengths[doc] - start[doc]
            loss = _loss(start[doc], lengths[doc], loss_from[doc])
            share = left / bounds**2
            score = size * share[0] + share[1] + loss * share[2]
            fits = (size <= left[0]) & (loss <= left[2])
            if fits.any():
                best = int(np.argmax(np.where(fits, score, -1.0)))
                take = int(size[best])
            else:
                best = int(np.argmax(score))
                take = _most(start[doc[best]], int(left[0]), loss_from[doc[best]], int(left[2]))
                if take < (limits.least_piece if open_ else 1):
                    break
            i = int(doc[best])
            s = int(start[i])
            open_.append((i, s, take))
            left -= [take, 1, int(_loss(s, s + take, loss_from[i]))]
            start[i] += take
            if start[i] == lengths[i]:
                doc = np.delete(doc, best)
        done.append(open_)
    return done


def merge_tails(demand: np.ndarray, limits: Limits) -> list[list[int]]:
    """Bins of tails (rows of tokens, segments, loss tokens) that fit together, none of them cut."""
    bounds = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    rest = np.argsort(-demand[:, 0], kind="stable")
    bins: list[list[int]] = []
    while len(rest):
        inside, left, rest = [int(rest[0])], bounds - demand[rest[0]], rest[1:]
        while len(rest):
            score = np.where((demand[rest] <= left).all(1), demand[rest] @ (left / bounds**2), -1.0)
            best = int(np.argmax(score))
            if score[best] < 0:
                break
            inside.append(int(rest[best]))
            left = left - demand[rest[best]]
            rest = np.delete(rest, best)
        bins.append(inside)
    return bins


def _repacked(pieces: DataFrame, limits: Limits, group_tails: int) -> DataFrame:
    """The pieces with their short sequences put together. ``pieces`` is a written table with a column ``short``."""
    short = pieces.where("short")
    tails = short.groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"), F.count("*").alias("segments"), F.sum("loss_tokens").alias("loss")
    )
    tails = written(tails, "tails")
    parts = -(-tails.count() // group_tails)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("sequence_id")
        ids = group["sequence_id"].to_numpy()
        demand = np.stack([group[c].to_numpy() for c in ("tokens", "segments", "loss")], 1)
        to, begin = ids.copy(), np.zeros(len(ids), np.int64)
        for inside in merge_tails(demand, limits):
            to[inside] = ids[inside[0]]
            begin[inside] = np.cumsum(demand[inside, 0]) - demand[inside, 0]
        return pa.table({"tail": ids, "to": to, "begin": begin})

    group = F.pmod(F.xxhash64("sequence_id"), F.lit(max(1, parts))).alias("part")
    moves = tails.groupBy(group).applyInArrow(run, "tail bigint, to bigint, begin bigint")
    moved = short.join(written(moves, "moves"), F.col("sequence_id") == F.col("tail"))
    moved = moved.withColumns({"sequence_id": F.col("to"), "offset": F.col("offset") + F.col("begin")})
    return pieces.where("not short").unionByName(moved.select(*pieces.columns)).drop("short")


def _most(start: int, room: int, loss_from: int, loss_room: int) -> int:
    """Longest piece from ``start`` within both limits."""
    return int(min(room, max(0, int(loss_from) - int(start)) + loss_room))


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    tokenizer: str | None = None,
    end_id: int = 1,
    limits: Limits = Limits(),
    group_docs: int = 4096,
    group_bytes: int = 8 << 20,
    with_ids: bool = False,
    group_tails: int = 4096,
) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens
    and, if ``with_ids``, the ids as little-endian unsigned 32-bit numbers.

    ``prompt_col``: number of leading tokens that bear no loss (null: none). ``tokenizer``: a file, by
    default the public word BPE. A group has at most ``group_docs`` documents and about ``group_bytes``
    of text, or one longer document. Its last sequence may stay short; about ``group_tails`` of these are put together at a time.

    Null and empty texts are the end id alone. Rows that repeat, or have a null id, are packed
    like any other. An empty table gives an empty result. Other columns are not read.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    source = docs.select(id_col, text_col, *([prompt_col] if prompt_col else [])).toDF(
        "_id", "_text", *(["_prompt"] if prompt_col else [])
    )
    id_type = source.schema["_id"].dataType.simpleString()
    out = (
        f"_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint, loss_tokens bigint, short boolean" + (", ids binary" if with_ids else "")
    )

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        encoder = WordTokenizer(path)
        for rows, texts in blocks(batches, "_text", group_bytes):
            for at in range(0, len(texts), group_docs):
                part = slice(at, at + group_docs)
                yield rows.slice(at, group_docs), *encoder.encode(texts[part], end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for rows, ids, offsets in groups(batches):
            lengths = np.diff(offsets)
            prompt = (
                np.asarray(rows["_prompt"].fill_null(0).to_numpy(), np.int64) if prompt_col
                else np.zeros(len(lengths), np.int64)
            )
            ids = ids.astype("<u4")
            picked: list[tuple] = []
            for sequence in pack(lengths, prompt, limits):
                offset = 0
                borne = sum(int(_loss(s, s + n, prompt[i])) for i, s, n in sequence)
                short = (
                    sum(n for _, _, n in sequence) < limits.tokens
                    and len(sequence) < limits.segments and borne < limits.loss_tokens
                )
                for i, start, size in sequence:
                    piece = ids[offsets[i] + start : offsets[i] + start + size].tobytes()
                    loss = int(_loss(start, start + size, prompt[i]))
                    picked.append((i, start, size, zlib.crc32(piece), int(lengths[i]), number, offset, loss, short, piece))
                    offset += size
                number += 1
            columns = list(zip(*picked, strict=True))
            arrays = [rows["_id"].combine_chunks().take(pa.array(columns[0], pa.int64()))]
            arrays += [pa.array(c, pa.int64()) for c in columns[1:8]] + [pa.array(columns[8], pa.bool_())]
            names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "short"]
            if with_ids:
                arrays.append(pa.array(columns[9], pa.binary()))
                names.append("ids")
            yield from pa.table(arrays, names).to_batches()

    pieces = written(source.mapInArrow(run, out), "pieces")
    return _repacked(pieces, limits, group_tails).withColumnRenamed("_id", id_col)
