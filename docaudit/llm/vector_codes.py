"""Vector code compression: k-means codebooks over the parts of integer vectors.

Every part of a vector is coded by the nearest entry of its codebook. A round assigns all parts and moves each entry
to the floored mean of its parts. Three things are kept for each part between rounds: its code, a lower bound of the
distance to every other entry, and the round in which that bound was measured (its stamp). All codebooks of the rounds
before are kept as well. So the bound of round s holds in round t after taking off how far an entry really moved
between the two, the norm of the sum of its steps, which is never more and mostly less than the sum of their norms.
Only where the distance to the own entry is not below that, all entries are compared again.

A round reads one written table and writes the next, without a shuffle; a task adds one row of sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.shared import discard, written

_STATE = np.dtype([("code", "u1"), ("stamp", "u1"), ("low", "<f4")])
_LATER = 1 - 1e-9  # room for rounding; a comparison too many changes nothing


@dataclass(frozen=True)
class CodeSettings:
    """``parts`` codebooks of ``entries`` each, moved in ``rounds`` rounds; components become floor(scale * x)."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096

    def __post_init__(self):
        if self.parts < 1 or not 1 <= self.entries <= 256 or not 0 <= self.rounds <= 255:
            raise ValueError("need parts >= 1, 1 <= entries <= 256, 0 <= rounds <= 255")


def finite(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def drift(history: np.ndarray) -> np.ndarray:
    """[stamp, part, own]: how far the entries other than ``own`` moved at most from the stamp's round to the last."""
    moved = np.sqrt(((history[-1] - history).astype(np.float64) ** 2).sum(-1))
    most = np.zeros_like(moved)
    for own in range(moved.shape[-1]):
        others = np.delete(moved, own, axis=-1)
        if others.shape[-1]:
            most[..., own] = others.max(-1)
    return most


def assign(v: np.ndarray, state: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, int]:
    """Squared distance of each part to its nearest entry (ties: lower index); updates the state in place.

    ``v`` is [row, part, position], ``state`` [row, part], ``history`` [round, part, entry, position]. Returns how many
    parts were compared with all entries, too.
    """
    book, now = history[-1], len(history) - 1
    part = np.arange(v.shape[1])[None, :]
    own = ((v - book[part, state["code"]]) ** 2).sum(-1)
    bound = state["low"].astype(np.float64) - drift(history)[state["stamp"], part, state["code"]]
    row, col = np.nonzero(~(np.sqrt(own.astype(np.float64)) < bound * _LATER))
    for at in range(0, len(row), 8192):
        r, c = row[at : at + 8192], col[at : at + 8192]
        every = ((v[r, c][:, None, :] - book[c]) ** 2).sum(-1)
        code = every.argmin(1)
        own[r, c] = every[np.arange(len(r)), code]
        every[np.arange(len(r)), code] = np.iinfo(np.int64).max
        low = np.nextafter(np.sqrt(every.min(1).astype(np.float64)).astype(np.float32), np.float32(0))
        state["code"][r, c], state["stamp"][r, c], state["low"][r, c] = code, now, low
    return own, len(row)


def _sums(v: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """[part, entry, position and count]."""
    out = np.zeros((v.shape[1], entries, v.shape[2] + 1), np.int64)
    for p in range(v.shape[1]):
        np.add.at(out[p, :, :-1], code[:, p], v[:, p])
        out[p, :, -1] = np.bincount(code[:, p], minlength=entries)
    return out


def _fixed(column: pa.Array, dtype) -> np.ndarray:
    """Binary values of equal length as rows of an array, which may be written to."""
    raw = b"".join(x.as_py() for x in column)
    return np.frombuffer(raw, dtype).reshape(len(column), -1).copy()


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    each = rows.itemsize * rows.shape[1]
    offsets = pa.array((np.arange(len(rows) + 1) * each).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, offsets.buffers()[1], pa.py_buffer(rows.tobytes())])


def _integers(vectors: pa.Array, dims: int, s: CodeSettings) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = np.floor(x * s.scale)
    # Beyond this, squared distances would leave 64 bits; it is far above any unit vector.
    if len(x) and np.abs(x).max() >= min(2**31, np.sqrt(2.0**61 / dims)):
        raise ValueError("a component is too large for exact distances in 64 bits")
    return x.astype(np.int64).reshape(len(x), s.parts, dims // s.parts)


def _round(table: DataFrame, history: np.ndarray, dims: int, s: CodeSettings, first: bool) -> DataFrame:
    """(_id, _label, v, state, sums) after one more assignment."""
    sent = table.sparkSession.sparkContext.broadcast(history)  # entries x dims numbers a round
    id_type, label_type = (table.schema[c].dataType.simpleString() for c in ("_id", "_label"))
    width = dims // s.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        entries = books.shape[2]
        total = np.zeros((s.parts, entries, width + 1), np.int64)
        kinds = None
        for batch in batches:
            kinds = batch.schema
            n = batch.num_rows
            if first:
                v = _integers(batch.column("v"), dims, s)
                state = np.zeros((n, s.parts), _STATE)  # a bound of 0 asks for a comparison
            else:
                v = _fixed(batch.column("v"), "<i4").astype(np.int64).reshape(n, s.parts, width)
                state = _fixed(batch.column("state"), _STATE)
            assign(v, state, books)
            total += _sums(v, state["code"], entries)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_label"), _binary(v.reshape(n, dims).astype("<i4")), _binary(state),
                 pa.nulls(n, pa.list_(pa.int64()))],
                ["_id", "_label", "v", "state", "sums"],
            )
        if kinds is not None:
            one = [pa.nulls(1, kinds.field(c).type) for c in ("_id", "_label")]
            sums = pa.array([total.ravel()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*one, pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), sums], ["_id", "_label", "v", "state", "sums"]
            )

    return table.mapInArrow(run, f"_id {id_type}, _label {label_type}, v binary, state binary, sums array<bigint>")


def _moved(table: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks after moving every used entry to the floored mean of its parts."""
    rows = table.where("sums is not null").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    sums = np.zeros((*book.shape[:2], book.shape[2] + 1), np.int64)
    for at, x in rows.collect():  # entries x (dims + parts) numbers
        sums.flat[at] = x
    count = sums[..., -1:]
    return np.where(count > 0, sums[..., :-1] // np.maximum(count, 1), book)


def _coded(table: DataFrame, history: np.ndarray, dims: int, s: CodeSettings, first: bool) -> DataFrame:
    """(_id, _label, code, error) by the last codebooks."""
    sent = table.sparkSession.sparkContext.broadcast(history)
    id_type, label_type = (table.schema[c].dataType.simpleString() for c in ("_id", "_label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if first:
                v, state = _integers(batch.column("v"), dims, s), np.zeros((n, s.parts), _STATE)
            else:
                v = _fixed(batch.column("v"), "<i4").astype(np.int64).reshape(n, s.parts, dims // s.parts)
                state = _fixed(batch.column("state"), _STATE)
            error, _ = assign(v, state, sent.value)
            codes = np.ascontiguousarray(state["code"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_label"), pa.array([x.tobytes().hex() for x in codes], pa.string()), pa.array(error.sum(1))],
                ["_id", "_label", "code", "error"],
            )

    return table.mapInArrow(run, f"_id {id_type}, _label {label_type}, code string, error bigint")


@dataclass
class Compressed:
    """``codes``: id, code, error, label_error, codebooks_sha256 by row. ``codebooks``: [part, entry, position]."""

    codes: DataFrame
    codebooks: np.ndarray


def compress_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    settings: CodeSettings = CodeSettings(),
) -> Compressed:
    """Codes and errors of all vectors, and the codebooks they refer to.

    Codebooks start with the vectors of the smallest ids (null ids last, equal ids by components), fewer than ``entries``
    if there are fewer. Equal vectors may fill several entries; the lowest is used. Rows are dropped if their vector is
    null, empty, or has a null or non-finite component, or another length than the vector with the smallest id. That
    length must be a multiple of ``parts``. Components must be below about 2^20 / scale in size by far; one that
    would take squared distances out of 64 bits is an error. Null ids and labels, and rows that repeat, are coded like
    any other. An empty table gives an empty result. Other columns are not read.
    """
    s = settings
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("v")).where(finite(F.col("v")))
    starts = [r["v"] for r in rows.select("_id", "v").orderBy(F.asc_nulls_last("_id"), "v").limit(s.entries).collect()]
    dims = len(starts[0]) if starts else s.parts
    if dims % s.parts:
        raise ValueError(f"{dims} components cannot be cut into {s.parts} equal parts")
    rows = rows.where(F.size("v") == dims)
    # Those of another length are dropped, and the next ids take their place.
    if any(len(x) != dims for x in starts):
        starts = [r["v"] for r in rows.select("_id", "v").orderBy(F.asc_nulls_last("_id"), "v").limit(s.entries).collect()]
    first = _integers(pa.array(starts, pa.list_(pa.float64())), dims, s) if starts else np.zeros((1, s.parts, 1), np.int64)
    history = first.transpose(1, 0, 2)[None]
    table, before = rows, None
    for i in range(s.rounds if starts else 0):
        step = _round(table.where("v is not null"), history, dims, s, first=i == 0)
        table = written(step, "codes")
        if before is not None:
            discard(before)
        before = table
        history = np.concatenate([history, _moved(table, history[-1])[None]])
    coded = written(_coded(table.where("v is not null"), history, dims, s, first=before is None), "coded")
    if before is not None:
        discard(before)
    by_label = written(coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error")), "labels")
    numbers = ",".join(str(x) for x in history[-1].ravel())
    codes = coded.join(by_label, F.col("_label").eqNullSafe(F.col("_of")), "left").select(
        F.col("_id").alias(id_col), "code", "error", "label_error",
        F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"),
    )
    return Compressed(codes, history[-1])
