"""Vectorised words of many texts at once, for functions that run on Arrow batches.

Spark partitions and shuffles the work; these helpers turn the texts of one batch into arrays
of word positions and hashes. Texts are taken in blocks of a few megabytes, so memory
follows the block size; a longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_STRETCH = 1 << 18
_BASE = U64(0x9E3779B97F4A7C0B)  # odd, and 3 modulo 8, so that powers differ in their low bits
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20_240_501).integers(0, 1 << 64, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word; a bijection on 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, _STRETCH + 1024)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


@dataclass
class WordBlock:
    """Words of several texts: ``start``/``end`` in ``buf``, text number, and texts' word offsets."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text_of: np.ndarray
    offsets: np.ndarray  # of each text's first word; one more entry at the end

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word, the same in every block."""
        out = np.empty(len(self.start), U64)
        at = 0
        while at < len(out):
            # A stretch of words at a time, so that the arrays over its bytes stay in cache.
            base = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, base + _STRETCH, "right")))
            size = int(self.end[to - 1] - base)
            up, down = _power_tables(size + 1)
            total = np.zeros(size + 1, U64)
            np.cumsum(_BYTE[self.buf[base : base + size]] * up[:size], out=total[1:])
            start, end = self.start[at:to] - base, self.end[at:to] - base
            out[at:to] = mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))
            at = to
        return out

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def word_block(texts: list[bytes], lower: bool) -> WordBlock:
    """Words between blanks, with A-Z lower-cased if asked."""
    data = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(data.lower() if lower else data, np.uint8)
    inside = ~_BLANK[buf]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edges[::2], edges[1::2]
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    offsets = np.searchsorted(start, begins)
    text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    return WordBlock(buf, start, end, text_of, offsets)


def blocks(
    batches: Iterable[pa.RecordBatch], text: str, block_bytes: int = 2 << 20
) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Rows with their texts as bytes (null: empty), cut so that a block has about ``block_bytes``."""
    rows: list[pa.RecordBatch] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        others = batch.drop_columns([text])
        begin = 0
        for i, value in enumerate(column):
            value = value.as_py() or b""
            texts.append(value)
            size += len(value)
            if size >= block_bytes:
                rows.append(others.slice(begin, i + 1 - begin))
                yield pa.Table.from_batches(rows), texts
                rows, texts, size, begin = [], [], 0, i + 1
        if begin < len(column):
            rows.append(others.slice(begin))
    if texts:
        yield pa.Table.from_batches(rows), texts


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges one after another."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
