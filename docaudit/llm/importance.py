"""Importance resampling towards a target distribution, with hashed word features.

1. Distinct words are counted over both tables. Those with at least one in ``dictionary`` of all tokens (so at
   most ``dictionary`` words) become an Aho-Corasick automaton. Its keys are the words between two
   delimiters; each carries its CRC-32 and length as payload.
2. A scan turns delimiters into blanks and lets the automaton emit payloads in text order. What lies between two
   matches without being one is a rarer word and gets its payload by hashing it.
3. Payloads of adjacent words are composed: the CRC of "a b" follows from those of its parts and their lengths, so a
   run of words is hashed without its text. CRC modulo ``buckets`` is the bucket.
4. One scan counts buckets in both tables, a second one sums the buckets' gains by document. The highest sums, each
   with Gumbel noise from the document's id, are drawn: a sample without replacement by importance weight.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.arrays import blocks
from docaudit.operators.ordering import number_rows
from docaudit.shared import written

_ALNUM = b"0123456789abcdefghijklmnopqrstuvwxyz"
# Lower-case A-Z, keep digits, letters and all bytes beyond ASCII; the rest are delimiters.
_PLAIN = bytes(b if b in _ALNUM or b > 0x7F else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_STRETCH = 1 << 20


@dataclass(frozen=True)
class ResampleSettings:
    """Features are runs of 1 to ``longest`` words. Of the documents with ``least_words``, ``percent`` % are drawn.

    ``dictionary``: most words in the automaton; ``word_bytes``: longest word in it. Both change the speed only.
    """

    longest: int = 1
    buckets: int = 10_000
    seed: int = 2024
    percent: int = 10
    least_words: int = 20
    dictionary: int = 1 << 18
    word_bytes: int = 48
    block_bytes: int = 2 << 20

    def __post_init__(self):
        if self.longest < 1 or self.buckets < 1 or not 0 <= self.percent <= 100:
            raise ValueError("need longest >= 1, buckets >= 1, 0 <= percent <= 100")


def _doubled(op: np.ndarray) -> np.ndarray:
    return _applied(op, op)


def _applied(op: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map on CRC registers, given as the images of each byte at each place."""
    out = op[0, crc & np.uint32(0xFF)]
    for place in range(1, 4):
        out = out ^ op[place, (crc >> np.uint32(8 * place)) & np.uint32(0xFF)]
    return out


def _zero_byte() -> np.ndarray:
    """The map that appends one zero byte, from the polynomial."""
    x = (np.arange(256, dtype=np.uint64)[None, :] << (8 * np.arange(4, dtype=np.uint64))[:, None]).astype(np.uint32)
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ np.where(x & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return x


_SHIFTS = [_zero_byte()]
while len(_SHIFTS) < 31:  # 2**k bytes each, enough for any text of Spark
    _SHIFTS.append(_doubled(_SHIFTS[-1]))


def composed(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of strings put together, from the CRCs of both parts and the byte lengths of the right ones."""
    out, bits = left.astype(np.uint32), length.astype(np.int64)
    for k in range(int(bits.max()).bit_length() if len(bits) else 0):
        out = np.where((bits >> k) & 1, _applied(_SHIFTS[k], out), out)
    return out ^ right


class Scanner:
    """Words of texts as payloads: CRC-32, length and number of the text."""

    def __init__(self, words: list[bytes]):
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.length = np.array([len(w) for w in words], np.int64)
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(words):
            self.found.add_word(f" {w.decode('latin-1')} ", i)  # a character for each byte
        if words:
            self.found.make_automaton()

    def _matches(self, part: bytes) -> np.ndarray:
        if not len(self.crc):
            return np.zeros((0, 2), np.int64)
        hits = self.found.iter(part.decode("latin-1"))
        return np.fromiter(chain.from_iterable(hits), np.int64).reshape(-1, 2)

    def _payloads(self, part: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, crc, length) of the words of a part that begins and ends with a delimiter."""
        found = self._matches(part)
        crc, length = self.crc[found[:, 1]], self.length[found[:, 1]]
        start = found[:, 0] - length
        left = np.concatenate([[0], found[:, 0]])
        right = np.concatenate([start - 1, [len(part) - 1]])
        rare = [
            (m.start(), zlib.crc32(m[0]), m.end() - m.start())
            for g in np.flatnonzero(right - left >= 2)
            for m in _WORD.finditer(part, int(left[g]), int(right[g]))
        ]
        if rare:
            at, c, n = zip(*rare, strict=True)
            start = np.concatenate([start, at])
            order = np.argsort(start, kind="stable")
            start = start[order]
            crc = np.concatenate([crc, np.array(c, np.uint32)])[order]
            length = np.concatenate([length, n])[order]
        return start, crc, length

    def scan(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(crc, length, text) of all words in order, in stretches of about a megabyte; every text is read whole."""
        data = b" " + b" ".join(texts).translate(_PLAIN) + b" "
        begins = np.zeros(len(texts), np.int64)
        np.cumsum([len(t) + 1 for t in texts[:-1]], out=begins[1:])
        at = 0
        while at < len(data) - 1:
            to = data.rfind(b" ", at + 1, at + _STRETCH)
            to = data.find(b" ", at + 1) if to < 0 else to
            start, crc, length = self._payloads(data[at : to + 1])
            yield crc, length, np.searchsorted(begins, start + at - 1, "right") - 1
            at = to


def buckets_of(
    scanner: Scanner, texts: list[bytes], longest: int, buckets: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, text, words) of every run of 1 to ``longest`` adjacent words of one text."""
    blank = np.uint32(zlib.crc32(b" "))
    crc0, length0, text0 = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for crc, length, text in scanner.scan(texts):
        carried = len(crc0)  # the last words of the stretch before, which runs may start with
        crc, length, text = (np.concatenate(x) for x in ((crc0, crc), (length0, length), (text0, text)))
        keep = longest - 1
        crc0, length0, text0 = (x[len(x) - min(keep, len(x)) :] for x in (crc, length, text))
        value = crc
        for n in range(1, longest + 1):
            if n > 1:
                tail = composed(np.full(len(crc) - n + 1, blank), crc[n - 1 :], length[n - 1 :])
                value = composed(value[:-1], tail, length[n - 1 :] + 1)
            new = np.arange(len(value)) + n - 1 >= carried
            new &= text[: len(value)] == text[n - 1 :]
            yield (value[new] % np.uint32(buckets)).astype(np.int64), text[n - 1 :][new], np.full(int(new.sum()), n)
            if len(value) < 2:
                break


def frequent_words(texts: DataFrame, s: ResampleSettings) -> list[bytes]:
    """Words of the one column of ``texts`` that make up at least one in ``dictionary`` of all tokens.

    So there are ``dictionary`` of them at most, however large the table is.
    """
    column = texts.columns[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for _, part in blocks(batches, column, s.block_bytes):
            for text in part:
                seen.update(text.translate(_PLAIN).split())
            if len(seen) > 200_000:
                yield told()
                seen.clear()
        if seen:
            yield told()

    # Long words are counted for the total but stay out of the list.
    word = F.when(F.octet_length("word") <= s.word_bytes, F.col("word"))
    counts = texts.mapInArrow(count, "word binary, n bigint").groupBy(word.alias("word")).agg(F.sum("n").alias("n"))
    counts = written(counts, "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("word").isNotNull() & (F.col("n") * F.lit(s.dictionary) >= total))
    return sorted(bytes(r["word"]) for r in often.select("word").collect())  # at most s.dictionary rows



def bucket_counts(texts: DataFrame, words, s: ResampleSettings) -> DataFrame:
    """(bucket, n): features of the one column of ``texts``, counted by bucket; at most ``buckets`` rows."""
    column = texts.columns[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, n = Scanner(words.value), np.zeros(s.buckets, np.int64)
        for _, part in blocks(batches, column, s.block_bytes):
            for bucket, _, _ in buckets_of(scanner, part, s.longest, s.buckets):
                n += np.bincount(bucket, minlength=s.buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    return texts.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """floor(1000 * ln(smoothed share in the target / smoothed share in the source)) of every bucket."""
    spark = source.sparkSession
    counts = spark.range(buckets).withColumnRenamed("id", "bucket")
    counts = counts.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    rows = counts.select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("s", "t")]).orderBy("bucket")
    rows = written(rows, "bucket-counts")  # a row per bucket
    all_s, all_t = rows.agg(F.sum("s"), F.sum("t")).first()
    ratio = ((F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets))) / (
        (F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets))
    )
    gains = rows.select("bucket", F.floor(F.log(ratio) * 1000).cast("bigint").alias("gain")).collect()
    return [gain for _, gain in sorted(map(tuple, gains))]


def gumbel(id_text: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise), from the first 32 bits of the SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("bigint")
    uniform = (h.cast("double") + 0.5) / 4294967296.0
    return F.floor(F.log(-F.log(uniform)) * -1000).cast("bigint")


def weigh(docs: DataFrame, id_col: str, text_col: str, words, gains, s: ResampleSettings) -> DataFrame:
    """(_id, n_words, n_features, weight) of every row."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, gain = Scanner(words.value), np.array(gains.value, np.int64)
        for rows, part in blocks(batches, "_text", s.block_bytes):
            n_words, n_features, weight = np.zeros((3, len(part)), np.int64)
            for bucket, text, run_words in buckets_of(scanner, part, s.longest, s.buckets):
                n_features += np.bincount(text, minlength=len(part))
                n_words += np.bincount(text[run_words == 1], minlength=len(part))
                np.add.at(weight, text, gain[bucket])
            yield pa.RecordBatch.from_arrays(
                [rows["_id"].combine_chunks(), pa.array(n_words), pa.array(n_features), pa.array(weight)],
                ["_id", "n_words", "n_features", "weight"],
            )

    return source.mapInArrow(run, f"_id {id_type}, n_words bigint, n_features bigint, weight bigint")


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    settings: ResampleSettings = ResampleSettings(),
) -> DataFrame:
    """One row per document row: ``id_col``, n_words, n_features, weight, score, rank (null: not drawn).

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Null and empty texts have no
    words, weight 0, and are never drawn if ``least_words`` is positive. ``target`` may be empty or hold nulls; then
    the gains follow from ``docs`` alone. Texts of any length are read whole, a megabyte at a time.

    Rows of one id have the same noise; equal scores are drawn by rising id (null: last, noise of an empty id), and
    rows that are alike in both in any order. An empty table gives an empty result. Other columns are not read.
    """
    s, context = settings, docs.sparkSession.sparkContext
    source, wanted = docs.select(F.col(text_col).alias("_text")), target.select(F.col(target_text_col).alias("_text"))
    words = context.broadcast(frequent_words(source.union(wanted), s))  # at most s.dictionary words of s.word_bytes
    counts = [written(bucket_counts(t, words, s), "buckets") for t in (source, wanted)]
    gains = context.broadcast(bucket_gains(*counts, s.buckets))  # a number per bucket
    noise = gumbel(F.coalesce(F.col("_id").cast("string"), F.lit("")), s.seed)
    scored = weigh(docs, id_col, text_col, words, gains, s).withColumn("score", F.col("weight") + noise)
    scored = written(scored, "scored")
    in_draw = F.col("n_words") >= s.least_words
    drawn = scored.where(in_draw).count() * s.percent // 100
    numbered = number_rows(
        scored, in_draw.desc(), F.desc("score"), F.asc_nulls_last("_id"), F.xxhash64("n_words", "n_features", "weight"), name="_place"
    )
    rank = F.when(in_draw & (F.col("_place") <= drawn), F.col("_place"))
    return numbered.select(
        F.col("_id").alias(id_col), "n_words", "n_features", "weight", "score", rank.cast("bigint").alias("rank")
    )
