"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed where the texts are read, in one pass, and written as a narrow table. Trees are
fitted on a bounded sample of labelled rows, binned to bytes, by histograms of gradients. They are flattened
into arrays, and every batch of documents walks all trees at once, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.arrays import blocks, mix, word_block
from docaudit.shared import written

FEATURES = (
    "log_words", "log_bytes", "mean_word", "spread_word", "longest_word", "upper", "digits", "marks", "symbols",
    "beyond_ascii", "line_ends", "distinct_words", "repeated_next", "repeated_pairs", "top_word", "upper_words",
    "digit_words", "marked_words", "short_words", "distinct_lines", "words_per_line", "sentence_ends", "exclaims",
    "vowels", "brackets",
)


@dataclass(frozen=True)
class TreeSettings:
    """``sample_rows``: about how many labelled rows are fitted on at most, picked by a hash of their id."""

    sample_rows: int = 200_000
    trees: int = 80
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    least_weight: float = 5.0
    ridge: float = 1.0
    cut: float = 0.7


def _kind(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT = _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kind("0123456789")
_MARK, _SYMBOL = _kind("!\"'(),-.:;?[]_`{}/\\@^~=+"), _kind("#*$%&|<>")
_SENTENCE, _EXCLAIM, _VOWEL, _BRACKET = _kind(".?!"), _kind("!"), _kind("aeiouAEIOU"), _kind("()[]{}")
_LINE = _kind("\n")
_BEYOND = np.arange(256) >= 128


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text; shares are 0 where there is nothing to count."""
    w = word_block(texts, lower=False)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    size = np.maximum(1, np.diff(begins) - 1)
    words = np.diff(w.offsets)
    some = np.maximum(1, words)

    def bytes_of(kind: np.ndarray) -> np.ndarray:
        total = np.zeros(len(w.buf) + 1, np.int64)
        np.cumsum(kind[w.buf], out=total[1:])
        return total

    def per_text(total: np.ndarray) -> np.ndarray:
        return (total[begins[1:] - 1] - total[begins[:-1]]) / size

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(w.text_of[flags], minlength=len(texts)) / some

    def has(total: np.ndarray) -> np.ndarray:
        return total[w.end] > total[w.start]

    length = (w.end - w.start).astype(float)
    mean = np.bincount(w.text_of, length, len(texts)) / some
    square = np.bincount(w.text_of, length**2, len(texts)) / some
    longest = np.zeros(len(texts))
    np.maximum.at(longest, w.text_of, length)
    h = w.hashes()
    same_text = np.concatenate([[False], w.text_of[1:] == w.text_of[:-1]]) if len(h) else np.zeros(0, bool)
    before = np.concatenate([h[:1], h[:-1]])
    key = mix(h + mix(w.text_of.astype(np.uint64)))
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    distinct = np.bincount(w.text_of[first], minlength=len(texts))
    top = np.zeros(len(texts))
    np.maximum.at(top, w.text_of[first], n.astype(float))
    pairs = mix(key + np.uint64(3) * before)[same_text]
    _, first, n = np.unique(pairs, return_index=True, return_counts=True)
    repeated = np.bincount(w.text_of[same_text][first], n - 1, len(texts)) if len(pairs) else np.zeros(len(texts))
    lines = [t.split(b"\n") for t in texts]
    upper, digit, mark, line = (bytes_of(k) for k in (_UPPER, _DIGIT, _MARK, _LINE))
    return np.column_stack([
        np.log1p(words), np.log1p(size), mean, np.sqrt(np.maximum(0, square - mean**2)), longest, per_text(upper),
        per_text(digit), per_text(mark), per_text(bytes_of(_SYMBOL)), per_text(bytes_of(_BEYOND)), per_text(line),
        distinct / some, per_word(same_text & (h == before)), repeated / some, top / some,
        per_word(upper[w.end] - upper[w.start] == w.end - w.start), per_word(has(digit)), per_word(has(mark)),
        per_word(length <= 3), [len(set(x)) / len(x) for x in lines], words / np.array([len(x) for x in lines]),
        *(per_text(bytes_of(k)) for k in (_SENTENCE, _EXCLAIM, _VOWEL, _BRACKET)),
    ]).astype(np.float32)


@dataclass
class Trees:
    """``feature``/``cut``: trees x inner nodes, in heap order; ``leaf``: trees x leaves; ``base``: log odds."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Walk all trees at once: rows x trees positions, one step per level."""
        out = np.full(len(x), self.base)
        tree = np.arange(len(self.feature))
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            row = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(tree)), np.int64)
            for _ in range(int(np.log2(self.leaf.shape[1]))):
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.cut[tree, node])
            out[at : at + 4096] += self.leaf[tree, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, s: TreeSettings) -> Trees:
    """Trees for P(y = 1). Without both classes there is nothing to split, and the base says it all."""
    inner, leaves = 2**s.depth - 1, 2**s.depth
    odds = (y.sum() + 0.5) / (len(y) - y.sum() + 0.5)
    model = Trees(
        np.zeros((s.trees, inner), np.int64), np.full((s.trees, inner), np.inf, np.float32),
        np.zeros((s.trees, leaves)), float(np.log(odds)),
    )
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, s.bins + 1)[1:-1])).astype(np.float32) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    d = x.shape[1]
    flat = binned + np.arange(d) * s.bins  # a cell of its own for every feature and bin
    total = np.full(len(y), model.base)
    for t in range(s.trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(s.depth):
            n, begin = 2**level, 2**level - 1
            cells = (node - begin)[:, None] * (d * s.bins) + flat
            g, h = (
                np.bincount(cells.ravel(), np.repeat(v, d), n * d * s.bins).reshape(n, d, s.bins).cumsum(2)
                for v in (gradient, weight)
            )
            gain = _gain(g, h, s)
            best = gain.reshape(n, -1).argmax(1)
            f, b = best // s.bins, best % s.bins
            good = gain.reshape(n, -1)[np.arange(n), best] > 1e-6
            for i in np.flatnonzero(good):
                model.feature[t, begin + i] = f[i]
                model.cut[t, begin + i] = edges[f[i]][b[i]] if b[i] < len(edges[f[i]]) else np.inf
            own = node - begin
            node = 2 * node + 1 + (good[own] & (binned[np.arange(len(y)), f[own]] > b[own]))
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, weight, leaves)
        model.leaf[t] = s.rate * g / (h + s.ridge)
        total += model.leaf[t][leaf]
    return model


def _gain(g: np.ndarray, h: np.ndarray, s: TreeSettings) -> np.ndarray:
    """Gain of a split after every bin, from running sums over the bins."""
    all_g, all_h = g[:, :, -1:], h[:, :, -1:]
    gain = g**2 / (h + s.ridge) + (all_g - g) ** 2 / (all_h - h + s.ridge) - all_g**2 / (all_h + s.ridge)
    return np.where((h >= s.least_weight) & (all_h - h >= s.least_weight), gain, -1.0)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    settings: TreeSettings = TreeSettings(),
) -> DataFrame:
    """One row per document: ``id_col``, held_out, score (0 to 1, higher: label 1 is likelier), predicted.

    Only the text makes the score. Learns from labelled rows for which ``held_out`` is not true; with more than
    ``sample_rows`` of them, from those with a small hash of their id. ``predicted`` is 1 from ``cut`` on.

    Null and empty texts have statistics of zero. Null labels are not learned from, null ids have no label; a
    null ``held_out`` counts as false. Rows that repeat are scored, and learned from, each. Without labels of
    both kinds every score is the same. An empty table gives an empty result. Other columns are not read.
    """
    s = settings
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, "_text"):
            x = statistics(texts)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(
                [rows["_id"].combine_chunks(), rows["held_out"].combine_chunks(), values], ["_id", "held_out", "x"]
            )

    facts = written(source.mapInArrow(measure, f"_id {id_type}, held_out boolean, x array<float>"), "statistics")
    known = labels.select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("int").alias("y")).where("y is not null")
    share = min(1.0, s.sample_rows / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("_label_id", F.lit("quality")), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = facts.where(~F.col("held_out")).join(picked, F.col("_id") == F.col("_label_id")).select("_id", "x", "y").toArrow()
    # The order of rows must not change the sums, so a lost executor does not change a score.
    sample = sample.sort_by("_id")
    x = sample["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if len(sample) else np.zeros((0, len(FEATURES)), np.float32)
    model = fit(x, (sample["y"].to_numpy() == 1).astype(float), s)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            p = sent.value.probability(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("held_out"), pa.array(p), pa.array((p >= s.cut).astype(np.int32))],
                ["_id", "held_out", "score", "predicted"],
            )

    return facts.mapInArrow(score, f"_id {id_type}, held_out boolean, score double, predicted int").withColumnRenamed("_id", id_col)
