"""Hidden Markov language model, trained and scored on Spark.

Latent states emit word classes, and a class emits its words by their smoothed counts:
P(word | state) = P(class | state) * P(word | class). The most frequent words are classes of their own; the others
share a class by their shape (a hash of their last bytes). Counts of all words come from all training texts.

1. Each task turns its documents into blocks: local vocabulary, and every token as a number in it.
2. Word counts are added up per block, then over all blocks; each block gets back the
   counts of its own words by a join, so no vocabulary is broadcast.
3. Baum-Welch: every task adds up expected transitions and emissions of its blocks, Spark sums
   them by class, and the driver gets a table of states x classes, whose size is fixed.
4. The scaled forward recursion gives the exact likelihood of every text. A long text is cut in
   segments whose transfer matrices are multiplied, so all segments advance together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.arrays import blocks, ranges, word_block
from docaudit.shared import written

_SHAPES = 1024


@dataclass(frozen=True)
class HmmSettings:
    """``top_words``: words that are classes of their own; ``segment``: tokens of a training sequence;
    ``block_bytes``: text in one block."""

    states: int = 6
    iterations: int = 4
    top_words: int = 4096
    segment: int = 256
    long_text: int = 2048
    block_bytes: int = 12 << 20
    seed: int = 7

    @property
    def classes(self) -> int:
        """Top words, shapes, and the end of a text."""
        return self.top_words + _SHAPES + 1


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpacked(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


_BLOCKS = (
    "block string, n_docs int, rows binary, lengths binary, held binary, tokens binary, "
    "words array<bigint>, shapes array<smallint>, counts array<int>"
)


def token_blocks(docs: DataFrame, id_col: str, text_col: str, held_out: Column, block_bytes: int) -> DataFrame:
    """One row per block of documents: their ids (as an Arrow table), number of words, held-out flags,
    tokens as numbers in the block's vocabulary, its words' hashes, and their training counts."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(held_out, F.lit(False)).alias("_held"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, (table, texts) in enumerate(blocks(batches, "_text", block_bytes)):
            parts, shapes, lengths, held = [], [], [], table["_held"].to_numpy()
            # Words are looked up in small parts, then the parts' vocabularies are joined.
            known: list[np.ndarray] = []
            for at in range(0, len(texts), 512):
                w = word_block(texts[at : at + 512], lower=True)
                hashes, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
                known.append(hashes)
                parts.append(inverse)
                lengths.append(np.diff(w.offsets))
                shapes.append(_shape(w, first))
            words, back = np.unique(np.concatenate(known), return_inverse=True)
            shape = np.zeros(len(words), np.int16)
            shape[back] = np.concatenate(shapes)
            begins = np.cumsum([0, *map(len, known)])
            tokens = np.concatenate(
                [back[begins[i] : begins[i + 1]][p] for i, p in enumerate(parts)] or [np.zeros(0, np.int64)]
            ).astype(np.uint32)
            lengths = np.concatenate(lengths).astype(np.int64)
            train = np.repeat(~held, lengths)
            counts = np.bincount(tokens[train], minlength=len(words)).astype(np.int32)
            sink = pa.BufferOutputStream()
            ids = table.select(["_id"]).combine_chunks()
            with pa.ipc.new_stream(sink, ids.schema) as out:
                out.write_table(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{task}-{number}"]), pa.array([len(texts)], pa.int32()),
                    pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([_packed(lengths)], pa.binary()),
                    pa.array([_packed(held)], pa.binary()), pa.array([_packed(tokens)], pa.binary()),
                    pa.array([words.view(np.int64)], pa.list_(pa.int64())), pa.array([shape], pa.list_(pa.int16())),
                    pa.array([counts], pa.list_(pa.int32())),
                ],
                ["block", "n_docs", "rows", "lengths", "held", "tokens", "words", "shapes", "counts"],
            )

    return rows.mapInArrow(run, _BLOCKS)


def _shape(w, first: np.ndarray) -> np.ndarray:
    """Class of the last three bytes and the length, for words outside the most frequent ones."""
    end, start = w.end[first], w.start[first]
    size = end - start
    value = np.minimum(size, 4).astype(np.uint32)
    for back in (1, 2, 3):
        byte = np.where(size >= back, w.buf[np.maximum(end - back, 0)], 0).astype(np.uint32)
        value = value * np.uint32(0x01000193) ^ byte
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x2C1B3C6D)
    value ^= value >> np.uint32(12)
    return (value % np.uint32(_SHAPES)).astype(np.int16)


def word_counts(packed: DataFrame) -> DataFrame:
    """(word, shape, c, n_blocks): training count of every word, and how many blocks hold it."""
    rows = packed.select(F.explode(F.arrays_zip("words", "shapes", "counts")).alias("x"))
    return rows.groupBy(F.col("x.words").alias("word")).agg(
        F.max("x.shapes").cast("int").alias("shape"), F.sum(F.col("x.counts").cast("bigint")).alias("c"),
        F.count("*").alias("n_blocks"),
    )


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x classes


def _initial(s: HmmSettings, share: np.ndarray) -> Model:
    rng = np.random.default_rng(s.seed)
    emit = share * np.exp(rng.normal(0, 0.7, (s.states, s.classes)))
    move = np.full((s.states, s.states), 0.02 / max(1, s.states - 1))
    np.fill_diagonal(move, 0.98)
    return Model(np.full(s.states, 1 / s.states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


_STEPS = 8  # tokens between two scalings; probabilities stay far above the smallest number


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order from long to short, and how many are longer than t, for every t."""
    order = np.argsort(-lengths, kind="stable")
    most = int(lengths.max(initial=0))
    longer = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(most), "right")
    return order, longer


def forward(m: Model, tokens: np.ndarray, begins: np.ndarray, lengths: np.ndarray, first: np.ndarray):
    """State weights after each sequence, and the natural log of what was scaled away.

    ``first``: weights before a sequence's first token, sequences x states (not moved yet).
    """
    order, longer = _by_length(lengths)
    begin, weights = begins[order], first[order].astype(np.float64)
    emit, log = np.ascontiguousarray(m.emit.T), np.zeros(len(lengths))
    for t, n in enumerate(longer):
        w = weights[:n]
        if t:
            w = w @ m.move
        w = w * emit[tokens[begin[:n] + t]]
        if t % _STEPS == _STEPS - 1:
            total = w.sum(1, keepdims=True)
            w /= total
            log[:n] += np.log(total[:, 0])
        weights[:n] = w
    total = weights.sum(1, keepdims=True)
    out, logs = np.empty_like(weights), np.empty_like(log)
    out[order], logs[order] = weights / total, log + np.log(total[:, 0])
    return out, logs


def log_likelihood(m: Model, tokens: np.ndarray, lengths: np.ndarray, long_text: int) -> np.ndarray:
    """Natural log probability of every text; each has at least its end token."""
    begins = np.cumsum(lengths) - lengths
    k, result = len(m.start), np.zeros(len(lengths))
    short, long_ = np.flatnonzero(lengths <= long_text), np.flatnonzero(lengths > long_text)
    _, result[short] = forward(m, tokens, begins[short], lengths[short], np.tile(m.start, (len(short), 1)))
    if not len(long_):
        return result
    # Every segment from every state; the move into a later segment comes with the product.
    part = long_text // 8
    sizes = _segments(lengths[long_], part)
    count = -(-lengths[long_] // part)
    at = np.repeat(begins[long_], count) + part * ranges(np.zeros(len(long_), np.int64), count)
    rows, logs = forward(m, tokens, np.repeat(at, k), np.repeat(sizes, k), np.tile(np.eye(k), (len(at), 1)))
    rows, logs = rows.reshape(-1, k, k), logs.reshape(-1, k)
    top = logs.max(1)
    transfer = np.exp(logs - top[:, None])[:, :, None] * rows
    onward = m.move @ transfer
    last = np.cumsum(count)
    for i, end, n in zip(long_, last, count, strict=True):
        weights, total = m.start @ transfer[end - n], top[end - n : end].sum()
        for j in range(end - n + 1, end):
            size = weights.sum()
            total += np.log(size)
            weights = (weights / size) @ onward[j]
        result[i] = total + np.log(weights.sum())
    return result


def expected_counts(m: Model, tokens: np.ndarray, lengths: np.ndarray):
    """Expected first states, moves and emissions of sequences, by the forward-backward recursion."""
    k = len(m.start)
    firsts, moves = np.zeros(k), np.zeros((k, k))
    emissions = np.zeros((m.emit.shape[1], k))
    emit = np.ascontiguousarray(m.emit.T)
    begins = np.cumsum(lengths) - lengths
    for at in range(0, len(lengths), 2048):
        size, begin = lengths[at : at + 2048], begins[at : at + 2048]
        order, longer = _by_length(size)
        begin = begin[order]
        most, n0 = len(longer), len(size)
        alpha, scale = np.empty((most, n0, k), np.float32), np.empty((most, n0), np.float32)
        e = np.empty((most, n0, k), np.float32)
        move, move_back = m.move.astype(np.float32), m.move.T.astype(np.float32)
        emit32 = emit.astype(np.float32)
        for t, n in enumerate(longer):
            e[t, :n] = emit32[tokens[begin[:n] + t]]
            w = (alpha[t - 1, :n] @ move if t else np.tile(m.start.astype(np.float32), (n, 1))) * e[t, :n]
            total = w.sum(1)
            scale[t, :n] = total
            alpha[t, :n] = w / total[:, None]
        beta = np.ones((n0, k), np.float32)
        for t in range(most - 1, -1, -1):
            n = longer[t]
            if t + 1 < most and longer[t + 1]:
                j = longer[t + 1]
                ahead = e[t + 1, :j] * beta[:j] / scale[t + 1, :j, None]
                moves += m.move * (alpha[t, :j].T.astype(np.float64) @ ahead)
                beta[:j] = ahead @ move_back
            gamma = alpha[t, :n] * beta[:n]
            alpha[t, :n] = gamma
            if t == 0:
                firsts += gamma.sum(0)
        where = np.concatenate([tokens[begin[:n] + t] for t, n in enumerate(longer)] or [np.zeros(0, np.int64)])
        gammas = np.concatenate([alpha[t, :n] for t, n in enumerate(longer)] or [np.zeros((0, k))])
        for s in range(k):
            emissions[:, s] += np.bincount(where, gammas[:, s], minlength=len(emissions))
    return firsts, moves, emissions


def _segments(lengths: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the training sequences that texts of these lengths are cut into."""
    full, rest = np.divmod(lengths, most)
    pieces = full + (rest > 0)
    out = np.full(int(pieces.sum()), most, np.int64)
    ends = np.cumsum(pieces)
    cut = rest > 0
    out[ends[cut] - 1] = rest[cut]
    return out


def _step(encoded: DataFrame, model: Model, s: HmmSettings) -> Model:
    """One Baum-Welch iteration over all training texts."""
    k = s.states
    sent = encoded.sparkSession.sparkContext.broadcast(model)  # states x classes: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((s.classes + k + 1, k))
        for batch in batches:
            for classes, lengths, held in zip(*(batch.column(c).to_pylist() for c in ("classes", "lengths", "held")), strict=True):
                classes, lengths, held = _unpacked(classes, np.uint16), _unpacked(lengths, np.int64) + 1, _unpacked(held, bool)
                use = np.repeat(~held, lengths)
                first, moves, emissions = expected_counts(sent.value, classes[use], _segments(lengths[~held], s.segment))
                total[: s.classes] += emissions
                total[s.classes : s.classes + k] += moves
                total[-1] += first
        row = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int32()), *[pa.array(total[row, j]) for j in range(k)]], ["row", *[f"s{j}" for j in range(k)]]
        )

    parts = encoded.select("classes", "lengths", "held").mapInArrow(run, "row int, " + ", ".join(f"s{j} double" for j in range(k)))
    table = np.zeros((s.classes + k + 1, k))
    for r in parts.groupBy("row").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]).collect():
        table[r["row"]] = r[1:]
    sent.unpersist()
    emit = table[: s.classes].T + 1e-3
    moves = table[s.classes : s.classes + k] + 1e-3
    first = table[-1] + 1e-3
    return Model(first / first.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def score_texts(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: HmmSettings = HmmSettings(),
) -> DataFrame:
    """One row per document: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows where ``held_out`` is not true. Scores are log10 probabilities of the
    whole text: ``base_score`` by smoothed word counts, ``score`` by the hidden Markov model.

    Null and empty texts are the end token alone. A null ``held_out`` counts as false. Rows that repeat
    count as often as they are there; ids are only passed through. Without training rows all words are
    unknown and the model is the initial one. An empty table gives an empty result.
    """
    s = settings
    packed = written(token_blocks(docs, id_col, text_col, held_out, s.block_bytes), "hmm-blocks")
    counts = written(word_counts(packed), "hmm-counts")
    ends = packed.select("lengths", "held").mapInArrow(_training_texts, "n bigint")
    n_ends = ends.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    seen = counts.where(F.col("c") > 0)
    whole = seen.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, n_distinct = whole["n"] + n_ends, whole["v"] + (n_ends > 0)
    top = seen.orderBy(F.desc("c"), "word").limit(s.top_words).collect()
    top_words = np.array([r["word"] for r in top], np.int64)
    by_word = np.argsort(top_words)

    # Words that one block alone holds have their count there; the others get it by a join.
    asked = packed.select("block", F.explode("words").alias("word"))
    shared = counts.where(F.col("n_blocks") > 1).select("word", "c")
    replies = asked.join(shared, "word").groupBy("block").agg(F.collect_list(F.struct("word", "c")).alias("said"))
    sent = docs.sparkSession.sparkContext.broadcast((top_words[by_word], by_word))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = sent.value
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                words = row.column("words").flatten().to_numpy()
                c = row.column("counts").flatten().to_numpy().astype(np.int64)
                said = row.column("said").flatten()
                order = np.argsort(words, kind="stable")
                c[order[np.searchsorted(words, said.field("word").to_numpy(), sorter=order)]] = said.field("c").to_numpy()
                at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
                hit = known[at] == words if len(known) else np.zeros(len(words), bool)
                classes = s.top_words + row.column("shapes").flatten().to_numpy().astype(np.int64)
                classes[hit] = rank[at[hit]]
                lengths = _unpacked(row.column("lengths")[0].as_py(), np.int64)
                tokens = _unpacked(row.column("tokens")[0].as_py(), np.uint32)
                ends_at = np.cumsum(lengths)
                full = np.insert(classes[tokens], ends_at, s.classes - 1).astype(np.uint16)
                # Known tokens, and the sums of the logs that need a word's own count.
                log_c = np.log10(c + 0.5)
                own = np.where(hit, 0.0, log_c)
                sums = [_sums(v[tokens], lengths) for v in ((c > 0).astype(float), log_c, own)]
                yield pa.RecordBatch.from_arrays(
                    [row.column(x) for x in ("rows", "lengths", "held")]
                    + [pa.array([x], pa.binary()) for x in (_packed(full), *(x.tobytes() for x in sums))],
                    ["rows", "lengths", "held", "classes", "known", "log_c", "own"],
                )

    encoded = written(
        packed.join(replies, "block", "left").mapInArrow(
            encode, "rows binary, lengths binary, held binary, classes binary, known binary, log_c binary, own binary"
        ),
        "hmm-encoded",
    )
    sent.unpersist()
    in_class, norms = _class_sizes(seen, top, n_ends, s)
    share = (in_class + 0.5) / (in_class + 0.5).sum()
    model = _initial(s, share)
    if n_train:
        for _ in range(s.iterations):
            model = _step(encoded, model, s)
    end_c, base_norm = np.log10(n_ends + 0.5), np.log10(n_train + 0.5 * (n_distinct + 1))
    out = docs.sparkSession.sparkContext.broadcast((model, norms))
    id_type = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, norm = out.value
        for batch in batches:
            for r in batch.to_pylist():
                ids = pa.ipc.open_stream(r["rows"]).read_all()["_id"].combine_chunks()
                lengths, held = _unpacked(r["lengths"], np.int64), _unpacked(r["held"], bool)
                classes = _unpacked(r["classes"], np.uint16)
                known, log_c, own = (np.frombuffer(r[c]) for c in ("known", "log_c", "own"))
                n = lengths + 1
                own = own - _sums(norm[classes], n)
                hidden = log_likelihood(m, classes, n, s.long_text) / np.log(10) + own
                base = log_c + end_c - n * base_norm
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(held), pa.array(n), pa.array(known.astype(np.int64) + int(n_ends > 0)),
                     pa.array(np.full(len(n), n_train, np.int64)), pa.array(base), pa.array(hidden)],
                    ["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return encoded.mapInArrow(
        score,
        f"_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    ).withColumnRenamed("_id", id_col)


def _training_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = sum(int((~_unpacked(h, bool)).sum()) for h in batch.column("held").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def _class_sizes(seen: DataFrame, top: list, n_ends: int, s: HmmSettings) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens of every class, and log10 of what the word counts of a class are divided by.

    Each word of a shape has 0.5 added to its count, and all unknown words of the shape share 0.5.
    """
    tokens, distinct = np.zeros(_SHAPES), np.zeros(_SHAPES)
    for r in seen.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        tokens[r["shape"]], distinct[r["shape"]] = r["c"], r["v"]
    in_class, norms = np.zeros(s.classes), np.zeros(s.classes)
    for i, r in enumerate(top):
        tokens[r["shape"]] -= r["c"]
        distinct[r["shape"]] -= 1
        in_class[i] = r["c"]
    in_class[s.top_words : -1] = tokens
    in_class[-1] = n_ends
    norms[s.top_words : -1] = np.log10(tokens + 0.5 * (distinct + 1))
    return in_class, norms
