"""N-gram Jaccard join with prefix filters under several global token orders.

If two sets are similar enough, their prefixes share a token, whatever the order of all tokens is. A candidate
must pass under each of several orders; the filters are intersected before sets are compared.

1. All shingles of all distinct sets are counted over the whole table. Those that repeat come last in every order, the
   more documents hold them the later, so prefixes hold shingles of few documents. As many as ``frequent_most``,
   from the most frequent down, can be sent to every task; what the list holds is only a matter of speed, never of results.
2. Each document gets its set's size and hash, and its prefix under every order. Equal sets are one node.
3. Nodes that share a prefix token of the first order are a list. Each list's first member is compared with
   all others; what is linked becomes one component. Only lists with several components are looked at again,
   and there only pairs of different components. A group of near copies so costs its length, not its square.
4. Candidates must have matching sizes and positions, and share tokens under the other orders too;
   then the whole sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.arrays import blocks, mix, word_block
from docaudit.llm.components import connected_components
from docaudit.shared import discard, written


@dataclass(frozen=True)
class JoinSettings:
    """Two documents link when 100 * intersection >= percent * union of their ``words``-word shingles.

    ``orders``: token orders, the first included. ``frequent_least``: shingles with at least this count come last;
    ``frequent_most``: longest list of them, five bytes each. ``ranges``: parts of the hash space that are counted
    apart, so a counting task holds that share of all shingles; to be raised with the table. ``broadcast_keys``: longest
    list of keys that is sent to all tasks instead of shuffling what they select from.
    """

    words: int = 3
    percent: int = 90
    orders: int = 3
    frequent_least: int = 2
    frequent_most: int = 8_000_000
    ranges: int = 1024
    chunk: int = 1 << 21
    broadcast_keys: int = 500_000
    block_bytes: int = 2 << 20

    def __post_init__(self):
        if not 50 <= self.percent <= 100 or self.words < 1 or self.orders < 1:
            raise ValueError("need 50 <= percent <= 100, words >= 1, orders >= 1")


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts one after another, sorted within a text, and the texts' sizes."""
    w = word_block(texts, lower=True)
    h = w.hashes()
    count = np.diff(w.offsets)
    # A text with fewer words is one shingle: the hash runs over what words there are.
    value = np.zeros(len(h), np.uint64)
    ahead = np.arange(len(h))
    end = np.repeat(w.offsets[1:], count)
    for i in range(words):
        at = np.minimum(ahead + i, len(h) - 1)
        value = mix(value + np.uint64(2 * i + 1)) + np.where(ahead + i < end, h[at], np.uint64(i + 1)) if len(h) else value
    value = mix(value)
    keep = (ahead + words <= end) | (ahead == np.repeat(w.offsets[:-1], count))
    value, text = value[keep], w.text_of[keep]
    order = np.argsort(value)
    order = order[np.argsort(text[order].astype(_small(len(texts))), kind="stable")]
    value, text = value[order], text[order]
    if len(value):
        first = np.concatenate([[True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])])
        value, text = value[first], text[first]
    return value, np.bincount(text, minlength=len(texts))


def _small(n: int):
    return np.uint16 if n <= 1 << 16 else np.int64  # 16 bits are sorted by radix


def set_hashes(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each set, from all its members."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    ends = np.cumsum(sizes)
    return mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)


def _deltas(codes: np.ndarray) -> bytes:
    """Rising 32-bit numbers as their differences, byte by byte, compressed."""
    planes = np.diff(codes, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _from_deltas(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def frequent_shingles(docs: DataFrame, text_col: str, s: JoinSettings) -> tuple[np.ndarray, np.ndarray]:
    """32-bit codes of frequent shingles, sorted, with a grade that grows with their count.

    A task sends the shingles of sets that are new to it as sorted runs, cut in ranges of the hash space; a range is
    counted in one place. A code is taken from the hash beside its range, so unlike shingles may share one; that
    puts a rare shingle too late in the order, which costs time only.
    """
    bits = max(1, (s.ranges - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        seen = np.zeros(0, np.int64)

        def told() -> pa.RecordBatch:
            values = np.sort(np.concatenate(kept))
            starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
            at = np.append(np.searchsorted(values, starts), len(values))
            some = np.flatnonzero(np.diff(at))
            codes = (values >> np.uint64(32 - bits)).astype(np.uint32)
            runs = [_deltas(codes[at[i] : at[i + 1]]) for i in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(runs, pa.binary())], ["range", "run"])

        for _, texts in blocks(batches, "_text", s.block_bytes):
            values, sizes = shingle_sets(texts, s.words)
            h = set_hashes(values, sizes)
            _, first = np.unique(h, return_index=True)  # copies count once in a task
            new = np.zeros(len(sizes), bool)
            new[first] = True
            new &= ~np.isin(h, seen)
            seen = np.append(seen[-500_000:], h[new])
            kept.append(values[np.repeat(new, sizes)])
            if sum(map(len, kept)) >= s.chunk:
                yield told()
                kept.clear()
        if kept:
            yield told()

    def count(group: pa.Table) -> pa.Table:
        codes = np.concatenate([_from_deltas(x.as_py()) for x in group["run"]])
        found, n = np.unique(codes, return_counts=True)
        often = n >= s.frequent_least
        grade = np.minimum(250, 1 + np.floor(8 * np.log2(n[often] / s.frequent_least))).astype(np.int16)
        # The range's number is put in the low bits, so that equal codes of two ranges stay apart as far as 32 bits go.
        code = (found[often] ^ (np.uint32(group["range"][0].as_py()) << np.uint32(32 - bits))).view(np.int32)
        return pa.table({"code": code, "grade": grade})

    runs = docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "range int, run binary")
    counted = written(runs.groupBy("range").applyInArrow(count, "code int, grade smallint"), "counts")
    total, least = 0, 0
    for grade, n in sorted(map(tuple, counted.groupBy("grade").count().collect()), reverse=True):  # at most 250 grades
        total += n
        if total > s.frequent_most:
            least = grade + 1
            break
    top = counted.where(F.col("grade") >= least).toArrow()
    code, grade = top["code"].to_numpy().view(np.uint32), top["grade"].to_numpy()
    discard(counted)
    order = np.lexsort((-grade, code))  # of one code the highest grade is found first
    return code[order], grade[order].astype(np.uint8)


def _codes(values: np.ndarray, ranges: int) -> np.ndarray:
    bits = max(1, (ranges - 1).bit_length())
    code = (values >> np.uint64(32 - bits)).astype(np.uint32)
    return code ^ ((values >> np.uint64(64 - bits)).astype(np.uint32) << np.uint32(32 - bits))


def _prefix_sizes(sizes: np.ndarray, percent: int) -> np.ndarray:
    return np.where(sizes > 0, sizes - -(-percent * sizes // 100) + 1, 0)


def _signatures(docs: DataFrame, id_col: str, text_col: str, frequent, s: JoinSettings) -> DataFrame:
    """(_id, n, h, first, more): size and hash of each document's set, tokens of the first order's prefix with rising
    position, and those of the other orders in 32 bits. A task leaves the prefixes of sets out that it has seen."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def prefixes(values: np.ndarray, sizes: np.ndarray, grade: np.ndarray, order: int) -> np.ndarray:
        text = np.repeat(np.arange(len(sizes)), sizes)
        key = mix(values ^ np.uint64(0xD1B54A32D192ED03 * (order + 1) % (1 << 64)))
        rank = np.argsort(key)
        rank = rank[np.argsort(grade[rank], kind="stable")]
        rank = rank[np.argsort(text[rank].astype(_small(len(sizes))), kind="stable")]
        begin = np.cumsum(sizes) - sizes
        place = np.arange(len(values)) - np.repeat(begin, sizes)
        return values[rank[place < np.repeat(_prefix_sizes(sizes, s.percent), sizes)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, grades = sent.value
        seen = np.zeros(0, np.int64)
        for rows, texts in blocks(batches, "_text", s.block_bytes):
            values, sizes = shingle_sets(texts, s.words)
            h = set_hashes(values, sizes)
            _, first = np.unique(h, return_index=True)
            new = np.zeros(len(sizes), bool)
            new[first] = True
            new &= ~np.isin(h, seen)
            seen = np.append(seen[-500_000:], h[new])
            values, told = values[np.repeat(new, sizes)], np.where(new, sizes, 0)
            grade = np.zeros(len(values), np.uint8)
            if len(known):
                code = _codes(values, s.ranges)
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                grade = np.where(known[at] == code, grades[at], 0).astype(np.uint8)
            ends = np.cumsum(_prefix_sizes(told, s.percent))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(p))
                for p in (
                    prefixes(values, told, grade, 0).view(np.int64),
                    *(prefixes(values, told, grade, o).astype(np.uint32).view(np.int32) for o in range(1, s.orders)),
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [rows["_id"].combine_chunks(), pa.array(sizes, pa.int32()), pa.array(h), *lists],
                ["_id", "n", "h", *[f"o{i}" for i in range(s.orders)]],
            )

    more = "".join(f", o{i} array<int>" for i in range(1, s.orders))
    return source.mapInArrow(run, f"_id {id_type}, n int, h bigint, o0 array<bigint>{more}")


def _similar(shared: Column, n1: Column, n2: Column, percent: int) -> Column:
    """Whether an overlap of ``shared`` is enough for sizes n1 and n2."""
    return shared * (100 + percent) >= (n1 + n2) * percent


def _possible(n1: Column, at1: Column, n2: Column, at2: Column, percent: int) -> Column:
    """Whether sets of these sizes can link when their first common token is at these positions."""
    return _similar(F.least(n1 - at1, n2 - at2), n1, n2, percent)


class _Verifier:
    """Compares candidate pairs: first by the other orders' prefixes, then by their whole sets."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, signatures: DataFrame, s: JoinSettings):
        self.docs, self.id_col, self.text_col, self.s = docs, id_col, text_col, s
        self.told = signatures.where((F.col("n") > 0) & (F.size("o0") > 0))
        self.passing: list[DataFrame] = []

    def _of(self, rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
        """Rows whose key is among the wanted ones. A short list of keys goes to the rows, else both are shuffled."""
        most = self.s.broadcast_keys
        keys = wanted.toDF("wanted").distinct()
        if keys.limit(most + 1).count() <= most:
            keys = F.broadcast(keys)
        return rows.join(keys, F.col(key) == F.col("wanted"), "left_semi")

    def _filtered(self, pairs: DataFrame) -> DataFrame:
        names = [f"o{i}" for i in range(1, self.s.orders)]
        if not names:
            return pairs
        told = self._of(self.told, "h", pairs.select("a").union(pairs.select("b")))
        a = told.select(F.col("h").alias("a"), *[F.col(x).alias(f"a_{x}") for x in names])
        b = told.select(F.col("h").alias("b"), *[F.col(x).alias(f"b_{x}") for x in names])
        shared = F.lit(True)
        for x in names:
            shared = shared & F.arrays_overlap(f"a_{x}", f"b_{x}")
        return pairs.join(a, "a").join(b, "b").where(shared).select("a", "b").distinct()

    def _sets(self, nodes: DataFrame) -> DataFrame:
        """(h, members): whole sets of the nodes, from one of their texts each."""
        ids = self._of(self.told.select("h", "_id"), "h", nodes).groupBy("h").agg(F.min("_id").alias("id"))
        ids = written(ids.select("id"), "wanted")
        self.passing.append(ids)
        texts = self._of(self.docs, self.id_col, ids).select(F.col(self.text_col).alias("_text"))
        words, size = self.s.words, self.s.block_bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, part in blocks(batches, "_text", size):
                values, sizes = shingle_sets(part, words)
                h = set_hashes(values, sizes)
                _, first = np.unique(h, return_index=True)
                ends = np.cumsum(sizes)
                members = [values[ends[i] - sizes[i] : ends[i]].tobytes() for i in first]
                yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(members, pa.binary())], ["h", "members"])

        return texts.mapInArrow(run, "h bigint, members binary")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link, written; what led there is deleted."""
        met = written(pairs, "pairs")
        pairs = written(self._filtered(met), "candidates")
        nodes = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
        sets = written(self._sets(nodes), "sets")
        a = sets.select(F.col("h").alias("a"), F.col("members").alias("x"))
        b = sets.select(F.col("h").alias("b"), F.col("members").alias("y"))
        percent = self.s.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                linked = np.zeros(batch.num_rows, bool)
                for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                    p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                    shared = int((q[at] == p).sum())
                    linked[i] = 100 * shared >= percent * (len(p) + len(q) - shared)
                yield batch.select(["a", "b"]).filter(pa.array(linked))

        linked = written(pairs.join(a, "a").join(b, "b").mapInArrow(run, "a bigint, b bigint"), "links")
        discard(met, pairs, sets, *self.passing)
        self.passing.clear()
        return linked


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _node_links(docs: DataFrame, id_col: str, text_col: str, signatures: DataFrame, s: JoinSettings) -> DataFrame:
    """Links (a, b) between nodes that connect what is connected at all; never a link too many."""
    check = _Verifier(docs, id_col, text_col, signatures, s)
    tokens = check.told.select("h", "n", F.posexplode("o0").alias("at", "t"))
    shared = tokens.groupBy("t").count().where("count > 1").select("t")
    lists = written(tokens.join(shared, "t"), "lists")
    hubs = lists.groupBy("t").agg(F.min(F.struct("at", "h", "n")).alias("hub"))
    x = lists.join(hubs, "t").where(
        (F.col("h") != F.col("hub.h"))
        & _possible(F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at"), s.percent)
    )
    tried = written(x.select(*_pair(F.col("h"), F.col("hub.h"))).distinct(), "tried")
    links = check.links(tried)

    # What is left: pairs of one list whose members are not connected yet.
    labels = connected_components(links)
    named = lists.join(labels, lists.h == labels.node, "left").select(
        "t", "h", "n", "at", F.coalesce("label", "h").alias("label")
    )
    named = written(named, "named-lists")
    discard(lists)
    open_ = named.groupBy("t").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    rest = written(named.join(open_.select("t"), "t"), "open-lists")
    discard(named)
    one, two = (rest.select("t", *[F.col(c).alias(f"{c}{i}") for c in ("h", "n", "at", "label")]) for i in (1, 2))
    x = one.join(two, "t").where(
        (F.col("h1") < F.col("h2")) & (F.col("label1") != F.col("label2"))
        & _possible(F.col("n1"), F.col("at1"), F.col("n2"), F.col("at2"), s.percent)
    )
    pairs = x.select(*_pair(F.col("h1"), F.col("h2"))).distinct().join(tried, ["a", "b"], "left_anti")
    more = check.links(pairs)
    discard(rest, tried)
    return links.unionByName(more)


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: JoinSettings = JoinSettings()
) -> DataFrame:
    """One row per document row: ``id_col``, n_shingles, component_id (smallest id linked directly or over others), set_hash.

    Words lie between blanks, A-Z lower-cased. A set is the distinct shingles; fewer words than a
    shingle has are one shingle. Null and empty texts have an empty set and link with nothing.

    Rows with a null id get no row. Rows that repeat, or equal sets under several ids, are one node. Sets are
    told apart by 64-bit hashes. An empty table gives an empty result. Other columns are not read.
    """
    s = settings
    docs = docs.select(id_col, text_col).where(F.col(id_col).isNotNull())
    frequent = frequent_shingles(docs, text_col, s)
    signatures = written(_signatures(docs, id_col, text_col, frequent, s), "signatures")
    links = written(_node_links(docs, id_col, text_col, signatures, s), "links")
    labels = connected_components(links)
    nodes = signatures.where("n > 0").groupBy("h").agg(F.min("_id").alias("least"))
    nodes = nodes.join(labels, nodes.h == labels.node, "left").select("h", "least", F.coalesce("label", "h").alias("label"))
    nodes = written(nodes, "nodes")
    component = nodes.groupBy("label").agg(F.min("least").alias("component"))
    named = nodes.join(component, "label").select(F.col("h").alias("h2"), "component")
    rows = signatures.select("_id", "n", "h")
    found = rows.join(named, (rows.h == named.h2) & (rows.n > 0), "left")
    return found.select(
        F.col("_id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"),
        F.coalesce("component", "_id").alias("component_id"), F.col("h").alias("set_hash"),
    )
