"""Models, packing and binary outputs: held-out accuracy, plain versions, exact round trips."""

import base64
import hashlib
import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest
from plain import SF
from pyspark.sql import functions as F

from docaudit.llm.boosted_trees import TreeSettings, fit, score_quality
from docaudit.llm.hidden_markov import HmmSettings, Model, forward, log_likelihood, score_texts
from docaudit.llm.packing import Limits, merge_tails, pack, pack_documents
from docaudit.llm.tokens import WordTokenizer, tokenizer_path
from docaudit.llm.training_order import OrderSettings, materialise, permuted, read_slots
from docaudit.llm.warc import read_warc, write_warc

SMALL = HmmSettings(states=3, iterations=2, top_words=20, segment=16, long_text=64, block_bytes=4000)


def _crc(d, n):
    return zlib.crc32(str(d).encode()) % n


def test_trees_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    rows = score_quality(docs, labels, held).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert sum((r["predicted"] == 1) == (r["quality"] == 1) for r in rows) / len(rows) > 0.95


def test_trees_cases(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(6, 1, "x"), (7, None, "x"), (101, 0, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    settings = TreeSettings(trees=5, least_weight=0.1)
    found = score_quality(odd, labels, F.lit(None).cast("boolean"), settings=settings).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(d for d, _ in odd_rows)
    assert all(0 <= r["score"] <= 1 and not r["held_out"] for r in found)
    assert score_quality(empty, labels, F.lit(False)).count() == 0
    one = score_quality(odd, labels.limit(0), F.lit(False), settings=settings)
    assert one.select("score").distinct().count() == 1


def test_trees_fit_a_rule():
    x = np.random.default_rng(1).random((3000, 4)).astype(np.float32)
    y = ((x[:, 1] > 0.6) ^ (x[:, 3] > 0.5)).astype(float)
    p = fit(x, y, TreeSettings(trees=40, depth=3)).probability(x)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.97


def _naive(m, tokens):
    w = m.start * m.emit[:, tokens[0]]
    for t in tokens[1:]:
        w = (w @ m.move) * m.emit[:, t]
    return math.log(w.sum())


def test_forward_is_exact():
    rng = np.random.default_rng(3)
    emit, move = rng.random((3, 7)), rng.random((3, 3))
    m = Model(np.array([0.2, 0.3, 0.5]), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
    lengths = np.array([1, 5, 64, 65, 200, 129, 2])
    tokens = rng.integers(0, 7, lengths.sum())
    got = log_likelihood(m, tokens, lengths, 64)
    ends = np.cumsum(lengths)
    assert np.allclose(got, [_naive(m, tokens[e - n : e]) for e, n in zip(ends, lengths, strict=True)])
    total = sum(math.exp(_naive(m, x)) for x in itertools.product(range(7), repeat=3))
    assert abs(total - 1) < 1e-9
    assert forward(m, tokens, np.zeros(0, int), np.zeros(0, int), np.zeros((0, 3)))[0].shape == (0, 3)


def test_markov_counts_and_base_score(spark, odd, odd_rows):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    found = score_texts(odd, held, settings=SMALL).collect()
    tokens = [(d, plain.blank_words(plain.lower(t)) + [None]) for d, t in odd_rows]
    train = Counter(w for d, words in tokens if d is None or _crc(d, 5) != 1 for w in words)
    n, v = sum(train.values()), len(train)
    want = defaultdict(list)
    for d, words in tokens:
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want[d].append((d is not None and _crc(d, 5) == 1, len(words), sum(train[w] > 0 for w in words), n, round(base, 5)))
    got = defaultdict(list)
    for r in found:
        got[r["doc_id"]].append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}
    assert all(r["score"] < 0 for r in found)


def test_markov_beats_word_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
    r = found.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_markov_edge_tables(empty, odd):
    assert score_texts(empty, F.lit(False), settings=SMALL).count() == 0
    nothing = score_texts(odd, F.lit(True), settings=SMALL)
    assert nothing.agg(F.max("n_known"), F.max("train_tokens")).first() == (0, 0)


@pytest.fixture(scope="module")
def reference_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_tokens_equal_the_tokenizer(odd_rows, document_rows, reference_ids):
    texts = ["it's we'll 12a3b!?c", "<|endoftext|> a", "x̂é. Ça1é2 naïve×3 ÷é! «oui»", "İx 日本語, ok", "<|ENDOFTEXT|>", "ﬁ½²"]
    texts += [t or "" for _, t in odd_rows if len(t or "") < 9000] + [r[1] for r in document_rows]
    ids, offsets = WordTokenizer(tokenizer_path("word_bpe_49k.json")).encode([t.encode() for t in texts])
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(offsets)] == [reference_ids(t) for t in texts]


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 3, 40, 4), Limits(16, 1, 16, 1), Limits(32, 8, 5, 8)])
def test_pack_holds_every_token_once(limits):
    rng = np.random.default_rng(2)
    lengths = np.concatenate([rng.integers(1, 200, 150), [5000, 1, 16, 64, 2048]])
    loss_from = np.minimum(lengths, rng.integers(0, 60, len(lengths)))
    seen = defaultdict(list)
    for sequence in pack(lengths, loss_from, limits):
        assert sum(n for _, _, n in sequence) <= limits.tokens and len(sequence) <= limits.segments
        assert sum(max(0, s + n - max(s, loss_from[i])) for i, s, n in sequence) <= limits.loss_tokens
        for i, s, n in sequence:
            seen[i].append((s, n))
    for i, pieces in seen.items():
        pieces.sort()
        assert [s for s, _ in pieces] == [0, *itertools.accumulate(n for _, n in pieces)][:-1] and sum(n for _, n in pieces) == lengths[i]
    assert len(seen) == len(lengths)


def test_packing_rows(spark, odd, odd_rows, empty, reference_ids):
    found = pack_documents(odd, with_ids=True, group_bytes=50_000).collect()
    assert pack_documents(empty).count() == 0
    want = Counter((d, tuple([*reference_ids(t), 1])) for d, t in odd_rows)
    by_sequence, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], np.frombuffer(r["ids"], "<u4")))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) <= 2048
    assert sum(n * k for n, k in ((len(i), c) for (_, i), c in want.items())) == sum(r["length"] for r in found)
    for (d, ids), count in want.items():
        held = sorted(pieces[d, len(ids)], key=lambda x: x[0])
        assert sum(len(x) for _, x in held) % len(ids) == 0
        if count == 1 and sum(len(x) for _, x in held) == len(ids):
            assert np.concatenate([x for _, x in held]).tolist() == list(ids)


@pytest.mark.parametrize("partitions,most", [(1, 0.005), (211, 0.01)])
def test_little_padding_however_rows_are_cut(spark, partitions, most):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(partitions)
    parts = defaultdict(list)
    for r in pack_documents(docs, group_tails=100).select("sequence_id", "offset", "length").collect():
        parts[r[0]].append((r[1], r[2]))
    for p in parts.values():
        p.sort()
        assert [o for o, _ in p] == [0, *itertools.accumulate(n for _, n in p)][:-1] and len(p) <= 64
    used = [sum(n for _, n in p) for p in parts.values()]
    assert max(used) <= 2048 and 1 - sum(used) / (2048 * len(used)) < most


def test_tails_by_the_dot_product_rule():
    """Against the rule written out; every tail is in one bin, and no two bins of few tails fit together."""
    rng = np.random.default_rng(3)
    limits = Limits(100, 5, 60)
    demand = np.stack([rng.integers(1, 90, 80), rng.integers(1, 4, 80), rng.integers(0, 50, 80)], 1)
    bounds = np.array([100, 5, 60])
    rest, want = sorted(range(80), key=lambda i: -demand[i][0]), []
    while rest:
        inside, left = [rest.pop(0)], None
        while True:
            left = bounds - sum(demand[i] for i in inside)
            fits = [i for i in rest if (demand[i] <= left).all()]
            if not fits:
                break
            best = max(fits, key=lambda i: (demand[i] * left / bounds**2).sum())
            inside.append(best)
            rest.remove(best)
        want.append(inside)
    got = merge_tails(demand, limits)
    assert sorted(i for b in got for i in b) == list(range(80))
    assert [sorted(b) for b in got] == [sorted(b) for b in want]


def test_prompts_bear_no_loss(spark):
    docs = spark.createDataFrame([(1, "a b c d", 3), (2, "e f", None), (3, None, 9)], "doc_id long, text string, prompt int")
    got = {r["doc_id"]: r["loss_tokens"] for r in pack_documents(docs, prompt_col="prompt").collect()}
    assert got == {1: 2, 2: 3, 3: 0}


PAGES = [
    (5, "http://a.example/x?q=1", "<p>same</p>"), (3, "http://b.example/", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "http://c.example/ü y\r\n", "ünï"),
    (2, "u", None), (4, "v", ""), (7, "w", "x" * 3_000_000), (None, "n", "alone"), (None, "n", "<p>same</p>"), (8, "r", "again"), (8, "r", "again"), (8, "r", "\r\n\r\n"),
]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, digest string")
    folder = str(tmp_path / "one")
    manifest = write_warc(pages, folder, file_bytes=2_000, shards=3)
    rows = read_warc(manifest, with_payload=True).collect()
    first = {}
    for d, _, h in PAGES:
        h = (h or "").encode()
        first[h] = min(x for x in (first.get(h), d) if x is not None) if (first.get(h), d) != (None, None) else None
    want = Counter()
    for d, _, h in PAGES:
        h = (h or "").encode()
        revisit = first[h] is not None and d != first[h]
        digest = base64.b32encode(hashlib.sha1(h).digest()).decode()
        want[d, len(h), digest, "revisit" if revisit else "response", first[h] if revisit else None, None if revisit else h] += 1
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"]) if r["payload"] else r["payload"] if r["payload"] is None else b"") for r in rows)
    assert got == want
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES) and not (tmp_path / "one" / "_temporary").exists()
    other = str(tmp_path / "two")
    write_warc(pages.repartition(7), other, file_bytes=2_000, shards=3)
    files = sorted(p.name for p in (tmp_path / "one").glob("*.warc.gz"))
    assert files == sorted(p.name for p in (tmp_path / "two").glob("*.warc.gz")) and len(files) > 1
    assert all((tmp_path / "one" / f).read_bytes() == (tmp_path / "two" / f).read_bytes() for f in files)
    assert read_warc(write_warc(pages.limit(0), str(tmp_path / "none"))).count() == 0


def test_warc_notices_damage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    manifest = write_warc(pages, str(tmp_path / "w"))
    path = next((tmp_path / "w").glob("*.warc.gz"))
    import gzip

    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"text\r\n\r\n", b"tixt\r\n\r\n")))
    with pytest.raises(Exception, match="does not match"):
        read_warc(manifest).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    got = permuted(np.arange(n), n, 99)
    assert sorted(got.tolist()) == list(range(n))
    if n > 900:
        assert (permuted(np.arange(n), n, 100) != got).any() and (np.diff(got) == 1).mean() < 0.05


def test_training_order(spark, odd, odd_rows, empty, tmp_path, reference_ids):
    s = OrderSettings(sequence=64, least_shards=5, block_bytes=20_000)
    slots, manifest = materialise(odd, str(tmp_path / "t"), settings=s)
    rows = sorted(slots.collect(), key=lambda r: r["slot"])
    n = len(rows)
    assert [r["slot"] for r in rows] == list(range(n))
    per_shard = -(-n // 5)
    ids = read_slots(str(tmp_path / "t"), 0, n, per_shard, 64)
    assert [zlib.crc32(x.tobytes()) for x in ids] == [r["ids_crc32"] for r in rows]
    assert all(r["shard"] == r["slot"] // per_shard and r["byte_offset"] == r["slot"] % per_shard * 128 for r in rows)
    assert (read_slots(str(tmp_path / "t"), per_shard - 2, 5, per_shard, 64) == ids[per_shard - 2 : per_shard + 3]).all()
    want = Counter(i for _, t in odd_rows for i in [*reference_ids(t), 1])
    assert Counter(i for x, r in zip(ids, rows, strict=True) for i in x[: r["n_tokens"]].tolist()) == want
    assert {d for r in rows for d in r["doc_ids"]} == {d for d, _ in odd_rows}
    assert manifest.agg(F.sum("records")).first()[0] == n
    assert materialise(empty, str(tmp_path / "e"), settings=s)[0].count() == 0


def test_queries_are_registered(spark):
    from docaudit.llm.queries import QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert QUERIES["op8_training_order"](spark, SF).count() > 0


@pytest.mark.parametrize("ranges", [2, 7, 1 << 14])
def test_shards_of_uneven_ids(spark, ranges):
    """Far outliers, negative ids, one id with a third of the rows, and null ids: no shard is much heavier than asked."""
    from docaudit.llm.shard_files import cut_shards

    keys = [*range(1, 2001), 10**12, -(2**62), 2**62, *[777] * 1000, *[None] * 500]
    df = spark.createDataFrame([(k, f"d{i}", 9) for i, k in enumerate(keys)], "id long, digest string, size long").repartition(3)
    found = cut_shards(df, "id", F.col("size"), 8, 1000, ranges)
    rows = df.withColumn("shard", found.of(F.col("id"), F.col("digest"))).collect()
    weight, ends = Counter(), defaultdict(list)
    for r in rows:
        weight[r["shard"]] += r["size"] + 1
        if r["id"] is not None:
            ends[r["shard"]].append(r["id"])
    assert set(weight) <= set(range(found.count)) and max(weight.values()) <= 1700
    single = {s for s, x in ends.items() if set(x) == {777}}
    assert len(single) >= 9
    ordered = [ends[s] for s in sorted(ends) if s not in single]
    assert all(max(a) < min(b) for a, b in itertools.pairwise(ordered))
    nothing = cut_shards(df.limit(0), "id", F.col("size"), 8, 1000, ranges)
    assert nothing.count == 0 and df.limit(0).withColumn("s", nothing.of(F.col("id"), F.col("digest"))).count() == 0


def test_rank_by_halving(spark):
    from docaudit.llm.shard_files import rank

    for starts in ([5], [1, 5], [1, 5, 9], list(range(0, 1000, 7))):
        got = spark.range(-3, 1010).select("id", rank(F.col("id"), starts).alias("r")).collect()
        assert all(r["r"] == sum(s <= r["id"] for s in starts) - 1 for r in got)
