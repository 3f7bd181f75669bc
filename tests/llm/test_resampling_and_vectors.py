"""Importance resampling, lattice near-duplicates and vector codes against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import plain
import pytest
from plain import SF
from pyspark.sql import functions as F

from docaudit.llm import importance, vector_codes
from docaudit.llm.importance import ResampleSettings, Scanner, buckets_of, composed, importance_resample
from docaudit.llm.lattice_dedup import LatticeSettings, e8_neighbours, near_embeddings, nearest_e8
from docaudit.llm.vector_codes import CodeSettings, compress_vectors

# ---- importance resampling


def _features(text, longest, buckets):
    w = [x.encode() for x in plain.alnum_words(text)]
    return [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def _resampled(rows, items, s):
    source, target = Counter(), Counter()
    for _, text in rows:
        source.update(_features(text, s.longest, s.buckets)[0])
    for text in items:
        target.update(_features(text, s.longest, s.buckets)[0])
    all_s, all_t = source.total(), target.total()
    out = []
    for d, text in rows:
        found, n_words = _features(text, s.longest, s.buckets)
        weight = sum(
            math.floor(1000 * math.log((target[b] + 1) * (all_s + s.buckets) / ((source[b] + 1) * (all_t + s.buckets)))) for b in found
        )
        h = int(hashlib.sha256(f"{s.seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((d, n_words, len(found), weight, score))
    out.sort(key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = [r for r in out if r[1] >= s.least_words]
    drawn = drawn[: len(drawn) * s.percent // 100]
    return out, [r[:5] for r in drawn]


@pytest.mark.parametrize("longest,dictionary", [(1, 1 << 18), (3, 50), (2, 0)])
def test_resampling(odd, odd_rows, spark, longest, dictionary):
    s = ResampleSettings(longest=longest, dictionary=dictionary, buckets=101, percent=35)
    items = ["w1 w2 w3 W4", None, "", "a shared line that is long", "ünïcode too"]
    target = spark.createDataFrame([(t, "x") for t in items], "text string, doc_id string")
    found = [tuple(r) for r in importance_resample(odd, target, settings=s).collect()]
    every, drawn = _resampled(odd_rows, items, s)
    assert Counter(r[:5] for r in found) == Counter(every)
    ranked = sorted((r for r in found if r[5] is not None), key=lambda r: r[5])
    assert [r[5] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [r[4] for r in ranked] == [r[4] for r in drawn]
    assert Counter(r[:5] for r in ranked) == Counter(drawn)


def test_resampling_of_empty_tables(spark, empty, odd):
    assert importance_resample(empty, odd).count() == 0
    assert importance_resample(empty, empty).count() == 0
    nothing = importance_resample(odd, empty, settings=ResampleSettings(percent=0))
    assert nothing.where("rank is not null").count() == 0 and nothing.count() == odd.count()


@pytest.mark.parametrize("stretch", [1 << 20, 40])
@pytest.mark.parametrize("known", [[], ["foo", "é"], ["foo", "bar", "b" * 500]])
def test_scanner_reads_every_word(monkeypatch, stretch, known):
    monkeypatch.setattr(importance, "_STRETCH", stretch)
    texts = ["Foo foo,bar  é", "", "b" * 500 + ".x", "\n\n", "bar\x00FOO-é1 " * 30, "foo"]
    scanner, got = Scanner([w.encode() for w in known]), [[] for _ in texts]
    for bucket, text, _ in buckets_of(scanner, [t.encode() for t in texts], 3, 997):
        for b, t in zip(bucket, text, strict=True):
            got[t].append(int(b))
    assert [sorted(x) for x in got] == [sorted(_features(t, 3, 997)[0]) for t in texts]


def test_crc_of_parts():
    parts = [(b"", b"a"), (b"ab", b""), (b"hello ", b"world" * 100), (bytes(range(256)), b"\x00" * 70_000)]
    left, right = (np.array([zlib.crc32(p[i]) for p in parts], np.uint32) for i in (0, 1))
    assert list(composed(left, right, np.array([len(b) for _, b in parts]))) == [zlib.crc32(a + b) for a, b in parts]


# ---- lattice near-duplicates


def _at(rng, x, c):
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(-1, keepdims=True) * x
    return c * x + math.sqrt(1 - c * c) * z / np.linalg.norm(z, axis=-1, keepdims=True)


def _linked(rows, least):
    """[(id, links, component)] by comparing every pair; null ids count as none."""
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    scaled = [[x / max(map(abs, v)) for x in v] if ok else v for ok, (_, v) in zip(fine, rows, strict=True)]
    part, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, a in enumerate(scaled):
        for j, b in enumerate(scaled[:i]):
            if fine[i] and fine[j] and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                links[i] += 1
                links[j] += 1
                part[root(i)] = root(j)
    least_id = {}
    for i, (d, _) in enumerate(rows):
        least_id[root(i)] = min((x for x in (least_id.get(root(i)), d) if x is not None), default=None)
    return Counter((d, links[i], least_id[root(i)], d == least_id[root(i)]) for i, (d, _) in enumerate(rows))


def test_lattice_points():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 8)) * 2
    near, steps = nearest_e8(x), e8_neighbours()
    assert len(steps) == 240 and np.allclose((steps**2).sum(1), 2)
    doubled = near * 2
    assert (doubled % 2 == doubled[:, :1] % 2).all() and (near.sum(1) % 2 == 0).all()
    # No point one shortest step away is nearer, which for E8 means that none is.
    assert (((x - near) ** 2).sum(1)[:, None] <= ((x[:, None] - near[:, None] - steps) ** 2).sum(-1) + 1e-9).all()


def test_links_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, 16))
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    rows = [(1, None), (2, []), (3, [0.0] * 16), (4, [float("nan")] * 16), (5, [None] + [1.0] * 15), (6, [float("inf")] + [1.0] * 15)]
    rows += [(i, list(a)) for i in (20, 21, 21, 22)] + [(None, list(a * 1e200)), (30, list(b)), (None, list(b)), (31, list(-b))]
    rows += [(40 + i, list(_at(rng, a, 0.985))) for i in range(30)] + [(80, list(a[:8])), (81, list(a[:8])), (90, list(b * 1e-200))]
    rows += [(None, list(rng.standard_normal(16)))]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, u string, rid int").repartition(3)
    assert Counter(tuple(r) for r in near_embeddings(df).collect()) == _linked(rows, 0.9)
    empty = near_embeddings(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_text_ids_and_single_precision(spark):
    a = [float(x) for x in np.random.default_rng(4).standard_normal(12)]
    df = spark.createDataFrame([("b", a), ("a", a), ("c", [-x for x in a])], "vec_id string, embedding array<float>")
    assert sorted(tuple(r) for r in near_embeddings(df).collect()) == [("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]


@pytest.mark.parametrize("cosine,least", [(0.901, 0.9), (0.92, 0.95), (0.95, 0.985)])
def test_recall_near_the_threshold(spark, cosine, least):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    both = np.concatenate([x, _at(rng, x, cosine)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    found = near_embeddings(df).agg(F.sum("n_links")).first()[0]
    assert least - 0.05 <= found / 2400 <= 1


def test_families_wider_than_a_ball(spark):
    """Members link with some of the others only; packs of a few members, so that balls are cut."""
    rng = np.random.default_rng(7)
    rows = []
    for centre in rng.standard_normal((4, 32)):
        centre /= np.linalg.norm(centre)
        rows += [_at(rng, centre, c) for c in rng.uniform(0.93, 0.995, 60)]
    rows = [(i, v.tolist()) for i, v in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    settings = LatticeSettings(pack=7, tables=16, probes=8)
    got = {r["vec_id"]: tuple(r) for r in near_embeddings(df, settings=settings).collect()}
    want = {r[0]: r for r in _linked(rows, 0.9)}
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(r[1] for r in got.values()) >= 0.99 * sum(r[1] for r in want.values())


# ---- vector codes


def _codes(rows, s):
    """rows: (id, label, vector) -> [(id, code, error, label error, hash)] by full comparisons."""
    z = [(d, lab, [math.floor(s.scale * x) for x in v]) for d, lab, v in rows]
    width = len(z[0][2]) // s.parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(z, key=lambda r: (r[0] is None, r[0], r[2]))[: s.entries]
    books = [[cut(v, p) for *_, v in first] for p in range(s.parts)]

    def nearest(p, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(s.rounds):
        for p in range(s.parts):
            groups = {}
            for *_, v in z:
                groups.setdefault(nearest(p, cut(v, p))[1], []).append(cut(v, p))
            for e, g in groups.items():
                books[p][e] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    told = []
    for d, lab, v in z:
        best = [nearest(p, cut(v, p)) for p in range(s.parts)]
        told.append((d, lab, "".join(f"{e:02x}" for _, e in best), sum(x for x, _ in best)))
    by_label = Counter()
    for _, lab, _, error in told:
        by_label[lab] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter((d, code, error, by_label[lab], digest) for d, lab, code, error in told)


@pytest.mark.parametrize("parts,entries,rounds", [(4, 5, 6), (2, 1, 3), (1, 30, 2), (4, 3, 0)])
def test_vector_codes(spark, parts, entries, rounds):
    rng = np.random.default_rng(9)
    good = [(i, [None, 1, 2][i % 3], rng.normal(i % 4, 0.3, 8).tolist()) for i in range(5, 120)]
    good += [(None, None, [0.5] * 8), (7, 1, [0.25] * 8), (200, 2, good[3][2]), (201, 2, good[3][2]), (201, 2, good[3][2])]
    bad = [(1, 1, None), (2, 1, [float("nan")] * 8), (3, 2, [None] * 8), (4, 2, [float("inf")] * 8), (300, 1, [1.0] * 4), (301, 1, [])]
    df = spark.createDataFrame([(*r, "x", 2) for r in good + bad], "vec_id long, label int, embedding array<double>, code string, v int")
    s = CodeSettings(parts=parts, entries=entries, rounds=rounds)
    assert Counter(tuple(r) for r in compress_vectors(df.repartition(5), settings=s).codes.collect()) == _codes(good, s)


def test_vector_codes_of_few_and_no_rows(spark):
    kind = "vec_id long, label int, embedding array<float>"
    few = spark.createDataFrame([(1, 1, [0.5] * 8), (2, 1, [0.5] * 8)], kind)
    found = compress_vectors(few)
    assert [r["code"] for r in found.codes.collect()] == ["00" * 8] * 2 and found.codebooks.shape == (8, 2, 1)
    assert compress_vectors(few.limit(0)).codes.count() == 0
    with pytest.raises(ValueError):
        compress_vectors(spark.createDataFrame([(1, 1, [0.5] * 9)], kind))


def test_bounds_save_comparisons():
    """The stamped bounds skip most comparisons once codebooks settle, and net moves are tighter than summed ones."""
    rng = np.random.default_rng(10)
    centres = rng.integers(-4000, 4000, (2, 6, 4))
    v = centres[:, rng.integers(0, 6, 3000)].transpose(1, 0, 2) + rng.integers(-300, 300, (3000, 2, 4))
    history = v[:6].transpose(1, 0, 2)[None].copy()
    state, compared = np.zeros((3000, 2), vector_codes._STATE), []
    for _ in range(8):
        error, n = vector_codes.assign(v, state, history)
        every = ((v[:, :, None] - history[-1]) ** 2).sum(-1)
        assert (error == every.min(-1)).all() and (state["code"] == every.argmin(-1)).all()
        compared.append(n)
        sums = vector_codes._sums(v, state["code"], 6)
        book = np.where(sums[..., -1:] > 0, sums[..., :-1] // np.maximum(sums[..., -1:], 1), history[-1])
        history = np.concatenate([history, book[None]])
    assert compared[0] == 6000 and compared[-1] < 3000
    steps = np.sqrt(((history[1:] - history[:-1]).astype(float) ** 2).sum(-1)).sum(0)
    net = np.sqrt(((history[-1] - history[0]).astype(float) ** 2).sum(-1))
    assert (net <= steps + 1e-9).all() and (net < 0.99 * steps).any()


def test_queries_on_the_small_tables(spark):
    from docaudit.llm.queries import QUERIES

    assert QUERIES["op12_lattice_dedup"](spark, SF).where("n_links > 0 and kept is null").count() == 0
    drawn = QUERIES["op11_importance_resampling"](spark, SF)
    assert drawn.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert re.fullmatch("[0-9a-f]{16}", QUERIES["op13_vector_codes"](spark, SF).first()["code"])
