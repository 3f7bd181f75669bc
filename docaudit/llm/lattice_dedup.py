"""Near duplicates of embeddings by lattice hashing.

A table projects vectors on random directions, eight at a time, and takes the nearest point of the E8 lattice for each
eight. Vectors of a small angle mostly meet in one point or in neighbouring ones, so each vector is filed under its own
cell of every table and looks up some neighbouring cells, those whose points are next nearest. What meets is verified.

Groups of copies are not compared pair by pair:

1. Vectors in one fine cell are compared with the cell's first one. All within half the angle of it are its ball:
   any two of them are within the whole angle, by the triangle inequality, so they link without a comparison.
2. The lattice tables find pairs of balls (mostly single vectors), each pair once however many members meet.
   A 64-bit sketch of signs keeps most unlike pairs of single vectors away from the exact comparison.
3. A pair of balls is decided by its two first members where possible: too far apart, or so near that all members
   link. Else members are compared in packs of bounded size, which give counts, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.arrays import mix
from docaudit.llm.components import connected_components
from docaudit.llm.vector_codes import finite
from docaudit.shared import discard, written

_ROUNDING = 1e-9


@dataclass(frozen=True)
class LatticeSettings:
    """Vectors link at cosine >= ``least``.

    ``tables`` of ``lattices`` E8 points each, on directions scaled by ``scale``; ``probes`` neighbouring cells. Balls come
    from ``rounds`` of ``fine_tables`` with ``fine_lattices`` points. Single vectors whose sketches
    differ in more than ``sketch_bits`` of 64 are not compared (one pair in 10^5 at cosine 0.9). ``pack``: members compared at once.
    """

    least: float = 0.9
    tables: int = 8
    lattices: int = 2
    scale: float = 0.5
    probes: int = 4
    fine_tables: int = 8
    fine_lattices: int = 3
    rounds: int = 2
    sketch_bits: int = 22
    pack: int = 256
    seed: int = 8

    def __post_init__(self):
        if not 0.5 <= self.least <= 1:
            raise ValueError("need 0.5 <= least <= 1")


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(-1)[..., None]
    odd = near.sum(-1, keepdims=True) % 2 != 0
    step = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0) * odd
    np.put_along_axis(near, worst, np.take_along_axis(near, worst, -1) + step, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 to each row: integer points with an even sum, or those moved by one half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(-1) <= ((x - half) ** 2).sum(-1)
    return np.where(nearer[..., None], whole, half)


def e8_neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(v) for v in product((0.5, -0.5), repeat=8) if np.prod(v) > 0]
    return np.array(out)


_STEPS = e8_neighbours()


def _directions(dims: int, tables: int, lattices: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dims, tables, lattices])
    return rng.standard_normal((tables, lattices, dims, 8)), rng.random((tables, lattices, 8)) * 2


def _cell_keys(points: np.ndarray, table: int, dims: int) -> np.ndarray:
    """64-bit keys of cells [row, lattice, 8]."""
    doubled = np.rint(points * 2).astype(np.int64).astype(np.uint64).reshape(len(points), -1)
    key = np.full(len(points), table * 1_000_003 + dims, np.uint64)
    for c in doubled.T:
        key = mix(key + np.uint64(0x9E3779B97F4A7C15)) ^ mix(c)
    return mix(key).view(np.int64)


def cells(unit: np.ndarray, tables: int, lattices: int, scale: float, probes: int, seed: int) -> np.ndarray:
    """[row, table, 1 + probes]: keys of the own cell of each table and of the neighbouring cells looked up."""
    dims = unit.shape[1]
    directions, offsets = _directions(dims, tables, lattices, seed)
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    rows = np.arange(len(unit))
    for t in range(tables):
        x = np.stack([unit @ (d * scale) + o for d, o in zip(directions[t], offsets[t], strict=True)], 1)
        own = nearest_e8(x)
        out[:, t, 0] = _cell_keys(own, t, dims)
        if not probes:
            continue
        # The point moved by one step is the nearer, the more the rest of the vector points that way.
        toward = ((x - own) @ _STEPS.T).reshape(len(unit), -1)
        best = np.argpartition(-toward, probes, axis=1)[:, :probes]
        for p in range(probes):
            moved = own.copy()
            moved[rows, best[:, p] // 240] += _STEPS[best[:, p] % 240]
            out[:, t, 1 + p] = _cell_keys(moved, t, dims)
    return out


def sketches(unit: np.ndarray, seed: int) -> np.ndarray:
    """Signs of 64 random projections as one number."""
    rng = np.random.default_rng([seed, unit.shape[1], 64])
    bits = unit @ rng.standard_normal((unit.shape[1], 64)) > 0
    return np.packbits(bits, axis=1).view(np.int64).ravel()


def units(column: pa.Array, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double precision) for each length among vectors stored as bytes."""
    raw = [x.as_py() for x in column]
    size = np.array([len(x) for x in raw], np.int64)
    out = []
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        x = np.frombuffer(b"".join(raw[i] for i in rows), kind).reshape(len(rows), -1).astype(np.float64)
        x = x / np.abs(x).max(1, keepdims=True)  # the largest component first, so that no square leaves the range
        out.append((rows, x / np.sqrt((x * x).sum(1, keepdims=True))))
    return out


class _Vectors:
    """The vectors that may link, numbered, and what is computed from them where they lie."""

    def __init__(self, base: DataFrame, kind: str, s: LatticeSettings):
        self.rows, self.kind, self.s = base.where("u is not null").select("rid", "u"), kind, s

    def fine_cells(self, rows: DataFrame, turn: int) -> DataFrame:
        """(cell, rid): the cells of one round of balls."""
        kind, s = self.kind, self.s

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rid = batch.column("rid").to_numpy()
                for part, unit in units(batch.column("u"), kind):
                    keys = cells(unit, s.fine_tables, s.fine_lattices, s.scale, 0, s.seed + 1 + turn)[:, :, 0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), pa.array(np.repeat(rid[part], s.fine_tables))], ["cell", "rid"]
                    )

        return rows.select("rid", "u").mapInArrow(run, "cell bigint, rid bigint")

    def filed(self, rows: DataFrame) -> DataFrame:
        """(cell, own, ball, alone, sketch) of all tables for rows (rid, u, ball, alone)."""
        kind, s = self.kind, self.s

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, unit in units(batch.column("u"), kind):
                    keys = cells(unit, s.tables, s.lattices, s.scale, s.probes, s.seed)
                    each = s.tables * (1 + s.probes)
                    take = pa.array(np.repeat(part, each))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys.ravel()),
                            pa.array(np.tile(np.arange(1 + s.probes) == 0, len(part) * s.tables)),
                            batch.column("ball").take(take), batch.column("alone").take(take),
                            pa.array(np.repeat(sketches(unit, s.seed), each)),
                        ],
                        ["cell", "own", "ball", "alone", "sketch"],
                    )

        return rows.mapInArrow(run, "cell bigint, own boolean, ball bigint, alone boolean, sketch bigint")

    def cosines(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b, ...) with the cosine of both vectors; null if their lengths differ."""
        a, b = (self.rows.select(F.col("rid").alias(x), F.col("u").alias(f"u{x}")) for x in ("a", "b"))
        joined = pairs.join(a, "a").join(b, "b")
        kind, names = self.kind, pairs.columns
        types = ", ".join(f"{n} {t}" for n, t in pairs.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cos = np.full(batch.num_rows, np.nan)
                size = {}
                for part, unit in units(batch.column("ua"), kind):
                    size[unit.shape[1]] = (part, unit)
                for part, unit in units(batch.column("ub"), kind):
                    own, first = size.get(unit.shape[1], (np.zeros(0, np.int64), unit))
                    both, i, j = np.intersect1d(own, part, assume_unique=True, return_indices=True)
                    cos[both] = (first[i] * unit[j]).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n) for n in names), pa.array(cos, from_pandas=True)], [*names, "cos"]
                )

        return joined.select(*names, "ua", "ub").mapInArrow(run, f"{types}, cos double")


def _balls(vectors: _Vectors, s: LatticeSettings) -> DataFrame:
    """(rid, ball, cos): vectors within half the angle of the ball's first member, other than that one."""
    tight = math.sqrt((1 + s.least) / 2) + _ROUNDING
    found: DataFrame | None = None
    for turn in range(s.rounds):
        free = vectors.rows if found is None else vectors.rows.join(found.select("rid"), "rid", "left_anti")
        filed = vectors.fine_cells(free, turn)
        firsts = filed.groupBy("cell").agg(F.min("rid").alias("first"), F.count("*").alias("n")).where("n > 1")
        firsts = written(firsts.select("cell", "first"), "fine-cells")
        tried = filed.join(firsts, "cell").where("rid > first").select(F.col("rid").alias("a"), F.col("first").alias("b")).distinct()
        near = written(vectors.cosines(tried).where(F.col("cos") >= tight), "near")
        if found is not None:  # a ball keeps its first member
            near = near.join(found.select(F.col("ball").alias("a")).distinct(), "a", "left_anti")
        inner = near.select(F.col("a").alias("b")).distinct()
        taken = near.join(inner, "b", "left_anti").groupBy(F.col("a").alias("rid")).agg(F.min(F.struct("b", "cos")).alias("x"))
        taken = taken.select("rid", F.col("x.b").alias("ball"), F.col("x.cos").alias("cos"))
        found = written(taken if found is None else found.unionByName(taken), "balls")
        discard(firsts)
    return found


def _ball_pairs(vectors: _Vectors, members: DataFrame, s: LatticeSettings) -> DataFrame:
    """Distinct pairs (a, b) of balls some members of which meet in a cell, a < b."""
    sizes = members.select(F.col("ball").alias("rid")).distinct().withColumn("many", F.lit(True))
    rows = vectors.rows.join(members.select("rid", "ball"), "rid", "left").join(sizes, "rid", "left")
    rows = rows.select("rid", "u", F.coalesce("ball", "rid").alias("ball"), (F.col("ball").isNull() & F.col("many").isNull()).alias("alone"))
    filed = vectors.filed(rows)
    # A ball counts once in a cell, however many members meet there.
    filed = filed.groupBy("cell", "ball").agg(F.max("own").alias("own"), F.max("alone").alias("alone"), F.min("sketch").alias("sketch"))
    filed = written(filed, "cells")
    homes = filed.where("own").select("cell", *[F.col(c).alias(f"{c}2") for c in ("ball", "alone", "sketch")])
    unlike = F.bit_count(F.col("sketch").bitwiseXOR(F.col("sketch2"))) > s.sketch_bits
    met = filed.join(homes, "cell").where((F.col("ball") != F.col("ball2")) & ~(F.col("alone") & F.col("alone2") & unlike))
    pairs = met.select(F.least("ball", "ball2").alias("a"), F.greatest("ball", "ball2").alias("b")).distinct()
    pairs = written(pairs, "ball-pairs")
    discard(filed)
    return pairs


def _packed(vectors: _Vectors, members: DataFrame, balls: DataFrame, s: LatticeSettings) -> DataFrame:
    """(ball, rids, us): all members of the wanted balls (ball, size), in packs of about ``pack``."""
    everyone = members.select("rid", "ball").unionByName(balls.select(F.col("ball").alias("rid"), "ball"))
    rows = everyone.join(balls, "ball").join(vectors.rows, "rid")
    pack = F.pmod(F.xxhash64("rid"), F.ceil(F.col("size") / s.pack)).alias("pack")
    packs = rows.groupBy("ball", pack).agg(F.collect_list(F.struct("rid", "u")).alias("m"))
    return packs.select("ball", F.col("m.rid").alias("rids"), F.col("m.u").alias("us"))


def _member_links(packs: DataFrame, pairs: DataFrame, kind: str, least: float) -> DataFrame:
    """(a, b, rid, links): how many members of the other ball each member links with; none without a link."""
    a, b = (packs.select(F.col("ball").alias(x), F.col("rids").alias(f"r{x}"), F.col("us").alias(f"u{x}")) for x in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                ra, rb = (np.array(batch.column(c)[i].as_py(), np.int64) for c in ("ra", "rb"))
                linked = np.zeros((len(ra), len(rb)), bool)
                of_b = {x.shape[1]: (rows, x) for rows, x in units(batch.column("ub")[i].values, kind)}
                for rows, x in units(batch.column("ua")[i].values, kind):
                    if x.shape[1] in of_b:
                        others, y = of_b[x.shape[1]]
                        linked[np.ix_(rows, others)] = x @ y.T >= least
                for rid, n in ((ra, linked.sum(1)), (rb, linked.sum(0))):
                    some = n > 0
                    out.append((np.full(some.sum(), batch.column("a")[i].as_py()), np.full(some.sum(), batch.column("b")[i].as_py()), rid[some], n[some]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b", "rid", "links"])

    met = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "ra", "rb", "ua", "ub")
    return met.mapInArrow(run, "a bigint, b bigint, rid bigint, links bigint")


def near_embeddings(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: LatticeSettings = LatticeSettings()
) -> DataFrame:
    """One row per vector: ``id_col``, n_links, component_id (smallest id reachable by links), kept (its id is that one).

    n_links counts other rows with cosine >= ``least`` in double precision, rows with an equal vector or id included;
    nothing below links. Which pairs are looked at depends on the lattice, so some near the threshold may be missed; the
    README gives the recall. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
    vectors of different length do not link with each other.

    Rows that repeat are vectors of their own. A null id counts as none for component_id, and such a row is kept
    only if no vector with an id is in its component. An empty table gives an empty result. Other columns are not read.
    """
    s = settings
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    kind = "<f4" if single else "<f8"
    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    nonzero = F.exists(vector, lambda x: x != 0)
    source = vectors.select(F.col(id_col).alias("_id"), F.when(finite(vector) & nonzero, vector).alias("v"))
    id_type = source.schema["_id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [v.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() if v.is_valid else None for v in batch.column("v")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(raw, pa.binary())], ["_id", "u"])

    base = source.mapInArrow(packed, f"_id {id_type}, u binary")
    base = written(base.withColumn("rid", F.monotonically_increasing_id()), "vectors")  # fixed once it is written
    known = _Vectors(base, kind, s)
    members = _balls(known, s)

    # Every ball, single vectors included: its size, widest angle and smallest id.
    rows = base.where("u is not null").select("rid", "_id").join(members, "rid", "left")
    balls = rows.groupBy(F.coalesce("ball", "rid").alias("ball")).agg(
        F.count("*").alias("size"), F.min("_id").alias("least"), F.max(F.acos(F.least(F.coalesce("cos", F.lit(1.0)), F.lit(1.0)))).alias("wide")
    )
    balls = written(balls, "ball-sizes")
    of_a, of_b = (balls.select(F.col("ball").alias(x), F.col("size").alias(f"size_{x}"), F.col("wide").alias(f"wide_{x}")) for x in ("a", "b"))
    pairs = known.cosines(_ball_pairs(known, members, s)).join(of_a, "a").join(of_b, "b")
    angle, slack = F.acos(F.greatest(F.least("cos", F.lit(1.0)), F.lit(-1.0))), F.col("wide_a") + F.col("wide_b")
    whole = math.acos(s.least)
    singles = (F.col("size_a") == 1) & (F.col("size_b") == 1)
    verdict = (
        F.when(F.col("cos").isNull(), F.when(singles, "none").otherwise("members"))
        .when(singles, F.when(F.col("cos") >= s.least, "all").otherwise("none"))
        .when(angle + slack <= whole - _ROUNDING, "all")
        .when(angle - slack >= whole + _ROUNDING, "none")
        .otherwise("members")
    )
    pairs = written(pairs.withColumn("verdict", verdict).where("verdict != 'none'"), "near-balls")
    full = pairs.where("verdict = 'all'")
    open_ = pairs.where("verdict = 'members'")
    wanted = open_.select(F.col("a").alias("ball"), F.col("size_a").alias("size")).union(open_.select("b", "size_b")).distinct()
    packs = written(_packed(known, members, wanted, s), "packs")
    by_member = written(_member_links(packs, open_, kind, s.least), "member-links")
    discard(packs)

    links = full.select("a", "b").union(by_member.select("a", "b").distinct())
    labels = connected_components(links)
    added = full.select(F.col("a").alias("of"), F.col("size_b").alias("n")).union(full.select("b", "size_a"))
    added = added.groupBy("of").agg(F.sum("n").alias("n"))
    named = balls.join(labels, F.col("ball") == F.col("node"), "left").join(added, F.col("ball") == F.col("of"), "left")
    named = named.select("ball", "size", "least", F.coalesce("label", "ball").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))
    named = written(named, "named-balls")
    least = written(named.groupBy("label").agg(F.min("least").alias("component")), "components")
    told = named.join(least, "label").where((F.col("size") > 1) | (F.col("n") > 0) | ~F.col("component").eqNullSafe(F.col("least")))
    told = written(told.select(F.col("ball").alias("of"), (F.col("size") - 1 + F.col("n")).alias("n"), "component"), "told")
    extra = written(by_member.groupBy(F.col("rid").alias("own")).agg(F.sum("links").alias("links")), "extra")

    # Most vectors are in none of these, so the short tables mostly go to the rows.
    rows = base.select("rid", "_id").join(members.select("rid", "ball"), "rid", "left").withColumn("ball", F.coalesce("ball", "rid"))
    rows = rows.join(told, F.col("ball") == F.col("of"), "left").join(extra, F.col("rid") == F.col("own"), "left")
    component = F.when(F.col("of").isNull(), F.col("_id")).otherwise(F.col("component"))
    rows = rows.withColumn("component_id", component)
    return rows.select(
        F.col("_id").alias(id_col), (F.coalesce("n", F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"),
        "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
