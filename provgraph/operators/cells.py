"""Nearest neighbours by an inverted file: vectors are kept by the cell of their nearest centre, and a question reads a few cells.

Centres are fitted by spherical k-means on at most `SAMPLE` vectors, taken by a hash of the id; every vector of the table is in the
index. How many cells a question probes is measured on the sample: the fewest that give `TARGET` of the exact neighbours of
sampled questions. Within the cells similarities are exact, in double precision.

Cells of many vectors or questions are dealt to several tasks of at most `ROWS` of each; there are at most `CELLS` cells, so their sizes and centres
may be broadcast. Vectors that are null, empty, zero, of another length than most, or hold null or non-finite entries are in no cell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import cut

SAMPLE, CELLS, ROUNDS, TARGET, ROWS = 20_000, 4096, 12, 0.95, 8192


@dataclass(frozen=True)
class Index:
    rows: DataFrame  # id, cell, x (unit vector, doubles)
    centres: np.ndarray
    probes: int


def _sound(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, x: usable vectors of the most frequent length, as doubles."""
    v = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)
    v = v.filter("id IS NOT NULL AND x IS NOT NULL").filter(F.coalesce(fine, F.lit(False)))
    top = v.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.filter(F.size("x") == (top["n"] if top else 0))


def _units(x: pa.Array, n: int) -> np.ndarray:
    m = x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of the sample's cells."""
    rng = np.random.default_rng(7)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, questions: int = 256) -> int:
    """The fewest cells that hold TARGET of the k nearest neighbours within the sample."""
    q = sample[: min(questions, len(sample))]
    near = sample @ q.T
    near[np.arange(len(q)), np.arange(len(q))] = -2
    top = np.argpartition(-near, min(k, len(sample) - 1) - 1, axis=0)[:k].T if len(sample) > 1 else np.zeros((len(q), 0), int)
    cell = (sample @ centres.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1), axis=1)  # of each cell, for each question
    need = np.sort(np.take_along_axis(place, cell[top], axis=1).ravel())
    return int(need[min(len(need) - 1, int(np.ceil(TARGET * len(need))))]) + 1 if len(need) else 1


def build(df: DataFrame, vec_id: str, vector: str, k: int = 10, cells: int | None = None) -> Index:
    v = _sound(df, vec_id, vector)
    total = v.count()
    share = min((1 << 63) - 1, int(SAMPLE * 0.95 / max(1, total) * (1 << 63)))
    picked = v.filter(F.xxhash64("id").bitwiseAND(F.lit((1 << 63) - 1)) <= share).orderBy(F.xxhash64("id")).limit(SAMPLE)
    rows = picked.select("x").toArrow()  # at most SAMPLE vectors
    if not rows.num_rows:
        return Index(cut(v.select("id", F.lit(0).alias("cell"), "x")), np.zeros((1, 1)), 1)
    sample = _units(rows["x"].combine_chunks(), rows.num_rows)
    centres = fit(sample, cells or int(min(CELLS, len(sample), max(4, round(np.sqrt(total) / 2)))))

    def assign(batches):
        for b in batches:
            if b.num_rows:
                x = _units(b.column("x"), b.num_rows)
                near = (x @ centres.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(near), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "cell", "x"])

    return Index(cut(v.mapInArrow(assign, "id long, cell int, x binary")), centres, probes_for(sample, centres, k))


def _best(k: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        q, r = (np.frombuffer(b"".join(t["x"].to_pylist()), dtype=float).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1)) for t in (left, right))
        out_q, out_r, out_s = [], [], []
        if len(q) and len(r):
            ids = right["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, r = ids[order], r[order]
            own = left["id"].to_numpy()
            for lo in range(0, len(q), 512):
                s = q[lo : lo + 512] @ r.T
                s[own[lo : lo + 512, None] == ids] = -2
                first = np.argsort(-s, axis=1, kind="stable")[:, :k]  # equal similarities by id
                keep = np.take_along_axis(s, first, axis=1)
                i, j = np.nonzero(keep > -2)
                out_q.append(own[lo + i])
                out_r.append(ids[first[i, j]])
                out_s.append(keep[i, j])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"id": join(out_q, np.int64), "neighbour": join(out_r, np.int64), "similarity": join(out_s, float)})

    return run


def neighbours(index: Index, questions: DataFrame, k: int = 10) -> DataFrame:
    """id, neighbour, similarity, rank: the k nearest others of each question (id; a vector of the index)."""
    centres, probes = index.centres, min(index.probes, len(index.centres))
    q = index.rows.join(questions.select("id").distinct(), "id", "left_semi")

    def spread(batches):
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column("x").to_pylist()), dtype=float).reshape(b.num_rows, -1)
                near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                at = pa.array(np.repeat(np.arange(b.num_rows), probes))
                yield pa.RecordBatch.from_arrays([b.column("id").take(at), pa.array(near.ravel()), b.column("x").take(at)], names=["id", "cell", "x"])

    asked = cut(q.mapInArrow(spread, "id long, cell int, x binary"))
    size = lambda t, name: t.groupBy("cell").agg(F.ceil(F.count("*") / ROWS).alias(name))
    sizes = F.broadcast(size(index.rows, "parts").join(size(asked, "turns"), "cell"))  # a row a cell
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    right = index.rows.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).withColumn("turn", number("turns")).select("cell", "part", "turn", "id", "x")
    left = asked.join(sizes, "cell").withColumn("turn", F.pmod(F.xxhash64("id"), "turns")).withColumn("part", number("parts")).select("cell", "part", "turn", "id", "x")
    keys = ["cell", "part", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best(k), "id long, neighbour long, similarity double")
    w = W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
