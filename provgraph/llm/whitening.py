"""Whitening of embeddings by the eigenvectors of their covariance.

Entries become integers, x = floor(64 c) + 1,000,000, so counts, sums and deviations are exact.

1. Every task adds up its vectors; n and the sums S are exact integers.
2. Every task centres its vectors (n x - S is exact, then one division) and adds their outer products in bands of
   `BAND` rows; bands are added in two steps, so no task gathers one band of all tasks.
3. On the d x d scatter: Cholesky with the largest remaining diagonal entry as the next pivot, then one-sided Jacobi
   on the columns of the triangular factor until all are orthogonal. Squared norms of the columns are the
   eigenvalues of the scatter, the normalised columns (rows put back in order) the components.
4. Every task projects its vectors and adds up the covariance of what comes out, for `identity_error`.
5. Every task emits its rows.

Only d sums and d x d products reach the driver (32 KB for 64 dimensions, 8 MB for 1,024), whatever the number of vectors; vectors
are never shuffled. A component's sign is such that its entry of the largest size is positive.

Dropped: vectors that are null or empty, hold null or non-finite entries or entries of a size of `LIMIT` / 64 or more, or have
another length than most vectors have (of equally frequent lengths the longest counts). Components end where the
covariance has no more rank, so equal vectors, a single one, and an empty table give no rows. Null and repeated ids
are kept as they are; repeated rows count as often as they occur. deviation is null where it does not fit a long.
Other columns are not read.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 64, 1_000_000
LIMIT = 1 << 43
COMPONENTS = 32
BAND = 16
CELLS = 1 << 19  # entries that are worked on at once
FAN = 512


def _entries(batch: pa.RecordBatch, dim: int | None = None):
    """(ids, integer vectors) of the rows that remain, of one length at a time and in blocks of CELLS entries."""
    lengths = pc.list_value_length(batch.column("embedding"))
    for d in [dim] if dim else sorted(x for x in set(lengths.to_pylist()) if x):
        rows = batch.filter(pc.fill_null(pc.equal(lengths, d), False))
        for lo in range(0, rows.num_rows, max(1, CELLS // d)):
            cut = rows.slice(lo, max(1, CELLS // d))
            c = cut.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
            whole = (np.abs(c) < LIMIT / SCALE).all(axis=1)  # false for what is not a number, and for null, which reads as that
            yield cut.column("vec_id").filter(pa.array(whole)), np.floor(SCALE * c[whole]).astype(np.int64) + SHIFT


def _sums(batches):
    found: dict[int, list] = {}
    for batch in batches:
        for _, x in _entries(batch):
            n, s = found.get(x.shape[1], (0, np.zeros(x.shape[1], dtype=object)))
            found[x.shape[1]] = n + len(x), s + x.sum(axis=0).astype(object)
    for dim, (n, s) in found.items():
        yield pa.RecordBatch.from_pydict({"dim": [dim], "n": [n], "sums": pa.array([[Decimal(int(v)) for v in s]], pa.list_(pa.decimal128(38, 0)))})


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, as integers of 64 bits where they fit, else of any size."""
    mean = np.array([s // n for s in sums])
    d = x - mean
    rest = np.array([s % n for s in sums])
    big = len(d) and (int(np.abs(d).max()) + 1) * n >= 1 << 62
    return d.astype(object) * n - rest.astype(object) if big else d * n - rest


def _deviation(d: np.ndarray) -> list[int | None]:
    if d.dtype != object and (not len(d) or int(np.abs(d).max()) ** 2 * d.shape[1] < 1 << 63):
        return (d * d).sum(axis=1).tolist()
    found = [sum(int(v) ** 2 for v in row) for row in d]
    return [v if v < 1 << 63 else None for v in found]


def _banded(total: np.ndarray):
    part = TaskContext.get().partitionId()
    for lo in range(0, len(total), BAND):
        yield pa.RecordBatch.from_pydict({"part": [part], "lo": [lo], "cells": [total[lo : lo + BAND].ravel().tolist()]})


def _add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = None
    for cells in table["cells"]:
        v = cells.values.to_numpy()
        total = v.copy() if total is None else total + v
    return pa.table({"part": [0], "lo": [key[0].as_py()], "cells": [total.tolist()]})


def _total(vectors: DataFrame, task, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all tasks of the matrix that task makes of its batches."""
    kind = "part long, lo long, cells array<double>"
    bands = vectors.mapInArrow(task, kind).withColumn("part", F.col("part") % FAN)
    once = bands.groupBy("lo", "part").applyInArrow(_add, kind)
    out = np.zeros(shape)
    for r in once.groupBy("lo").applyInArrow(_add, kind).collect():  # shape[0] / BAND rows
        band = np.array(r["cells"]).reshape(-1, shape[1])
        out[r["lo"] : r["lo"] + len(band)] = band
    return out


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(l, order): a[order][:, order] = l l'. l has as many columns as a has rank."""
    a, d = a.copy(), len(a)
    order, l, rank = np.arange(d), np.zeros_like(a), 0
    least = d * np.finfo(float).eps * max(0.0, a.diagonal().max(initial=0))
    for k in range(d):
        rest = a.diagonal()[k:]
        p = k + int(rest.argmax())
        if a[p, p] <= least:
            break
        for m in (a, l):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        l[k, k] = np.sqrt(a[k, k])
        l[k + 1 :, k] = a[k + 1 :, k] / l[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(l[k + 1 :, k], l[k + 1 :, k])
        rank += 1
    return l[:, :rank], order


def one_sided_jacobi(l: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """l with its columns rotated two by two until all are orthogonal; each round takes disjoint pairs."""
    u, r = l.copy(), l.shape[1]
    ring = list(range(r + r % 2))  # an odd number gets a bye
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], ring[::-1]) if max(a, b) < r]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = np.array(pairs, dtype=int).reshape(-1, 2).T
            x, y = u[:, p], u[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            off = np.abs(xy) / np.maximum(np.sqrt(xx * yy), np.finfo(float).tiny)
            worst = max(worst, off.max(initial=0))
            turn = off > 1e-16
            zeta = np.where(turn, yy - xx, 0.0) / np.where(turn, 2 * xy, 1.0)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            u[:, p], u[:, q] = c * (x - t * y), c * (t * x + y)
        if worst < 1e-15:
            break
    return u


def principal(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix without negative ones, as far as its rank goes."""
    l, order = pivoted_cholesky(scatter)
    u = one_sided_jacobi(l)
    norms = np.sqrt((u * u).sum(axis=0))
    fall = np.argsort(-norms, kind="stable")
    fall = fall[norms[fall] > 0]
    vectors = np.zeros((len(scatter), len(fall)))
    vectors[order] = u[:, fall] / norms[fall]
    biggest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(fall))] if len(fall) else np.zeros(0)
    return norms[fall] ** 2, vectors * np.where(biggest < 0, -1.0, 1.0)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row a vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sums = common.written(vectors.mapInArrow(_sums, "dim long, n long, sums array<decimal(38,0)>"), "whiten-sums")
    top = sums.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if not top or not top["n"]:
        return embeddings.sparkSession.createDataFrame([], schema)
    dim, n = top["dim"], top["n"]
    each = sums.filter(F.col("dim") == dim).select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    total = [int(r["s"]) for r in each.orderBy("at").collect()]  # one row a dimension
    common.drop_written(sums)

    def centred(batches):
        for batch in batches:
            for ids, x in _entries(batch, dim):
                d = _centred(x, n, total)
                yield ids, d, (d / n).astype(float)

    def scatter(batches):
        out = np.zeros((dim, dim))
        for _, _, y in centred(batches):
            out += y.T @ y
        yield from _banded(out)

    values, axes = principal(_total(vectors, scatter, (dim, dim)))
    trace = float(values.sum())
    values, axes = values[:components], axes[:, :components]
    if not len(values):
        return embeddings.sparkSession.createDataFrame([], schema)
    k, weights, share = len(values), axes / np.sqrt(values / n), (values / trace).tolist()

    def identity(batches):
        """Products of whitened vectors, and in the last row their sums."""
        out = np.zeros((k + 1, k))
        for _, _, y in centred(batches):
            w = y @ weights
            out[:k] += w.T @ w
            out[k] += w.sum(axis=0)
        yield from _banded(out)

    products = _total(vectors, identity, (k + 1, k))
    mean = products[k] / n  # nought but for rounding
    error = float(np.abs(products[:k] / n - np.outer(mean, mean) - np.eye(k)).max())

    def emit(batches):
        for ids, d, y in centred(batches):
            if len(d):
                w, far = y @ weights, pa.array(_deviation(d), pa.int64())
                again = pa.array(np.repeat(np.arange(len(d)), k))
                numbers = np.tile(np.arange(1, k + 1, dtype=np.int32), len(d))
                same = lambda v, kind: pa.array(np.full(len(numbers), v, dtype=kind))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(again), pa.array(numbers), same(n, np.int64), far.take(again), pa.array(w.ravel()), pa.array(np.tile(share, len(d))), same(error, float)],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(emit, schema)
