"""Near-equal embeddings by sorted projection passes.

Vectors are hashed as they differ from the mean direction of their label: embeddings with a common mean would share nearly all
bits, and those who share them would fill the windows. Cosines are of the vectors themselves. What two linked vectors differ by weighs more
in what is left, so the number of passes follows from each label's size and spread (1 - the squared length of its mean direction).

Each pass orders the vectors of a label by 64 concatenated random hyperplane bits and compares
bounded windows of the order: every block of `BLOCK` vectors with itself and the next one, by
matrix products in double precision. Where the blocks compared last still hold a link, the
window doubles, until what is new in it holds none; so a large group of near copies is compared
throughout, in as many rounds as its size has powers of two. Links of all passes are united; a pair that an earlier pass has compared is skipped.

Tasks return counts per vector and the links of a spanning forest, never pairs. Blocks hold
equally many vectors whatever a label's share. Vectors equal in label and components are merged
first, so copies cost one row. A pair at the threshold meets in some window with probability RECALL or more, for labels of which all but the mean
spreads evenly; `MOST` passes at most, which labels reach whose typical cosine is about 0.95. There nearly all pairs are close to being linked, and windows grow.

Recall is that of the passes: a link is lost if its vectors meet in no window. Ties in the order go by id; equal
vectors are one row, so repeated rows link whatever the windows. An empty table gives no rows; other columns are not read.

Vectors that are null, empty, zero, or hold null or non-finite components, and vectors without a
label or an id, link with nothing and are components of their own. Vectors of different lengths are not compared.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

THRESHOLD = 0.98
BLOCK = 1024
RECALL = 0.98
MOST = 64
BITS = 64


def passes_for(size: Column, spread: Column) -> Column:
    """Passes for a label of this many vectors."""
    cosine = F.greatest(F.lit(0.0), 1 - (1 - THRESHOLD) / F.greatest(spread, F.lit(1 - THRESHOLD)))
    agree = 1 - F.acos(cosine) / math.pi
    meet = F.pow(agree, F.greatest(F.lit(1.0), F.log2(F.greatest(size, F.lit(1)) / BLOCK)))
    wanted = F.when(meet >= RECALL, 1).otherwise(F.ceil(math.log(1 - RECALL) / F.log(1 - F.least(meet, F.lit(RECALL)))))
    return F.least(F.lit(MOST), F.greatest(F.lit(2), wanted)).cast("int")


def _prepare(batches):
    for pdf in batches:
        out = []
        for v, y, e in zip(pdf["vec_id"].astype("object"), pdf["label"].astype("object"), pdf["embedding"]):
            x = None if e is None else np.array([math.nan if c is None else c for c in e], dtype=float)
            if x is None or not len(x) or pd.isna(y) or pd.isna(v) or not np.isfinite(x).all() or not x.any():
                out.append((v, None, None, None, None))
                continue
            x = x + 0.0  # one zero
            out.append((v, int(y), len(x), xxhash.xxh128_digest(x.tobytes()), x.tobytes()))
        frame = pd.DataFrame(out, columns=["vec_id", "label", "dim", "digest", "x"])
        for c in ("vec_id", "label", "dim"):
            frame[c] = frame[c].astype("Int64")
        yield frame


def _directions(pdf: pd.DataFrame) -> np.ndarray:
    """Unit vectors of rows of one length; scaled first, so that no square overflows."""
    x = np.frombuffer(b"".join(pdf["x"]), dtype=float).reshape(len(pdf), -1)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _sums(batches):
    found: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
    for pdf in batches:
        for key, g in pdf.groupby(["label", "dim"]):
            n, s = found.get(key, (0, 0.0))
            found[key] = n + len(g), s + _directions(g).sum(axis=0)
            if len(found) > 10_000:
                yield pd.DataFrame([(*k, n, s) for k, (n, s) in found.items()], columns=["label", "dim", "n", "sums"])
                found = {}
    yield pd.DataFrame([(*k, n, s) for k, (n, s) in found.items()], columns=["label", "dim", "n", "sums"])


def _means(rows: DataFrame) -> DataFrame:
    """label, dim, n, mean (of the directions of the label's vectors), spread."""
    sums = rows.select("label", "dim", "x").mapInPandas(_sums, "label long, dim long, n long, sums array<double>")
    each = sums.select("label", "dim", "n", F.posexplode("sums").alias("at", "s")).groupBy("label", "dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    place = F.struct("at", (F.col("s") / F.col("n")).alias("m"))
    m = each.groupBy("label", "dim").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(place)), lambda p: p["m"]).alias("mean"))  # one entry a dimension
    return m.withColumn("spread", 1 - F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x))


def _keys(passes: int):
    planes: dict[int, np.ndarray] = {}

    def run(batches):
        for pdf in batches:
            out = np.empty(len(pdf), dtype=object)
            pdf = pdf.reset_index(drop=True)
            for (_, dim), g in pdf.groupby(["label", "dim"]):
                if dim not in planes:
                    planes[dim] = np.random.default_rng(20 + dim).standard_normal((dim, BITS * passes))
                bits = (_directions(g) - np.asarray(g["mean"].iloc[0])) @ planes[dim] > 0
                packed = np.packbits(bits.reshape(len(g), passes, BITS), axis=2).view(">i8")[..., 0].astype(np.int64) ^ np.int64(-(1 << 63))
                for i, keys in zip(g.index, packed):
                    out[i] = keys
            yield pdf.drop(columns="mean").assign(keys=out)

    return run


def _number(batches):
    part, at = TaskContext.get().partitionId(), 0
    for pdf in batches:
        yield pdf.assign(part=part, at=range(at, at + len(pdf)))
        at += len(pdf)


def ordered(rows: DataFrame, key) -> DataFrame:
    """rows with block: their place in the order of (label, dim, key, id), cut every BLOCK rows; written."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = rows.withColumn("k", key).repartitionByRange(parts, "label", "dim", "k", "id").sortWithinPartitions("label", "dim", "k", "id").drop("k")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in r.schema)
    n = common.written(r.mapInPandas(_number, f"{schema}, part int, at long"), "vec-order")
    sizes = {x["part"]: x["n"] for x in n.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    base, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, base))
        base += sizes[p]
    starts = spark.createDataFrame(offsets, "part int, base long")
    return n.join(F.broadcast(starts), "part").withColumn("block", F.floor((F.col("base") + F.col("at")) / BLOCK)).drop("part", "at", "base")


def _forest(i: np.ndarray, j: np.ndarray, n: int):
    """Indices of links that join something new, by union-find within the task."""
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for at in range(len(i)):
        a, b = find(i[at]), find(j[at])
        if a != b:
            root[max(a, b)] = min(a, b)
            yield at


def _compare(key, pdf):
    """Compares the rows of a block with themselves (step 0) or with those of the block `step` further on."""
    low, step = key
    pdf = pdf.sort_values("id", kind="stable")
    out = []
    for dim, g in pdf.groupby("dim"):
        a = g[g["block"] == low]
        b = a if step == 0 else g[g["block"] == low + step]
        if not len(a) or not len(b):
            continue
        x, y = (np.frombuffer(b"".join(z["x"]), dtype=float).reshape(-1, int(dim)) for z in (a, b))
        hit = (x @ y.T) >= THRESHOLD * np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]
        hit &= a["label"].to_numpy()[:, None] == b["label"].to_numpy()[None]
        if step == 0:
            np.fill_diagonal(hit, False)
        blocks_a, blocks_b = (np.array(z["blocks"].tolist(), dtype=np.int64).reshape(len(z), -1) for z in (a, b))
        reach_a, reach_b = (np.array(z["reaches"].tolist(), dtype=np.int64).reshape(len(z), -1) for z in (a, b))
        linked = hit.any()
        for q in range(blocks_a.shape[1]):
            apart = blocks_b[None, :, q] - blocks_a[:, None, q]
            hit &= ~np.where(apart >= 0, apart <= reach_a[:, None, q], -apart <= reach_b[None, :, q])
        i, j = np.nonzero(hit)
        ida, idb = a["id"].to_numpy(), b["id"].to_numpy()
        ca, cb = a["copies"].to_numpy(), b["copies"].to_numpy()
        out += [("n", u, n) for u, n in zip(ida, hit @ cb) if n]
        if step:
            out += [("n", v, n) for v, n in zip(idb, hit.T @ ca) if n]
        both = np.unique(np.concatenate([ida, idb]))
        si, sj = np.searchsorted(both, ida[i]), np.searchsorted(both, idb[j])
        out += [("e", both[si[t]], both[sj[t]]) for t in _forest(si, sj, len(both))]
        if linked:
            out.append(("w", int(low), int(step)))
    return pd.DataFrame(out, columns=["kind", "a", "b"])


def links(rows: DataFrame, passes: int) -> tuple[DataFrame, DataFrame]:
    """rows: id, label, dim, x, copies, keys. Returns (id, n) to be summed, and links (u, v) of spanning forests."""
    found = []
    none = F.expr("cast(array() as array<bigint>)")
    rows = rows.withColumn("blocks", none).withColumn("reaches", none)
    for p in range(passes):
        placed = common.written(ordered(rows, F.col("keys")[p]), "vec-blocks")
        first, last, active, reach = 0, 0, None, None
        while True:
            steps = F.explode(F.sequence(F.lit(first), F.lit(last)).cast("array<bigint>")).alias("step")
            r = placed.select("*", steps).withColumn("low", F.col("block"))
            if first:
                r = r.unionByName(placed.select("*", steps).withColumn("low", F.col("block") - F.col("step")))
            if active is not None:
                r = r.join(active, "low", "left_semi")
            got = common.written(r.groupBy("low", "step").applyInPandas(_compare, "kind string, a long, b long"), "vec-links")
            found.append(got)
            if first:
                active = common.written(got.filter("kind = 'w'").select(F.col("a").alias("low")).distinct(), "vec-active")
                grown = active.withColumn("reach", F.lit(2 * last + 1).cast("long"))
                reach = grown if reach is None else reach.unionAll(grown)
                if not active.limit(1).count():
                    break
            first, last = max(1, last + 1), 2 * last + 1
        reach = reach.groupBy(F.col("low").alias("block")).agg(F.max("reach").alias("reach"))
        placed = placed.join(reach, "block", "left")
        rows = placed.withColumn("blocks", F.concat("blocks", F.array("block"))).withColumn("reaches", F.concat("reaches", F.array(F.coalesce("reach", F.lit(1).cast("long"))))).drop("block", "reach")
    every = found[0]
    for f in found[1:]:
        every = every.unionAll(f)
    return every.filter("kind = 'n'").select(F.col("a").alias("id"), F.col("b").alias("n")), every.filter("kind = 'e'").select(F.col("a").alias("u"), F.col("b").alias("v"))


def linked(embeddings: DataFrame) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links, component_id, kept."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    member = common.written(e.mapInPandas(_prepare, "vec_id long, label long, dim long, digest binary, x binary"), "vec-rows")
    same = ["label", "dim", "digest"]
    groups = member.filter(F.col("digest").isNotNull()).groupBy(*same).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    groups = common.written(groups, "vec-groups")
    first = member.join(groups, same).filter(F.col("vec_id") == F.col("id")).select("id", "label", "dim", "x", "copies").dropDuplicates(["id", "label", "dim", "x"])
    first = common.written(first, "vec-distinct")
    means = common.written(_means(first), "vec-means")
    passes = means.agg(F.max(passes_for(F.col("n"), F.col("spread")))).first()[0] or 2
    schema = "id long, label long, dim long, x binary, copies long, keys array<long>"
    placed = first.join(means.select("label", "dim", "mean"), ["label", "dim"]).select("id", "label", "dim", "x", "copies", "mean")
    keyed = common.written(placed.mapInPandas(_keys(passes), schema), "vec-keys")
    common.drop_written(first, means)
    counts, pairs = links(keyed, passes)
    found = components(pairs).withColumnRenamed("u", "id")
    counts = counts.groupBy("id").agg(F.sum("n").alias("n"))
    g = groups.join(counts, "id", "left").join(found, "id", "left")
    g = common.written(g.select(*same, (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component")), "vec-classes")
    out = member.select("vec_id", *same).join(g, same, "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
