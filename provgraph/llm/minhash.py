"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the weighted set of its five-word shingles (weight: occurrences); its similarity to
another is their weighted Jaccard index, and texts at `SIMILARITY` or more are linked. Fewer than
five words make one shingle. Texts equal in words are merged first, so a group of copies
of any size is one row from there on.

Signatures: each unit of weight of a shingle throws darts, a Poisson stream of ranks drawn from
hashes of shingle, unit and throw. Darts with a rank under t / (total weight) are kept, t being
about k ln k + 2k, which reaches all k coordinates almost always (else the bound is doubled and
the same streams are read on). Each dart hits one coordinate; the earliest dart there is the
coordinate's value. Two documents agree in a coordinate with probability equal to their similarity.

Banding: `BANDS` bands of `ROWS` coordinates; a bucket holds the documents equal in one band.
Pass 1 compares every member of a bucket with its first member: first the first of all such leaders, then,
where both are not of one class yet, the next ones up to `LEADERS`. Pass 2 handles all the rest: in
the buckets whose members are not yet of one class, members meet in lanes of about `LANE_BYTES`. A bucket of `LARGE` lanes or more, which
is there because of a passage that all its members share, is split again first, by the units of weight that are not usual in it:
a member belongs to a part for each unit of its prefix, and no pair of `SIMILARITY` or more has prefixes apart (see `prefix`). A task compares signatures of members of different
classes and, where the estimate reaches `ESTIMATE`, at once their exact weights; a link makes its two
classes one for the rest of the task, and a pair is taken in the first bucket that it shares. So only
links that join classes leave a task, never pairs. Classes are the components of verified links.

Long texts are signed whole, a few rows at a time. Null texts, empty texts and texts without words are in a class of their own each. Rows are told apart by a
row key, not by id: rows may share an id, or have none; a class is named by the least id in it. Exactly
one row of each class is kept: one with the least id, the first of them by row key. A table
without rows gives none. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .components import components

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 8
K = BANDS * ROWS
LANE_BYTES = 4_000_000
LARGE = 3  # lanes from which a bucket of many classes is split again
SAMPLED = 64
LEADERS = 8
ESTIMATE = 0.68
WORD = re.compile(r"\w+")
CACHE = 300_000
THROWN = 50_000
U64 = np.uint64

_words: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    words = WORD.findall(text.lower())
    if len(_words) > CACHE:
        _words.clear()
    get, out = _words.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _words[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(text: str) -> np.ndarray:
    """One hash per shingle occurrence."""
    w = word_hashes(text)
    if not len(w):
        return w
    width = min(WIDTH, len(w))
    h = np.zeros(len(w) - width + 1, dtype=U64)
    for i in range(width):
        h = mix(h * U64(0x9E3779B97F4A7C15) + w[i : len(w) - width + 1 + i])
    return h


def units(occurrences: np.ndarray) -> np.ndarray:
    """Units of weight: the n-th occurrence of a shingle is another element than its first."""
    s = np.sort(occurrences)
    if not len(s):
        return s
    new = np.concatenate([[True], s[1:] != s[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    return mix(s + (np.arange(len(s)) - first).astype(U64) * U64(0xD1B54A32D192ED03))


def signatures(sets: list[np.ndarray], widen: int = 1) -> np.ndarray:
    """For each set of units of weight (none empty) its K earliest darts, 32 bits of their identity each.

    All sets throw together; a set that leaves a coordinate unreached throws again with twice the bound.
    """
    size = np.array([len(x) for x in sets])
    bound = widen * (K * np.log(K) + 2 * K) / size
    alive, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    at, throw = np.zeros(len(alive)), 0
    rank, value = np.full(len(sets) * K, np.inf), np.zeros(len(sets) * K, dtype=U64)
    while len(alive):
        throw += 1
        dart = mix(alive + U64(throw * 0xA24BAED4963EE407 & (1 << 64) - 1))
        at = at - np.log(((dart >> U64(11)).astype(float) + 1) * 2.0**-53)  # the next rank of the stream
        near = at < bound[owner]
        alive, at, owner, dart = alive[near], at[near], owner[near], mix(dart[near])
        column = owner * K + (dart % U64(K)).astype(np.int64)
        np.minimum.at(rank, column, at)
        earliest = rank[column] == at
        value[column[earliest]] = dart[earliest]
    out = (value >> U64(32)).astype("<u4").reshape(-1, K)
    short = np.flatnonzero(np.isinf(rank.reshape(-1, K)).any(1))
    if len(short):
        out[short] = signatures([sets[i] for i in short], widen * 2)
    return out


def signature(elements: np.ndarray) -> np.ndarray:
    return signatures([elements])[0]


def _grouped(items: list, size) -> list[list]:
    """Runs of items of at most about THROWN units together."""
    out, total = [[]], 0
    for x in items:
        if out[-1] and total + size(x) > THROWN:
            out.append([])
            total = 0
        out[-1].append(x)
        total += size(x)
    return out if out[0] else []


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard index of two sets of units of weight."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard index of two arrays of shingle occurrences."""
    return overlap(units(a), units(b))


def _digest(batches):
    for pdf in batches:
        for lo, hi in common.slices(pdf["text"]):
            cut = pdf.iloc[lo:hi]
            digests, fresh = [], {}
            for t in cut["text"]:
                w = word_hashes(t)
                digest = xxhash.xxh128_digest(w.tobytes()) if len(w) else None
                digests.append(digest)
                if digest and digest not in fresh:
                    fresh[digest] = units(shingles(t))
            bands: dict = {None: None}
            for group in _grouped(list(fresh.items()), lambda x: len(x[1])):
                for (digest, _), row in zip(group, signatures([x for _, x in group])):
                    bands[digest] = [xxhash.xxh64_intdigest(row[ROWS * b : ROWS * (b + 1)].tobytes(), b) - (1 << 63) for b in range(BANDS)]
            yield pd.DataFrame({"rid": cut["rid"], "doc_id": cut["doc_id"].astype("Int64"), "words": digests, "bands": [bands[d] for d in digests]})


def _sign(batches):
    for pdf in batches:
        for lo, hi in common.slices(pdf["text"]):
            cut = pdf.iloc[lo:hi]
            held = [units(shingles(t)) for t in cut["text"]]
            rows = [x for group in _grouped(held, len) for x in signatures(group)]
            yield pd.DataFrame({"id": cut["rid"], "size": [len(x) for x in held], "signature": [r.tobytes() for r in rows], "units": [x.tobytes() for x in held]})


def _verify(batches):
    for pdf in batches:
        known: dict[int, np.ndarray] = {}
        keep = []
        for v, a, b in zip(pdf["v"], pdf["a"], pdf["b"]):
            if v not in known:
                known = {v: np.frombuffer(b, dtype=U64)}
            keep.append(overlap(np.frombuffer(a, dtype=U64), known[v]) >= SIMILARITY)
        yield pdf.loc[keep, ["u", "v"]]


def verified(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs u, v that are similar by their units of weight; written."""
    one = pairs.join(signed.select(F.col("id").alias("u"), F.col("units").alias("a")), "u")
    two = one.join(signed.select(F.col("id").alias("v"), F.col("units").alias("b")), "v").select("u", "v", "a", "b")
    return common.written(two.mapInPandas(_verify, "u long, v long"), "near-links")


def _links(band: int, pdf: pd.DataFrame, low: int, high: int) -> tuple[list, list]:
    """Links between members of different classes: all within a lane, or one lane with another."""
    rows = np.frombuffer(b"".join(pdf["signature"]), dtype="<u4").reshape(-1, K)
    held = [np.frombuffer(x, dtype=U64) for x in pdf["units"]]
    size, ids, lanes = pdf["size"].to_numpy(), pdf["id"].to_numpy(), pdf["lane"].to_numpy()
    root, of = np.unique(pdf["component"].to_numpy(), return_inverse=True)
    root = np.arange(len(root))  # of each class, by the links found here
    right = np.flatnonzero(lanes == high)
    us, vs = [], []
    for i in np.flatnonzero(lanes == low):
        other = right[root[of[right]] != root[of[i]]]
        if low == high:
            other = other[other > i]
        other = other[np.minimum(size[other], size[i]) >= SIMILARITY * np.maximum(size[other], size[i])]
        if not len(other):
            continue
        same = rows[other] == rows[i]
        estimate = same.mean(1)
        near = np.flatnonzero(estimate >= ESTIMATE)
        if band:
            earlier = same[near, : ROWS * band].reshape(len(near), band, ROWS).all(2).any(1)
            near = near[~earlier]
        for j in other[near[np.argsort(-estimate[near], kind="stable")]]:
            x, y = root[of[i]], root[of[j]]
            if x != y and overlap(held[i], held[j]) >= SIMILARITY:
                root[root == max(x, y)] = min(x, y)
                us.append(max(ids[i], ids[j]))
                vs.append(min(ids[i], ids[j]))
    return us, vs


def _close(key, pdf):
    """One lane of a bucket, or of a part of one, with itself or another."""
    us, vs = _links(key[0], pdf, *key[-2:])
    return pd.DataFrame({"u": np.array(us, dtype=np.int64), "v": np.array(vs, dtype=np.int64)})


def _close_parts(key, pdf):
    """Several small parts of a bucket."""
    us, vs = [], []
    for _, g in pdf.assign(lane=0).groupby("part", sort=False):
        u, v = _links(key[0], g, 0, 0)
        us += u
        vs += v
    return pd.DataFrame({"u": np.array(us, dtype=np.int64), "v": np.array(vs, dtype=np.int64)})


def _common(key, pdf):
    """Units that many of a few members of a bucket hold."""
    units, n = np.unique(np.frombuffer(b"".join(pdf["units"]), dtype=U64), return_counts=True)
    return pd.DataFrame({"band": [key[0]], "h": [key[1]], "common": [units[n >= max(2, len(pdf) // 8)].tobytes()]})


def prefix(elements: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first of a set's units in an order that is the same for all sets: those outside common (sorted) first, each by value.

    Two sets of SIMILARITY or more share as many units as that share of the larger one, so these prefixes of theirs have one in common.
    """
    at = np.searchsorted(common, elements)
    usual = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == elements) if len(common) else np.zeros(len(elements), bool)
    order = np.lexsort((elements, usual))
    return elements[order[: len(elements) - int(np.ceil(SIMILARITY * len(elements))) + 2]]


def _parts(key, members, frame):
    usual = np.frombuffer(frame["common"].iloc[0], dtype=U64) if len(frame) else np.zeros(0, U64)
    found = [prefix(np.frombuffer(x, dtype=U64), usual) for x in members["units"]]
    n = [len(x) for x in found]
    part = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
    again = {c: np.repeat(members[c].to_numpy(), n) for c in ("id", "component", "size")}
    return pd.DataFrame({"band": np.full(len(part), key[0], np.int32), "h": np.full(len(part), key[1], np.int64), "part": part} | again)


def _in_lanes(m: DataFrame, signed: DataFrame, keys: list[str]) -> DataFrame:
    """Links within the groups of m (keys, lanes, id, component, size): each lane with itself and the others."""
    m = m.withColumn("lane", F.pmod(F.xxhash64("id", "band"), F.col("lanes")).cast("int"))
    m = m.join(signed.drop("size"), "id").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    m = m.withColumn("low", F.least("lane", "o")).withColumn("high", F.greatest("lane", "o"))
    m = m.select(*keys, "low", "high", "id", "component", "lane", "size", "signature", "units")
    return m.groupBy(*keys, "low", "high").applyInPandas(_close, "u long, v long")


def _large(members: DataFrame, signed: DataFrame) -> DataFrame:
    """Links within large buckets of many classes. members: band, h, lanes, id, component, size.

    Such a bucket is there because of what its members share (a long passage in all of them), which says little about any two. So it is split
    again, by units outside of that: a member belongs to the parts of its prefix. No pair of SIMILARITY or more is lost, and members
    that share only what all share meet nowhere.
    """
    lane = F.pmod(F.xxhash64("id", "band"), F.col("lanes")).cast("int")
    m = common.written(members.join(signed.select("id", "units"), "id").withColumn("lane", lane), "near-large")
    few = m.withColumn("n", F.row_number().over(W.partitionBy("band", "h").orderBy(F.xxhash64("id"), "id"))).filter(F.col("n") <= SAMPLED)
    usual = few.select("band", "h", "units").groupBy("band", "h").applyInPandas(_common, "band int, h long, common binary")
    frame = common.written(m.select("band", "h", "lane").distinct().join(usual, ["band", "h"]), "near-usual")
    keys = ["band", "h", "lane"]
    parts = m.groupBy(*keys).cogroup(frame.groupBy(*keys)).applyInPandas(_parts, "band int, h long, part long, id long, component long, size long")
    parts = common.written(parts, "near-parts")
    keys = ["band", "h", "part"]
    mixed = parts.groupBy(*keys).agg(F.min("component").alias("x"), F.max("component").alias("y"), F.sum(_size()).alias("bytes")).filter("x <> y")
    mixed = common.written(mixed.select(*keys, "bytes", F.ceil(F.col("bytes") / LANE_BYTES).cast("int").alias("lanes")), "near-part-sizes")
    tasks = mixed.filter("lanes = 1").groupBy("band", "h").agg(F.ceil(F.sum("bytes") / LANE_BYTES).alias("tasks"))
    small = mixed.filter("lanes = 1").join(tasks, ["band", "h"]).select(*keys, F.pmod(F.xxhash64("part"), "tasks").alias("task"))
    some = parts.join(small, keys).join(signed.drop("size"), "id").groupBy("band", "h", "task").applyInPandas(_close_parts, "u long, v long")
    rest = _in_lanes(parts.join(mixed.filter("lanes > 1").drop("bytes"), keys), signed, keys)
    out = common.written(some.unionAll(rest), "near-large-links")
    common.drop_written(m, frame, parts, mixed)
    return out


def _size():
    return F.col("size") * 8 + 4 * K


def _across(buckets: DataFrame, found: DataFrame, signed: DataFrame) -> DataFrame:
    """Links between different classes of one bucket, written; buckets: band, h, id."""
    b = buckets.join(found.withColumnRenamed("u", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    b = common.written(b.join(signed.select("id", "size"), "id"), "near-members")
    mixed = b.groupBy("band", "h").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.sum(_size()).alias("bytes")).filter("x <> y")
    mixed = common.written(mixed.select("band", "h", F.ceil(F.col("bytes") / LANE_BYTES).cast("int").alias("lanes")), "near-mixed")
    m = b.join(mixed, ["band", "h"])
    large = F.col("lanes") >= LARGE
    out = common.written(_in_lanes(m.filter(~large), signed, ["band", "h"]), "near-more")
    if mixed.filter(large).limit(1).count():
        out = common.written(out.unionAll(_large(m.filter(large), signed)), "near-more")
    common.drop_written(b, mixed)
    return out


def keyed(docs: DataFrame, name: str = "rid") -> DataFrame:
    """docs with a row key, written: the key is the same whenever the rows are read again."""
    return common.written(docs.withColumn(name, F.monotonically_increasing_id()), "near-rows")


def classes_of_rows(rows: DataFrame) -> DataFrame:
    """rows: rid, doc_id, text, written. Returns for each: rid, doc_id, class_id, copies (rows with its words), kept."""
    member = common.written(rows.mapInPandas(_digest, "rid long, doc_id long, words binary, bands array<long>"), "near-words")
    groups = member.filter(F.col("words").isNotNull()).groupBy("words").agg(F.min("rid").alias("id"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    groups = common.written(groups, "near-groups")
    leaders = member.join(groups.select("words", F.col("id").alias("rid")), ["words", "rid"]).select(F.col("rid").alias("id"), F.posexplode("bands").alias("band", "h"))
    bands = common.written(leaders, "near-bands")
    many = bands.groupBy("band", "h").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least <> most")
    many = common.written(many.select("band", "h", "least"), "near-buckets")
    buckets = common.written(bands.join(many, ["band", "h"]), "near-bucketed")
    common.drop_written(bands, many)
    ids = common.written(buckets.select(F.col("id").alias("rid")).distinct(), "near-ids")
    signed = rows.select("rid", "text").join(ids, "rid", "left_semi").mapInPandas(_sign, "id long, size long, signature binary, units binary")
    signed = common.written(signed, "near-signed")
    stars = buckets.filter(F.col("id") != F.col("least")).select(F.col("id").alias("u"), F.col("least").alias("v")).distinct()
    stars = common.written(stars.withColumn("n", F.row_number().over(W.partitionBy("u").orderBy("v"))), "near-stars")
    links = verified(stars.filter("n = 1").select("u", "v"), signed)
    found = components(links)
    rest = stars.filter(F.col("n").between(2, LEADERS)).select("u", "v")  # further leaders only where the first left two classes
    for end in ("u", "v"):
        rest = rest.join(found.select(F.col("u").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    rest = verified(rest.filter(F.coalesce("of_u", "u") != F.coalesce("of_v", "v")).select("u", "v"), signed)
    if rest.limit(1).count():
        links = common.written(links.unionAll(rest), "near-links")
        found = components(links)
    more = _across(buckets.select("band", "h", "id").distinct(), found, signed)
    common.drop_written(signed, buckets, stars)
    if more.limit(1).count():
        found = components(links.unionAll(more))
    g = groups.join(found.withColumnRenamed("u", "id"), "id", "left").select("words", "least", "copies", F.coalesce("component", "id").alias("component"))
    g = common.written(g, "near-classes")
    named = common.written(g.groupBy("component").agg(F.min("least").alias("class_id")), "near-named")
    g = common.written(g.drop("least").join(named, "component"), "near-classes")
    placed = common.written(member.select("rid", "doc_id", "words").join(g, "words", "left"), "near-placed")
    keep = placed.filter(F.col("component").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("component").agg(F.min("rid").alias("keep"))
    out = placed.join(keep, "component", "left")
    alone = F.col("component").isNull()
    return out.select("rid", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), (alone | (F.col("rid") == F.col("keep"))).alias("kept"))


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least id of its class), copies (rows with its words), kept (one row of each class)."""
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    return classes_of_rows(rows).drop("rid")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The kept rows of docs, whole."""
    key = common.fresh(docs, "rid")
    rows = keyed(docs, key)
    found = classes_of_rows(rows.select(F.col(key).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    drop = common.written(found.filter(~F.col("kept")).select(F.col("rid").alias(key)), "near-dropped")
    return rows.join(drop, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
