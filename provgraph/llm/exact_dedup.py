"""Exact duplicates by a minimal perfect hash over the digests that are already known.

A text's digest is the SHA-256 of its UTF-8 bytes without the characters of `[\\x20\\x09-\\x0D]`. The index holds every
historical distinct digest: digests are dealt to shards by their first bits, and a shard is a minimal perfect hash
(levels of bit arrays: a key rests at the first level where no other key of the shard shares its position; its slot is
the number of set bits before it) and its slots, each with the full digest and the locator of the row that stays.

1. `fingerprints`: row, doc_id, code points, digest of every document; texts are read once and go no further.
2. `build`: the index over the classes of the historical rows.
3. `lookup`: the classes of the other rows meet the index. A member takes over the locator of its slot, or replaces it if
   its own row is the better one; a slot counts only if all 32 bytes of its digest are equal. Nonmembers are grouped among
   themselves.
4. `build` again: the next history, over all classes. Every row is looked up there; it is kept if the slot names it.

Rows are combined by digest before every shuffle but the last. The last deals rows by shard; a shard with more than its
share of rows (an empty text that a third of all rows hold) is dealt to as many tasks as it needs, each with a copy of that
one shard. At most `HOT` shards can have more than a `HOT`th of the rows, so the list of them that is broadcast is bounded.

Of equal texts the row with the most code points stays, then the least doc_id (null last), then the first of rows
that are alike in both, so exactly one. Null texts count as empty, and all texts of white space are equal to those. Long texts are
hashed whole. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BLANKS = " \t\n\x0b\x0c\r"
KEYS = 2048  # digests of a shard, on average
ROWS = 32_768  # rows that a shard may have before they are dealt to several tasks
HOT = 100_000
LEVELS = 64
SPARE = 2  # positions of a level for each key

LOCATOR = ["less_chars", "no_id", "id", "row"]
SLOT = np.dtype([("digest", "<u8", 4), ("less_chars", "<i8"), ("no_id", "?"), ("id", "<i8"), ("row", "<i8"), ("copies", "<i8")])


def _words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _position(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where keys stand at a level: the words of a digest, mixed anew for each level."""
    h = np.full(len(words), level * 0x9E3779B97F4A7C15 & (1 << 64) - 1, dtype=np.uint64)
    for k in range(4):
        h = (h ^ words[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(size)).astype(np.int64)


def perfect_hash(words: np.ndarray, levels: int = LEVELS) -> tuple[list[np.ndarray], np.ndarray]:
    """(bits of each level, slot of each key). Keys that collide at all levels take the last slots."""
    slot, found, base, left = np.zeros(len(words), dtype=np.int64), [], 0, np.arange(len(words))
    while len(left) and len(found) < levels:
        size = SPARE * len(left)
        at = _position(words[left], len(found), size)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        slot[left[alone]] = base + (np.cumsum(bits) - 1)[at[alone]]
        base += int(alone.sum())
        found.append(bits)
        left = left[~alone]
    slot[left] = base + np.arange(len(left))
    return found, slot


def find_slots(words: np.ndarray, levels: list[np.ndarray], slots: np.ndarray) -> np.ndarray:
    """The slot whose digest equals each key's in every byte, or -1."""
    out, base, left = np.full(len(words), -1, dtype=np.int64), 0, np.arange(len(words))
    for level, bits in enumerate(levels):
        at = _position(words[left], level, len(bits))
        hit = bits[at]
        out[left[hit]] = base + (np.cumsum(bits) - 1)[at[hit]]
        base += int(bits.sum())
        left = left[~hit]
    if base < len(slots) and len(left):  # keys that never stood alone
        rest = {s["digest"].tobytes(): base + i for i, s in enumerate(slots[base:])}
        out[left] = [rest.get(words[i].tobytes(), -1) for i in left]
    if len(slots):
        out[(slots["digest"][out] != words).any(axis=1)] = -1
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """row, doc_id, less_chars (code points, negative), digest; written."""
    d = common.doc_texts(docs)
    bare = F.translate("text", BLANKS, "")
    return common.written(
        d.select(
            F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (-F.length("text")).cast("long").alias("less_chars"),
            F.unhex(F.sha2(bare.cast("binary"), 256)).alias("digest"),
        ),
        "exact-rows",
    )


def classes(rows: DataFrame) -> DataFrame:
    """One row a digest: digest, best (the locator of the row that stays), copies."""
    locator = F.struct("less_chars", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row")
    return rows.groupBy("digest").agg(F.min(locator).alias("best"), F.count("*").alias("copies"))


def _shard(shards: int) -> Column:
    return F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long") % F.lit(shards)


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    levels, slot = perfect_hash(words := _words(table["digest"].to_pylist()))
    slots = np.zeros(len(words), dtype=SLOT)
    slots["digest"][slot] = words
    for c in (*LOCATOR, "copies"):
        slots[c][slot] = table[c].to_numpy()
    return pa.table({
        "shard": [key[0].as_py()], "sizes": [[len(b) for b in levels]], "bits": [np.packbits(np.concatenate(levels)).tobytes()], "slots": [slots.tobytes()],
    })


def build(found: DataFrame) -> tuple[DataFrame, int]:
    """The index over classes (one row a digest), written: shard, sizes, bits, slots; and its number of shards."""
    shards = max(1, -(-found.count() // KEYS))
    flat = found.select(_shard(shards).alias("shard"), "digest", *[F.col(f"best.{c}").alias(c) for c in LOCATOR], "copies")
    made = flat.groupBy("shard").applyInArrow(_build, "shard long, sizes array<long>, bits binary, slots binary")
    return common.written(made, "exact-index"), shards


def _meet(left: pa.Table, right: pa.Table) -> pa.Table:
    """Each row of left with the locator and the copies of its digest's slot in the shard; null where there is none."""
    words = _words(left["digest"].to_pylist())
    at, slots = np.full(len(words), -1), np.zeros(0, dtype=SLOT)
    if right.num_rows:
        shard = right.slice(0, 1).to_pylist()[0]
        cuts = np.cumsum(shard["sizes"])
        bits = np.unpackbits(np.frombuffer(shard["bits"], dtype=np.uint8), count=int(cuts[-1])).astype(bool)
        slots = np.frombuffer(shard["slots"], dtype=SLOT)
        at = find_slots(words, np.split(bits, cuts[:-1]), slots)
    none = at < 0
    got = {c: pa.array(slots[c][at] if len(slots) else np.zeros(len(at), SLOT[c]), mask=none) for c in (*LOCATOR, "copies")}
    keep = [c for c in left.column_names if c not in ("shard", "deal")]
    return pa.table([left[c] for c in keep] + list(got.values()), names=keep + [f"slot_{c}" for c in got])


def lookup(keys: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """keys, with digest, and slot_less_chars, slot_no_id, slot_id, slot_row, slot_copies of the index; null for nonmembers."""
    k = keys.withColumn("shard", _shard(shards))
    sizes = k.groupBy("shard").agg(F.count("*").alias("n"))
    most = max(ROWS, (sizes.agg(F.sum("n")).first()[0] or 0) // HOT)
    # more than `most` rows each, so at most HOT shards
    hot = F.broadcast(sizes.filter(F.col("n") > most).select("shard", F.ceil(F.col("n") / most).alias("deals")))
    k = k.join(hot, "shard", "left").withColumn("deal", F.pmod(F.xxhash64(*keys.columns), F.coalesce("deals", F.lit(1)))).drop("deals")
    i = index.join(hot, "shard", "left").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("deals", F.lit(1)) - 1))).drop("deals")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema)
    slot = "slot_less_chars long, slot_no_id boolean, slot_id long, slot_row long, slot_copies long"
    return k.groupBy("shard", "deal").cogroup(i.groupBy("shard", "deal")).applyInArrow(_meet, f"{schema}, {slot}")


def resolve(historical: DataFrame, arrived: DataFrame) -> DataFrame:
    """The classes of both, with one locator and all copies a digest. historical, arrived: tables of classes().

    Members of the index over historical join its slot; nonmembers, and slots that nothing met, stay as they are.
    """
    index, shards = build(historical)
    met = common.written(lookup(arrived.select("digest", "best", "copies"), index, shards), "exact-met")
    common.drop_written(index)
    member = F.col("slot_row").isNotNull()
    slot = F.struct(*[F.col(f"slot_{c}").alias(c) for c in LOCATOR])
    merged = met.select("digest", F.when(member, F.least("best", slot)).otherwise(F.col("best")).alias("best"), (F.col("copies") + F.coalesce("slot_copies", F.lit(0))).alias("copies"))
    return merged.unionByName(historical.join(met.filter(member).select("digest"), "digest", "left_anti"))


def dedup(docs: DataFrame, historical: Column) -> DataFrame:
    """One row a document: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256.

    historical: condition on doc_id that tells the rows whose digests are known first; either part may be empty.
    """
    rows = fingerprints(docs)
    past = F.coalesce(historical, F.lit(False))
    old, new = common.written(classes(rows.filter(past)), "exact-old"), common.written(classes(rows.filter(~past)), "exact-new")
    every = common.written(resolve(old, new), "exact-classes")
    common.drop_written(old, new)
    index, shards = build(every)
    common.drop_written(every)
    got = lookup(rows.select("row", "doc_id", "digest"), index, shards)
    return got.select(
        "doc_id", F.when(~F.col("slot_no_id"), F.col("slot_id")).alias("keep_id"), F.col("slot_copies").alias("group_size"), (F.col("row") == F.col("slot_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
k as (select doc_id, length(text) as chars, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') as bare from t),
g as (select *, first_value(doc_id) over w as keep_id, row_number() over w as place, count(*) over (partition by bare) as group_size
      from k window w as (partition by bare order by chars desc, doc_id))
select doc_id, keep_id, group_size, place = 1 as kept, sha256(bare) as text_sha256 from g
"""
