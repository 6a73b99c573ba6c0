"""Sorted-string-table shards of token ids.

A shard holds a contiguous range of keys. Layout: data blocks (entries with prefix-compressed
keys, compressed by zstd behind their size), a sparse index (first key, offset and size of each block), a Bloom filter over
the keys, and a fixed-size footer. A lookup reads footer, filter and index, searches the index
by bisection, and unpacks one block.

Keys are the document id as a sign-flipped big-endian 64-bit integer behind a marker byte, so
byte order is numeric order and null ids (marker 0) come first. Equal ids keep one entry each,
ordered by text. Values are ids as little-endian 16-bit integers where they fit, else 32-bit.

Null and empty texts are the end id alone. Repeated rows keep an entry each, so all are read back and found. A long text is one
entry, in a block of its own where it fills one. An empty table gives an empty manifest, and reading that no rows. Only doc_id and
text are read, whatever other columns there are.
"""

from __future__ import annotations

import bisect
import itertools
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

TOKENIZER = "byte_bpe_50k.json"
END = 2
BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"TOKSST02"
SIZE = struct.Struct("<Q")
FOOTER = struct.Struct("<QQQQQQ8s")  # index at, index size, filter at, filter size, entries, ids, magic


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", int(doc_id) + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def pack_ids(ids: np.ndarray) -> bytes:
    if len(ids) and ids.max() >= 1 << 16:
        return b"\x04" + ids.astype("<u4").tobytes()
    return b"\x02" + ids.astype("<u2").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype=f"<u{value[0]}", offset=1).astype("<u4")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        n |= (x & 127) << shift
        at += 1
        if x < 128:
            return n, at
        shift += 7


def _bloom_bits(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.adler32(key) * 0x9E3779B1 & 0xFFFFFFFF | 1
    a = (a ^ a >> 15) * 0x85EBCA6B & 0xFFFFFFFF
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


def write_shard(out, entries) -> tuple[int, int]:
    """Writes (key, value) pairs in key order; returns entries and ids."""
    at, index, keys, total = 0, [], [], 0
    block, first, last = bytearray(), b"", b""

    def flush():
        nonlocal at, block
        if block:
            raw = SIZE.pack(len(block)) + pa.compress(bytes(block), codec="zstd", asbytes=True)
            out.write(raw)
            index.append((first, at, len(raw)))
            at += len(raw)
            block = bytearray()

    for key, value in entries:
        if not block:
            first, last = key, b""
        shared = 0
        while shared < min(len(key), len(last)) and key[shared] == last[shared]:
            shared += 1
        block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        last = key
        keys.append(key)
        total += (len(value) - 1) // value[0]
        if len(block) >= BLOCK_BYTES:
            flush()
    flush()
    raw_index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in index)
    bits = max(64, BLOOM_BITS * len(keys))
    bloom = np.zeros(bits, dtype=bool)
    for k in keys:
        bloom[_bloom_bits(k, bits)] = True
    raw_bloom = struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
    out.write(raw_index)
    out.write(raw_bloom)
    out.write(FOOTER.pack(at, len(raw_index), at + len(raw_index), len(raw_bloom), len(keys), total, MAGIC))
    return len(keys), total


class Shard:
    """A shard opened for reading; source is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        index_at, index_size, bloom_at, bloom_size, self.entries, self.ids, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        raw, at, self.index = self._read(index_at, index_size), 0, []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            offset, at = _read_varint(raw, at)
            length, at = _read_varint(raw, at)
            self.index.append((key, offset, length))
        bloom = self._read(bloom_at, bloom_size)
        self.bits, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, i: int):
        _, offset, length = self.index[i]
        packed, at, last = self._read(offset, length), 0, b""
        raw = pa.decompress(packed[SIZE.size :], SIZE.unpack_from(packed)[0], codec="zstd", asbytes=True)
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            last = last[:shared] + raw[at : at + rest]
            at += rest
            yield last, raw[at : at + n]
            at += n

    def __iter__(self):
        for i in range(len(self.index)):
            yield from self._block(i)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[b >> 3] >> (7 - (b & 7)) & 1 for b in _bloom_bits(key, self.bits))

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry under this document id; empty if there is none."""
        key = key_of(doc_id)
        if not self.index or not self.may_hold(key):
            return []
        i, found = max(0, bisect.bisect_left([k for k, _, _ in self.index], key) - 1), []
        while i < len(self.index) and self.index[i][0] <= key:
            found += [unpack_ids(v) for k, v in self._block(i) if k == key]
            i += 1
        return found


def open_uri(uri: str, mode: str):
    system, path = common.file_system(uri)
    if mode == "r":
        return system.open_input_file(path)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def _writer(folder: str, tokenizer_path: str, end: int):
    def run(batches):
        enc, tail = encoder(tokenizer_path), end.to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        span: list = []

        def entries():
            for pdf in batches:
                for doc_id, text in zip(pdf["doc_id"].astype("object"), pdf["text"]):
                    key = key_of(None if pd.isna(doc_id) else int(doc_id))
                    span[:] = [span[0] if span else key, key]
                    yield key, pack_ids(np.frombuffer(enc.encode(text) + tail, dtype="<u4"))

        path = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.sst"  # a retried task writes another file; only listed ones are read
        with open_uri(path, "w") as out:
            n, ids = write_shard(out, entries())
        if n:
            yield pd.DataFrame({"shard": [part], "path": [path], "entries": [n], "ids": [ids], "first_key": [span[0]], "last_key": [span[1]]})

    return run


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end: int = END) -> DataFrame:
    """Writes the shards; returns the written manifest: shard, path, entries, ids, first_key, last_key."""
    spark = docs.sparkSession
    d = common.doc_texts(docs)
    d = d.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = d.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    made = ranged.mapInPandas(_writer(folder or common.new_folder(spark, "sst"), tokenizer_path, end), "shard int, path string, entries long, ids long, first_key binary, last_key binary")
    return common.written(made, "sst-manifest")


def _reader(batches):
    for pdf in batches:
        for path, at in zip(pdf["path"], pdf["base"]):
            with open_uri(path, "r") as source:
                entries = iter(Shard(source))
                while chunk := list(itertools.islice(entries, 256)):
                    ids = [unpack_ids(v) for _, v in chunk]
                    n = [len(x) for x in ids]
                    start = [at + x for x in itertools.accumulate([0, *n[:-1]])]
                    at += sum(n)
                    yield pd.DataFrame({"doc_id": pd.array([id_of(k) for k, _ in chunk], dtype="Int64"), "start": start, "n_tokens": n, "ids": [x.tobytes() for x in ids]})


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every entry of the listed shards: doc_id, start (ids of all documents before it), n_tokens, ids (uint32, little-endian)."""
    rows = manifest.orderBy("shard").select("shard", "path", "ids").collect()  # one row a shard
    base = itertools.accumulate([0, *(r["ids"] for r in rows)])
    listed = [(r["shard"], r["path"], b) for r, b in zip(rows, base)]
    frame = spark.createDataFrame(listed, "shard int, path string, base long")
    return frame.repartitionByRange(max(1, len(listed)), "shard").mapInPandas(_reader, "doc_id long, start long, n_tokens long, ids binary")


def digest(entries: DataFrame) -> DataFrame:
    return entries.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
