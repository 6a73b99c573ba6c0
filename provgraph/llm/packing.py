"""Concatenate and cut: all documents as one stream of ids, cut every `length` ids.

Pass 1 encodes each partition and notes, per document, the ids before it in its partition.
The totals of the partitions (one number each) are summed to give each partition's offset
in the stream; pass 2 turns global offsets into windows. No shuffle, no sort: a hot source
or a long text only makes more windows. Null or empty texts are a lone end id; repeated
rows are packed as often as they occur, and so are rows with a null id; an empty table gives no pieces. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

LENGTH = 2048
END = 1
TOKENIZER = "word_bpe_49k.json"


def _encode(path: str, end: int):
    def run(batches):
        enc, part, at = encoder(path), TaskContext.get().partitionId(), 0
        tail = end.to_bytes(4, "little")
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                cut = pdf.iloc[lo : lo + 500]
                ids = [enc.encode(t) + tail for t in cut["text"]]
                n = [len(b) // 4 for b in ids]
                before = [at + x for x in itertools.accumulate([0, *n[:-1]])]
                at += sum(n)
                yield pd.DataFrame({"doc_id": cut["doc_id"].astype("object").to_numpy(), "part": part, "before": before, "n": n, "ids": ids})

    return run


def encoded(docs: DataFrame, tokenizer_path: str, end: int = END) -> DataFrame:
    """Pass 1, written: doc_id, part, before (ids before it in its partition), n, ids (uint32, little-endian)."""
    d = common.doc_texts(docs)
    kind = d.schema["doc_id"].dataType.simpleString()
    return common.written(d.mapInPandas(_encode(tokenizer_path, end), f"doc_id {kind}, part int, before long, n long, ids binary"), "packing-ids")


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary, uint32 little-endian), doc_tokens, sequence_id, offset, boundary.

    boundary tells how the piece meets its document: whole, head, middle or tail.
    """
    t = encoded(docs, tokenizer_path, end)
    totals = [(r["part"], r["n"]) for r in t.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()]  # one row a partition
    offsets = list(itertools.accumulate([0, *(n for _, n in totals)]))
    base = t.sparkSession.createDataFrame([(p, o) for (p, _), o in zip(totals, offsets)], "part int, base long")
    t = t.join(F.broadcast(base), "part").withColumn("at", F.col("base") + F.col("before"))
    size = F.lit(length)

    def piece(s):
        lo = F.greatest(s * size, F.col("at"))
        hi = F.least((s + 1) * size, F.col("at") + F.col("n"))
        return F.struct(
            (lo - F.col("at")).alias("start"), (hi - lo).alias("length"), s.alias("sequence_id"), (lo - s * size).alias("offset"),
            F.substring("ids", (4 * (lo - F.col("at")) + 1).cast("int"), (4 * (hi - lo)).cast("int")).alias("ids"),
        )

    first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size)
    p = t.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    head, tail = F.col("p.start") == 0, F.col("p.start") + F.col("p.length") == F.col("doc_tokens")
    boundary = F.when(head & tail, "whole").when(head, "head").when(tail, "tail").otherwise("middle")
    return p.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset", boundary.alias("boundary"))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "boundary")
