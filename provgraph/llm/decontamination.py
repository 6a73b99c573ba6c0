"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-cased words joined by single spaces. An item of n
characters may occur in a text with at most k = n // EDIT_EVERY edits (insert, delete, replace).
Cut into k + 1 pieces, one piece of any such occurrence is unedited, so: find all exact piece
hits with one automaton over all pieces, take the stretch of text that the item could cover
around each hit, and verify it with Myers' bit-parallel distance (substring form, one bit a
character of the item). No occurrence within the budget is missed.

Items of fewer than EDIT_EVERY characters have no budget: they are found as they are, as whole words. An item
without a word matches nothing.

The normalised items are written to the shared folder in blocks of about BLOCK_CHARS characters (by a hash of
their id), and tasks read a block from there: nothing of the benchmark passes through the driver, and a
task holds one block at a time. Documents are scanned once a block. Nothing is shuffled but the
items; a very common passage costs its own verification and nothing else.

Null or empty texts match nothing; null items, or items with a null id, are left out. Repeated documents each
get their hits, whatever their ids; items of equal text each get theirs, and of rows with equal id and text
one counts. Long texts are searched whole. Of several occurrences the one of least distance, then the first, is given. An empty
table gives no rows. Only the columns named here are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

EDIT_EVERY = 16
BLOCK_CHARS = 8_000_000
WORD = re.compile(r"\w+")


def normalised(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length, with their offsets."""
    cuts = [round(i * len(item) / (budget + 1)) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, text: str, budget: int) -> tuple[int, int] | None:
    """The least distance of item to any substring of text and the end of the first such one; None beyond the budget."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    m = len(item)
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best, end = budget + 1, -1
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(d | plus) & full, plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score < best:
            best, end = score, at + 1
        up, down = up << 1 & full, down << 1 & full  # a match may start anywhere
        plus, minus = down | ~(d | up) & full, up & d
    return (best, end) if best <= budget else None


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, t, len(t) // EDIT_EVERY) for i, t in items]
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for at, piece in pieces(t, k):
                owners.setdefault(piece, []).append((n, at))
        for piece, held in owners.items():
            self.automaton.add_word(piece, (len(piece), held))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text): the best occurrence of each item."""
        if self.empty or not text:
            return []
        near: dict[int, set[int]] = {}
        for end, (size, held) in self.automaton.iter(text):
            for n, at in held:
                near.setdefault(n, set()).add(end + 1 - size - at)
        found = []
        for n, starts in near.items():
            item_id, item, k = self.items[n]
            if not k:
                if whole := [s for s in sorted(starts) if f" {item} " in f" {text[max(0, s - 1) : s + len(item) + 1]} "]:
                    found.append((item_id, 0, whole[0] + len(item)))
                continue
            best = None
            stretch = None
            for s in sorted(starts):  # hits whose stretches overlap are verified together
                a, b = max(0, s - k), min(len(text), s + len(item) + k)
                if stretch and a <= stretch[0] + 2 * k:
                    stretch = (stretch[0], max(b, stretch[1]))
                    continue
                if stretch:
                    best = self._better(best, item, text, stretch, k)
                stretch = (a, b)
            best = self._better(best, item, text, stretch, k)
            if best:
                found.append((item_id, *best))
        return found

    @staticmethod
    def _better(best, item, text, stretch, k):
        a, b = stretch
        got = myers(item, text[a:b], k)
        return min(filter(None, [best, (got[0], a + got[1]) if got else None]), default=None)


_matchers: dict[str, Matcher] = {}


def _matcher(folder: str) -> Matcher:
    """The matcher of a written block; a worker process keeps one."""
    if folder not in _matchers:
        from pyarrow import dataset

        system, path = common.file_system(folder)
        rows = dataset.dataset(path, filesystem=system, format="parquet").to_table(columns=["item_id", "item"])
        _matchers.clear()
        _matchers[folder] = Matcher(list(zip(rows["item_id"].to_pylist(), rows["item"].to_pylist())))
    return _matchers[folder]


def _scan(folder: str):
    def run(batches):
        matcher = _matcher(folder)
        for pdf in batches:
            rows = [(d, *hit) for d, t in zip(pdf["doc_id"].astype("object"), pdf["text"]) for hit in matcher.find(normalised(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "end_at"])

    return run


def _normalise(batches):
    for pdf in batches:
        items = pdf.assign(item=[normalised(t) for t in pdf["text"]])
        yield items.loc[items["item"] != "", ["item_id", "item"]]


def blocks(benchmark: DataFrame) -> list[str]:
    """Folders of the written blocks of normalised items."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    items = common.written(rows.mapInPandas(_normalise, "item_id long, item string").distinct(), "bench-items")
    chars = items.agg(F.sum(F.length("item"))).first()[0]
    if not chars:
        return []
    n = -(-chars // BLOCK_CHARS)
    parted = items.withColumn("block", F.pmod(F.xxhash64("item_id", "item"), F.lit(n)))
    return [common.written(parted.filter(F.col("block") == i).select("item_id", "item").repartition(1), "bench-block")._shared_path for i in range(n)]


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that occurs in it: doc_id, item_id, distance, end_at."""
    d = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") > 0))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, item_id long, distance int, end_at long"
    out = docs.sparkSession.createDataFrame([], schema)
    for folder in blocks(benchmark):
        out = out.unionAll(d.mapInPandas(_scan(folder), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, whole, in which no item occurs."""

    def holds_none(folder):
        @F.pandas_udf("boolean")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = _matcher(folder)
            for texts in parts:
                yield pd.Series([not matcher.find(normalised(t)) for t in texts], dtype=bool)

        return run

    for folder in blocks(benchmark):
        docs = docs.filter(holds_none(folder)(F.coalesce("text", F.lit(""))))
    return docs
