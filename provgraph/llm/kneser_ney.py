"""Quality by perplexity under interpolated modified Kneser-Ney trigram models.

Trusted text: all rows labelled quality 1. A hash of the id halves the ids, and each half of the trusted text makes a model.
Every document of the corpus, trusted or not, is scored by the model of the half that its id is not in: so every
trusted document counts in a model, none is scored by a model that has learnt from its id, and all perplexities compare.

`judged` keeps no tokens and no answers. Trusted documents are cut into trigrams, which are dealt by their middle word (and half)
into parts of about `PART * SLICE` characters of the corpus. A part counts its trigrams, contexts and pairs and keeps them as whole numbers;
only its words' numbers of words before them come from elsewhere, from a job by word. Words that fill more than half a part in a sample of
`SAMPLE` documents get several parts, by the word before; their pairs are summed up in a job of their own and sent back to these parts.
The sample only evens out the parts: results do not depend on it. With all discounts known, the documents follow in `GROUPS` groups by
a hash of the id: each sends its trigrams, whole, to the parts, and gets a sum from each. What a group shuffles goes before the next.
A word's own probability is added where it is the middle word, so the sum over a document is that of all its tokens.

`estimate` makes the same model as additive entries by joins, for a small model at hand (`train`):

    log P1(w) + [v seen] log g(v) + [vw seen] d2 + [uv seen] log g(uv) + [uvw seen] d3

with d2, d3 what the interpolated estimate adds to backing off.

A document is kept if its perplexity is at most the `QUANTILE` quantile of the trusted documents of its language;
languages with fewer than `ENOUGH` of them take the quantile over all languages.

Null or empty texts hold the end token alone. A null language is a language of its own. Repeated rows and ids are
scored each by itself. A perplexity equal to the threshold is kept. Long texts are scored whole. Without
trusted text in both halves everything is kept (threshold null); an empty table gives no rows. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SLICE = 7_000_000
PART = 8
CHUNK = 600_000
GROUPS = 8
SAMPLE = 2_000
QUANTILE = 0.99
ENOUGH = 20
TOKEN = re.compile(r"\w+|[^\w\s]")
CACHE = 300_000
START, END = -2, -4
U64 = np.uint64
CONTEXT = U64(1 << 63)
FLUSH = 2_000_000


class _Words(dict):
    def __missing__(self, w: str) -> int:
        h = self[w] = _word(w)
        return h


class _Seen(dict):
    def __missing__(self, w) -> int:
        n = self[w] = len(self)
        return n


class _Chunks(dict):
    """What stands between white space, as the places of its tokens."""

    def __init__(self, seen: _Seen):
        self.seen = seen

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        places = self[chunk] = self.seen[chunk].to_bytes(4, "little") if chunk.isalnum() else b"".join([self.seen[w].to_bytes(4, "little") for w in TOKEN.findall(chunk)])
        return places


def _word(w: str) -> int:
    return xxhash.xxh64_intdigest(w) >> 2 << 1


_words = _Words()


def token_ids(text: str, half: int = 0) -> np.ndarray:
    """Two start marks, the hashed tokens, one end mark; the lowest bit of each is the half."""
    if len(_words) > CACHE:
        _words.clear()
    return np.array([START, START, *map(_words.__getitem__, TOKEN.findall(text.lower())), END], dtype=np.int64) + half


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def entry_key(tag, *parts: np.ndarray) -> np.ndarray:
    """The key of an entry: 1 word, 2 pair, 3 triple; 4 and 5, the contexts of one and two, differ from 1 and 2 in the highest bit alone."""
    h = np.full(len(parts[0]), tag - 3 if tag > 3 else tag, dtype=U64)
    for p in parts:
        h = mix(h * U64(0x9E3779B97F4A7C15) + p.astype(np.int64).view(U64))
    return h | CONTEXT if tag > 3 else h & ~CONTEXT


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys & ~CONTEXT) % U64(parts)).astype(np.int64)


def _trigrams(batches):
    for pdf in batches:
        for lo, hi in common.slices(pdf["text"], 10_000, 4 * FLUSH):
            ids = [token_ids(t, h) for t, h in zip(pdf["text"].iloc[lo:hi], pdf["half"].iloc[lo:hi])]
            u, v, w = (np.concatenate([x[i : len(x) - 2 + i] for x in ids]) for i in range(3))
            _, at, n = np.unique(entry_key(3, u, v, w), return_index=True, return_counts=True)
            yield pd.DataFrame({"u": u[at], "v": v[at], "w": w[at], "c": n})


def _by_half(values, column: str) -> Column:
    """values[0] or values[1], by the lowest bit of the column."""
    return F.when(F.col(column).bitwiseAND(1) == 1, float(values[1])).otherwise(float(values[0]))


def _discounts(counts: DataFrame) -> list[tuple[float, float]]:
    """D1, D2, D3+ of both halves, from how many n-grams occur once to four times."""
    seen = counts.filter("c <= 4").groupBy(F.col("w").bitwiseAND(1).alias("half"), "c").agg(F.count("*").alias("k")).collect()
    n, out = {(r["half"], r["c"]): r["k"] for r in seen}, []
    for half in (0, 1):
        n1, n2, n3, n4 = (max(1, n.get((half, i), 0)) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        out.append([min(0.95 * i, max(0.1, i - (i + 1) * y * b / a)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))])
    return list(zip(*out))


def _held(d, column: str) -> Column:
    """The discount of a count."""
    return F.when(F.col("c") == 1, _by_half(d[0], column)).when(F.col("c") == 2, _by_half(d[1], column)).otherwise(_by_half(d[2], column))


def _contexts(counts: DataFrame, keys: list, d) -> DataFrame:
    """Totals and back-off weights of the contexts."""
    return counts.groupBy(*keys).agg(F.sum("c").alias("total"), F.sum(_held(d, "w")).alias("held")).withColumn("g", F.col("held") / F.col("total"))


def _entries(parts: int):
    """Entries in blocks by part."""

    def blocks(keys, values):
        keys, values = np.concatenate(keys), np.concatenate(values)
        part = part_of(keys, parts)
        order = np.lexsort((keys, part))
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        some = np.flatnonzero(np.diff(cuts))
        at = [order[cuts[p] : cuts[p + 1]] for p in some]
        return pd.DataFrame({"part": some, "key": [keys[x].tobytes() for x in at], "value": [values[x].tobytes() for x in at]})

    def run(rows):
        keys, values, size = [], [], 0
        for pdf in rows:
            for tag, g in pdf.groupby("tag"):
                of = {1: ["w"], 2: ["v", "w"], 3: ["u", "v", "w"], 4: ["v"], 5: ["u", "v"]}[tag]
                keys.append(entry_key(tag, *[g[p].to_numpy(dtype=np.int64) for p in of]))
                values.append(g["value"].to_numpy(dtype="<f4"))
            size += len(pdf)
            if size >= FLUSH:
                yield blocks(keys, values)
                keys, values, size = [], [], 0
        if size:
            yield blocks(keys, values)

    return run


def estimate(texts: DataFrame, parts: int = 1):
    """texts: text, half. (Entries in blocks by part, log10 probability of an unseen word by half); None without any."""
    counted = texts.mapInPandas(_trigrams, "u long, v long, w long, c long").groupBy("u", "v", "w").agg(F.sum("c").alias("c"))
    three = common.written(counted, "kn-3")
    two = common.written(three.groupBy("v", "w").agg(F.count("*").alias("c")), "kn-2")
    one = common.written(two.groupBy("w").agg(F.count("*").alias("c")), "kn-1")
    d1, d2, d3 = _discounts(one), _discounts(two), _discounts(three)
    flat = _contexts(one, [F.col("w").bitwiseAND(1).alias("half")], d1)
    kinds = one.groupBy(F.col("w").bitwiseAND(1).alias("half")).agg(F.count("*").alias("kinds"))
    flat = {r["half"]: r for r in flat.join(kinds, "half").collect()}  # at most two rows
    if not flat:
        return None
    floor = {h: r["g"] / (r["kinds"] + 1) for h, r in flat.items()}
    total = [flat[h]["total"] if h in flat else 1 for h in (0, 1)]
    p1 = one.select("w", ((F.col("c") - _held(d1, "w")) / _by_half(total, "w") + _by_half([floor.get(h, 1) for h in (0, 1)], "w")).alias("p1"))
    c2, c3 = _contexts(two, ["v"], d2), _contexts(three, ["u", "v"], d3)
    p2 = two.join(c2, "v").join(p1, "w").select("v", "w", "g", "p1", ((F.col("c") - _held(d2, "w")) / F.col("total") + F.col("g") * F.col("p1")).alias("p2"))
    p2 = common.written(p2, "kn-p2")
    p3 = three.join(c3.withColumnRenamed("g", "g3"), ["u", "v"]).join(p2.select("v", "w", "p2"), ["v", "w"])
    p3 = p3.select("u", "v", "w", "g3", "p2", ((F.col("c") - _held(d3, "w")) / F.col("total") + F.col("g3") * F.col("p2")).alias("p3"))
    none = F.lit(0).cast("long")

    def rows(tag, df, value, **parts):
        return df.select(F.lit(tag).alias("tag"), *[(F.col(k) if k in parts else none).alias(k) for k in ("u", "v", "w")], F.log10(value).alias("value"))

    every = rows(1, p1, F.col("p1"), w=1).unionAll(rows(2, p2, F.col("p2") / (F.col("g") * F.col("p1")), v=1, w=1)).unionAll(rows(3, p3, F.col("p3") / (F.col("g3") * F.col("p2")), u=1, v=1, w=1))
    every = every.unionAll(rows(4, c2, F.col("g"), v=1)).unionAll(rows(5, c3, F.col("g"), u=1, v=1))
    entries = common.written(every.mapInPandas(_entries(parts), "part long, key binary, value binary"), "kn-entries")
    common.drop_written(three, two, one, p2)
    return entries, {h: float(np.log10(x)) for h, x in floor.items()}


def _merged(blocks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and values of blocks of entries."""
    keys = np.concatenate([np.frombuffer(b, dtype="<u8") for b in blocks["key"]] or [np.zeros(0, "<u8")])
    values = np.concatenate([np.frombuffer(b, dtype="<f4") for b in blocks["value"]] or [np.zeros(0, "<f4")])
    order = np.argsort(keys)
    return keys[order], values[order]


def train(texts: DataFrame):
    """(keys, values, log10 probability of an unseen word) as arrays, for a small model at hand; None without text."""
    found = estimate(texts.select("text", F.lit(0).alias("half")))
    return found and (*_merged(found[0].toPandas()), found[1][0])


class Table:
    """Open addressing over 64-bit keys, looked up a whole array at a time; what is absent gives the default."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(len(keys) * 2 - 1).bit_length())
        self.mask = U64(size - 1)
        self.marks, self.values = np.zeros(size, dtype="<u8"), np.zeros(size, dtype="<f4")
        todo, at = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        mark = self._mark(keys)
        self.longest = 0
        while len(todo):
            self.longest += 1
            free = self.marks[at[todo]] == 0
            first = np.unique(at[todo[free]], return_index=True)[1]
            placed = todo[free][first]
            self.marks[at[placed]], self.values[at[placed]] = mark[placed], values[placed]
            left = np.ones(len(keys), dtype=bool)
            left[placed] = False
            todo = todo[left[todo]]
            at[todo] = (at[todo] + 1) & int(self.mask)

    @staticmethod
    def _mark(keys):
        """The whole key; zero marks a free place."""
        return np.where(keys == 0, U64(1), keys)

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        out = np.full(len(keys), default, dtype=float)
        at, mark = (keys & self.mask).astype(np.int64), self._mark(keys)
        todo = np.arange(len(keys))
        for _ in range(self.longest + 1):
            found = self.marks[at[todo]]
            hit = found == mark[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[(found != 0) & ~hit]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & int(self.mask)
        return out


def log10_scores(texts, table: Table, unseen: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of log10 probabilities and numbers of tokens."""
    ids = [token_ids(t) for t in texts]
    n = np.array([len(x) - 2 for x in ids])
    flat = np.concatenate(ids)
    u, v, w = flat[:-2], flat[1:-1], flat[2:]
    total = table.get(entry_key(1, w), unseen)
    for tag, parts in ((4, (v,)), (2, (v, w)), (5, (u, v)), (3, (u, v, w))):
        total += table.get(entry_key(tag, *parts), 0.0)
    starts = np.concatenate([[0], np.cumsum(n + 2)[:-1]])
    sums = np.concatenate([[0.0], np.cumsum(total)])
    return sums[starts + n] - sums[starts], n


def _packed(x: np.ndarray) -> bytes:
    """An array of whole numbers: its length in bytes, then its bytes by place, by zstd."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(raw: bytes, dtype="<i8") -> np.ndarray:
    found = np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    return found.reshape(np.dtype(dtype).itemsize, -1).T.copy().view(dtype).ravel()


def _joined(raws, dtype="<i8") -> np.ndarray:
    return np.concatenate([_unpacked(x, dtype) for x in raws] or [np.zeros(0, dtype)])


def _word_key(words: np.ndarray) -> np.ndarray:
    return entry_key(1, words)


def _one_list(x) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def _slices(batches, limit: int):
    """Rows of batches in slices of a bounded number of characters: a number, and the columns, of which texts and halves are lists."""
    at = TaskContext.get().partitionId() << 32
    size, texts, halves, ids, langs = 0, [], [], [], []
    for b in batches:
        every = b.column("text").to_pylist()
        for lo, hi in common.slices(every, 1000, limit):
            length = sum(map(len, every[lo:hi]))
            if texts and size + length > limit:
                yield at, texts, halves, ids, langs
                at, size, texts, halves, ids, langs = at + 1, 0, [], [], [], []
            size += length
            texts += every[lo:hi]
            halves += b.column("half").to_pylist()[lo:hi]
            if "doc_id" in b.schema.names:
                ids.append(b.column("doc_id").slice(lo, hi - lo))
                langs.append(b.column("lang").slice(lo, hi - lo))
    if texts:
        yield at, texts, halves, ids, langs


class _Parts:
    """Which part has a trigram: that of its middle word; a frequent word has several, and the word before it says which."""

    def __init__(self, parts: int, ways: dict[int, int]):
        self.parts = parts
        self.words = np.array(sorted(ways), dtype="<i8")
        self.ways = np.array([ways[w] for w in sorted(ways)], dtype="<i8")

    def frequent(self, words: np.ndarray) -> np.ndarray:
        """How many parts each word has."""
        out = np.ones(len(words), dtype="<i8")
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            out[self.words[at] == words] = self.ways[at[self.words[at] == words]]
        return out

    def first(self, words: np.ndarray) -> np.ndarray:
        return (_word_key(words) % U64(self.parts)).astype("<i8")

    def of(self, words: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        part, ways = self.first(words)[v], self.frequent(words)
        if (ways > 1).any():
            at = np.flatnonzero(ways[v] > 1)
            turn = (mix(_word_key(words)) >> U64(8)).astype("<i8")
            part[at] = (part[at] + turn[u[at]] % ways[v[at]]) % self.parts
        return part


def _dealt(texts, halves, dealer: _Parts):
    """The trigrams of texts by part (that of the other half from `parts` on): part, words, commonest first, u, v, w as places in them, document; and the documents' tokens."""
    seen = _Seen()
    start, end = seen[""], seen[None]
    chunks = _Chunks(seen)
    before, after = 2 * start.to_bytes(4, "little"), end.to_bytes(4, "little")
    found = [b"".join([before, *map(chunks.__getitem__, t.lower().split()), after]) for t in texts]
    words = np.array([START, END, *map(_word, list(seen)[2:])], dtype="<i8")
    n = np.array([len(x) // 4 - 2 for x in found], dtype="<i8")
    index = np.frombuffer(b"".join(found), dtype="<u4")
    del found, seen, chunks
    order = np.argsort(-np.bincount(index), kind="stable")
    rank = np.empty(len(order), dtype="<u4")
    rank[order] = np.arange(len(order))
    words, start, index = words[order], rank[start], rank[index]
    inside = index[2:] != start  # one that ends in a start mark spans two documents
    u, v, w = index[:-2][inside], index[1:-1][inside], index[2:][inside]
    doc = np.repeat(np.arange(len(n), dtype="<u4"), n)
    part = dealer.of(words, u, v) + dealer.parts * np.asarray(halves, dtype="<i8")[doc]
    part = part.astype(np.uint16) if 2 * dealer.parts < 65536 else part
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(2 * dealer.parts + 1))
    del index, inside, part

    def rows():
        for p in range(2 * dealer.parts):
            for lo in range(cuts[p], cuts[p + 1], CHUNK):
                at = order[lo : min(lo + CHUNK, cuts[p + 1])]
                three = np.concatenate([u[at], v[at], w[at]])
                if len(words) < 8 * len(three):
                    here = np.flatnonzero(np.bincount(three, minlength=len(words)))
                    rank[here] = np.arange(len(here))
                    place = rank[three]
                else:
                    here, place = np.unique(three, return_inverse=True)
                yield p, words[here], *place.astype("<u4").reshape(3, -1), doc[at]

    return n, rows()


def _learn(limit: int, dealer: _Parts):
    """The distinct trigrams of slices of trusted documents with their counts, by part."""

    def run(batches):
        for _, texts, halves, *_ in _slices(batches, limit):
            out = []
            for p, words, u, v, w, _ in _dealt(texts, halves, dealer)[1]:
                key, c = np.unique((v.astype("<i8") * len(words) + w) * len(words) + u, return_counts=True)
                key, u = np.divmod(key, len(words))
                v, w = np.divmod(key, len(words))
                out.append((p, _packed(words), *(_packed(x.astype("<u4")) for x in (u, v, w, c))))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64(), *[pa.binary()] * 5])], names=["part", *"abcde"])

    return run


def _ask(limit: int, dealer: _Parts):
    """The trigrams of slices of documents by part, and a row that has the documents themselves."""

    def run(batches):
        for at, texts, halves, ids, langs in _slices(batches, limit):
            n, rows = _dealt(texts, [1 - x for x in halves], dealer)
            ids, langs = _one_list(pa.concat_arrays(ids)), _one_list(pa.concat_arrays(langs))
            none = [pa.array([None], x.type) for x in (ids, langs)]
            names = ["part", "slice", "doc_id", "lang", *"abcde"]
            blobs = lambda *x: [pa.array([y], pa.binary()) for y in (*x, *[None] * (5 - len(x)))]
            yield pa.RecordBatch.from_arrays([pa.array([2 * dealer.parts + at % dealer.parts], pa.int64()), pa.array([at], pa.int64()), ids, langs, *blobs(_packed(np.array(halves, dtype="<u4")), _packed(n))], names=names)
            for p, words, u, v, w, doc in rows:
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                docs, many = doc[first], np.diff(np.r_[first, len(doc)])
                places = _packed(np.concatenate([u, v, w]))
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([at], pa.int64()), *none, *blobs(_packed(words), places, _packed(docs), _packed(many.astype("<u4")))], names=names)

    return run


def _summed(inverse: np.ndarray, values: np.ndarray, size: int = 0) -> np.ndarray:
    return np.bincount(inverse, weights=values, minlength=size).astype(np.int64)


def _rows(found: list) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["kind", "part", "source", *"abcdef", "numbers"])


FOUND = "kind int, part long, source long, a binary, b binary, c binary, d binary, e binary, f binary, numbers array<long>"
MODEL, WORDS, PAIRS, STATISTICS, ANSWER = range(5)


def _by_count(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def _statistics(level: int, half: int, numbers: list[int]) -> tuple:
    return STATISTICS, half, level, *[None] * 6, numbers


def _to_words(source: int, words: np.ndarray, n: np.ndarray, half: int, parts: int):
    """The rows that ask the parts of words for their numbers of words before; n: what to add to them."""
    part = part_of(_word_key(words), parts)
    for p in np.unique(part):
        yield WORDS, int(p) + half * parts, source, _packed(words[part == p]), _packed(n[part == p].astype("<u4")), *[None] * 4, None


def _three(dealer: _Parts):
    """Counts the trigrams of a part: a model of places in its words, by pair. Pairs of frequent middle words are passed on."""

    def run(pdf):
        at, parts = int(pdf["part"].iloc[0]), dealer.parts
        half, lists = at // parts, [_unpacked(x) for x in pdf["a"]]
        words = np.unique(np.concatenate(lists))
        n, places, counts = len(words), [], []
        for x, *cols in zip(lists, *(pdf[k] for k in "bcde")):
            place = np.searchsorted(words, x)
            u, v, w, c = (_unpacked(y, "<u4") for y in cols)
            places.append((place[u], place[v] * n + place[w]))
            counts.append(c)
        pairs, pair = np.unique(np.concatenate([x for _, x in places]), return_inverse=True)
        keys, inverse = np.unique(pair * n + np.concatenate([x for x, _ in places]), return_inverse=True)
        c = _summed(inverse, np.concatenate(counts))
        pair, u = np.divmod(keys, n)
        v, w = np.divmod(pairs, n)
        many = np.bincount(pair, minlength=len(pairs))
        passed = dealer.frequent(words)[v] > 1
        out = [(MODEL, at, -1, _packed(words), *(_packed(x.astype("<u4")) for x in (v, w, many, u, c)), None), _statistics(3, half, _by_count(c)), _statistics(2, half, _by_count(many[~passed]))]
        known = np.zeros(n, dtype=bool)
        known[v] = known[w] = True
        out += _to_words(at, words[known], np.bincount(w[~passed], minlength=n)[known], half, parts)
        v, w, many = words[v[passed]], words[w[passed]], many[passed]
        bucket = part_of(entry_key(2, v, w), parts)
        for p in np.unique(bucket):
            x = bucket == p
            out.append((PAIRS, int(p) + half * parts, -1, _packed(v[x]), _packed(w[x]), _packed(many[x]), *[None] * 3, None))
        return _rows(out)

    return run


def _two(parts: int):
    """Sums up passed pairs, and asks for their words' numbers as the part 2 * parts further on."""

    def run(pdf):
        at = int(pdf["part"].iloc[0])
        v, w = _joined(pdf["a"]), _joined(pdf["b"])
        words, place = np.unique(np.concatenate([v, w]), return_inverse=True)
        v, w = place.reshape(2, -1)
        pairs, inverse = np.unique(v * len(words) + w, return_inverse=True)
        c = _summed(inverse, _joined(pdf["c"]))
        v, w = np.divmod(pairs, len(words))
        out = [(PAIRS, at + 2 * parts, -1, _packed(words), *(_packed(x.astype("<u4")) for x in (v, w, c)), None, None, None), _statistics(2, at // parts, _by_count(c))]
        return _rows([*out, *_to_words(at + 2 * parts, words, np.bincount(w, minlength=len(words)), at // parts, parts)])

    return run


def _one(parts: int):
    """Sums up the words of a part and answers those that asked."""

    def run(pdf):
        at, lists = int(pdf["part"].iloc[0]), [_unpacked(x) for x in pdf["a"]]
        words, place = np.unique(np.concatenate(lists), return_inverse=True)
        c = _summed(place, _joined(pdf["b"], "<u4"))
        ends = np.cumsum([len(x) for x in lists])
        out = [(ANSWER, s, at, _packed(c[place[e - len(x) : e]].astype("<u4")), *[None] * 5, None) for s, x, e in zip(pdf["source"], lists, ends)]
        return _rows([*out, _statistics(1, at // parts, [*_by_count(c), int(c.sum()), int((c > 0).sum()), int((c >= 3).sum()), int(c[words == END].sum())])])

    return run


def _numbers_of(words: np.ndarray, answers: dict[int, bytes], parts: int) -> np.ndarray:
    """The answers for words, from each part of words in turn."""
    out = np.zeros(len(words), dtype="<i8")
    out[np.argsort(part_of(_word_key(words), parts), kind="stable")] = _joined([answers[p] for p in sorted(answers)], "<u4")
    return out


def _returned(dealer: _Parts):
    """Passed pairs with all numbers, to each part of their first word."""

    def run(pdf, answers):
        if not len(pdf):
            return _rows([])
        parts, row, out = dealer.parts, next(pdf.itertuples()), []
        half, words = row.part // parts - 2, _unpacked(row.a)
        v, w, c = (_unpacked(x, "<u4") for x in (row.b, row.c, row.d))
        before = _numbers_of(words, dict(zip(answers["source"], answers["a"])), parts)
        first, ways = dealer.first(words)[v], dealer.frequent(words)[v]
        for turn in range(int(ways.max())):
            to = np.where(ways > turn, (first + turn) % parts, -1)
            for p in np.unique(to[to >= 0]):
                x = to == p
                out.append((PAIRS, int(p) + half * parts, -1, *map(_packed, (words[v[x]], words[w[x]], c[x], before[v[x]].astype("<u4"), before[w[x]].astype("<u4"))), None, None))
        return _rows(out)

    return run


def _numbers(found: DataFrame) -> dict[int, dict[int, list[int]]]:
    """The sums of the statistics by level and half."""
    rows = found.filter(F.col("kind") == STATISTICS).groupBy("source", "part").agg(*[F.sum(F.get("numbers", F.lit(i))).alias(f"n{i}") for i in range(8)]).collect()
    out = {level: {} for level in (1, 2, 3)}
    for r in rows:
        out[r["source"]][r["part"]] = [x or 0 for x in list(r)[2:]]
    return out


def _taken_off(counts: list[int]) -> np.ndarray:
    """0, D1, D2, D3+ from how many n-grams occur once to four times."""
    n = [max(1, x) for x in counts[:4]]
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(0.95 * i, max(0.1, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3))])


def _word_probability(c: np.ndarray, numbers: list[int]) -> np.ndarray:
    """Of words by their number of words before, which may be 0."""
    n1, n2, _, _, total, kinds, more, _ = numbers
    d = _taken_off(numbers)
    return (c - d[np.minimum(c, 3)]) / total + (n1 * d[1] + n2 * d[2] + more * d[3]) / total / (kinds + 1)


def _places(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where among ascending keys; -1 for what is absent."""
    if not len(keys):
        return np.full(len(asked), -1)
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    at[keys[at] != asked] = -1
    return at


def _ascending(held: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Distinct values, ascending; held is so already."""
    if not sum(map(len, more)):
        return held
    x = np.sort(np.concatenate([held, *more]))
    return x[np.r_[True, x[1:] != x[:-1]]]


class _Model:
    """One part's model. As arrays by place in its words, in its pairs and in its contexts of two."""

    def __init__(self, rows: pd.DataFrame, half: int, dealer: _Parts, statistics):
        d1, d2, d3 = (_taken_off(statistics[i][half]) for i in (1, 2, 3))
        model, back = rows[rows["kind"] == MODEL], rows[rows["kind"] == PAIRS]
        none = np.zeros(0, dtype="<i8")
        own, v, w, many, u, c, before = none, none, none, none, none, none, none
        if len(model):
            own = _unpacked(model["a"].iloc[0])
            v, w, many, u, c = (_unpacked(model[k].iloc[0], "<u4").astype("<i8") for k in "bcdef")
            known = np.zeros(len(own), dtype=bool)
            known[v] = known[w] = True
            asked = rows[rows["kind"] == ANSWER]
            before = np.zeros(len(own), dtype="<i8")
            before[known] = _numbers_of(own[known], dict(zip(asked["source"], asked["a"])), dealer.parts)
        first, second = _joined(back["a"]), _joined(back["b"])
        self.words = _ascending(own, first, second)
        n = len(self.words)
        numbers = np.zeros(n, dtype="<i8")
        place = np.searchsorted(self.words, own)
        numbers[place] = before
        first, second = np.searchsorted(self.words, first), np.searchsorted(self.words, second)
        numbers[first], numbers[second] = _joined(back["d"], "<u4"), _joined(back["e"], "<u4")
        self.p1 = _word_probability(numbers, statistics[1][half])
        self.unseen = _word_probability(np.zeros(1, dtype="<i8"), statistics[1][half])[0]
        v, w, u = place[v], place[w], place[u]
        self.pairs = _ascending(v * n + w, first * n + second)
        c2 = np.zeros(len(self.pairs), dtype="<i8")
        pair = np.searchsorted(self.pairs, v * n + w)
        c2[pair] = many
        c2[np.searchsorted(self.pairs, first * n + second)] = _joined(back["c"], "<u4")
        start = self.pairs // max(1, n)
        total, held = np.bincount(start, weights=c2, minlength=n), np.bincount(start, weights=d2[np.minimum(c2, 3)], minlength=n)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.g2 = np.where(total > 0, held / total, 1.0)
        self.a2 = (c2 - d2[np.minimum(c2, 3)]) / total[start] / self.p1[self.pairs % max(1, n)]  # over the probability of the word
        self.three = np.repeat(pair, many) * n + u
        del start, place, first, second, pair, own
        self.contexts, context = np.unique(np.repeat(v, many) * n + u, return_inverse=True)
        del u, v
        total, held = np.bincount(context, weights=c), np.bincount(context, weights=d3[np.minimum(c, 3)])
        self.g3 = held / total
        self.a3 = (c - d3[np.minimum(c, 3)]) / total[context] / np.repeat(self.p1[w], many)

    def log10(self, words: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """For trigrams, as places in words: of p(w | u, v) / p(w) * p(v), that of a start mark being 1."""
        n, place = len(self.words), _places(self.words, words)
        known = place >= 0
        p1, g2 = np.full(len(words), self.unseen), np.ones(len(words))
        p1[known], g2[known] = self.p1[place[known]], self.g2[place[known]]
        p1[words == START] = 1.0
        order = np.argsort(place[v] * n + place[w])  # so that what is looked up lies close together
        u, v, w = u[order], v[order], w[order]
        last = p1[v]
        out, u, v, w = g2[v], place[u], place[v], place[w]
        at = np.flatnonzero((v >= 0) & (w >= 0))
        pair = np.full(len(v), -1)
        pair[at] = _places(self.pairs, v[at] * n + w[at])
        at = np.flatnonzero(pair >= 0)
        out[at] += self.a2[pair[at]]
        at = np.flatnonzero((v >= 0) & (u >= 0))
        context = _places(self.contexts, v[at] * n + u[at])
        at, context = at[context >= 0], context[context >= 0]
        out[at] *= self.g3[context]
        at = at[pair[at] >= 0]
        three = _places(self.three, pair[at] * n + u[at])
        out[at[three >= 0]] += self.a3[three[three >= 0]]
        last[order] = np.log10(out * last)
        return last


def _score(dealer: _Parts, statistics):
    """Sums by document of what a part's trigrams add to its score; rows that have the documents themselves pass."""

    def run(asks, model):
        found = asks.select(["slice", "doc_id", "lang", "a", "b"])
        if not len(asks) or asks["part"][0].as_py() >= 2 * dealer.parts:
            return found
        held, out = _Model(model.to_pandas(), asks["part"][0].as_py() // dealer.parts, dealer, statistics), []
        for words, places, docs, many in zip(*(asks[k] for k in "abcd")):
            many = _unpacked(many.as_py(), "<u4")
            score = held.log10(_unpacked(words.as_py()), *_unpacked(places.as_py(), "<u4").reshape(3, -1))
            out.append((docs.as_py(), _packed(np.bincount(np.repeat(np.arange(len(many)), many), weights=score))))
        for i, x in enumerate(zip(*out)):
            found = found.set_column(3 + i, found.schema.field(3 + i), pa.chunked_array([pa.array(x, pa.binary())]))
        return found

    return run


def _added_up(statistics):
    """A slice's documents with their numbers of tokens and scores."""
    ends = [float(np.log10(_word_probability(np.array([statistics[1][h][7]]), statistics[1][h])[0])) for h in (0, 1)]

    def run(rows):
        at = next(i for i, x in enumerate(rows["doc_id"]) if x.is_valid)
        docs, n = rows.slice(at, 1), _unpacked(rows["b"][at].as_py())
        score = np.where(_unpacked(docs["a"][0].as_py(), "<u4") == 1, ends[0], ends[1])  # the model is the other half's
        for i, (a, b) in enumerate(zip(rows["a"], rows["b"])):
            if i != at:
                score[_unpacked(a.as_py(), "<u4")] += _unpacked(b.as_py(), "<f8")
        flat = lambda k: docs[k].combine_chunks().flatten()
        return pa.table({"doc_id": flat("doc_id"), "lang": flat("lang"), "n_tokens": pa.array(n, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def _word_counts(batches):
    for pdf in batches:
        many = Counter(w for t in pdf["text"] for w in TOKEN.findall(t.lower()))
        yield pd.DataFrame({"word": [-1, *map(_word, many)], "n": [sum(many.values()), *many.values()]})


def _ways(d: DataFrame, rows: int, parts: int) -> dict[int, int]:
    """Words that fill more than half a part, by a sample of documents, and how many parts they get. Results do not depend on it, only how evenly the parts fill."""
    if parts == 1:
        return {}
    sample = d.filter(common.hashed("doc_id", "text") <= common.hash_share(min(1.0, SAMPLE / rows))).select(F.substring("text", 1, 10_000).alias("text"))
    counts = sample.mapInPandas(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counts.orderBy(F.desc("n"), "word").limit(2 * parts + 1).collect()}
    total = found.pop(-1, 0)
    return {w: min(parts, -(-2 * n * parts // total)) for w, n in found.items() if 2 * n * parts > total}


def _settled(spark) -> None:
    """Waits until the last job's events are through and hold its plan no more, so that its shuffle files can go."""
    for _ in range(2):
        common.release_shuffles(spark)
        time.sleep(1)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, lang, n_tokens, perplexity, threshold, kept."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    hashed = common.hashed("doc_id")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"), (hashed % 2).cast("int").alias("half"), (F.shiftright(hashed, 1) % GROUPS).alias("g"))
    kind, spark = d.schema["doc_id"].dataType.simpleString(), d.sparkSession
    rows, size = d.agg(F.count("*"), F.sum(F.length("text") + 100)).first()
    parts = 1 + (size or 0) // (PART * SLICE)
    dealer = _Parts(parts, _ways(d, rows, parts))
    asks = d.join(F.broadcast(good), "doc_id", "left_semi").select("text", "half").mapInArrow(_learn(SLICE, dealer), "part long, a binary, b binary, c binary, d binary, e binary")
    three = common.written(asks.groupBy("part").applyInPandas(_three(dealer), FOUND), "kn-3")
    common.release_shuffles(spark)
    of = lambda df, kind: df.filter(F.col("kind") == kind)
    two = common.written(of(three, PAIRS).groupBy("part").applyInPandas(_two(parts), FOUND), "kn-2")
    one = common.written(of(three.unionByName(two), WORDS).groupBy("part").applyInPandas(_one(parts), FOUND), "kn-1")
    back = common.written(of(two, PAIRS).groupBy("part").cogroup(of(one, ANSWER).filter(F.col("part") >= 2 * parts).groupBy("part")).applyInPandas(_returned(dealer), FOUND), "kn-pairs")
    statistics = _numbers(reduce(DataFrame.unionByName, (three, two, one)))
    if any(statistics[1].get(half, [0] * 5)[4] == 0 for half in (0, 1)):
        common.drop_written(three, two, one, back)
        return d.select("doc_id", "lang", F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    common.drop_written(two)
    model = of(three, MODEL).unionByName(of(one, ANSWER).filter(F.col("part") < 2 * parts)).unionByName(back)
    summed, columns = [], f"slice long, doc_id array<{kind}>, lang array<string>, a binary, b binary"
    for g in range(GROUPS):
        _settled(spark)
        asks = d.filter(F.col("g") == g).select("doc_id", "text", "lang", "half").mapInArrow(_ask(SLICE, dealer), f"part long, {columns}, c binary, d binary, e binary")
        parted = asks.groupBy("part").cogroup(model.groupBy("part")).applyInArrow(_score(dealer, statistics), columns)
        summed.append(common.written(parted.groupBy("slice").applyInArrow(_added_up(statistics), f"doc_id {kind}, lang string, n_tokens long, score double"), "kn-sums"))
    common.release_shuffles(spark)
    common.drop_written(three, one, back)
    scored = reduce(DataFrame.unionByName, summed).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    trusted = scored.join(good, "doc_id", "left_semi")
    quantile = F.percentile_approx("perplexity", F.lit(QUANTILE), F.lit(10_000))
    overall = trusted.agg(quantile.alias("q")).first()["q"]
    by = trusted.groupBy(F.col("lang").alias("l")).agg(quantile.alias("q"), F.count("*").alias("n")).filter(F.col("n") >= ENOUGH).select("l", "q")
    out = scored.join(by, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("threshold", F.coalesce("q", F.lit(overall).cast("double")))
    return out.select("doc_id", "lang", "n_tokens", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
