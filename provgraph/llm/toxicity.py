"""Toxicity by a factorization machine over hashed terms.

Terms of a text: each distinct word, its first 5, 6 and 7 characters, a repeat mark for words and
starts that occur three times or more, and one term for the order of magnitude of its length.
Terms are hashed to 2**20 buckets. On the training rows, document counts by label pick the
`FEATURES` buckets that tell labels apart best by themselves. Terms that say nothing alone and much beside
another are found by pairs: the words of at least `SUPPORT` toxic rows (the `VOCABULARY` most frequent of them)
are counted two by two, and up to `PAIRS` pairs with far more toxic rows than the odds of their two
words explain (`PAIR_SIGMAS` standard deviations, and `LIFT` times the odds of either word) add their words.
The machine (global, linear and pairwise parts) is fitted on the indicators of all these by Adam. Pairs are
counted and the machine is fitted in one task each, as the sample is bounded; the counts are products of blocks of rows,
so their cost grows with the rows, not with the square of a text.

Training rows: at most about `SAMPLE` labelled rows, taken by a hash of the id, so the fit costs the
same at any corpus size; their ids alone are broadcast. Scoring reads every whole text once, without a shuffle.

Null or empty texts hold only a length term and get a score like any other. Repeated rows are scored each by itself, and an id that
several rows share gives its label to all of them; rows with a null id are scored and teach nothing. An empty table gives no rows. Only
doc_id and text are read, whatever other columns there are. A document with several label rows counts as toxic if one says so; null labels teach nothing. Without two
classes to learn from, every score is the share of toxic training rows (0 with none).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 20
FEATURES = 500
SIGMAS = 2.5
VOCABULARY = 2_000
SUPPORT = 10
PAIRS = 200
PAIR_SIGMAS = 6.0
LIFT = 2.0
BLOCK = 1_000
SAMPLE = 16_000
FACTORS = 4
ROUNDS = 200
STEP = 0.05
L2 = 1e-4
REPEATS = 3
STARTS = (5, 6, 7)
WORD = re.compile(r"[^\W_]+")
CACHE = 300_000

_buckets: dict[str, tuple[int, ...]] = {}


def _hash(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) % BUCKETS


def _word_buckets(word: str) -> tuple[int, ...]:
    """Buckets of the word and its starts."""
    found = _buckets.get(word)
    if found is None:
        if len(_buckets) > CACHE:
            _buckets.clear()
        found = _buckets[word] = (_hash("w " + word), *(_hash("s " + word[:k]) for k in STARTS if len(word) >= k))
    return found


def buckets(text: str, wanted: dict | None = None) -> set[int]:
    """The hashed terms of a text; with wanted, only those in it."""
    counts: Counter = Counter()
    words = Counter(WORD.findall(text.lower()))
    for w, n in words.items():
        for b in _word_buckets(w):
            if wanted is None or b in wanted:
                counts[b] += n
    out = set(counts)
    for b, n in counts.items():
        if n >= REPEATS:
            out.add((b * 2654435761 + 1) % BUCKETS)
    out.add(_hash(f"length {sum(words.values()).bit_length()}"))
    return out


def words_of(text: str) -> set[int]:
    """The buckets of whole words."""
    return {_word_buckets(w)[0] for w in set(WORD.findall(text.lower()))}


def _bucket_labels(terms):
    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                cut = pdf.iloc[lo : lo + 64]
                counts: dict[int, list[int]] = {}
                for t, y in zip(cut["text"], cut["toxic"]):
                    for b in terms(t):
                        counts.setdefault(b, [0, 0])[y] += 1
                yield pd.DataFrame({"b": list(counts), "clean": [x[0] for x in counts.values()], "toxic": [x[1] for x in counts.values()]})

    return run


def _places(chosen, terms):
    """Rows of the places of their terms in chosen, and their labels."""

    def run(batches):
        at = {b: i for i, b in enumerate(chosen.value)}
        for pdf in batches:
            yield pd.DataFrame({"x": [[at[b] for b in terms(t, at) if b in at] for t in pdf["text"]], "y": pdf["toxic"].astype(float)})

    return run


def telling_pairs(rows: list[list[int]], y: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Pairs of terms with far more toxic rows than the odds of the two explain, the surest first, PAIRS at most."""
    both, toxic = np.zeros((n, n)), np.zeros((n, n))
    for lo in range(0, len(rows), BLOCK):
        block = np.zeros((min(BLOCK, len(rows) - lo), n), dtype=np.float32)
        for i, r in enumerate(rows[lo : lo + BLOCK]):
            block[i, r] = 1
        both += block.T @ block
        marked = block[y[lo : lo + BLOCK] > 0]
        toxic += marked.T @ marked
    total, base = len(rows), (y.sum() + 0.5) / (len(y) - y.sum() + 0.5)
    odds = (np.diag(toxic) + 0.5) / (np.diag(both - toxic) + 0.5)
    expected = odds[:, None] * odds[None, :] / base
    share = expected / (1 + expected)
    sure = (toxic - both * share) / np.sqrt(both * share * (1 - share) + 1)
    seen = (toxic + 0.5) / (both - toxic + 0.5)
    good = (toxic >= SUPPORT) & (sure >= PAIR_SIGMAS) & (seen >= LIFT * np.maximum(odds[:, None], odds[None, :])) & (both < total)
    a, b = np.nonzero(np.triu(good, 1))
    order = np.lexsort((b, a, -sure[a, b]))[:PAIRS]
    return [(int(a[i]), int(b[i])) for i in order]


def _pairs(n: int):
    def run(batches):
        got = pd.concat(list(batches), ignore_index=True)
        found = telling_pairs([list(x) for x in got["x"]], got["y"].to_numpy(), n)
        yield pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found]}, dtype="int32")

    return run


def _beside(train: DataFrame) -> set[int]:
    """The buckets of words that tell labels apart only beside another; train: text, toxic."""
    by = train.mapInPandas(_bucket_labels(words_of), "b int, clean long, toxic long").groupBy("b").agg(F.sum("toxic").alias("t"))
    words = [r["b"] for r in by.filter(F.col("t") >= SUPPORT).orderBy(F.desc("t"), "b").limit(VOCABULARY).collect()]  # bounded by VOCABULARY
    if len(words) < 2:
        return set()
    x = train.mapInPandas(_places(train.sparkSession.sparkContext.broadcast(words), lambda t, _: words_of(t)), "x array<int>, y double")
    found = x.repartition(1).mapInPandas(_pairs(len(words)), "a int, b int").collect()  # bounded by PAIRS
    return {words[i] for r in found for i in (r["a"], r["b"])}


def train_machine(rows: list[list[int]], y: np.ndarray, features: int, seed: int = 11):
    """Bias, linear weights and factors for indicator rows, by full-batch Adam on the logistic loss."""
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.array([i for r in rows for i in r], dtype=np.int64)
    base = y.mean()
    rng = np.random.default_rng(seed)
    bias, linear, v = np.array(np.log((base + 1e-3) / (1 - base + 1e-3))), np.zeros(features), rng.normal(0, 0.05, (features, FACTORS))
    params = [bias, linear, v]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by_row = lambda w: np.bincount(of, weights=w, minlength=len(rows))
    by_feature = lambda w: np.bincount(at, weights=w, minlength=features)
    for t in range(1, ROUNDS + 1):
        bias, linear, v = params
        sums = np.stack([by_row(v[at, f]) for f in range(FACTORS)], axis=1)
        squares = by_row((v[at] ** 2).sum(1))
        z = bias + by_row(linear[at]) + 0.5 * ((sums**2).sum(1) - squares)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        first = by_feature(g[of])
        pairs = np.stack([by_feature(g[of] * sums[of, f]) for f in range(FACTORS)], axis=1) - v * first[:, None]
        for i, grad in enumerate((g.sum(), first + L2 * linear, pairs + L2 * v)):
            m[i] = 0.9 * m[i] + 0.1 * grad
            s[i] = 0.999 * s[i] + 0.001 * grad**2
            params[i] = params[i] - STEP * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return float(params[0]), params[1], params[2]


def _train(features: int):
    def run(batches):
        got = pd.concat(list(batches), ignore_index=True)
        bias, linear, v = train_machine([list(x) for x in got["x"]], got["y"].to_numpy(), features)
        yield pd.DataFrame({"bias": [bias], "linear": [linear.astype("<f8").tobytes()], "factors": [v.astype("<f8").tobytes()]})

    return run


class _Wanted:
    def __init__(self, at):
        self.at = at

    def __contains__(self, b):
        return b in self.at or (b * 2654435761 + 1) % BUCKETS in self.at


def _present(text: str, at: dict) -> list[int]:
    return [b for b in buckets(text, _Wanted(at)) if b in at]


def _scorer(model):
    """A function from texts to scores."""
    chosen, bias, linear, factors, flat = model
    at = {b: i for i, b in enumerate(chosen)}
    known: dict[str, tuple[int, ...]] = {}  # a word's buckets that matter
    wanted = _Wanted(at)

    def one(text: str) -> float:
        if linear is None:
            return flat
        words = WORD.findall(text.lower())
        counts: dict[int, int] = {}
        for w in words:
            found = known.get(w)
            if found is None:
                if len(known) > CACHE:
                    known.clear()
                found = known[w] = tuple(b for b in (_hash("w " + w), *(_hash("s " + w[:k]) for k in STARTS if len(w) >= k)) if b in wanted)
            for b in found:
                counts[b] = counts.get(b, 0) + 1
        seen = set(counts) | {(b * 2654435761 + 1) % BUCKETS for b, n in counts.items() if n >= REPEATS} | {_hash(f"length {len(words).bit_length()}")}
        i = [at[b] for b in seen if b in at]
        v = factors[i]
        s = v.sum(0)
        m = bias + linear[i].sum() + 0.5 * float((s * s - (v * v).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(m, -500, 500))))

    return lambda texts: np.array([one(t) for t in texts], dtype=float)


def _score(sent):
    def run(batches):
        score_of = _scorer(sent.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": score_of(pdf["text"])})

    return run


def fit(docs: DataFrame, labels: DataFrame, may_train):
    """The fitted machine: (buckets, bias, linear, factors, flat score). may_train: a condition on doc_id."""
    spark = docs.sparkSession
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(may_train)
    n = marked.count()
    share = min(1.0, SAMPLE / max(1, n))
    marked = marked.filter(common.hashed("doc_id") <= common.hash_share(share))  # about SAMPLE rows at most
    train = common.written(common.doc_texts(docs).join(F.broadcast(marked), "doc_id"), "fm-train")
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    flat = toxic / max(1, clean + toxic)
    if not clean or not toxic:
        return [], 0.0, None, None, float(flat)
    by = train.mapInPandas(_bucket_labels(buckets), "b int, clean long, toxic long").groupBy("b").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    p, q = (F.col("t") + 0.5) / (toxic + 1.0), (F.col("c") + 0.5) / (clean + 1.0)
    gain = F.abs(F.log(p / q)) * F.sqrt(F.least(p, F.lit(1.0)) + q) * F.sqrt(F.abs(p - q))
    sure = F.abs(F.log(p / q)) / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)) >= SIGMAS  # log odds over their standard error
    top = by.filter(sure & (F.col("c") + F.col("t") >= 3)).orderBy(F.desc(gain), "b").limit(FEATURES).collect()  # bounded by FEATURES
    chosen = sorted({*(r["b"] for r in top), *_beside(train), *(_hash(f"length {k}") for k in range(24))})
    x = train.mapInPandas(_places(spark.sparkContext.broadcast(chosen), _present), "x array<int>, y double")
    got = x.repartition(1).mapInPandas(_train(len(chosen)), "bias double, linear binary, factors binary").first()
    common.drop_written(train)
    linear, factors = np.frombuffer(got["linear"]), np.frombuffer(got["factors"]).reshape(-1, FACTORS)
    return chosen, got["bias"], linear, factors, float(flat)


def score(docs: DataFrame, labels: DataFrame, held_out, may_train) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = fit(docs, labels, may_train)
    d = common.doc_texts(docs).withColumn("held_out", held_out)
    kind = d.schema["doc_id"].dataType.simpleString()
    out = d.mapInPandas(_score(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def kept(docs: DataFrame, model) -> DataFrame:
    """The rows of docs, whole, whose text scores under 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _scorer(sent.value)
        for texts in parts:
            yield pd.Series(scorer(texts))

    return docs.filter(score_of(F.coalesce("text", F.lit(""))) < 0.5)
