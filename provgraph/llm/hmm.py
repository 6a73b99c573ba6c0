"""Hidden Markov language model over words, trained by Baum-Welch on the whole corpus.

Tokens are lower-cased (A-Z) runs of anything but ASCII white space, then one end token.
Symbols: the end token, the `HEAD` most frequent training words one by one, and every other
word through one of `TIED` classes (by its last two characters). A state emits a head word
directly, and a tied word as P(class | state) * P(word | class), where the second factor is
the add-one estimate (count + 1) / (class total + class words + 1) from counts over the whole
training corpus; each class keeps one event for words never seen. So the score is the exact
log10 likelihood of the text under one normalised model, by the scaled forward recursion.

Steps: word counts (combined in tasks, then summed), documents encoded once to a written table,
the rest of the words joined with the count table and summed per document, expected counts of
every Baum-Welch round summed per task and then in two levels. Each round runs over all training
documents, whole, from a fixed random start; rounds end when the log-likelihood grows by less than the
share `GAIN`, after `ROUNDS` at the latest. What reaches the driver is bounded by HEAD + TIED, never by the corpus.

Tasks hold documents in time order side by side, about `BATCH_TOKENS` tokens at once. A longer document is
one batch: its forward values are kept at every `BATCH_TOKENS` tokens alone and computed again on the way back.

Null and empty texts hold the end token alone. Repeated rows are separate documents, whatever their ids; null
ids are scored and learnt from like others. Ties among words for the head go to the lesser word. With no
training rows the model is uniform over its symbols and base counts are zero; an empty table gives no rows.
Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HEAD = 32_768
TIED = 256
STATES = 8
ROUNDS, GAIN = 12, 0.005
BATCH_TOKENS = 400_000
POOL_TOKENS = 4_000_000
CHUNK = 4_096
FLUSH = 200_000
SMOOTH = 50.0


def words(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes.lower: A-Z alone; bytes.split: ASCII white space alone


def _count(batches):
    seen: Counter = Counter()

    def out():
        return pd.DataFrame({"word": [w.decode() for w in seen], "n": list(seen.values())})

    for pdf in batches:
        for t in pdf["text"]:
            seen.update(words(t))
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
    if seen:
        yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over all rows of texts; written."""
    return common.written(texts.select("text").mapInPandas(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "hmm-counts")


def most_frequent(counts: DataFrame) -> DataFrame:
    """The HEAD most frequent words. A histogram of the counts first sets a bound, so that tasks sort only what may be among them."""
    level = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2("n") * 16)).cast("long")  # 64 is level 96
    sizes = {r["level"]: r["k"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()}  # at most 1,100 rows
    held, bound = 0, 0
    for x in sorted(sizes, reverse=True):
        held += sizes[x]
        if held >= HEAD:
            bound = x
            break
    return counts.filter(level >= bound).orderBy(F.desc("n"), "word").limit(HEAD)


def _class_of(word: str) -> int:
    return zlib.crc32(word[-2:].encode()) % TIED


def _class_column(word):
    return (F.crc32(F.substring(word, -2, 2)) % TIED).cast("int")


class _Ids(dict):
    """Word to symbol: the head's words; any other has its class's, which those that end in the same two ASCII characters share."""

    def __init__(self, head):
        super().__init__((w, i + 1) for i, w in enumerate(head))
        self.ends: dict = {}

    def __missing__(self, word: bytes) -> int:
        end = word[-2:]
        symbol = self.ends.get(end)
        if symbol is None:
            symbol = len(self) + 1 + _class_of(word.decode())
            if end.isascii():
                self.ends[end] = symbol
        return symbol


def _encode(head):
    def run(batches):
        ids, first = _Ids(head.value), len(head.value) + 1
        for pdf in batches:
            for lo, hi in common.slices(pdf["text"], 500):
                cut = pdf.iloc[lo:hi]
                encoded, rest_words, rest_n = [], [], []
                for t in cut["text"]:
                    ws = words(t)
                    out = np.fromiter(itertools.chain(map(ids.__getitem__, ws), (0,)), dtype="<u2", count=len(ws) + 1)
                    n = Counter([ws[i] for i in np.flatnonzero(out >= first).tolist()])
                    encoded.append(out.tobytes())
                    rest_words.append([w.decode() for w in n])
                    rest_n.append(list(n.values()))
                yield pd.DataFrame({"rid": cut["rid"], "doc_id": cut["doc_id"], "held_out": cut["held_out"], "ids": encoded, "words": rest_words, "ks": rest_n})

    return run


def by_length(docs: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Indices of docs, longest first, in batches of about BATCH_TOKENS tokens; a longer document is a batch."""
    n = np.array([len(x) for x in docs])
    order = np.argsort(-n, kind="stable")
    batch = (np.cumsum(n[order]) - 1) // BATCH_TOKENS
    return iter(np.split(order, np.flatnonzero(np.diff(batch)) + 1)) if len(docs) else iter(())


def time_major(docs: list[np.ndarray]):
    """docs, longest first, as one array in order of time; where each time starts, and how many documents reach it."""
    n = np.array([len(x) for x in docs])
    active = len(docs) - np.concatenate([[0], np.cumsum(np.bincount(n, minlength=n[0] + 1))])[1 : n[0] + 1]
    starts = np.cumsum(active) - active
    time = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    ids = np.empty(n.sum(), dtype=np.int64)
    ids[starts[time] + np.repeat(np.arange(len(docs)), n)] = np.concatenate(docs)
    return ids, starts.tolist(), active.tolist()


def _spans(starts: list[int], active: list[int]) -> list[tuple[int, int]]:
    """Runs of times of about BATCH_TOKENS tokens; up to twice as many are one."""
    cuts = [0]
    if starts[-1] + active[-1] <= 2 * BATCH_TOKENS:
        return [(0, len(starts))]
    for t in range(1, len(starts)):
        if starts[t] + active[t] - starts[cuts[-1]] > BATCH_TOKENS:
            cuts.append(t)
    return list(zip(cuts, [*cuts[1:], len(starts)]))


def expected(docs: list[np.ndarray], model):
    """Expected counts over docs (longest first): starts, moves, emissions; and the log-likelihood."""
    begin, move, emit = model
    ids, starts, active = time_major(docs)
    spans, ones, back = _spans(starts, active), np.ones(len(begin), emit.dtype), move.T.copy()

    def forward(lo, hi, before):
        at, end = starts[lo], starts[hi - 1] + active[hi - 1]
        x = emit[ids[at:end]]
        a, scale = np.empty_like(x), np.empty(len(x), x.dtype)
        for t in range(lo, hi):
            i, m = starts[t] - at, active[t]
            y = a[i : i + m]
            if t == 0:
                y[:] = begin
            else:
                np.matmul(before[:m], move, out=y)
            y *= x[i : i + m]
            c = np.matmul(y, ones, out=scale[i : i + m])
            y /= c[:, None]
            before = y
        return x, a, scale

    befores: list = [None]
    for lo, hi in spans[:-1]:
        befores.append(forward(lo, hi, befores[-1])[1][-active[hi - 1] :].copy())
    b, ahead = np.ones((len(docs), len(begin)), emit.dtype), None
    moves, emissions, loss = np.zeros(move.shape), np.zeros(emit.shape), 0.0
    for (lo, hi), before in zip(reversed(spans), reversed(befores)):
        x, a, scale = forward(lo, hi, before)
        at = starts[lo]
        for t in range(hi - 1, lo - 1, -1):
            i, m = starts[t] - at, active[t]
            now = a[i : i + m]
            if ahead is not None:
                q = len(ahead)
                moves += now[:q].T @ ahead
                np.matmul(ahead, back, out=b[:q])
            ahead = x[i : i + m]
            ahead *= b[:m] / scale[i : i + m, None]
            now *= b[:m]  # now the posterior of the state
        loss += np.log(scale, dtype=float).sum()
        seen = ids[at : at + len(a)]
        for s in range(len(begin)):
            emissions[:, s] += np.bincount(seen, weights=a[:, s], minlength=len(emit))
    return a[: active[0]].sum(0, dtype=float), moves * move, emissions, loss


def _pools(ids_of):
    """Documents in pools of about POOL_TOKENS tokens, so that the long ones of a task meet in one batch."""
    held, size = [], 0
    for ids in ids_of:
        held.append(ids)
        size += len(ids)
        if size >= POOL_TOKENS:
            yield held
            held, size = [], 0
    yield held


def _accumulate(ids_of, model):
    model = tuple(x.astype("<f4") for x in model)
    total = None
    for docs in _pools(ids_of):
        for batch in by_length(docs):
            found = expected([docs[i] for i in batch], model)
            total = list(found) if total is None else [x + y for x, y in zip(total, found)]
    return total


def updated(total, prior: np.ndarray):
    """The maximisation step; emissions lean on the corpus distribution, so that every symbol keeps some mass."""
    begin, moves, emissions, _ = total
    k = len(begin)
    emit = emissions + SMOOTH * prior[:, None]
    return (begin + 1) / (begin.sum() + k), (moves + 1) / (moves.sum(1, keepdims=True) + k), emit / emit.sum(0)


def initial(prior: np.ndarray, seed: int = 7):
    rng = np.random.default_rng(seed)
    emit = prior[:, None] * rng.gamma(1.0, 1.0, (len(prior), STATES)) + 1e-3 * prior[:, None]
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    return np.full(STATES, 1 / STATES), move, emit / emit.sum(0)


def _ids(pdf):
    return (np.frombuffer(b, dtype="<u2") for b in pdf)


def _expect(model):
    def run(batches):
        total = _accumulate((x for pdf in batches for x in _ids(pdf["ids"])), model.value)
        if total is not None:
            begin, moves, emissions, loss = total
            pid = TaskContext.get().partitionId()
            parts = [(-1, np.concatenate([begin, moves.ravel(), [loss]]))]
            parts += [(i // CHUNK, emissions[i : i + CHUNK].ravel()) for i in range(0, len(emissions), CHUNK)]
            yield pd.DataFrame({"chunk": [c for c, _ in parts], "lane": pid % 32, "data": [x.astype("<f4" if c >= 0 else "<f8").tobytes() for c, x in parts]})

    return run


def _sum(key, pdf):
    kind = "<f4" if pdf["chunk"].iloc[0] >= 0 else "<f8"
    data = np.sum([np.frombuffer(b, dtype=kind).astype("<f8") for b in pdf["data"]], axis=0)
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "lane": [-1], "data": [data.astype(kind).tobytes()]})


def baum_welch(training: DataFrame, prior: np.ndarray, rounds: int = ROUNDS):
    """training: ids. Returns the model's arrays and the log-likelihood of every round, all over all training rows."""
    spark, k = training.sparkSession, STATES
    model, losses = initial(prior), []
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        parts = training.mapInPandas(_expect(sent), "chunk int, lane int, data binary")
        lanes = parts.groupBy("chunk", "lane").applyInPandas(_sum, "chunk int, lane int, data binary")
        got = {r["chunk"]: r["data"] for r in lanes.groupBy("chunk").applyInPandas(_sum, "chunk int, lane int, data binary").collect()}
        sent.destroy()
        if not got:
            break
        small = np.frombuffer(got.pop(-1), dtype="<f8")
        emissions = np.concatenate([np.frombuffer(got[c], dtype="<f4").astype(float) for c in sorted(got)]).reshape(-1, k)
        losses.append(small[-1])
        model = updated((small[:k], small[k : k + k * k].reshape(k, k), emissions, small[-1]), prior)
        if len(losses) > 1 and losses[-1] - losses[-2] < GAIN * abs(losses[-2]):
            break
    return model, losses


def log10_likelihood(docs: list[np.ndarray], model) -> np.ndarray:
    """Scaled forward recursion over whole documents, all documents of a batch side by side."""
    begin, move, emit = model
    out = np.zeros(len(docs))
    for batch in by_length(docs):
        ids, starts, active = time_major([docs[i] for i in batch])
        total, a = np.zeros(len(batch)), None
        for t, (i, m) in enumerate(zip(starts, active)):
            x = (begin if t == 0 else a[:m] @ move) * emit[ids[i : i + m]]
            c = x.sum(1)
            a = x / c[:, None]
            total[:m] += np.log10(c)
        out[batch] = total
    return out


def _score(sent):
    def run(batches):
        model, base = sent.value
        for pdf in batches:
            docs = list(_ids(pdf["ids"]))
            score = log10_likelihood(docs, model)
            heads = [d[d < len(base)] for d in docs]
            yield pd.DataFrame({
                "rid": pdf["rid"], "doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "n_tokens": [len(d) for d in docs], "hmm": score,
                "known_head": [int(np.isfinite(base[h]).sum()) for h in heads], "base_head": [float(base[h].sum()) for h in heads],
            })

    return run


def score(docs: DataFrame, held_out) -> DataFrame:
    """docs: doc_id, text; held_out: a boolean column of rows that are scored but not learnt from.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and log10 per token as `per_token`.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    d = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    counts = word_counts(d.filter(~F.col("held_out")))
    ends = d.filter(~F.col("held_out")).count()
    seen = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    total, kinds = seen["n"] + ends, seen["v"] + (ends > 0)
    top = most_frequent(counts).collect()  # bounded by HEAD
    head = [r["word"].encode() for r in top]
    head_n = np.array([ends, *(r["n"] for r in top)], dtype=float)
    ranks = sc.broadcast(head)
    encoded = common.written(d.mapInPandas(_encode(ranks), f"rid long, doc_id {kind}, held_out boolean, ids binary, words array<string>, ks array<long>"), "hmm-ids")
    # the words outside the head, joined with their counts
    if top:
        last = top[-1]
        tail = counts.filter((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") > last["word"])))
    else:
        tail = counts
    sizes = {r["c"]: (r["n"], r["v"]) for r in tail.groupBy(_class_column(F.col("word")).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}  # at most TIED rows
    class_n = np.array([sizes.get(c, (0, 0))[0] for c in range(TIED)], dtype=float)
    class_z = np.array([sum(sizes.get(c, (0, 0))) + 1 for c in range(TIED)], dtype=float)
    z = F.element_at(F.array(*[F.lit(float(x)) for x in class_z]), _class_column(F.col("word")) + 1)
    found = encoded.select("rid", F.explode(F.arrays_zip("words", "ks")).alias("r")).select("rid", F.col("r.words").alias("word"), F.col("r.ks").alias("k")).join(tail, "word", "left")
    c = F.coalesce("n", F.lit(0)).cast("double")
    rest = found.groupBy("rid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("known_rest"),
        F.sum(F.col("k") * F.log10((c + 1) / F.lit(float(total + kinds + 1)))).alias("base_rest"),
        F.sum(F.col("k") * F.log10((c + 1) / z)).alias("word_rest"),
    )
    prior = np.concatenate([head_n + 1, class_n + 1])
    prior /= prior.sum()
    model, _ = baum_welch(encoded.filter(~F.col("held_out")).select("ids"), prior)
    with np.errstate(divide="ignore"):
        base = np.where(head_n >= 0, np.log10((head_n + 1) / (total + kinds + 1)), 0)
    known_end = 1 if ends else 0
    scored = encoded.select("rid", "doc_id", "held_out", "ids").mapInPandas(
        _score(sc.broadcast((model, base))), f"rid long, doc_id {kind}, held_out boolean, n_tokens long, hmm double, known_head long, base_head double"
    )
    zero = lambda name: F.coalesce(name, F.lit(0.0))
    out = scored.join(rest, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known_head") - (1 - known_end) + F.coalesce("known_rest", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_head") + zero("base_rest")).alias("base_score"), (F.col("hmm") + zero("word_rest")).alias("score"),
    )
    return out.withColumn("per_token", F.col("score") / F.col("n_tokens"))
