import itertools
import pathlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from provgraph.llm import common, components, decontamination, embedding_dedup, hmm, kneser_ney, minhash, packing, pii, rendering, sstable, tokens, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the and of harbour lantern river stone copper window garden silver morning letter bridge winter signal".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOC).repartition(2)


TEXTS = [(0, "Hello, world"), (1, None), (2, ""), (3, prose(1, 3000)), (4, "Hello, world"), (5, "a\x1cb  c"), (5, "x y")]


def library_ids(name, text):
    from tokenizers import Tokenizer

    return np.asarray(Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids, dtype="<u4")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(public_tokenizers.path(name)), tokens.Encoder(public_tokenizers.path(name))
    rng = random.Random(3)
    parts = [*"aAbeéE1290.,;'!?-_/<|>\n\n  \t\r\"()@#ßÀ", "don't", "'ll", " the", "<|endoftext|>", "<|startoftext|>", "\n\n", "  ", "İ", "ı", "日"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["", " ", "a  b\n\nc ", "it's don't 12ab", "ÀÉ naïve Ÿ", "é x", "日本 語", "x\x1cy", "hello <|endoftext|> world", prose(2, 30_000), "x" * 5_000]
    for text in texts:
        assert e.encode(text) == np.asarray(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_hmm_batches_go_forward_once():
    """A batch just over BATCH_TOKENS is one span, so that its forward pass is not made again."""
    held = [np.zeros(1000, dtype="<u2")] * 401
    assert sum(map(len, held)) > hmm.BATCH_TOKENS
    assert len(hmm._spans(*hmm.time_major(held)[1:])) == 1


def test_encoder_cuts_no_plain_words_by_pattern():
    e = tokens.Encoder(public_tokenizers.path(sstable.TOKENIZER))
    e.pattern = object()  # nothing to cut with
    for text in ("hello world. Naïve, über? x!", "so a\nstone lies; élan.", "word " * 50 + "end."):
        assert e.encode(text) == library_ids(sstable.TOKENIZER, text).tobytes()


LONG = [(8, prose(3, 30_000)), (9, "a <|endoftext|> b"), (None, "null id")]


@pytest.mark.parametrize("length", [64, 48])
def test_packing_is_gapless_and_equals_library(spark, length):
    path = public_tokenizers.path(packing.TOKENIZER)
    clash = docs(spark, TEXTS + LONG).withColumn("part", F.lit("x")).withColumn("n", F.lit(1)).withColumn("ids", F.lit(2)).withColumn("before", F.lit(3))
    got = packing.digest(packing.pack(clash, path, length)).toPandas()
    want = Counter()
    for i, text in TEXTS + LONG:
        want[(i, len(library_ids(packing.TOKENIZER, text or "")) + 1)] += 1
    whole = got.groupby(["doc_id", "doc_tokens"], dropna=False)["length"].sum()
    assert {(None if np.isnan(i) else int(i), n): k for (i, n), k in whole.items()} == {(i, n): n * k for (i, n), k in want.items()}
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= length
    assert got.groupby("sequence_id")["length"].sum().sort_index().iloc[:-1].eq(length).all()
    for i, text in [*TEXTS[:5], *LONG[:2]]:
        ids = [*library_ids(packing.TOKENIZER, text or ""), packing.END]
        for r in got[got.doc_id == i].itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32
    assert packing.pack(docs(spark, []), path).count() == 0


def test_shards_round_trip_and_lookup(spark):
    path = public_tokenizers.path(sstable.TOKENIZER)
    rows = [(i, prose(i, 40)) for i in range(-3, 60)] + [(7, "again"), (7, "again"), (70, None), (71, ""), *LONG]
    clash = docs(spark, rows).withColumn("shard", F.lit("x")).withColumn("path", F.lit(1)).withColumn("entries", F.lit(2))
    manifest = sstable.write(clash, path)
    got = sstable.digest(sstable.read(spark, manifest)).toPandas().sort_values("start")
    want = Counter((i, zlib.crc32(np.array([*library_ids(sstable.TOKENIZER, t or ""), sstable.END], dtype="<u4").tobytes())) for i, t in rows)
    assert Counter((None if np.isnan(i) else int(i), c) for i, c in zip(got["doc_id"].astype(float), got["ids_crc32"])) == want
    assert list(got["start"]) == [0, *got["n_tokens"].cumsum()[:-1]]
    ids = [-(10**9) if np.isnan(i) else i for i in got["doc_id"].astype(float)]
    assert ids == sorted(ids)
    with sstable.open_uri(next(r["path"] for r in manifest.collect() if r["first_key"] <= sstable.key_of(7) <= r["last_key"]), "r") as f:
        found = sstable.Shard(f).lookup(7)
        known = {len(library_ids(sstable.TOKENIZER, t)) + 1 for t in (prose(7, 40), "again")}
        assert found and {len(x) for x in found} <= known
        assert sstable.Shard(f).lookup(10**9) == []
    assert sstable.read(spark, sstable.write(docs(spark, []), path)).count() == 0


def brute_forward(ids, model):
    begin, move, emit = model
    a = begin * emit[ids[0]]
    for i in ids[1:]:
        a = (a @ move) * emit[i]
    return np.log10(a.sum())


def brute_counts(ids, model):
    """Expected counts of one document by summing over all paths of states."""
    begin, move, emit = model
    k = len(begin)
    starts, moves, emissions, total = np.zeros(k), np.zeros((k, k)), np.zeros(emit.shape), 0.0
    for path in itertools.product(range(k), repeat=len(ids)):
        p = begin[path[0]] * emit[ids[0], path[0]]
        for t in range(1, len(ids)):
            p *= move[path[t - 1], path[t]] * emit[ids[t], path[t]]
        total += p
        starts[path[0]] += p
        for t, s in enumerate(path):
            emissions[ids[t], s] += p
            if t:
                moves[path[t - 1], s] += p
    return starts / total, moves / total, emissions / total


@pytest.mark.parametrize("batch_tokens", [400_000, 4])
def test_forward_and_expected_counts(monkeypatch, batch_tokens):
    monkeypatch.setattr(hmm, "BATCH_TOKENS", batch_tokens)
    monkeypatch.setattr(hmm, "STATES", 3)
    rng = np.random.default_rng(1)
    model = hmm.initial(np.full(6, 1 / 6))
    data = [rng.integers(0, 6, n) for n in (7, 1, 5, 3)]
    assert np.allclose(hmm.log10_likelihood(data, model), [brute_forward(d, model) for d in data])
    want = [sum(x) for x in zip(*(brute_counts(d, model) for d in data))]
    total = None
    for batch in hmm.by_length(data):
        got = hmm.expected([data[i] for i in batch], model)
        total = got if total is None else [x + y for x, y in zip(total, got)]
    assert all(np.allclose(x, y, atol=1e-6) for x, y in zip(total, want))
    assert np.isclose(total[3] / np.log(10), sum(brute_forward(d, model) for d in data))


def test_hmm_counts(spark):
    rows = [*TEXTS, (None, "hello  WORLD again"), (9, prose(1, 3000)), (10, " ".join(f"w{i}" for i in range(50_000)))]
    clash = docs(spark, rows).withColumn("rid", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("words", F.lit(2)).withColumn("word", F.lit(3))
    got = hmm.score(clash, F.coalesce(F.col("doc_id") == 4, F.lit(False))).collect()
    counts = Counter()
    for i, t in rows:
        if i != 4:
            counts.update([*(t or "").encode().lower().split(), b"\x00end"])
    n, v = sum(counts.values()), len(counts)
    want = sorted((i if i is not None else -1, len(x), sum(counts[w] > 0 for w in x), sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in x)) for i, x in ((i, [*(t or "").encode().lower().split(), b"\x00end"]) for i, t in rows))
    have = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["base_score"]) for r in got)
    assert all(a[:3] == b[:3] and np.isclose(a[3], b[3]) for a, b in zip(have, want)) and len(have) == len(want)
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got) and [r["doc_id"] for r in got if r["held_out"]] == [4]
    assert hmm.score(docs(spark, []), F.lit(False)).count() == 0
    assert hmm.score(docs(spark, TEXTS), F.lit(True)).filter("train_tokens = 0 AND n_known = 0").count() == len(TEXTS)


def test_toxicity(spark):
    rows = [(i, prose(i, 40) + (" you utter scoundrel" if i % 3 == 0 else "")) for i in range(120)] + [(200, None)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs(spark, rows), labels, F.lit(False), F.lit(True)).collect()}
    assert all(got[i] == int(i % 3 == 0) for i in range(90, 120)) and got[200] in (0, 1)
    flat = toxicity.score(docs(spark, rows), labels.filter("toxic = 0"), F.lit(False), F.lit(True))
    assert {r["score"] for r in flat.collect()} == {0.0}


def test_toxicity_of_pairs_only(spark):
    """Words that each stand as often in clean rows as in toxic ones are told apart by their pairs, and scores equal the plain sum over all pairs."""
    rng = random.Random(3)
    rows = []
    for i in range(1000):
        pick = ["amber brook", "cedar delta"] if i % 5 == 0 else ["amber cedar", "amber delta", "brook cedar", "brook delta"]
        words = [f"w{rng.randrange(300)}" for _ in range(20)] + rng.choice(pick).split()
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(1000)], "doc_id long, quality int, toxic int")
    held = F.col("doc_id") % 4 == 1
    chosen, bias, linear, factors, _ = model = toxicity.fit(docs(spark, rows), labels, ~held)
    assert {toxicity._hash("w " + w) for w in ("amber", "brook", "cedar", "delta")} <= set(chosen)
    score = dict(zip(range(1000), toxicity._scorer(model)([t for _, t in rows])))
    out = [i for i in range(1000) if i % 4 == 1]
    assert np.mean([(score[i] >= 0.5) == (i % 5 == 0) for i in out]) >= 0.97
    for i in out[:20]:
        at = [chosen.index(b) for b in toxicity.buckets(rows[i][1]) if b in set(chosen)]
        z = bias + sum(linear[a] for a in at) + sum(factors[a] @ factors[b] for n, a in enumerate(at) for b in at[:n])
        assert np.isclose(score[i], 1 / (1 + np.exp(-z)))
    counts = [[0, 1], [0], [1], []]
    assert toxicity.telling_pairs(counts * 3, np.array([1, 0, 0, 0] * 3, dtype=float), 2) == []  # too few rows to be sure


def test_near_duplicates(spark):
    """Classes equal those of all pairs, in a group of near copies of which few are similar to each other."""
    rng = random.Random(3)
    base = prose(5, 200).split()
    near = base[:100] + ["changed"] + base[101:]
    half = base[:100] + prose(6, 100).split()
    rows = [(10, " ".join(base)), (11, " ".join(near)), (12, " ".join(half)), (13, " ".join(base)), (14, None), (15, ""), (16, "one two"), (17, "one two"), (16, "one two"), (16, prose(30, 20)), (None, prose(31, 20)), (None, " ".join(base)), (18, prose(32, 30_000))]
    hot = prose(7, 100).split()
    for i in range(400):
        copy = list(hot)
        for _ in range(rng.choice([1, 2, 4])):
            copy[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(copy)))
    sets = [set(minhash.units(minhash.shingles(t or "")).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= minhash.SIMILARITY * len(x | sets[j]) > 0:
                root[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i, (d, _) in enumerate(rows):
        members.setdefault(find(i), []).append(d)
    least = {k: min((d for d in g if d is not None), default=None) for k, g in members.items()}
    want = Counter((d, least[find(i)]) for i, (d, _) in enumerate(rows))
    clash = docs(spark, rows).withColumn("rid", F.lit("x")).withColumn("words", F.lit(1)).withColumn("kept", F.lit(2))
    got = minhash.classes(clash).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(members) and all(r["doc_id"] == r["class_id"] for r in got if r["kept"])
    assert minhash.classes(docs(spark, [])).count() == 0


def test_signature_estimates_weighted_similarity():
    a = minhash.shingles(prose(8, 400))
    b = np.concatenate([a[:300], minhash.shingles(prose(9, 120))])
    agree = (minhash.signature(minhash.units(a)) == minhash.signature(minhash.units(b))).mean()
    assert abs(agree - minhash.similarity(a, b)) < 0.12


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    got = {r["u"]: r["component"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {x: x for e in links for x in e}

    def find(x):
        return x if root[x] == x else find(root[x])

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in links)}


def plain_distance(item, text):
    """The least edit distance of item to any substring of text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
    return min(row)


def test_edit_matching(spark):
    rng = random.Random(9)
    items = [prose(20, 12), prose(21, 6), "short", "two words", "!!", prose(20, 12), "a" * 40]

    def edited(t, n):
        for _ in range(n):
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice(["", "z", "yy"]) + t[at + 1 :]
        return t

    rows = [(i, f"{prose(40 + i, 10)} {edited(items[i % 2], i % 9)} {prose(80 + i, 5)}") for i in range(40)]
    rows += [(100, "a short note"), (101, "shortly"), (102, "TWO  words"), (103, None), (104, ""), (None, items[0]), (100, "nothing"), (105, prose(24, 30_000) + " " + items[1]), (106, "a" * 43)]
    bench = spark.createDataFrame([*enumerate(items), (8, None), (None, items[0]), (0, items[0])], "item_id long, text string")
    clash = docs(spark, rows).withColumn("item_id", F.lit("x")).withColumn("item", F.lit(1))
    got = Counter((r["doc_id"], r["item_id"], r["distance"]) for r in decontamination.find(clash, bench).collect())
    want = Counter()
    for d, t in rows:
        text = decontamination.normalised(t or "")
        for i, item in enumerate(map(decontamination.normalised, items)):
            if item and len(item) < decontamination.EDIT_EVERY:
                want[(d, i, 0)] += f" {item} " in f" {text} "
            elif item and len(text) < 2000:
                n = plain_distance(item, text)
                want[(d, i, n)] += n <= len(item) // decontamination.EDIT_EVERY
    want[(105, 1, 0)] += 1
    assert got == +want
    left = decontamination.clean(clash, bench)
    assert left.columns == clash.columns and Counter(r["text"] for r in left.collect()) == Counter(t for d, t in rows if t != items[0] and not any(k[0] == d and not (d == 100 and t == "nothing") for k in got))
    assert decontamination.find(docs(spark, rows), bench.filter("false")).count() == 0 and decontamination.find(docs(spark, []), bench).count() == 0


def test_embeddings(spark, monkeypatch):
    """Links, counts and classes equal those of all pairs, with blocks small enough that windows matter."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 16))
    rows = [(i, v, i % 2) for i, v in enumerate(base)]
    rows += [(200 + i, base[i] + 0.02 * rng.standard_normal(16), i % 2) for i in range(60)]
    rows += [(300 + i, base[0] + 0.03 * rng.standard_normal(16), 0) for i in range(130)]  # a group of many blocks
    rows = [(i, [float(x) for x in v], y) for i, v, y in rows]
    rows += [(500, rows[0][1], 0), (501, None, 0), (502, [0.0] * 16, 0), (503, [None] + [1.0] * 15, 1), (504, rows[0][1], None), (505, [float("nan")] * 16, 0), (506, [1.0], 0), (506, [1.0], 0), (507, [], 1)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("block", F.lit("x")).withColumn("x", F.lit(1)).withColumn("keys", F.lit(2))
    sound = [i for i, (_, v, y) in enumerate(rows) if v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in sound:
        for j in sound:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], dtype="f4").astype(float) for k in (i, j))
                if a @ b >= 0.98 * np.linalg.norm(a) * np.linalg.norm(b):
                    links[i].add(j)
    component = list(range(len(rows)))
    for _ in rows:
        for i in links:
            component[i] = min([component[i], *(component[j] for j in links[i])], key=lambda c: rows[c][0])
    want = sorted((rows[i][0], len(links[i]), rows[component[i]][0]) for i in range(len(rows)))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.linked(e).collect())
    assert sum(n for _, n, _ in got) >= 0.97 * sum(n for _, n, _ in want) and all(g[1] <= w[1] for g, w in zip(got, want))
    assert [(g[0], g[2]) for g in got] == [(w[0], w[2]) for w in want]
    assert embedding_dedup.linked(e.filter("false")).count() == 0


def luhn(d):
    return sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    """The base spans by the four patterns and checks as they are stated."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, rule, good) in enumerate(rules) for m in re.finditer(rule, text) if good(m[0])]
    return ",".join(f"{name}:{s}:{e}" for s, _, name, e in sorted(found))


def test_pii_base_equals_plain_patterns(spark):
    rng = random.Random(8)
    parts = ["a", "b.c", "@", ".", "1", "23", "255", "256", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "+49 30 123456789", "x@y.co", "1.2.3.4", "é", "\x01", "\n", "_"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(600)] + [(None, "x@y.co"), (1, "x@y.co"), (2, None)]
    got = Counter((r["doc_id"], r["base"]) for r in pii.find(docs(spark, rows)).collect())
    assert got == Counter((i, plain_spans((t or "").replace("\x01", "\x03"))) for i, t in rows)
    assert pii.find(docs(spark, [])).count() == 0


def test_pii(spark):
    rows = [(1, "é mail a@b.co now"), (2, None), (3, ""), (3, "x@y.zz 1.2.3.4"), (None, "a@b.co"), (4, " ".join(f"{i}.1.2.3 555-{i:04}" for i in range(2000)))]
    clash = docs(spark, rows)
    for c in ("_p", "_s", "_m", "_clean", "_base", "_cand", "_spans", "_near", "row"):
        clash = clash.withColumn(c, F.lit(c))
    red = pii.redact(clash)
    assert red.columns == clash.columns
    got = red.collect()
    assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] in (1, 2)} == {1: "é mail [EMAIL] now", 2: None}
    assert {r["text"] for r in got if r["doc_id"] in (3, None)} == {"", "[EMAIL] [IP]", "[EMAIL]"}
    assert all(r[c] == c for r in got for c in ("_p", "_base", "_near", "row")) and all(r["n_chars"] == len(r["text"] or "") for r in got)
    assert next(r["text"] for r in got if r["doc_id"] == 4).count("[IP]") == 256


def test_pii_adds_loose_formats(spark):
    rng = random.Random(11)
    strict = ["a{}@mail.example.com", "+1 ({0:03}) 555-{1:04}", "10.{0}.7.{0}", "4111 1111 1111 1111", "5105 1051 0510 5100"]
    wrong = ["41111111{1:04}1112", "20{0:02}-01-02 {0:02}", "me @ home. Then", "id 77{1:04}{1:04}"]
    rows = [(i, f"{prose(i, 8)} x " + rng.choice(strict if i % 2 else wrong).format(rng.randrange(10, 100), rng.randrange(1000, 9999)) + " y") for i in range(400)]
    loose = {1000: ("email", "name (at) host (dot) org"), 1001: ("phone", "(132) 555-1352"), 1002: ("card", "4111.1111.1111.1111"), 1003: ("card", "5105/1051/0510/5100"), 1004: ("email", "name [at] a.host [dot] org")}
    bad = {1010: "4111.1111.1111.1112", 1011: "2024-01-02 03", 1012: "you @ home. Then"}
    rows += [(i, f"see {m} now") for i, (_, m) in loose.items()] + [(i, f"see {m} now") for i, m in bad.items()]
    got = {r["doc_id"]: r for r in pii.find(docs(spark, rows)).collect()}
    for i, (kind, m) in loose.items():
        assert got[i]["base"] == "" and got[i]["spans"] == f"{kind}:4:{4 + len(m)}", (i, got[i])
    assert all(got[i]["spans"] == "" for i in bad)


def test_kneser_ney(spark):
    rows = [(i, prose(i, 60)) for i in range(200)] + [(300, "@@ ## %% zq xv " * 30), (301, None), (None, prose(301, 60)), (301, "")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(300, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    clash = docs(spark, rows).withColumn("score", F.lit("x")).withColumn("q", F.lit(1)).withColumn("l", F.lit(2)).withColumn("n", F.lit(3))
    got = {r["doc_id"]: r for r in kneser_ney.judged(clash, labels).collect()}
    assert not got[300]["kept"] and sum(got[i]["kept"] for i in range(120)) >= 114
    assert sum(got[i]["kept"] for i in range(120, 200)) >= 72  # documents without a label fare like labelled ones
    assert kneser_ney.judged(docs(spark, rows), labels.filter("false")).filter("kept").count() == len(rows)
    assert kneser_ney.judged(docs(spark, []), labels).count() == 0


def test_kneser_ney_sums_to_one(spark):
    texts = ["a b a c", "a b b", "c a b"]
    model = kneser_ney.train(docs(spark, list(enumerate(texts))).select("text"))
    table = kneser_ney.Table(*model[:2])
    ids = {w: int(kneser_ney.token_ids(w)[2]) for w in "abc"} | {"end": kneser_ney.END, "unseen": 12345}
    for u, v in (("a", "b"), ("c", "a")):
        total = 0.0
        for w in ids.values():
            x = np.array([ids[u]]), np.array([ids[v]]), np.array([w])
            p = table.get(kneser_ney.entry_key(1, x[2]), model[2])
            for tag, parts in ((4, x[1:2]), (2, x[1:]), (5, x[:2]), (3, x)):
                p = p + table.get(kneser_ney.entry_key(tag, *parts), 0.0)
            total += 10.0 ** p[0]
        assert abs(total - 1) < 1e-3


def test_rendering():
    page = "<title>t</title><h1>A &amp; B</h1><p>one<p>two<br>three<ul><li>x<li>y<ol start=3><li>z</ol></ul><div hidden>no</div><script>'</p>'</script><table><tr><th>k<th>v<tr><td>long<td>1</table>"
    assert rendering.text_of(page) == "A & B\n\none\n\ntwo\nthree\n\n- x\n- y\n  3. z\n\nk     v\nlong  1"
    assert rendering.text_of("") == "" and "deep" in rendering.text_of("<div>" * 3000 + "deep") and rendering.text_of("<" * 50)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<table><tr>stray<td>a<tr><form><td>b<td>c</form></tr><tr><a>d</a></table>", "stray  a\nb      c\nd"),
        ("<textarea>a &lt; b</textarea><svg><title>t</title><text>in</text></svg> <xmp><b>raw</b></xmp>", "a < bin\n<b>raw</b>"),
        ("<table><tr><td><pre>x\ny</pre><td>z</table>", "x  z\ny"),
        ("<dialog>no</dialog><dialog open>yes</dialog><p style='opacity: 0'>no<p style='opacity:0.5'>half", "yes\n\nhalf"),
        ("<div>" * 300 + "<i hidden>no<b>no</b></i>yes" + "</div>" * 300 + "<p>after", "yes\n\nafter"),
        ("<p>a<p>a", "a\n\na"),
    ],
)
def test_rendering_shows_what_is_visible(page, text):
    assert rendering.text_of(page) == text


def test_rendering_pads_within_bounds():
    page = "<table><tr><td>" + "x" * 20_000 + "<td>1" + "<tr><td>y<td>2" * 300 + "</table>"
    out = rendering.text_of(page)
    assert "x" * 20_000 in out and len(out) < 20_000 + 300 * (rendering.PAD + 10)
    assert len(rendering.text_of("<b>" * 20_000 + "deep" + "</p>" * 2_000)) == 4


def test_rendered_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "word " * 200_000)], "page_id long, url string, html string").withColumn("text", F.lit(7))
    got = sorted((r["page_id"] or 0, r["n_chars"], r["n_lines"]) for r in rendering.rendered(pages).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 0, 0), (3, 999_999, 1)]
    assert rendering.rendered(pages.filter("false")).count() == 0


def test_kneser_ney_against_a_plain_model(spark):
    """Interpolated modified Kneser-Ney by loops over plain dictionaries, for texts in and out of training."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(40)], k=rng.randrange(0, 30))) for _ in range(300)]
    words = lambda t: ["<s>", "<s>", *t.split(), "</s>"]
    three = Counter(tuple(words(t)[i : i + 3]) for t in texts for i in range(len(words(t)) - 2))
    two = Counter(k[1:] for k in three)
    one = Counter(k[1:] for k in two)

    def level(counts):
        n = [sum(c == i for c in counts.values()) or 1 for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [0.0] + [min(0.95 * i, max(0.1, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]
        total, held = Counter(), Counter()
        for k, c in counts.items():
            total[k[:-1]] += c
            held[k[:-1]] += d[min(c, 3)]
        return counts, d, total, held

    def probability(key, levels):
        if not levels:
            return 1 / (len(one) + 1)
        counts, d, total, held = levels[0]
        lower = probability(key[1:], levels[1:])
        if key[:-1] not in total:
            return lower
        c = counts.get(key, 0)
        return (c - d[min(c, 3)]) / total[key[:-1]] + held[key[:-1]] / total[key[:-1]] * lower

    levels = [level(three), level(two), level(one)]
    keys, values, unseen = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    asked = [*texts[:50], "", "w0 never w1 w2", "w39 w38 w37 w39", "never ever", "w1 " * 200]
    got, n = kneser_ney.log10_scores(asked, kneser_ney.Table(keys, values), unseen)
    for t, score, size in zip(asked, got, n):
        w = words(t)
        assert size == len(w) - 2
        assert score == pytest.approx(sum(np.log10(probability(tuple(w[i : i + 3]), levels)) for i in range(size)), rel=1e-4, abs=1e-4)


def test_kneser_ney_learns_from_all_trusted_documents(spark, monkeypatch):
    """Each document's score is that of a model of all trusted documents of the other half; thresholds come from all trusted documents."""
    monkeypatch.setattr(kneser_ney, "SLICE", 100_000)  # several slices and parts
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.8)) % 500}" for _ in range(rng.randrange(1, 12)))) for i in range(6000)]
    trusted = 5000
    labels = spark.createDataFrame([(i, 1, 0) for i in range(trusted)], "doc_id long, quality int, toxic int")
    table = docs(spark, rows)
    half = {r["doc_id"]: r["h"] for r in table.select("doc_id", (common.hashed("doc_id") % 2).alias("h")).collect()}
    got = {r["doc_id"]: r for r in kneser_ney.judged(table, labels).collect()}
    assert len(got) == len(rows)
    for h in (0, 1):
        keys, values, unseen = kneser_ney.train(spark.createDataFrame([(t,) for i, t in rows[:trusted] if half[i] != h], "text string"))
        asked = [(i, t) for i, t in rows if half[i] == h]
        score, n = kneser_ney.log10_scores([t for _, t in asked], kneser_ney.Table(keys, values), unseen)
        for (i, _), s, k in zip(asked, score, n):
            assert got[i]["n_tokens"] == k and got[i]["perplexity"] == pytest.approx(10 ** (-s / k), rel=1e-4)
    bound = np.quantile([got[i]["perplexity"] for i in range(trusted)], kneser_ney.QUANTILE, method="inverted_cdf")
    assert got[0]["threshold"] == pytest.approx(bound, rel=1e-2)


def test_kneser_ney_splits_frequent_words(spark, monkeypatch):
    """Many parts, a word that fills several of them, and few bytes in the shared folder: the scores of the plain model."""
    monkeypatch.setattr(kneser_ney, "SLICE", 20_000)
    folder, sizes, write = pathlib.Path(common.shared_dir(spark).removeprefix("file://")), [], common.written
    held = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before, rng = held(), random.Random(13)

    def written(*args):
        out = write(*args)
        sizes.append(held() - before)
        return out

    monkeypatch.setattr(common, "written", written)
    rows = [(i, " ".join(rng.choice([".", f"w{int(rng.paretovariate(0.8)) % 3000}"]) for _ in range(400))) for i in range(1000)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    table = docs(spark, rows)
    got = {r["doc_id"]: r for r in kneser_ney.judged(table, labels).collect()}
    assert max(sizes) < 0.3 * sum(len(t) for _, t in rows)
    monkeypatch.setattr(common, "written", write)
    half = {r["doc_id"]: r["h"] for r in table.select("doc_id", (common.hashed("doc_id") % 2).alias("h")).collect()}
    for h in (0, 1):
        keys, values, unseen = kneser_ney.train(spark.createDataFrame([(t,) for i, t in rows[:100] if half[i] != h], "text string"))
        asked = [(i, t) for i, t in rows if half[i] == h]
        for (i, _), s, k in zip(asked, *kneser_ney.log10_scores([t for _, t in asked], kneser_ney.Table(keys, values), unseen)):
            assert got[i]["n_tokens"] == k and got[i]["perplexity"] == pytest.approx(10 ** (-s / k), rel=1e-4)
    size = sum(len(t) + 100 for _, t in rows)
    assert kneser_ney._ways(table, len(rows), 1 + size // (kneser_ney.PART * kneser_ney.SLICE))[kneser_ney._word(".")] > 2


def test_kneser_ney_keeps_little_on_disk(spark, monkeypatch):
    """What is in the shared folder at once stays below the size of the texts."""
    monkeypatch.setattr(kneser_ney, "SLICE", 1_000_000)
    rng, folder, sizes, write = random.Random(12), pathlib.Path(common.shared_dir(spark).removeprefix("file://")), [], common.written
    held = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = held()

    def written(*args):
        out = write(*args)
        sizes.append(held() - before)
        return out

    monkeypatch.setattr(common, "written", written)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.8)) % 20_000}" for _ in range(200))) for i in range(2000)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    assert kneser_ney.judged(docs(spark, rows), labels).count() == 2000
    assert max(sizes) < sum(len(t) for _, t in rows)
