"""Exact duplicates, whitening and divergence of sources, against brute force and SQL."""

import hashlib
import itertools
import math
import os
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provgraph.llm import common, divergence, embedding_dedup, exact_dedup, kneser_ney, minhash, registry, rendering, toxicity, whitening

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    got = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    at = [list(want.columns).index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


# exact duplicates


def brute_dedup(rows):
    groups = defaultdict(list)
    for at, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, at))
    out = []
    for bare, members in groups.items():
        best = min(members)
        for m in members:
            out.append((None if m[1] else m[2], None if best[1] else best[2], len(members), hashlib.sha256(bare.encode()).hexdigest()))
    return Counter(out), Counter(min(m)[1:3] for m in groups.values())


TEXTS = [
    (5, "a b"), (3, "ab"), (4, "a\tb"), (9, " a\nb"), (None, "a  b "), (2, None), (1, ""), (7, " \x0b"), (8, "é𝄞"), (6, "é𝄞"), (6, "é𝄞"), (10, "x" * 300_000), (11, "x" * 300_000 + "\r"),
    (None, "only"), (None, "only"), (-(1 << 63), "least"), ((1 << 63) - 1, "least"), (12, "a b"),
]


@pytest.mark.parametrize("known", ["true", "false", "doc_id % 2 = 0"])
def test_exact_dedup(spark, monkeypatch, known):
    monkeypatch.setattr(exact_dedup, "KEYS", 64)
    monkeypatch.setattr(exact_dedup, "ROWS", 16)  # the empty text is dealt to several tasks
    rng = random.Random(1)
    rows = TEXTS + [(i, f"{' ' * rng.randrange(3)}word{rng.randrange(500)}") for i in range(20, 900)] + [(i, " " * (i % 7)) for i in range(1000, 1400)]
    clash = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).withColumn("row", F.lit("x")).withColumn("shard", F.lit(1)).withColumn("digest", F.lit(2)).repartition(3)
    got = exact_dedup.dedup(clash, F.expr(known)).collect()
    want, stay = brute_dedup(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got if r.kept) == stay


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.dedup(spark.createDataFrame([], DOC), F.lit(True)).collect() == []


@pytest.mark.parametrize("levels", [64, 1, 0])
def test_perfect_hash_is_minimal_and_checks_bytes(levels):
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(3000)), dtype="<u8").reshape(-1, 4)
    found, slot = exact_dedup.perfect_hash(keys[:2000], levels)
    assert sorted(slot) == list(range(2000))
    slots = np.zeros(2000, dtype=exact_dedup.SLOT)
    slots["digest"][slot] = keys[:2000]
    at = exact_dedup.find_slots(keys, found, slots)
    assert (at[:2000] == slot).all() and (at[2000:] == -1).all()
    near = keys[:2000].copy()
    near[:, 3] ^= np.uint64(1)  # one bit of a known digest
    assert (exact_dedup.find_slots(near, found, slots) == -1).all()


def test_index_of_an_earlier_run(spark):
    old = exact_dedup.classes(exact_dedup.fingerprints(spark.createDataFrame([(1, "seen  before", "en", "s", 0)], DOC)))
    index, shards = exact_dedup.build(old)
    new = exact_dedup.fingerprints(spark.createDataFrame([(7, "seenbefore", "en", "s", 0), (8, "fresh", "en", "s", 0)], DOC))
    got = {r.doc_id: r.slot_id for r in exact_dedup.lookup(new, index, shards).collect()}
    assert got == {7: 1, 8: None}


# whitening

VEC = "vec_id long, embedding array<float>, label int"


def integers(vectors):
    return np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)


@pytest.mark.parametrize("shape", [(300, 12), (80, 50), (40, 1)])
def test_whitening(spark, shape):
    rng = np.random.default_rng(4)
    data = (rng.standard_normal(shape) @ rng.standard_normal((shape[1], shape[1])) + 3).tolist()
    odd = [(901, None, 1), (902, [], 1), (903, [1.0] * (shape[1] + 1), 1), (904, [math.nan] * shape[1], 1), (905, [None] * shape[1], 1), (906, [math.inf] * shape[1], 1), (907, [3e38] * shape[1], 1)]
    rows = [(i if i else None, v, 0) for i, v in enumerate(data)] + odd + [(5, data[5], 0)]
    got = whitening.whiten(spark.createDataFrame(rows, VEC).withColumn("n", F.lit("x")).withColumn("component", F.lit("y")).repartition(3)).toPandas()
    x = integers([*data, data[5]])
    n, sums, k = len(x), x.sum(axis=0), min(32, shape[1])
    y = ((n * x - sums) / n).astype(float)
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    assert len(got) == n * k and set(got["n"]) == {n} and got["identity_error"].max() < 1e-6
    far = {i if i else None: sum(int(v) ** 2 for v in n * x[i] - sums) for i in range(len(data))}
    known = got[got.vec_id.notna()]
    assert (known["deviation"] == known["vec_id"].astype(int).map(far)).all() and set(got[got.vec_id.isna()]["deviation"]) == {far[None]}
    assert np.allclose(got.groupby("component")["explained"].first(), values / np.trace(y.T @ y / n), rtol=1e-6)
    for c, g in known.groupby("component"):
        want = y @ axes[:, c - 1] / np.sqrt(values[c - 1])
        seen = g["whitened"].to_numpy()
        want = want[g["vec_id"].astype(int)]
        assert min(np.abs(seen - want).max(), np.abs(seen + want).max()) < 1e-6


def test_whitening_without_spread(spark):
    for rows in ([], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, None, 0)]):
        assert whitening.whiten(spark.createDataFrame(rows, VEC)).collect() == []
    flat = [(i, [float(i), 2.0 * i, 5.0], 0) for i in range(9)]  # rank 1
    got = whitening.whiten(spark.createDataFrame(flat, VEC)).collect()
    assert {r.component for r in got} == {1} and len(got) == 9 and got[0].explained == pytest.approx(1)


def test_exact_numbers_beyond_a_word():
    x = np.array([[1 << 42, 5], [-(1 << 42), 5], [0, 6]], dtype=np.int64)
    n = 1 << 22
    d = whitening._centred(x, n, [n * 3 + 7, n * 5])
    assert d.tolist() == [[n * int(a) - n * 3 - 7, n * int(b) - n * 5] for a, b in x]
    assert whitening._deviation(d) == [None, None, (-n * 3 - 7) ** 2 + n * n]


@pytest.mark.parametrize("d", [1, 2, 7, 33])
def test_eigenvectors(d):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, d + 3)) * 10.0 ** -np.arange(d)[:, None].clip(0, 5)
    a = a @ a.T
    values, axes = whitening.principal(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-9, atol=1e-14 * np.trace(a))
    assert np.allclose(axes.T @ axes, np.eye(d), atol=1e-12) and np.allclose(a @ axes, axes * values, atol=1e-13 * np.trace(a))


# divergence of sources


def brute_divergence(rows):
    groups, df, n = {}, defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        n[lang, source].update(found)
        df[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, c in df[lang].items() if c >= 3]

        def level(counter):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 1) // (total + len(kept)) for t in kept}

        q = level(sum((n[lang, s] for s in sources), Counter()))
        p = {s: level(n[lang, s]) for s in sources}
        for s in sources:
            far = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
            own = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(sorted(far), 1)}
            out |= {(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(sorted(own)[:200], 1)}
    return out


@pytest.mark.parametrize("small", [True, False])
def test_divergence(spark, monkeypatch, small):
    if small:
        for name, v in (("BLOCK", 70), ("SLICE", 2)):
            monkeypatch.setattr(divergence, name, v)
    rng = random.Random(7)
    letters = "abcdefghiJKLMéßПİ𝄞"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(600)]
    rows = []
    for i in range(300):
        words = [vocabulary[int(600 * rng.random() ** 3)] for _ in range(rng.randrange(60))]
        rows.append((rng.choice([" ", "1-", "\n_@["]).join(words), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "d", "é", None])))
    rows += [(None, "en", "silent"), ("", "none", "x"), ("1 2", "none", "y"), ("word", "alone", "z"), (" ".join(vocabulary * 30), "en", "long"), *[("same same", "en", "a")] * 4, ("q" * 200, "en", "b")]
    docs = spark.createDataFrame([(i, t, lang, s, 0) for i, (t, lang, s) in enumerate(rows)], DOC).withColumn("term", F.lit(1)).withColumn("n", F.lit(2)).repartition(3)
    got = divergence.audit(docs).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_divergence(rows)


def test_counting_in_small_pieces(monkeypatch):
    """A task's counts are the same however often it hands them on, and however finely it cuts a text."""
    for name, v in (("ENTRIES", 5), ("CHARS", 3)):
        monkeypatch.setattr(divergence, name, v)
    texts = ["Red réd BLUE_red", "", None, "9", "red " * 50, "İé 𝄞x" * 9, "end"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t or "" for t in texts]), "lang": ["en"] * len(texts), "source": list("aabbcca")})
    seen = defaultdict(lambda: np.zeros(2, dtype=int))
    for r in itertools.chain.from_iterable(b.to_pylist() for b in divergence._count([batch])):
        seen[r["source"], r["term"].decode()] += [r["n"], r["df"]]
    want = defaultdict(lambda: np.zeros(2, dtype=int))
    for t, s in zip(texts, "aabbcca"):
        for term, n in Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")).items():
            want[s, re.sub("[A-Z]", lambda m: m[0].lower(), term)] += [n, 0]
        for term in {re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")}:
            want[s, term] += [0, 1]
    assert {k: list(v) for k, v in seen.items() if k[1]} == {k: list(v) for k, v in want.items()}
    assert {k[0] for k in seen if not k[1]} == {"a", "b", "c"} and all(not v.any() for k, v in seen.items() if not k[1])


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOC)).collect() == []
    assert divergence.audit(spark.createDataFrame([(1, "a", "en", "only", 0)], DOC)).collect() == []


def test_bitmaps_hold_each_count(spark):
    docs = spark.createDataFrame([(i, "red red blue green", "en", "a", 0) for i in range(3)] + [(9, "blue", "en", "b", 0)], DOC)
    rows, _, _ = divergence.cells(divergence.counts(docs))
    levels = {(r.at, r.n): r.bits for r in divergence.bitmaps(rows).collect()}
    assert {k: v.bit_count() for k, v in levels.items()} == {(0, 6): 1, (0, 3): 2, (1, 1): 1}
    assert levels[0, 3] & levels[1, 1] == levels[1, 1]
    assert common.table(spark, SF, "documents").count() > 0


# embeddings with a common mean, pages of tags that do not end


@pytest.mark.parametrize("typical", [0.8])
def test_links_are_found_around_a_common_mean(spark, monkeypatch, typical):
    """Twins just over the threshold, among many vectors whose cosine with each other is about `typical`."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 128)
    rng, n, twins, dim = np.random.default_rng(int(typical * 10)), 2500, 200, 64

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    base = np.sqrt(typical) * unit(rng.standard_normal(dim)) + np.sqrt(1 - typical) * unit(rng.standard_normal((n, dim)))
    base = unit(base)
    side = unit(rng.standard_normal((twins, dim)))
    side = unit(side - (side * base[:twins]).sum(axis=1, keepdims=True) * base[:twins])
    near = 0.9802 * base[:twins] + np.sqrt(1 - 0.9802**2) * side
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(np.concatenate([base, near]))]
    got = embedding_dedup.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4))
    found = got.filter((F.col("vec_id") >= n) & (F.col("component_id") == F.col("vec_id") - n)).count()
    assert found >= 0.95 * twins, found


@pytest.mark.parametrize(
    "rows, text",
    [
        ("<tr><td colspan=2>wide<td>b<tr><td>1<td>2<td>3", "wide  b\n1  2  3"),
        ("<tr><td rowspan=2>tall<td>b<tr><td>c<tr><td>x<td>y", "tall  b\n      c\nx     y"),
        ("<tr><th colspan=2>a long heading<th>z<tr><td>1<td>2<td>3", "a long heading  z\n1  2            3"),
        ("<tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e", "a  b\n   c\nd  e"),
        ("<tr><td>\u65e5\u672c<td>b<tr><td>abcd<td>c", "\u65e5\u672c  b\nabcd  c"),
        ("<tr><td rowspan=3>a<td>b<tr><td><tr><td>c", "a  b\n   c"),
    ],
)
def test_cells_over_several_columns_and_rows(rows, text):
    assert rendering.text_of(f"<table>{rows}</table>") == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div style='visibility:hidden'>a<b style='visibility: visible'>seen</b>c<hr></div>d", "seen\nd"),
        ("<style>.x{display:none} @media print{.y{display:none}}</style><p class='k x'>no<p class=y>yes", "yes"),
        ("<style>#z, .q{visibility:hidden} .q{color:red}</style><p id=z>no<p class=q>no <b style='visibility:visible'>in</b>", "in"),
        ("<style>.x{display:none}.x{display:block}.y{display:none}</style><p class=x>yes<p class=y style='display:block'>too", "yes\n\ntoo"),
        ("<style media=print>.x{display:none}</style><p class=x>yes", "yes"),
        ("<div style='backface-visibility:hidden'>shown</div><i style='fill-opacity:0'>too</i>", "shown\ntoo"),
        ("a<select><option>b<option>c</select>d<button>go</button>now<input type=submit value='Send &amp; go'>x", "a\nb\nc\nd go now Send & go x"),
        ("<select><optgroup label=G><option>b</optgroup></select>", "G\nb"),
    ],
)
def test_rules_of_visibility_and_controls(page, text):
    assert rendering.text_of(page) == text


def test_wide_and_tall_cells_cost_no_more_than_the_page():
    tall = "".join(f"<td rowspan={i % 7 + 2} colspan=999>" for i in range(5_000)) + "<tr><td>b" * 10_000
    wide = "<td>" + ("<td>" + "y" * 60) * 1_000 + "<tr><td colspan=900>b<td>c" * 10_000
    for cells in (tall, wide):
        begun = time.time()
        out = rendering.text_of("<table><tr>" + cells)
        assert time.time() - begun < 10 and len(out) < 10 * len(cells)


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<p x='", "</b ", "<a \"'>", "<", "<!", "<a <b> "])
def test_rendering_takes_time_in_proportion(piece):
    page = "<p>before</p>" + piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    out = rendering.text_of(page)
    assert time.perf_counter() - began < 10 and out.startswith("before")


def test_tags_that_do_not_end():
    assert rendering.text_of("one <a href='x>two</a> three") == "one two three"
    assert rendering.text_of("a < b <i title='>'>c</i> <b") == "a < b c <b"
    assert rendering.text_of("x <b>y</b> <!-- never ends") == "x y"


# near-duplicates in large buckets of many classes


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(6)
    for _ in range(500):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 200, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.95], rng.integers(0, 200, int(rng.integers(0, 5))).astype(np.uint64)]))
        usual = np.unique(rng.integers(0, 200, int(rng.integers(0, 90))).astype(np.uint64))
        if len(y) and minhash.overlap(x, y) >= minhash.SIMILARITY:
            assert set(minhash.prefix(x, usual)) & set(minhash.prefix(y, usual))
    all_share = np.arange(300, dtype=np.uint64)
    assert not set(minhash.prefix(np.concatenate([all_share, np.arange(1000, 1085, dtype=np.uint64)]), all_share)) & set(all_share)


def test_large_bucket_of_many_classes(spark, monkeypatch):
    """Documents that share most of their text, pairs of which are near copies: classes equal brute force where every bucket is split."""
    monkeypatch.setattr(minhash, "LANE_BYTES", 3_000)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(4000)]
    shared = [rng.choice(words) for _ in range(75)]
    texts = []
    for _ in range(60):
        own = [rng.choice(words) for _ in range(22)]
        texts.append(shared + own)
        if len(texts) % 3 == 0:  # a near copy, one word of it changed
            copy = shared + own
            copy[rng.randrange(len(copy))] = "other"
            texts.append(copy)
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], DOC)
    units = [minhash.units(minhash.shingles(" ".join(t))) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if minhash.overlap(units[i], units[j]) >= minhash.SIMILARITY:
                    least[i] = least[j] = min(least[i], least[j])
    calls = []
    large = minhash._large
    monkeypatch.setattr(minhash, "_large", lambda *a: calls.append(1) or large(*a))
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    assert calls and got == dict(enumerate(least)) and len(set(least)) < len(texts)


# rows of any kind


def test_toxicity_of_odd_rows(spark):
    """Empty tables, null and repeated ids, clashing names and very long texts all get their score."""
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, "vile insult " * 3 if i % 2 else "kind words today", "en", "s", 0) for i in range(40)] + [(None, "vile insult", "en", "s", 0), (None, None, "en", "s", 0), (7, "kind words", "en", "s", 0), (50, "kind words " * 100_000, "en", "s", 0)]
    clash = spark.createDataFrame(rows, DOC).withColumn("score", F.lit("x")).withColumn("toxic", F.lit(1)).withColumn("held_out", F.lit(2)).withColumn("x", F.lit(3))
    never = F.lit(False)
    got = toxicity.score(clash, labels, never, ~never).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] not in (None, 7)}
    assert by[1] == 1 and by[2] == 0
    assert toxicity.score(clash.filter("false"), labels, never, ~never).collect() == []
    assert {r["score"] for r in toxicity.score(clash, labels.filter("false"), never, ~never).collect()} == {0.0}


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(2)
    long = [f"w{rng.randrange(5000)}" for _ in range(120_000)]
    other = [f"v{rng.randrange(5000)}" for _ in range(120_000)]
    near = [w if i % 500 else "changed" for i, w in enumerate(long)]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(other)), (4, None), (5, "short text")]
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in minhash.classes(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True), 5: (5, True)}


def test_quality_of_very_long_texts(spark):
    docs = spark.createDataFrame([(i, f"the river runs by the old mill {i % 7} today", "en", "s", 0) for i in range(200)] + [(900, "the river runs by the old mill 3 today " * 30_000, "en", "s", 0)], DOC)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in kneser_ney.judged(docs, labels).collect()}
    assert len(got) == 201 and np.isfinite(got[900]["perplexity"])
