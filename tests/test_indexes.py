import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from provgraph.operators import cells, trigrams

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abAB éİK.1") for _ in range(rng.randrange(60)))) for i in range(400)] + [(400, None), (401, ""), (402, "ab"), (403, "needle " * 5000 + "Haystack")]
    df = spark.createDataFrame(rows, "id long, text string")
    return df, trigrams.write(df, "id", "text", folder=f"file://{tmp_path_factory.mktemp('grams')}/p")


@pytest.mark.parametrize("terms", [["aba"], ["ABA", "b.a"], ["é b"], ["kab"], ["ab"], ["haystack", "zzz"], []])
def test_terms_find_what_a_scan_finds(texts, terms):
    df, index = texts
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.lower("text").contains(t.lower())
    plan = trigrams.any_term(df, index, "id", ["text"], terms)
    assert {r["id"] for r in plan.rows.collect()} == {r["id"] for r in df.filter(hit).collect()}
    assert plan.scanned == any(len(t) < 3 for t in terms)


@pytest.mark.parametrize(
    "text, literal",
    [("aba", ["aba"]), ("ab[aA]b", []), ("(aba)+1?b", ["aba"]), ("aba|bab", []), ("a{3}", ["aaa"]), ("^abA?b1*a", []), ("x*(needle ){2}", ["needle needle "]), ("Hay(stack)$", ["haystack"]), (".", []), ("a(?=ba)", []), ("éaba", ["aba"]), ("(?i)ABA", ["aba"]), ("a{2,5}ba", [])],
)
def test_patterns_find_what_a_scan_finds(texts, text, literal):
    df, index = texts
    assert trigrams.literals(text) == literal
    plan = trigrams.pattern(df, index, "id", "text", text)
    assert {r["id"] for r in plan.rows.collect()} == {r["id"] for r in df.filter(F.col("text").rlike(text)).collect()}
    assert plan.scanned == (not literal)


def test_a_search_reads_only_its_trigrams(texts):
    df, index = texts
    plan = trigrams.any_term(df, index, "id", ["text"], ["aba"]).rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan or "EqualTo(gram" in plan


def exact(v, ids, k=10):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    at = np.flatnonzero(ids % 20 == 0)
    s = v[at] @ v.T
    s[np.arange(len(at)), at] = -2
    return {int(ids[a]): set(ids[np.argsort(-row, kind="stable")[:k]].tolist()) for a, row in zip(at, s)}


def recall(spark, df, v, ids, **kw):
    index = cells.build(df, "vec_id", "embedding", **kw)
    got = {}
    for r in cells.neighbours(index, df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("id"))).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    want = exact(v, ids)
    return sum(len(got.get(i, set()) & w) for i, w in want.items()) / sum(len(w) for w in want.values()), index


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = df.toPandas()
    found, index = recall(spark, df, np.array(pdf["embedding"].tolist(), dtype=float), pdf["vec_id"].to_numpy())
    print("recall", found, "probes", index.probes, "of", len(index.centres))
    assert found >= 0.9


def test_recall_where_vectors_cluster(spark, monkeypatch):
    """Few cells are read, a cell with a third of all vectors is dealt to several tasks, and odd vectors are in no cell."""
    monkeypatch.setattr(cells, "ROWS", 300)
    rng = np.random.default_rng(3)
    centres = 3 * rng.standard_normal((40, 16))
    v = centres[np.where(rng.random(4000) < 0.33, 0, rng.integers(0, 40, 4000))] + rng.standard_normal((4000, 16))
    odd = [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] * 16), (5080, [1.0] * 3)]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + odd, "vec_id long, embedding array<double>")
    found, index = recall(spark, df, v, np.arange(4000))
    assert found >= 0.9 and index.probes <= len(index.centres) / 3
    empty = cells.build(df.filter("false"), "vec_id", "embedding")
    assert cells.neighbours(empty, df.select(F.col("vec_id").alias("id"))).collect() == []
