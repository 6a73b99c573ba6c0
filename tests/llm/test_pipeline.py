"""Every stage of the corpus pipeline on rows with nulls, repeats, long texts and extra columns, and on none."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

WORDS = "the and of harbour lantern river stone copper window garden silver morning letter bridge winter signal".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels and a benchmark beside the documents that each test makes."""
    d = "file://" + str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, prose(900, 20)), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def documents(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("rid", "_clean", "words", "part", "item"):
        df = df.withColumn(c, F.lit(c))
    return df.repartition(3)


def texts(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in df.collect())


def test_toxicity_goes(spark, folder):
    rows = [(i, prose(i, 40) + (" you utter scoundrel" if i % 4 == 0 else "")) for i in range(160)] + [(200, None), (201, ""), (None, prose(201, 40)), (7, prose(202, 40_000))]
    docs = documents(spark, rows)
    left = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert left.columns == docs.columns
    kept = {i for i, _ in texts(left)}
    assert not kept & {i for i in range(120, 160) if i % 4 == 0} and {i for i in range(160) if i % 4} <= kept and -1 in kept
    assert corpus_pipeline.drop_toxic(spark, docs.filter("false"), folder).count() == 0


def test_one_of_near_copies_stays(spark, folder):
    base = prose(1, 200)
    near = base.replace(base.split()[100], "changed", 1)
    rows = [(3, base), (2, near), (5, base), (5, base), (None, base), (6, None), (6, None), (7, ""), (8, prose(2, 100))]
    docs = documents(spark, rows)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert left.columns == docs.columns
    assert texts(left) == sorted([(2, near), (6, ""), (6, ""), (7, ""), (8, prose(2, 100))])
    assert corpus_pipeline.drop_near_duplicates(spark, docs.filter("false"), folder).count() == 0


def test_benchmark_passages_go(spark, folder):
    item = prose(900, 20)
    rows = [(1, prose(3, 10) + " " + item), (None, item.upper()), (2, prose(4, 50)), (2, item.replace("river", "rivr", 1)), (4, None), (5, ""), (6, prose(5, 30_000))]
    docs = documents(spark, rows)
    left = corpus_pipeline.drop_benchmark_passages(spark, docs, folder)
    assert left.columns == docs.columns and [i for i, _ in texts(left)] == [2, 4, 5, 6]


def test_personal_data_is_redacted_and_packed(spark, folder):
    rows = [(1, "mail a@b.co, 1.2.3.4"), (None, "a@b.co"), (2, None), (3, ""), (4, prose(6, 30_000)), (1, "mail a@b.co, 1.2.3.4")]
    docs = documents(spark, rows)
    left = corpus_pipeline.redact_personal_data(spark, docs, folder)
    assert left.columns == docs.columns
    assert texts(left) == sorted([(1, "mail [EMAIL], [IP]")] * 2 + [(-1, "[EMAIL]"), (2, ""), (3, ""), (4, prose(6, 30_000))])
    packed = corpus_pipeline.pack_sequences(spark, left, folder)
    assert packed.filter("start = 0").count() == len(rows) and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert corpus_pipeline.pack_sequences(spark, docs.filter("false"), folder).count() == 0


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "benchmark_decontamination", "personal_data", "packing"]


def test_run_over_whole_tables(spark, tmp_path):
    """What should go is gone, what should stay is packed whole, without gaps; none of empty tables."""
    base = f"file://{tmp_path}"
    item = prose(900, 20)
    rows = [(i, prose(i, 40) + (" you utter scoundrel" if i % 4 == 0 else "")) for i in range(160)]
    rows += [(300, prose(301, 60)), (301, prose(301, 60)), (302, prose(301, 60) + " more"), (303, prose(5, 30) + " " + item + " " + prose(6, 30)), (304, None), (305, "write to ann@example.org now"), (None, prose(400, 40))]
    documents(spark, rows).write.parquet(f"{base}/full/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/full/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/full/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{base}/full").toPandas()
    want = {i for i in range(160) if i % 4} | {300, 304, 305, None}
    assert {None if i != i else int(i) for i in got["doc_id"]} == want
    whole = got.groupby(["doc_id", "doc_tokens"], dropna=False)["length"].sum().reset_index()
    assert (whole["length"] == whole["doc_tokens"]).all() and len(whole) == len(want)
    assert got.groupby("sequence_id")["length"].sum().sort_index().iloc[:-1].eq(2048).all()
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{base}/full/{t}.parquet").limit(0).write.parquet(f"{base}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{base}/none").collect() == []
