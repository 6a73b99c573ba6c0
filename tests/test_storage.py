import datetime
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from provgraph.operators import promotion, temporal
from provgraph.storage import files
from provgraph.storage.store import StaleGeneration, Store

T0 = datetime.datetime(2024, 1, 1)
STAGE = "id string, payload string, certainty string, owners array<string>"


@pytest.fixture
def folder(spark, tmp_path):
    return f"file://{tmp_path}/store"


def rows_of(df):
    return sorted((r["id"], r["payload"], r["certainty"], tuple(r["owners"]), r["valid_from"], r["valid_to"]) for r in df.collect())


def stage_of(spark, items):
    return spark.createDataFrame([(i, p, c, list(o)) for i, p, c, o in items], STAGE)


def files_of(store, generation):
    """(bucket, file) of every file that a generation reads."""
    out = set()
    for b, part in enumerate(generation.parts):
        for n in files.names(store.spark, f"{store.root}/rows/part={part}") if part else []:
            if (m := re.search(r"_(\d+)\.c\d+", n)) and int(m[1]) == b:
                out.add((b, part, n))
    return out


def test_a_file_is_created_once(spark, folder):
    files.create_json(spark, f"{folder}/x.json", {"a": 1})
    with pytest.raises(files.Exists):
        files.create_json(spark, f"{folder}/x.json", {"a": 2})
    assert files.read_json(spark, f"{folder}/x.json") == {"a": 1} and files.names(spark, folder) == ["x.json"]


def test_publication_equals_the_snapshot_over_rounds(spark, folder):
    """Every generation holds what promoting over plain rows gives, through inserts, replacements, closures and owners that unite."""
    rng = random.Random(5)
    store = promotion.facts(spark, folder, 8)
    base, plain = store.generation(), spark.createDataFrame([], promotion.FACTS)
    pinned = []
    for turn in range(3):
        items = [(f"n{i}", f"p{rng.randrange(3)}", rng.choice(["inferred", "asserted"]), rng.choice(["a", "b", "ab"])) for i in rng.sample(range(60), 40)]
        stage, at = stage_of(spark, items), T0 + datetime.timedelta(days=turn)
        open_rows = temporal.current(plain).select("id", "payload", "certainty", "owners", "valid_from")
        want = temporal.promote(open_rows, stage, ["a"], F.lit(str(at)).cast("timestamp"))
        receipt = {r["action"]: r["n"] for r in temporal.receipt(want).collect()}
        after = rows_of(temporal.snapshot(want).unionByName(plain.filter("valid_to IS NOT NULL")))
        base = promotion.publish(store, base, stage, ["a"], at, f"run{turn}", strict=False)
        assert rows_of(store.read(base)) == after
        assert {k: v for k, v in base.info["counts"].items() if v} == receipt
        plain = spark.createDataFrame(after, promotion.FACTS)
        pinned.append((base, after))
    for generation, after in pinned:  # readers of older generations see their rows still
        assert rows_of(store.read(store.generation(generation.number))) == after
    store.vacuum(keep=3)
    assert rows_of(store.read(store.generation())) == pinned[-1][1]
    with pytest.raises(Exception):
        store.generation(1)


def test_only_touched_buckets_are_rewritten(spark, folder):
    store = promotion.facts(spark, folder, 16)
    first = promotion.publish(store, store.generation(), stage_of(spark, [(f"n{i}", "p", "asserted", "a") for i in range(200)]), [], T0, "r1")
    second = promotion.publish(store, first, stage_of(spark, [("n7", "q", "asserted", "a")]), [], T0, "r2")
    moved = [b for b in range(16) if first.parts[b] != second.parts[b]]
    assert moved == [r[0] for r in spark.createDataFrame([("n7",)], "id string").select(store.bucket()).collect()]
    assert {x for x in files_of(store, first) if x[0] not in moved} == {x for x in files_of(store, second) if x[0] not in moved}
    third = promotion.publish(store, second, stage_of(spark, [(f"n{i}", "q" if i == 7 else "p", "asserted", "a") for i in range(200)]), ["a"], T0, "r3")
    assert third.parts == second.parts and third.info["counts"]["unchanged"] == 200  # nothing changed, nothing written
    assert third.info["published_at"] == "2024-01-01T00:00:00.000002"


def test_stored_side_is_not_exchanged(spark, folder):
    """The join of stored facts with a stage exchanges the stage alone."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = promotion.facts(spark, folder, 4)
        base = promotion.publish(store, store.generation(), stage_of(spark, [(f"n{i}", "p", "asserted", "a") for i in range(50)]), [], T0, "r1")
        df = promotion.decided(store, base, stage_of(spark, [("n1", "q", "asserted", "a")]), ["a"], F.lit(str(T0)).cast("timestamp"))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SelectedBucketsCount: 4 out of 4" in plan or "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 1
    under = plan[plan.index("Exchange hashpartitioning"):]
    assert "FileScan" not in under or plan.index("FileScan") < plan.index("Exchange hashpartitioning")


def test_of_two_writers_one_wins(spark, folder):
    store = promotion.facts(spark, folder, 4)
    base = promotion.publish(store, store.generation(), stage_of(spark, [("n", "p", "asserted", "a")]), [], T0, "r0")
    before = rows_of(store.read(base))
    won, lost = [], []

    def write(name):
        try:
            won.append((name, promotion.publish(store, base, stage_of(spark, [("n", name, "asserted", "a")]), [], T0, name)))
        except StaleGeneration:
            lost.append(name)

    both = [threading.Thread(target=write, args=(n,)) for n in ("x", "y")]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert len(won) == len(lost) == 1
    assert {r[1] for r in rows_of(temporal.current(store.read(store.generation())))} == {won[0][0]}
    assert rows_of(store.read(base)) == before  # pinned before
    named = {f"part={p}" for g in (base, store.generation()) for p in g.parts if p}
    assert named == set(files.names(spark, f"{folder}/rows"))  # the loser left nothing


def test_conflict_publishes_nothing(spark, folder):
    store = promotion.facts(spark, folder, 4)
    base = promotion.publish(store, store.generation(), stage_of(spark, [("n", "p", "asserted", "a")]), [], T0, "r0")
    with pytest.raises(promotion.Conflict):
        promotion.publish(store, base, stage_of(spark, [("n", "q", "asserted", "b")]), [], T0, "r1")
    assert store.generation() == base


def test_empty_store_and_stage(spark, folder):
    store = Store(spark, folder, "id string, n long", "id", 4)
    assert store.read(store.generation()).collect() == []
    assert promotion.publish(promotion.facts(spark, folder + "2", 4), promotion.facts(spark, folder + "2", 4).generation(), stage_of(spark, []), [], T0, "r").number == 1


def test_release_deletes_what_queries_left(spark):
    from provgraph.tables import cut, release

    release(spark)
    t = cut(spark.range(5))
    folder = t.inputFiles()[0].rsplit("/", 1)[0]
    assert t.count() == 5 and files.names(spark, folder)
    assert release(spark) == 1 and files.names(spark, folder) == [] and release(spark) == 0
