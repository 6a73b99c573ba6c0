import datetime

import pytest
from pyspark.sql import functions as F

from provgraph.operators import overlay, runtime
from provgraph.storage.store import Store
from provgraph.streaming import hits, observations, progress

T = datetime.datetime(2024, 1, 1)


def at(n):
    return T + datetime.timedelta(hours=n)


def arrivals(spark, rows):
    return spark.createDataFrame([("a", "b", "CALLS", o, n, at(f), at(last)) for o, n, f, last in rows], hits.ARRIVALS)


def totals(store):
    return [(r["hit_count"], r["first_seen_at"], r["last_seen_at"]) for r in store.read(store.generation()).collect()]


@pytest.fixture
def base(tmp_path):
    return f"file://{tmp_path}"


def test_hits_over_batches_restarts_and_replays(spark, base):
    """Cumulative counts add up to the greatest of each observation, however they arrive; every run but the first is a restart."""
    store = Store(spark, f"{base}/totals", hits.TOTALS, "edge", 4)

    def feed(rows):
        arrivals(spark, rows).write.mode("append").parquet(f"{base}/in")
        hits.run(hits.deltas(spark.readStream.schema(hits.ARRIVALS).parquet(f"{base}/in")), hits.Totals(store), f"{base}/state")
        return totals(store)

    assert feed([("o", 3, 5, 6), ("o", 2, 4, 4), ("p", 1, 7, 7)]) == [(4, at(4), at(7))]
    assert feed([("o", 3, 5, 6), ("p", 1, 7, 7)]) == [(4, at(4), at(7))]  # replayed: nothing is new
    assert feed([("o", 5, 6, 9), ("p", -4, 8, 2)]) == [(6, at(2), at(9))]  # two more; a first time after the last gives way; a count below nought is none
    done = store.generation().number
    hits.run(hits.deltas(spark.readStream.schema(hits.ARRIVALS).parquet(f"{base}/in")), hits.Totals(store), f"{base}/state")
    assert store.generation().number == done  # nothing has come


def test_a_batch_is_taken_in_once(spark, base):
    store = Store(spark, f"{base}/totals", hits.TOTALS, "edge", 4)
    sink = hits.Totals(store)
    batch = arrivals(spark, [("o", 3, 1, 2)]).withColumnRenamed("seen_count", "delta")
    for number in (0, 0, 1, 0, 1):
        sink(batch, number)
    assert [r[0] for r in totals(store)] == [6] and store.generation().number == 2


EDGE = "source_id string, target_id string, kind string, operation string, path string"


def test_matching_takes_the_first_edge_of_any_key(spark):
    """By source and target, whether the raw or the normal form finds it; only paths have a normal form."""
    edges = spark.createDataFrame([
        ("b", "x", "CALLS", "/orders/42", None), ("a", "http.GET./orders/{id}", "CALLS", None, None), ("c", "contract:POST /pay", "CALLS", None, None), ("d", "contract:http:POST:/ship", "CALLS", None, None),
        ("e", "t", "CALLS", "select orders", None), ("f", "t", "CALLS", None, "/p"), ("g", "contract:GET", "CALLS", None, None), ("h", "http.GETorders", "CALLS", "", None), ("i", "t", "EXPOSES", "/orders/42", None),
    ], EDGE)
    ops = {1: "/orders/42", 2: "/orders/7/", 3: "/pay", 4: "/ship", 5: "select orders", 6: "SELECT ORDERS", 7: "/p?x=1", 8: "", 9: None, 10: "GET"}
    o = spark.createDataFrame([(i, "CALLS", op) for i, op in ops.items()], "observation_id int, kind string, operation string")
    got = {r["observation_id"]: r["source_id"] for r in runtime.match(o, runtime.match_index(edges)).collect()}
    assert got == {1: "a", 2: "a", 3: "c", 4: "d", 5: "e", 6: None, 7: "f", 8: None, 9: None, 10: None}


def test_reconciliation_refuses_a_repeated_batch(spark, base):
    index = runtime.match_index(spark.createDataFrame([("a", "http.GET./x", "CALLS", None, None)], EDGE))
    store = Store(spark, f"{base}/cursors", hits.CURSORS, "cursor", 4)
    sink = hits.Reconciliation(store, index)
    batch = lambda *rows: spark.createDataFrame([(o, "CALLS", op, n, at(1), at(2)) for o, op, n in rows], "observation_id string, kind string, operation string, seen_count long, first_seen_at timestamp, last_seen_at timestamp")
    first, second = batch(("1", "/x", 2), ("1", "/x", 4), ("2", "/nowhere", 9)), batch(("1", "/x", 5), ("3", "/x/", 1))
    for rows, number in ((first, 0), (first, 0), (second, 1), (first, 0), (second, 1)):
        sink(rows, number)
    infos = [store.generation(n).info for n in (1, 2)]
    assert store.generation().number == 2
    assert infos == [{"batch": 0, "matched": 1, "unmatched": 1, "new_hits": 4}, {"batch": 1, "matched": 2, "unmatched": 0, "new_hits": 2}]
    assert [(r["source_id"], r["hit_count"]) for r in hits.overlay(store.read(store.generation())).collect()] == [("a", 6)]


def test_progress_notes_each_batch_once(spark, base):
    name = "progress-test"
    listener = progress.Progress(spark, f"{base}/notes", name)
    spark.streams.addListener(listener)
    try:
        for n in (5, 7):
            spark.range(n).write.mode("append").parquet(f"{base}/in")
            s = progress.observed(spark.readStream.schema("id long").parquet(f"{base}/in"), "m", even=F.count_if(F.col("id") % 2 == 0))
            q = s.writeStream.queryName(name).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).format("parquet").start(f"{base}/out")
            q.awaitTermination()
            progress.settled(spark)
    finally:
        spark.streams.removeListener(listener)
    got = {r["batch"]: (r["rows_in"], r["metrics"]["m.even"]) for r in progress.rows(spark, f"{base}/notes").collect()}
    assert got == {0: (5, 3), 1: (7, 4)} and sum(n for n, _ in got.values()) == spark.read.parquet(f"{base}/out").count()


def test_bursts_coalesce_within_the_watermark(spark, base):
    """The first of repeated events counts, within a batch and across batches and a restart; windows close behind the watermark."""
    kept, windows = [], {}

    def feed(rows):
        spark.createDataFrame([(i, "push", at(h)) for i, h in rows], "event_id long, event_type string, ts timestamp").write.mode("append").parquet(f"{base}/in")
        s = spark.readStream.schema("event_id long, event_type string, ts timestamp").parquet(f"{base}/in")
        hits.run(observations.coalesced(s), lambda b, n: kept.extend(r["event_id"] for r in b.collect()), f"{base}/c", "append")
        hits.run(observations.windowed_counts(s), lambda b, n: windows.update({r["start"]: r["n"] for r in b.collect()}), f"{base}/w", "append")

    feed([(1, 0), (1, 0), (2, 0)])
    feed([(1, 0.1), (3, 5)])
    feed([(4, 9)])
    assert sorted(kept) == [1, 2, 3, 4]
    assert windows == {at(0): 4, at(5): 1}  # the last window is open still


def test_the_newest_confirmation_holds(spark):
    rows = spark.createDataFrame([("e", "confirm", at(1), "ann"), ("e", "dispute", at(3), "bob"), ("f", "confirm", at(2), "ann"), ("e", "confirm", at(3), "abe")], "edge string, action string, recorded_at timestamp, actor string")
    assert {r["edge"]: (r["action"], r["actor"]) for r in overlay.last_confirmation(rows, "edge").collect()} == {"e": ("dispute", "bob"), "f": ("confirm", "ann")}
