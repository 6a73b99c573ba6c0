"""Registered queries over streams with state and over committed generations, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import promotion, runtime, temporal
from ..storage.store import Store
from ..streaming import hits, progress
from ..tables import load, shared_folder
from . import projection as g
from .catalogue import _LIVE, AFTER, BEFORE, query

BATCHES = 3
_PUBLISHED = f""", s AS (SELECT id, kind, value FROM versions WHERE {_LIVE.format(t=AFTER)}),
c AS (SELECT id, kind, value FROM versions WHERE {_LIVE.format(t=BEFORE)}),
j AS (SELECT coalesce(c.id, s.id) AS id, c.id IS NOT NULL AS old, s.id IS NOT NULL AS new, c.kind = s.kind AND c.value = s.value AS same FROM c FULL JOIN s ON c.id = s.id)"""


def _published(spark: SparkSession, d: str) -> Store:
    """A store with two generations: the graph of one time, then that of another published over it."""
    v = g.versions(spark, d).withColumn("payload", F.to_json(F.struct("kind", "value"))).withColumn("certainty", F.lit("asserted")).withColumn("owners", F.array(F.lit("events")))
    store, base = promotion.facts(spark, shared_folder(spark, "facts"), 16), None
    for run, at in (("before", BEFORE), ("after", AFTER)):
        stage = temporal.as_of(v, F.expr(at)).select("id", "payload", "certainty", "owners")
        when = datetime.datetime.fromisoformat(at.split("'")[1])
        base = promotion.publish(store, base or store.generation(), stage, ["events"], when, run)
    return store


@query(f"""{_PUBLISHED}
SELECT id, {BEFORE} AS valid_from, CASE WHEN new AND same THEN NULL ELSE {AFTER} END AS valid_to FROM j WHERE old
UNION ALL SELECT id, {AFTER}, NULL FROM j WHERE new AND NOT (old AND same)""")
def published_generation(spark, d):
    store = _published(spark, d)
    return store.read(store.generation()).select("id", "valid_from", "valid_to")


@query(f"SELECT id, kind, value FROM versions WHERE {_LIVE.format(t=BEFORE)}")
def pinned_generation(spark, d):
    """A reader pinned to the first generation, after the second has been committed."""
    store = _published(spark, d)
    payload = F.from_json("payload", "kind string, value double")
    return store.read(store.generation(1)).select("id", payload["kind"].alias("kind"), payload["value"].alias("value"))


@query(f"""{_PUBLISHED}
SELECT action, count(*) AS n FROM (SELECT CASE WHEN NOT old THEN 'insert' WHEN NOT new THEN 'close' WHEN same THEN 'unchanged' ELSE 'replace' END AS action FROM j) GROUP BY 1""")
def generation_receipt(spark, d):
    """The counts of the second publication, as its manifest has them."""
    counts = _published(spark, d).generation().info["counts"]
    return spark.createDataFrame([(k, n) for k, n in counts.items() if n], "action string, n long")


def _in_batches(spark: SparkSession, rows: list[DataFrame], name: str, start) -> None:
    """Adds the rows to a folder, one table after the other, and lets the stream over it run after each: every table is a batch of its own.

    start: called with the stream and a checkpoint, it runs what is there and stops; so all runs but the first are restarts.
    """
    folder, checkpoint = shared_folder(spark, name), shared_folder(spark, f"{name}-state")
    for batch in rows:
        batch.write.mode("append").parquet(folder)
        start(spark.readStream.schema(batch.schema).parquet(folder), checkpoint)


def _batch_number():
    return F.col("event_id") % BATCHES


@query("SELECT 'user:' || user_id AS source_id, 'events' AS target_id, 'CALLS' AS kind, count(*) AS hit_count, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM events GROUP BY user_id", graph=False)
def streamed_hits(spark, d):
    """Cumulative counts of every user's event types, in two batches, the second of which repeats all; hits of users add up once."""
    seen = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    e = load(spark, d, "events").withColumn("seen_count", seen.cast("long"))
    a = e.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("source_id"), F.lit("events").alias("target_id"), F.lit("CALLS").alias("kind"), F.col("event_type").alias("observation_id"),
        "seen_count", F.col("ts").alias("first_seen_at"), F.col("ts").alias("last_seen_at"), _batch_number().alias("b"),
    )
    last = F.col("b") == BATCHES - 1
    batches = [a.filter(~last).drop("b"), a.filter(last).unionAll(a).drop("b")]
    store = Store(spark, shared_folder(spark, "hits"), hits.TOTALS, "edge", 16)
    _in_batches(spark, batches, "arrivals", lambda s, c: hits.run(hits.deltas(s), hits.Totals(store), c))
    return store.read(store.generation()).drop("edge")


@query(f"SELECT 'user:' || user_id AS service, event_type AS operation, 'CALLS' AS kind, count(DISTINCT event_id % {BATCHES}) AS seen_count FROM events GROUP BY 1, 2", graph=False)
def streamed_triples(spark, d):
    """In how many batches each triple occurs; the state's last word on each."""
    e = load(spark, d, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("service"), F.col("event_type").alias("operation"), F.lit("CALLS").alias("kind"), _batch_number().alias("b"))
    out = shared_folder(spark, "triples")

    def start(stream, checkpoint):
        hits.run(hits.counted(stream), lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), checkpoint)

    _in_batches(spark, [e.filter(F.col("b") == b).drop("b") for b in range(BATCHES)], "spans", start)
    keys = ["service", "operation", "kind"]
    return spark.read.parquet(out).groupBy(*keys).agg(F.max("seen_count").alias("seen_count"))


_OBSERVED = f""", e AS (SELECT *, event_id % {BATCHES} AS b, user_id || '/' || event_type AS observation_id, NOT starts_with(event_type, 'c') AS known FROM events)"""


def _reconciled(spark: SparkSession, d: str) -> Store:
    """Cumulative observations of paths in batches, against the edges of some of the paths."""
    e = load(spark, d, "events").withColumn("b", _batch_number()).withColumn("observation_id", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    path = F.concat(F.lit("/"), F.col("event_type"), F.lit("/"))
    edges = e.filter(~F.col("event_type").startswith("c")).select(
        F.concat(F.lit("svc:"), (F.col("user_id") % 5).cast("string")).alias("source_id"), F.concat(F.lit("contract:http:GET:"), path, F.lit("{id}")).alias("target_id"), F.lit("CALLS").alias("kind")
    )
    grouped = lambda b: e.filter(F.col("b") <= b).groupBy(
        "observation_id", F.lit("CALLS").alias("kind"), F.concat(path, F.col("user_id").cast("string")).alias("operation")
    ).agg(F.count("*").alias("seen_count"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"))
    store = Store(spark, shared_folder(spark, "cursors"), hits.CURSORS, "cursor", 16)
    sink = hits.Reconciliation(store, runtime.match_index(edges.distinct()))
    _in_batches(spark, [grouped(b) for b in range(BATCHES)], "observations", lambda s, c: hits.run(s, sink, c, "append"))
    return store


@query(f"""{_OBSERVED} SELECT CAST(r.b AS BIGINT) AS batch, count(DISTINCT observation_id) FILTER (known) AS matched, count(DISTINCT observation_id) FILTER (NOT known) AS unmatched,
count(*) FILTER (known AND e.b = r.b) AS new_hits FROM e JOIN range({BATCHES}) AS r(b) ON e.b <= r.b GROUP BY 1""")
def reconciled_batches(spark, d):
    store = _reconciled(spark, d)
    infos = [store.generation(n).info for n in range(1, store.generation().number + 1)]  # one a batch
    return spark.createDataFrame([(i["batch"], i["matched"], i["unmatched"], i["new_hits"]) for i in infos], "batch long, matched long, unmatched long, new_hits long")


@query(f"""{_OBSERVED}, f AS (SELECT event_type, min('svc:' || user_id % 5) AS source_id FROM e WHERE known GROUP BY 1)
SELECT f.source_id, 'contract:http:GET:/' || event_type || '/{{id}}' AS target_id, 'CALLS' AS kind, count(*) AS hit_count, min(ts) AS first_seen_at, max(ts) AS last_seen_at
FROM e JOIN f USING (event_type) GROUP BY 1, 2""")
def reconciled_overlay(spark, d):
    store = _reconciled(spark, d)
    return hits.overlay(store.read(store.generation()))


@query(f"SELECT event_id % {BATCHES} AS batch, count(*) AS rows_in, count(*) FILTER (value > 50) AS large, count(*) AS written FROM events GROUP BY 1", graph=False)
def stream_progress(spark, d):
    """What the listener notes of each batch, beside the rows that the batch has written."""
    e = load(spark, d, "events").select("event_id", "value", _batch_number().alias("b"))
    out, notes = shared_folder(spark, "progress-rows"), shared_folder(spark, "progress")
    listener = progress.Progress(spark, notes, out.rsplit("/", 1)[1])

    def start(stream, checkpoint):
        seen = progress.observed(stream, "rows", large=F.count_if(F.col("value") > 50))
        q = seen.writeStream.queryName(listener.query).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(f"{out}")
        q.awaitTermination()
        progress.settled(spark)

    spark.streams.addListener(listener)
    try:
        _in_batches(spark, [e.filter(F.col("b") == b).drop("b") for b in range(BATCHES)], "progress-in", start)
    finally:
        spark.streams.removeListener(listener)
    written = spark.read.parquet(out).groupBy(_batch_number().alias("batch")).agg(F.count("*").alias("written"))
    return progress.rows(spark, notes).select("batch", "rows_in", F.col("metrics")["rows.large"].alias("large")).join(written, "batch")
