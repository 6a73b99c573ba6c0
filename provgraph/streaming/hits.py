"""Runtime evidence as streams with keyed state, and their sinks that take every batch in once.

* `deltas`: cumulative counts of observations arrive again and again, repeated and out of order. The state holds, per (edge, observation),
  what has been counted, so only what exceeds it is new. Rows of a partition are combined before they are dealt by key, so a key
  that arrives often costs one row a partition.
* `counted`: how many batches a (service, operation, kind) has occurred in.
* `Totals`, `Reconciliation`: foreachBatch sinks over a `Store`. The generation that a batch makes carries the batch's number, so
  a batch that is handed in again (a restart after the commit) is refused.

State lives in the state store of the query's checkpoint and goes on after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import runtime
from ..storage.store import Generation, Store
from ..tables import cut

EDGE = ["source_id", "target_id", "kind"]
ARRIVALS = "source_id string, target_id string, kind string, observation_id string, seen_count long, first_seen_at timestamp, last_seen_at timestamp"
TOTALS = "edge string, source_id string, target_id string, kind string, hit_count long, first_seen_at timestamp, last_seen_at timestamp"
CURSORS = "cursor string, source_id string, target_id string, kind string, observation_id string, applied long, first_seen_at timestamp, last_seen_at timestamp"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """State of keys lives in RocksDB, which spills to disk and is copied to the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # a batch stores what it has changed


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = [*EDGE, "observation_id"]
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by(keys).aggregate([("seen", "max"), ("first", "min"), ("last", "max")])
        yield from t.select([*keys, "seen_max", "first_min", "last_max"]).rename_columns([*keys, "seen", "first", "last"]).combine_chunks().to_batches()


class Cursor(StatefulProcessor):
    """State of an (edge, observation): the count that has been applied, and the first and last time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "applied long, first long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.seen.get()
        applied, first, last = old if old is not None else (0, None, None)
        now = applied
        for pdf in rows:
            now = max(now, int(pdf["seen"].max()))
            first = min(x for x in (first, int(pdf["first"].min())) if x is not None)
            last = max(x for x in (last, int(pdf["last"].max())) if x is not None)
        if old is None or tuple(old) != (now, first, last):
            self.seen.update((now, first, last))
            names = [*EDGE, "observation_id", "delta", "first", "last"]
            yield pd.DataFrame([(*key, now - applied, first, last)], columns=names)

    def close(self) -> None:
        pass


def deltas(arrivals: DataFrame) -> DataFrame:
    """arrivals: ARRIVALS, streamed. What is new per (edge, observation) and batch: its columns, delta, first_seen_at, last_seen_at (of all so far)."""
    use_keyed_state(arrivals.sparkSession)
    keys = [*EDGE, "observation_id"]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    a = arrivals.select(*keys, F.greatest(F.lit(0), "seen_count").alias("seen"), F.least(micros("first_seen_at"), micros("last_seen_at")).alias("first"), micros("last_seen_at").alias("last"))
    a = a.mapInArrow(_combine, a.schema)
    kind = ", ".join(f"{k} string" for k in keys) + ", delta long, first long, last long"
    d = a.groupBy(*keys).transformWithStateInPandas(Cursor(), kind, "Update", "None")
    return d.select(*keys, "delta", F.timestamp_micros("first").alias("first_seen_at"), F.timestamp_micros("last").alias("last_seen_at"))


class BatchCounter(StatefulProcessor):
    """State of a key: in how many batches it has occurred, and when first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "batches long, first long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = max(int(pdf["now"].max()) for pdf in rows)
        batches, first = self.count.get() or (0, now)
        self.count.update((batches + 1, first))
        yield pd.DataFrame([(*key, batches + 1, first, now)], columns=["service", "operation", "kind", "seen_count", "first", "last"])

    def close(self) -> None:
        pass


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([]).combine_chunks().to_batches()  # now is the same in all rows of a batch


def counted(spans: DataFrame) -> DataFrame:
    """spans: service, operation, kind, streamed. Counts of batches, not of spans: seen_count, first_seen_at, last_seen_at."""
    use_keyed_state(spans.sparkSession)
    s = spans.select("service", "operation", "kind", F.unix_millis(F.current_timestamp()).alias("now")).filter("service <> '' AND operation <> ''")
    s = s.mapInArrow(_once, s.schema)
    kind = "service string, operation string, kind string, seen_count long, first long, last long"
    c = s.groupBy("service", "operation", "kind").transformWithStateInPandas(BatchCounter(), kind, "Update", "None")
    return c.select("service", "operation", "kind", "seen_count", F.timestamp_millis("first").alias("first_seen_at"), F.timestamp_millis("last").alias("last_seen_at"))


def _due(store: Store, number: int) -> Generation | None:
    """The generation to build on, or None if this batch has been taken in."""
    base = store.generation()
    return None if base.info.get("batch", -1) >= number else base


def _touched(store: Store, keys: DataFrame) -> list[int]:
    return sorted(r["b"] for r in keys.select(store.bucket().alias("b")).distinct().collect())  # at most as many as buckets


class Totals:
    """Sink of `deltas`: hits, first and last time of each edge, in a store of TOTALS keyed by edge."""

    def __init__(self, store: Store):
        self.store = store

    def __call__(self, batch: DataFrame, number: int) -> None:
        base = _due(self.store, number)
        if base is None:
            return
        edge = F.concat_ws("\x1f", *EDGE).alias("edge")
        sums = batch.groupBy(edge, *EDGE).agg(F.sum("delta").alias("n"), F.min("first_seen_at").alias("f"), F.max("last_seen_at").alias("l"))
        sums = cut(sums)  # the state has moved on; a second reading must not ask it again
        old = self.store.read(base)
        j = old.join(sums.withColumnsRenamed({c: f"_{c}" for c in EDGE}), "edge", "full")
        rows = j.select(
            "edge", *[F.coalesce(c, f"_{c}").alias(c) for c in EDGE], (F.coalesce("hit_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("hit_count"),
            F.least("first_seen_at", "f").alias("first_seen_at"), F.greatest("last_seen_at", "l").alias("last_seen_at"),
        )
        self.store.commit(base, rows, None, _touched(self.store, sums), {"batch": number})


class Reconciliation:
    """Sink of observations (observation_id, kind, operation, seen_count, first_seen_at, last_seen_at): matched to edges, cursors advanced.

    Every batch makes one generation of a store of CURSORS, whose info says batch, matched, unmatched, new_hits. index: `runtime.match_index`.
    Of an observation that a batch has several times, the greatest count holds.
    """

    def __init__(self, store: Store, index: DataFrame):
        self.store, self.index = store, index

    def __call__(self, batch: DataFrame, number: int) -> None:
        base = _due(self.store, number)
        if base is None:
            return
        first = F.least("first_seen_at", "last_seen_at")
        one = batch.groupBy("observation_id", "kind", "operation").agg(
            F.greatest(F.lit(0), F.max("seen_count")).alias("seen"), F.min(first).alias("f"), F.max("last_seen_at").alias("l"),
        )
        found = cut(runtime.match(one, self.index).withColumn("cursor", F.when(F.col("source_id").isNotNull(), F.concat_ws("\x1f", *EDGE, "observation_id"))))
        matched = found.filter("cursor IS NOT NULL").drop("operation").withColumnsRenamed({c: f"_{c}" for c in (*EDGE, "observation_id")})
        j = self.store.read(base).join(matched, "cursor", "full")
        new = F.greatest(F.lit(0), F.coalesce("seen", F.lit(0)) - F.coalesce("applied", F.lit(0)))
        sums = j.agg(F.sum(new).alias("new_hits")).first()
        n = found.agg(F.count("cursor").alias("matched"), F.count("*").alias("n")).first()
        rows = j.select(
            "cursor", *[F.coalesce(c, f"_{c}").alias(c) for c in (*EDGE, "observation_id")], F.greatest("applied", "seen").alias("applied"),
            F.least("first_seen_at", "f").alias("first_seen_at"), F.greatest("last_seen_at", "l").alias("last_seen_at"),
        )
        info = {"batch": number, "matched": n["matched"], "unmatched": n["n"] - n["matched"], "new_hits": sums["new_hits"] or 0}
        self.store.commit(base, rows, None, _touched(self.store, matched), info)


def overlay(cursors: DataFrame) -> DataFrame:
    """Hits, first and last time of each edge, from its cursors."""
    return cursors.groupBy(*EDGE).agg(F.sum("applied").alias("hit_count"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


def run(df: DataFrame, sink, checkpoint: str, mode: str = "update") -> None:
    """Streams what is there into a foreachBatch sink and stops; the next run goes on behind it."""
    q = df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
