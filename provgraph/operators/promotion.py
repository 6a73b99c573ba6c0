"""Publication of staged facts into a store of bitemporal facts.

The stored rows are read as they lie, bucketed by id; only the stage is shuffled, to the same buckets. One pass decides every row
and counts the actions; a second rewrites the buckets in which anything changed, and the commit refuses to
follow another writer's. See `temporal.promote` for the actions.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..storage.store import Generation, Store
from ..tables import cut
from . import temporal

FACTS = "id string, payload string, certainty string, owners array<string>, valid_from timestamp, valid_to timestamp"
ACTIONS = ("insert", "replace", "close", "keep", "unchanged", "downgrade_ignored", "conflict")
_TICK = datetime.timedelta(microseconds=1)


class Conflict(Exception):
    """Two owners claim different payloads for one id."""


def facts(spark: SparkSession, folder: str, buckets: int = 64) -> Store:
    return Store(spark, folder, FACTS, "id", buckets)


def published_at(base: Generation, asked: datetime.datetime) -> datetime.datetime:
    """The time of the next publication: as asked, but after the one before by a microsecond at least."""
    before = base.info.get("published_at")
    return max(asked, datetime.datetime.fromisoformat(before) + _TICK) if before else asked


def decided(store: Store, base: Generation, stage: DataFrame, authoritative: list[str], at: Column) -> DataFrame:
    """temporal.promote over the rows that are current in the base; the stored side is not exchanged."""
    return temporal.promote(temporal.current(store.read(base)), stage, authoritative, at)


def publish(store: Store, base: Generation, stage: DataFrame, authoritative: list[str], asked: datetime.datetime, run_id: str, strict: bool = True) -> Generation:
    """Promotes a stage (id, payload, certainty, owners; ids distinct) over base and commits it.

    The manifest's info is the receipt: run_id, generation, base_generation, published_at, sources and the count of each action. strict: conflicts refuse the
    publication; otherwise the stored row stays.
    """
    when = published_at(base, asked)
    at = F.lit(when.isoformat(sep=" ")).cast("timestamp")
    seen = Observation(f"publish-{run_id}")
    every = decided(store, base, stage, authoritative, at).observe(seen, *[F.count_if(F.col("action") == a).alias(a) for a in ACTIONS])
    united = (F.col("action") == "unchanged") & (F.size(F.array_except("s_owners", "c_owners")) > 0)
    changed = cut(every.filter(F.col("action").isin("insert", "replace", "close") | united))
    counts = dict(seen.get)
    if strict and counts["conflict"]:
        raise Conflict(f"{counts['conflict']} ids are held by other sources with another payload")
    touched = sorted(r["b"] for r in changed.select(store.bucket().alias("b")).distinct().collect())  # at most as many as buckets
    stays = store.read(base).join(changed.select("id", F.lit(True).alias("moved")), "id", "left")
    stays = stays.filter(F.col("moved").isNull() | F.col("valid_to").isNotNull()).drop("moved")
    info = {
        "run_id": run_id, "generation": base.number + 1, "base_generation": base.number, "published_at": when.isoformat(), "sources": sorted(set(authoritative)), "counts": counts,
    }
    return store.commit(base, stays, temporal.snapshot(changed), touched, info)
