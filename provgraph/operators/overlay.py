"""Human and runtime overlays over source facts, which they never change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["source_id", "target_id"]


def effective(certainty: Column, action: Column) -> Column:
    """A confirmation lifts inferred to asserted; nothing else changes."""
    return F.when((action == "confirm") & (certainty == "inferred"), "asserted").otherwise(certainty)


def read_view(edges: DataFrame, human: DataFrame, seen: DataFrame) -> DataFrame:
    """edges with action, effective_certainty, hit_count and exercised."""
    out = edges.join(human, KEY, "left").join(seen, KEY, "left")
    return out.withColumn("effective_certainty", effective(F.col("certainty"), F.col("action"))).withColumn("exercised", F.coalesce(F.col("hit_count"), F.lit(0)) > 0)


def last_confirmation(records: DataFrame, *key: str) -> DataFrame:
    """The newest record of each key."""
    w = W.partitionBy(*key).orderBy(F.desc("recorded_at"), F.desc("actor"))
    return records.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def accumulate_hits(cursor: DataFrame, arrived: DataFrame) -> DataFrame:
    """Idempotent replay: per edge and observation, only what exceeds the applied count is added.

    cursor: edge, observation_id, applied; arrived: edge, observation_id, seen. Returns edge, observation_id, applied, delta.
    """
    g = arrived.groupBy("edge", "observation_id").agg(F.max("seen").alias("seen")).join(cursor, ["edge", "observation_id"], "full")
    applied = F.coalesce("applied", F.lit(0))
    return g.select("edge", "observation_id", F.greatest(applied, F.coalesce("seen", F.lit(0))).alias("applied"), F.greatest(F.lit(0), F.coalesce("seen", F.lit(0)) - applied).alias("delta"))
