"""Structured Streaming: running observation counters and idempotent hit accumulation.

Event-time windows are an extension: the source model is a running counter without watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(events: DataFrame) -> DataFrame:
    """Counter, first and last time per (event_type, user_id); update mode."""
    return events.groupBy("event_type", "user_id").agg(F.count("*").alias("seen_count"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "w.end", "event_type", "n")


def coalesced(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first of repeated events within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def drain(df: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there; every batch's state goes to files of its own in the shared folder, the last is returned."""
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
        done.append(number)

    q = df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(f"{folder}/batch-{max(done)}") if done else spark.createDataFrame([], df.schema)
