"""Progress of streams: one row a batch, from the metrics that Spark gathers while the batch runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..storage import files

ROWS = "query string, batch long, rows_in long, metrics map<string, long>"


def observed(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """df, whose every batch reports these aggregates under the name; no job of their own."""
    return df.observe(name, *[c.alias(k) for k, c in metrics.items()])


class Progress(StreamingQueryListener):
    """Writes a small file for each batch of the queries with this name; a batch that is run again keeps its first row."""

    def __init__(self, spark: SparkSession, folder: str, query: str):
        self.spark, self.folder, self.query = spark, folder, query

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.query:
            return
        found = {f"{name}.{k}": v for name, row in (p.observedMetrics or {}).items() for k, v in row.asDict().items()}
        try:
            files.create_json(self.spark, f"{self.folder}/{p.batchId:012d}.json", {"query": p.name, "batch": p.batchId, "rows_in": p.numInputRows, "metrics": found})
        except files.Exists:
            pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ROWS).json(folder)


def settled(spark: SparkSession) -> None:
    """Waits until the listeners have heard of all that has happened."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(60_000)
