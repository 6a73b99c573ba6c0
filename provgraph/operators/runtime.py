"""Traces to observations to edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normal_path

ATTRIBUTE = "array<struct<key: string, value: struct<stringValue: string, intValue: string, boolValue: boolean, doubleValue: double>>>"
TRACE = (
    f"struct<resourceSpans: array<struct<resource: struct<attributes: {ATTRIBUTE}>, scopeSpans: array<struct<spans: "
    f"array<struct<traceId: string, spanId: string, parentSpanId: string, name: string, kind: int, attributes: {ATTRIBUTE}>>>>>>>"
)


def attribute(attributes: Column, key: str) -> Column:
    """The first value under a key, as text."""
    v = F.get(F.filter(attributes, lambda a: a["key"] == key), 0)["value"]
    return F.coalesce(v["stringValue"], v["intValue"], v["boolValue"].cast("string"), v["doubleValue"].cast("string"))


def spans(traces: DataFrame) -> DataFrame:
    """trace: JSON text. Returns service, operation, kind of every span that names both."""
    r = traces.select(F.explode(F.from_json("trace", TRACE)["resourceSpans"]).alias("r"))
    s = r.select(attribute(F.col("r.resource.attributes"), "service.name").alias("service"), F.explode(F.flatten(F.transform("r.scopeSpans", lambda x: x["spans"]))).alias("s"))
    a = F.col("s.attributes")
    statement = F.concat_ws(" ", attribute(a, "db.operation"), attribute(a, "db.sql.table"))
    operation = F.coalesce(attribute(a, "http.route"), attribute(a, "rpc.method"), F.nullif(statement, F.lit("")), F.col("s.name"))
    return s.select("service", operation.alias("operation"), F.when(F.col("s.kind") == 2, "EXPOSES").otherwise("CALLS").alias("kind")).filter("service <> '' AND operation <> ''")


def observed(stored: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Observations after a batch: each distinct triple counts once a batch."""
    keys = ["service", "operation", "kind"]
    fresh = batch.select(*keys).distinct().select(*keys, F.lit(1).cast("long").alias("seen_count"), now.alias("first_seen_at"), now.alias("last_seen_at"))
    return stored.select(*fresh.columns).unionAll(fresh).groupBy(*keys).agg(F.sum("seen_count").alias("seen_count"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


#: The fields of an edge that may name its operation.
CANDIDATES = ("operation", "path", "route")


def path_in_id(node_id: Column) -> Column:
    """The path that a contract's id carries: contract:http:METHOD:/path, contract:METHOD /path, http.METHOD./path; null for other ids."""
    after = lambda text, mark: F.when(F.instr(text, mark) > 0, F.right(text, F.length(text) - F.instr(text, mark) - len(mark) + 1))
    rest = F.right(node_id, F.length(node_id) - len("contract:"))
    spaced = F.coalesce(F.nullif(after(rest, " "), F.lit("")), rest)
    http = F.nullif(after(F.right(node_id, F.length(node_id) - len("contract:http:")), ":"), F.lit(""))
    return (
        F.when(node_id.startswith("contract:http:"), http)
        .when(node_id.startswith("contract:"), F.when(spaced.startswith("/"), spaced))
        .when(node_id.startswith("http."), F.when(F.instr(node_id, "./") > 0, F.right(node_id, F.length(node_id) - F.instr(node_id, "./"))))
    )


def _keys(operation: Column) -> Column:
    """Look-up keys of an operation: itself, and its normal form if it is a path."""
    raw = F.when(operation != "", F.concat(F.lit("raw:"), operation))
    norm = F.when(operation.startswith("/"), F.concat(F.lit("norm:"), normal_path(operation)))
    return F.array_compact(F.array(raw, norm))


def match_index(edges: DataFrame) -> DataFrame:
    """kind, key, first (the first edge, by source and target, of each key). edges: source_id, target_id, kind and any of CANDIDATES."""
    named = [F.col(c) for c in CANDIDATES if c in edges.columns] + [path_in_id(F.col("target_id"))]
    keys = F.array_distinct(F.flatten(F.transform(F.array_compact(F.array(*named)), _keys)))
    e = edges.select("kind", F.explode(keys).alias("key"), F.struct("source_id", "target_id").alias("edge"))
    return e.groupBy("kind", "key").agg(F.min("edge").alias("first"))


def match(observations: DataFrame, index: DataFrame) -> DataFrame:
    """observations (kind, operation and more) with source_id and target_id of the first edge that either key of the operation finds, or null."""
    keys = _keys(F.col("operation"))
    o = observations.withColumn("_raw", F.get(keys, 0)).withColumn("_norm", F.get(keys, 1))
    for c in ("_raw", "_norm"):
        o = o.join(index.select("kind", F.col("key").alias(c), F.col("first").alias(f"{c}_edge")), ["kind", c], "left")
    first = F.least("_raw_edge", "_norm_edge")
    return o.select(*observations.columns, first["source_id"].alias("source_id"), first["target_id"].alias("target_id"))


def reconcile(observations: DataFrame, edges: DataFrame) -> DataFrame:
    """observation_id with the edge it is evidence for; unmatched ones have none."""
    return match(observations, match_index(edges)).select("observation_id", "source_id", "target_id")
