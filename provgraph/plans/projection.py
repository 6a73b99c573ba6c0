"""The graph that the given tables stand for: parts are symbols, orders data entities.

GRAPH_SQL holds the same projections as SQL, for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import load

GRAPH_SQL = """
symbols AS (SELECT 'part:' || p_partkey AS id, p_partkey AS k, p_name AS name, p_brand AS component_id,
  lower(p_type) || '/' || p_partkey AS path, p_size <= 2 AS is_entry_point FROM part),
hops AS (SELECT o_orderdate, l_partkey AS s, lead(l_partkey) OVER (PARTITION BY o_orderkey ORDER BY l_partkey) AS t
  FROM (SELECT DISTINCT o_orderkey, o_orderdate, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        WHERE o_orderpriority LIKE '1%' AND l_returnflag = 'R')),
calls AS MATERIALIZED (SELECT s, t, 'part:' || s AS source_id, 'part:' || t AS target_id, min(o_orderdate) AS valid_from,
  CASE s % 3 WHEN 0 THEN 'inferred' WHEN 1 THEN 'asserted' ELSE 'verified' END AS certainty, s % 7 = 0 AS via_runtime
  FROM hops WHERE t IS NOT NULL GROUP BY s, t),
human AS (SELECT source_id, target_id, CASE WHEN (s + t) % 11 = 0 THEN 'confirm' ELSE 'dispute' END AS action FROM calls WHERE (s + t) % 11 IN (0, 1)),
seen AS (SELECT source_id, target_id, 1 + s % 9 AS hit_count, valid_from + INTERVAL 5 DAY AS last_seen_at FROM calls WHERE (s + t) % 5 = 0),
access AS MATERIALIZED (SELECT DISTINCT 'part:' || l_partkey AS source_id, 'data:order:' || l_orderkey AS target_id,
  CASE l_linestatus WHEN 'F' THEN 'READS' ELSE 'WRITES' END AS kind FROM lineitem),
exposes AS MATERIALIZED (SELECT DISTINCT 'supplier:' || l_suppkey AS source_id,
  'http.GET./' || lower(replace(substr(o_orderpriority, 3), ' ', '-')) || '/' || l_returnflag AS target_id
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 50),
edges AS MATERIALIZED (SELECT source_id, target_id, 'CALLS' AS kind FROM calls UNION ALL SELECT source_id, target_id, kind FROM access
  UNION ALL SELECT source_id, target_id, 'EXPOSES' FROM exposes),
versions AS (SELECT 'user:' || user_id AS id, event_type AS kind, value, ts AS valid_from,
  lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events),
observations AS (SELECT event_type AS operation, user_id, count(*) AS seen_count, min(ts) AS first_seen_at, max(ts) AS last_seen_at
  FROM events GROUP BY event_type, user_id)
"""


def part_id(c) -> F.Column:
    return F.concat(F.lit("part:"), c.cast("string"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    return p.select(
        part_id(F.col("p_partkey")).alias("id"), F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("component_id"),
        F.concat(F.lower("p_type"), F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") <= 2).alias("is_entry_point"),
    )


def calls(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_orderdate")
    li = load(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    rows = o.join(li, o.o_orderkey == li.l_orderkey).select("o_orderkey", "o_orderdate", F.col("l_partkey").alias("s")).distinct()
    hops = rows.withColumn("t", F.lead("s").over(W.partitionBy("o_orderkey").orderBy("s"))).filter("t IS NOT NULL")
    e = hops.groupBy("s", "t").agg(F.min("o_orderdate").alias("valid_from"))
    certainty = F.element_at(F.array(F.lit("inferred"), F.lit("asserted"), F.lit("verified")), (F.col("s") % 3 + 1).cast("int"))
    return e.select("s", "t", part_id(F.col("s")).alias("source_id"), part_id(F.col("t")).alias("target_id"), "valid_from", certainty.alias("certainty"), (F.col("s") % 7 == 0).alias("via_runtime"))


def human(calls: DataFrame) -> DataFrame:
    x = (F.col("s") + F.col("t")) % 11
    return calls.filter(x.isin(0, 1)).select("source_id", "target_id", F.when(x == 0, "confirm").otherwise("dispute").alias("action"))


def seen(calls: DataFrame) -> DataFrame:
    return calls.filter((F.col("s") + F.col("t")) % 5 == 0).select(
        "source_id", "target_id", (1 + F.col("s") % 9).alias("hit_count"), (F.col("valid_from") + F.expr("INTERVAL 5 DAY")).alias("last_seen_at")
    )


def access(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    kind = F.when(F.col("l_linestatus") == "F", "READS").otherwise("WRITES")
    return li.select(part_id(F.col("l_partkey")).alias("source_id"), F.concat(F.lit("data:order:"), F.col("l_orderkey").cast("string")).alias("target_id"), kind.alias("kind")).distinct()


def exposes(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").filter("l_quantity >= 50")
    o = load(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    path = F.lower(F.replace(F.substring("o_orderpriority", 3, 100), F.lit(" "), F.lit("-")))
    return (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("http.GET./"), path, F.lit("/"), F.col("l_returnflag")).alias("target_id"))
        .distinct()
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d).select("source_id", "target_id", F.lit("CALLS").alias("kind"))
    return c.unionAll(access(spark, d)).unionAll(exposes(spark, d).withColumn("kind", F.lit("EXPOSES")))


def versions(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("kind"), "value", F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy(F.col("event_type").alias("operation"), "user_id").agg(F.count("*").alias("seen_count"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"))
