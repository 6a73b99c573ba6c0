"""Registered queries that answer as a whole: what has changed between two runs, and what a run of the detectors did. With their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings, publication, receipts
from ..tables import load
from . import projection as g
from .answers import LATER, THEN, _opaque, _OPAQUE
from .catalogue import _FOUND, _found, query

# parts and orders as nodes that were made over when something of theirs was shipped
_NODES = """, nv AS (SELECT id, kind, t AS valid_from, lead(t) OVER (PARTITION BY id ORDER BY t) AS valid_to FROM (
SELECT DISTINCT 'part:' || l_partkey AS id, 'Symbol' AS kind, date_trunc('year', l_shipdate) AS t FROM lineitem WHERE l_returnflag = 'R' OR l_shipdate < DATE '1995-01-01')
UNION ALL SELECT 'data:order:' || o_orderkey, 'DataEntity', o_orderdate, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 400 DAY END FROM orders),
ev AS (SELECT source_id, target_id, 'CALLS' AS kind, valid_from, CASE WHEN s % 4 = 0 THEN valid_from + INTERVAL 900 DAY END AS valid_to FROM calls),
lb AS (SELECT id, max(kind) AS kind, max(valid_from) AS f FROM nv WHERE valid_from <= {b} AND (valid_to IS NULL OR valid_to > {b}) GROUP BY id),
la AS (SELECT id, max(kind) AS kind, max(valid_from) AS f FROM nv WHERE valid_from <= {a} AND (valid_to IS NULL OR valid_to > {a}) GROUP BY id),
ch AS (SELECT coalesce(la.id, lb.id) AS id, coalesce(la.kind, lb.kind) AS kind, CASE WHEN lb.id IS NULL THEN 'added' WHEN la.id IS NULL THEN 'removed' ELSE 'modified' END AS change
  FROM la FULL JOIN lb ON la.id = lb.id WHERE la.f IS DISTINCT FROM lb.f),
xb AS (SELECT DISTINCT source_id, target_id, kind FROM ev WHERE valid_from <= {b} AND (valid_to IS NULL OR valid_to > {b})),
xa AS (SELECT DISTINCT source_id, target_id, kind FROM ev WHERE valid_from <= {a} AND (valid_to IS NULL OR valid_to > {a})),
xd AS (SELECT kind, change, count(*) AS n FROM (SELECT *, 'added' AS change FROM (FROM xa EXCEPT FROM xb) UNION ALL SELECT *, 'removed' FROM (FROM xb EXCEPT FROM xa)) GROUP BY ALL),
im AS (SELECT change, target_id AS id, count(*) AS n, list_sort(list(source_id))[1:10] AS items FROM xb JOIN ch ON ch.id = target_id WHERE change <> 'added' GROUP BY ALL ORDER BY n DESC, target_id LIMIT 40),
an AS (SELECT 'nodes' AS part, kind, change, NULL AS id, count(*) AS n, list_sort(list(id))[1:40] AS items FROM ch GROUP BY kind, change
UNION ALL SELECT 'edges', kind, change, NULL, n, [] FROM xd UNION ALL SELECT 'impact', NULL, change, id, n, items FROM im
UNION ALL SELECT 'summary', NULL, 'nodes_' || c, NULL, (SELECT count(*) FROM ch WHERE change = c), [] FROM (VALUES ('added'), ('removed'), ('modified')) v(c)
UNION ALL SELECT 'summary', NULL, 'edges_' || c, NULL, (SELECT coalesce(sum(n), 0) FROM xd WHERE change = c), [] FROM (VALUES ('added'), ('removed')) v(c)
UNION ALL SELECT 'summary', NULL, 'impacted_callers', NULL, (SELECT coalesce(sum(n), 0) FROM im), [])
SELECT part, kind, change, id, CAST(n AS BIGINT) AS n, array_to_string(items, ',') AS items FROM an""".replace("{b}", THEN).replace("{a}", LATER)


@query(_NODES)
def run_comparison(spark, d):
    li, o = load(spark, d, "lineitem"), load(spark, d, "orders")
    made = li.filter("l_returnflag = 'R' OR l_shipdate < DATE '1995-01-01'").select(g.part_id(F.col("l_partkey")).alias("id"), F.date_trunc("year", "l_shipdate").alias("valid_from")).distinct()
    parts = made.select("id", F.lit("Symbol").alias("kind"), "valid_from", F.expr("lead(valid_from) OVER (PARTITION BY id ORDER BY valid_from)").alias("valid_to"))
    gone = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 400 DAY"))
    orders = o.select(F.concat(F.lit("data:order:"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("DataEntity").alias("kind"), F.col("o_orderdate").alias("valid_from"), gone.alias("valid_to"))
    calls = g.calls(spark, d)
    edges = calls.select("source_id", "target_id", F.lit("CALLS").alias("kind"), "valid_from", F.when(F.col("s") % 4 == 0, F.col("valid_from") + F.expr("INTERVAL 900 DAY")).alias("valid_to"))
    answer = publication.comparison(parts.unionByName(orders), edges, F.expr(LATER), F.expr(THEN))  # in either order
    return answer.withColumn("items", F.array_join("items", ","))


_PLACED = "f5 AS (SELECT kind, kind || ':' || subject_id AS k FROM fd UNION ALL SELECT 'opaque_component_failing', 'opaque_component_failing:' || target_id FROM oy WHERE errors / greatest(calls, 1) >= 0.1)"


@query(f"""{_FOUND}, {_OPAQUE}, {_PLACED}, fk AS (SELECT DISTINCT k FROM f5),
st AS (SELECT k, CASE WHEN length(k) % 4 = 0 THEN 'resolved' WHEN length(k) % 4 = 1 THEN 'acknowledged' ELSE 'open' END AS status FROM (SELECT k FROM fk WHERE length(k) % 3 > 0 UNION ALL SELECT 'lost:' || o_orderkey FROM orders))
SELECT name, coalesce(n, 0) AS n FROM (VALUES ('duplicate_endpoint'), ('unverified_claim'), ('dynamic_call_detected'), ('dead_path_suspected'), ('schema_mismatch'), ('opaque_component_failing')) v(name)
LEFT JOIN (SELECT kind AS name, count(*) AS n FROM f5 GROUP BY 1) USING (name)
UNION ALL SELECT 'new', count(*) FROM fk WHERE k NOT IN (SELECT k FROM st) UNION ALL SELECT 'reopened', count(*) FROM st WHERE status = 'resolved' AND k IN (SELECT k FROM fk)
UNION ALL SELECT 'auto_resolved', count(*) FROM st WHERE status <> 'resolved' AND k NOT IN (SELECT k FROM fk)""")
def detector_run(spark, d):
    """What a run of all six detectors did to the findings that an earlier run left."""
    opaque = findings.detect_rows(_opaque(spark, d), "opaque_component_failing", "warning", F.col("target_id"))
    found = _found(spark, d).unionAll(opaque).withColumn("identity_key", F.concat_ws(":", "kind", "subject_id"))
    lost = load(spark, d, "orders").select(F.concat(F.lit("lost:"), F.col("o_orderkey").cast("string")).alias("identity_key"))
    keys = found.select("identity_key").distinct().filter(F.length("identity_key") % 3 > 0).unionAll(lost)
    n = F.length("identity_key") % 4
    status = F.when(n == 0, "resolved").when(n == 1, "acknowledged").otherwise("open")
    return findings.run_stats(found, keys.select("identity_key", status.alias("status"), F.when(n == 0, "system").alias("resolved_by")))


@query("""SELECT dimension, value, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'priority' AS dimension, p AS value, 0 AS n FROM (VALUES ('P1'), ('P2'), ('P3'), ('P4')) v(p)
UNION ALL SELECT 'priority', CASE WHEN r >= 75 THEN 'P1' WHEN r >= 50 THEN 'P2' WHEN r >= 25 THEN 'P3' ELSE 'P4' END, 1 FROM (SELECT o_orderkey % 101 AS r FROM orders WHERE o_orderstatus <> 'F')
UNION ALL SELECT 'status', CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'acknowledged' ELSE 'open' END, 1 FROM orders UNION ALL SELECT 'kind', o_orderpriority, 1 FROM orders) GROUP BY ALL""", graph=False)
def findings_breakdown(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "P", "acknowledged").otherwise("open")
    o = load(spark, d, "orders").select(status.alias("status"), F.col("o_orderpriority").alias("kind"), (F.col("o_orderkey") % 101).alias("risk_score"))
    return findings.breakdown(o)


@query("""SELECT run_id, list_filter([CASE WHEN k % 5 = 0 THEN 'scope' END, CASE WHEN k % 7 = 0 THEN 'generation' END, CASE WHEN k % 3 = 0 THEN 'sources_order' END, CASE WHEN k % 11 = 0 THEN 'seal_mismatch' END,
CASE WHEN k % 13 = 0 THEN 'publication_before_seal' END, CASE WHEN k % 17 = 0 THEN 'counts_negative' END, CASE WHEN status = 'F' AND k % 13 <> 0 THEN NULL WHEN status = 'O' THEN 'completed_missing' END, CASE WHEN status = 'O' THEN 'completed_before_publication' END,
CASE WHEN k % 2 = 0 AND k % 4 = 0 THEN 'head_state' END, CASE WHEN k % 2 = 0 AND k % 7 = 0 THEN 'head_generation' END, CASE WHEN k % 2 = 0 AND k % 13 = 0 THEN 'head_published_at' END], lambda x: x IS NOT NULL) AS f,
f[1] AS fault, len(f) AS n FROM (SELECT o_orderkey AS run_id, o_orderkey AS k, o_orderstatus AS status FROM orders)""".replace("SELECT run_id, list_filter", "SELECT run_id, fault, CAST(n AS INTEGER) AS n FROM (SELECT run_id, list_filter", 1) + ")", graph=False)
def receipt_checks(spark, d):
    """Receipts of runs that went wrong in every way that depends on the order's key."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    later = lambda h: at + F.expr(f"INTERVAL {h} HOUR")
    utc = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pick = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    counts = F.create_map(*[x for name in receipts.COUNTS for x in (F.lit(name), pick(17, F.lit(-1), F.lit(1)))])
    receipt = F.to_json(F.struct(
        F.lit("v1").alias("contract_version"), pick(7, k, k + 1).alias("generation"), k.alias("base_generation"), utc(pick(13, at, later(2))).alias("published_at"), F.array(F.lit("a"), F.lit("b")).alias("authoritative_sources"),
        utc(later(1)).alias("coverage_sealed_at"), counts.alias("counts"), F.lit(True).alias("atomic"),
    ))
    status = F.when(F.col("o_orderstatus") == "P", "published").otherwise("completed")
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate").repartition("o_orderkey")  # receipts are made and checked where they are joined
    runs = orders.select(
        k.alias("run_id"), F.lit("p").alias("project_id"), status.alias("status"), pick(5, F.lit("odd"), F.lit("full")).alias("scope"), at.alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", later(3)).alias("completed_at"), k.alias("base_generation"), pick(3, F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("b"))).alias("sources"),
        pick(11, later(5), later(1)).alias("sealed_at"), receipt.alias("receipt"),
    )
    heads = orders.filter(k % 2 == 0).select(k.alias("head_id"), F.lit("p").alias("head_project"), pick(4, F.lit("needs_rebuild"), F.lit("ready")).alias("state"), (k + 1).alias("head_generation"), later(2).alias("head_published_at"))
    return receipts.faults(runs, heads, "v1").select("run_id", "fault", F.size("faults").alias("n"))
