"""Registered queries of context packs, the project index, pinned reads and pushed runs, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, pinning
from ..tables import load
from . import projection as g
from .answers import LATER, THEN, clients
from .catalogue import _FOUND, _found, query

_ITEMS = 10
_SUBJECT = "split_part(subject_id, '->', 1)"


def _lists(name: str, key: str, item: str, table: str) -> str:
    return f"(SELECT id, list(item ORDER BY item) AS {name} FROM (SELECT id, item, row_number() OVER (PARTITION BY id ORDER BY item) AS r FROM (SELECT DISTINCT {key} AS id, {item} AS item FROM {table})) WHERE r <= {_ITEMS} GROUP BY id)"


_PARTS = ("callers", "callees", "data_access", "findings")


@query(f"""{_FOUND}, pk AS (SELECT s.id, s.name, {", ".join(f"coalesce({p}, CAST([] AS VARCHAR[])) AS {p}" for p in _PARTS)} FROM symbols s
LEFT JOIN {_lists("callers", "target_id", "source_id", "calls")} a ON a.id = s.id LEFT JOIN {_lists("callees", "source_id", "target_id", "calls")} b ON b.id = s.id
LEFT JOIN {_lists("data_access", "source_id", "kind || ' ' || target_id", "access")} c ON c.id = s.id LEFT JOIN {_lists("findings", _SUBJECT, "severity || ' ' || kind", "fd")} f ON f.id = s.id)
SELECT id, name, CAST(to_json({{'id': id, 'name': name, {", ".join(f"'{p}': {p}" for p in _PARTS)}}}) AS VARCHAR) AS artifact, false AS truncated,
{", ".join(f"CAST(len({p}) AS INTEGER) AS n_{p}, len({p}) >= {_ITEMS} AS {p}_full" for p in _PARTS)} FROM pk""")
def context_packs(spark, d):
    found = _found(spark, d).select(F.split("subject_id", "->")[0].alias("id"), "severity", "kind")
    return context.task_packs(g.symbols(spark, d), g.calls(spark, d), g.access(spark, d), found, _ITEMS).drop("n_bytes")


def _summed(target: str, text: str) -> str:
    return f"""SELECT {target} AS target_id, l_orderkey * 10 + l_linenumber AS summary_id, CASE WHEN l_returnflag = 'A' THEN 'x' END AS superseded_by, l_shipdate AS generated_at, {text} AS text
FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""


def _summaries(spark, d, target, text):
    """What is said of a target, line by line; returned lines are superseded."""
    li = load(spark, d, "lineitem").join(load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    return li.select(
        target.alias("target_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("summary_id"), F.when(F.col("l_returnflag") == "A", "x").alias("superseded_by"),
        F.col("l_shipdate").alias("generated_at"), text.alias("text"),
    )


def _pack_sql(before: str, targets: str, names: str, parts: list[str], lists: list[str], summary: str) -> str:
    """The rows of packs: targets with the lists and the newest summary."""
    joins = " ".join(f"LEFT JOIN {x} l{i} ON l{i}.id = t.id" for i, x in enumerate(lists))
    fields = ", ".join(f"'{n}': {n}" for n in [*names.split(", "), *parts, "summary"])
    return f"""{before}, su AS ({summary}), pk AS (SELECT {", ".join("t." + n for n in names.split(", "))}, {", ".join(f"coalesce({p}, CAST([] AS VARCHAR[])) AS {p}" for p in parts)}, coalesce(said, '') AS summary FROM ({targets}) t {joins}
LEFT JOIN (SELECT target_id AS id, arg_max(text, (generated_at, summary_id, text)) AS said FROM su WHERE superseded_by IS NULL GROUP BY 1) s ON s.id = t.id)
SELECT {names}, CAST(to_json({{{fields}}}) AS VARCHAR) AS artifact, false AS truncated, {", ".join(f"CAST(len({p}) AS INTEGER) AS n_{p}, len({p}) >= {_ITEMS} AS {p}_full" for p in parts)} FROM pk"""


_RISKS = _lists("findings", _SUBJECT, "severity || ' ' || kind", "fd")
_REACHED = f"""{_FOUND}, r(root, id, depth) AS (SELECT id, id, 0 FROM symbols WHERE is_entry_point UNION SELECT r.root, c.source_id, r.depth + 1 FROM r JOIN calls c ON c.target_id = r.id WHERE r.depth < 3),
af AS (SELECT root, id, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY ALL), tc AS (SELECT DISTINCT root, target_id AS id FROM (SELECT DISTINCT root, id FROM r) x JOIN access a ON a.source_id = x.id)"""


@query(_pack_sql(
    _REACHED, "SELECT id, name FROM symbols WHERE is_entry_point", "id, name", ["callers", "callees", "data_access", "contracts", "findings", "impact_callers", "impact_data"],
    [_lists("callers", "target_id", "source_id", "calls"), _lists("callees", "source_id", "target_id", "calls"), _lists("data_access", "source_id", "kind || ' ' || target_id", "access"),
     _lists("contracts", "'part:' || l_partkey", "target_id", "(SELECT l_partkey, e.target_id FROM lineitem JOIN exposes e ON e.source_id = 'supplier:' || l_suppkey WHERE l_quantity >= 50)"),
     _RISKS, _lists("impact_callers", "root", "depth || ' ' || id", "af"), _lists("impact_data", "root", "id", "tc")],
    _summed("'part:' || l_partkey", "'Supplied by ' || l_suppkey || ' for order ' || l_orderkey"),
))
def symbol_packs(spark, d):
    """The entry points; a part exposes what the suppliers of its large lines expose."""
    found = _found(spark, d).select(F.split("subject_id", "->")[0].alias("id"), "severity", "kind")
    by = load(spark, d, "lineitem").filter("l_quantity >= 50").select(g.part_id(F.col("l_partkey")).alias("part"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("source_id")).distinct()
    exposes = g.exposes(spark, d).join(by, "source_id").select(F.col("part").alias("source_id"), "target_id").distinct()
    said = F.concat(F.lit("Supplied by "), F.col("l_suppkey").cast("string"), F.lit(" for order "), F.col("l_orderkey").cast("string"))
    targets = g.symbols(spark, d).filter("is_entry_point")
    packs = context.symbol_packs(targets, g.calls(spark, d), g.access(spark, d), exposes, found, _summaries(spark, d, g.part_id(F.col("l_partkey")), said), 3, _ITEMS)
    return packs.drop("n_bytes")


_CLIENTS = """ct AS (SELECT DISTINCT 'customer:' || o_custkey AS source_id,
'http.GET./' || CASE WHEN l_tax = 0 THEN 'v2/' ELSE '' END || lower(replace(substr(o_orderpriority, 3), ' ', '-')) || '/' || l_returnflag AS contract_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
_CONTRACT = "'http.GET./' || lower(replace(substr(o_orderpriority, 3), ' ', '-')) || '/' || l_returnflag"


@query(_pack_sql(
    f"{_FOUND}, {_CLIENTS}", "SELECT target_id AS id FROM exposes UNION SELECT contract_id FROM ct", "id", ["exposers", "callers", "findings"],
    [_lists("exposers", "target_id", "source_id", "exposes"), _lists("callers", "contract_id", "source_id", "ct"), _RISKS], _summed(_CONTRACT, "'Called for order ' || l_orderkey"),
))
def contract_packs(spark, d):
    found = _found(spark, d).select(F.split("subject_id", "->")[0].alias("id"), "severity", "kind")
    name = F.concat(F.lit("http.GET./"), F.lower(F.replace(F.substring("o_orderpriority", 3, 100), F.lit(" "), F.lit("-"))), F.lit("/"), F.col("l_returnflag"))
    said = _summaries(spark, d, name, F.concat(F.lit("Called for order "), F.col("l_orderkey").cast("string")))
    return context.contract_packs(g.exposes(spark, d), clients(spark, d), found, said, _ITEMS).drop("n_bytes")


@query(_pack_sql(
    _FOUND, "SELECT 'data:order:' || o_orderkey AS id FROM orders", "id", ["accessors", "findings"],
    [_lists("accessors", "target_id", "kind || ' ' || source_id", "access"), _lists("findings", "split_part(subject_id, '->', 2)", "severity || ' ' || kind", "fd")],
    _summed("'data:order:' || l_orderkey", "'Holds line ' || l_linenumber || ' of part ' || l_partkey"),
))
def entity_packs(spark, d):
    found = _found(spark, d).select(F.get(F.split("subject_id", "->"), F.lit(1)).alias("id"), "severity", "kind").filter("id IS NOT NULL")
    entity = lambda c: F.concat(F.lit("data:order:"), F.col(c).cast("string"))
    said = _summaries(spark, d, entity("l_orderkey"), F.concat(F.lit("Holds line "), F.col("l_linenumber").cast("string"), F.lit(" of part "), F.col("l_partkey").cast("string")))
    return context.entity_packs(load(spark, d, "orders").select(entity("o_orderkey").alias("id")), g.access(spark, d), found, said, _ITEMS).drop("n_bytes")


@query("""SELECT 'nodes' AS section, 'Symbol' AS item, count(*) AS n FROM symbols UNION ALL SELECT 'nodes', 'DataEntity', count(DISTINCT target_id) FROM access UNION ALL SELECT 'nodes', 'Contract', count(DISTINCT target_id) FROM exposes
UNION ALL SELECT 'edges', kind, count(*) FROM edges GROUP BY kind UNION ALL SELECT 'certainty', certainty, count(*) FROM calls GROUP BY certainty
UNION ALL (SELECT 'hot_symbols', id, n FROM (SELECT id, n FROM (SELECT s.id, coalesce(c.n, 0) AS n FROM symbols s LEFT JOIN (SELECT target_id, count(*) AS n FROM calls GROUP BY 1) c ON c.target_id = s.id ORDER BY n DESC, s.id LIMIT 100) ORDER BY n DESC, id LIMIT 10))
UNION ALL (SELECT 'data_entities', target_id, n FROM (SELECT target_id, count(*) AS n FROM access GROUP BY 1 ORDER BY n DESC, target_id LIMIT 10))""")
def project_index(spark, d):
    return context.project_index(g.symbols(spark, d), g.edges(spark, d), g.calls(spark, d))


def _stamp(t: str) -> str:
    return f"""(SELECT o_custkey AS project_id, run_id, generation, published_at, coalesce(n, 0) AS overlay_generation FROM (
SELECT o_custkey, o_orderkey AS run_id, o_orderdate AS published_at, o_orderstatus <> 'P' AS ready, count(*) OVER (PARTITION BY o_custkey) AS generation, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
FROM orders WHERE o_orderdate <= {t}) LEFT JOIN (SELECT o_custkey, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate <= {t} GROUP BY 1) USING (o_custkey) WHERE r = 1 AND ready)"""


@query(f"""SELECT c_custkey AS project_id, CASE WHEN b.run_id IS NULL OR a.run_id IS NULL THEN 'unavailable' WHEN (b.run_id, b.generation, b.overlay_generation, b.published_at) <> (a.run_id, a.generation, a.overlay_generation, a.published_at) THEN 'changed' ELSE 'current' END AS status,
b.generation, a.generation AS now FROM customer LEFT JOIN {_stamp(THEN)} b ON b.project_id = c_custkey LEFT JOIN {_stamp(LATER)} a ON a.project_id = c_custkey""", graph=False)
def pinned_reads(spark, d):
    o = load(spark, d, "orders")
    runs = o.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("published_at"), (F.col("o_orderstatus") != "P").alias("ready"))
    shipped = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").alias("at"))
    overlays = shipped.join(runs.select("run_id", "project_id"), "run_id").select("project_id", "at")
    before, after = (pinning.stamps(runs, overlays, F.expr(t)) for t in (THEN, LATER))
    return pinning.revalidated(before, after, load(spark, d, "customer").select(F.col("c_custkey").alias("project_id")))


@query("""WITH r AS (SELECT o_orderkey AS run_id, o_custkey AS project_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'success' END AS status, o_orderpriority NOT LIKE '1%' AS pushed, o_orderdate AS t, year(o_orderdate) || o_orderpriority AS job FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY project_id, job ORDER BY t, run_id) AS k FROM r WHERE pushed),
mo AS (SELECT project_id, t, lead(least) OVER (PARTITION BY project_id ORDER BY t) AS nx FROM (SELECT project_id, t, min(run_id) AS least FROM f WHERE k = 1 GROUP BY 1, 2))
SELECT r.run_id, CASE WHEN k > 1 OR (k = 1 AND r.status = 'queued' AND nx IS NOT NULL) THEN 'cancelled' ELSE r.status END AS status,
CASE WHEN k > 1 THEN 'duplicate_webhook_job' WHEN k = 1 AND r.status = 'queued' AND nx IS NOT NULL THEN 'superseded_by_newer_webhook:' || nx END AS reason
FROM r LEFT JOIN f ON f.run_id = r.run_id LEFT JOIN mo ON mo.project_id = r.project_id AND mo.t = r.t""", graph=False)
def coalesced_pushes(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("success")
    runs = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("project_id"), status.alias("status"), (~F.col("o_orderpriority").startswith("1")).alias("pushed"),
        F.concat(F.year("o_orderdate").cast("string"), "o_orderpriority").alias("job_id"), F.col("o_orderdate").alias("created_at"),
    )
    return pinning.after_pushes(runs)


@query(f"""{_FOUND}, pk AS (SELECT c.source_id || '->' || c.target_id AS id, c.source_id, a.name AS source_name, c.target_id, b.name AS target_name, coalesce(f.findings, CAST([] AS VARCHAR[])) AS findings FROM calls c
LEFT JOIN symbols a ON a.id = c.source_id LEFT JOIN symbols b ON b.id = c.target_id LEFT JOIN {_lists("findings", "subject_id", "severity || ' ' || kind", "fd")} f ON f.id = c.source_id || '->' || c.target_id)
SELECT id, source_id, source_name, target_id, target_name, findings[1] AS first_finding, CAST(len(findings) AS INTEGER) AS n_findings, len(findings) >= {_ITEMS} AS findings_full, false AS truncated FROM pk""")
def edge_packs(spark, d):
    found = _found(spark, d).withColumnRenamed("subject_id", "id")
    packs = context.edge_packs(g.calls(spark, d), g.symbols(spark, d), found, _ITEMS)
    return packs.withColumn("first_finding", F.get_json_object("artifact", "$.findings[0]")).drop("artifact", "n_bytes")


@query(f"""{_FOUND} SELECT subject_id, kind, severity, CASE WHEN contains(subject_id, '->') THEN 'edge' ELSE 'node' END AS subject, a.name AS source_name, b.name AS target_name
FROM fd LEFT JOIN symbols a ON a.id = {_SUBJECT} LEFT JOIN symbols b ON contains(subject_id, '->') AND b.id = split_part(subject_id, '->', 2)""")
def finding_packs(spark, d):
    return context.finding_packs(_found(spark, d), g.symbols(spark, d))
