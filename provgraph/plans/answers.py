"""Registered queries of answers, publication, reviews and ledgers, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import contract_id
from ..operators import answers, budget, findings, ledger, publication, review, temporal
from ..operators import search as lexical
from ..tables import load, shared_folder
from . import projection as g
from .catalogue import _END, _FOUND, _OF, _REACH, AFTER, BEFORE, ROLE_PATHS, _entries, _found, _orders_as_findings, placed, query

DATED = """, dated AS MATERIALIZED (SELECT 'part:' || l_partkey AS source_id, 'data:order:' || l_orderkey AS target_id, CASE l_linestatus WHEN 'F' THEN 'READS' ELSE 'WRITES' END AS kind,
o_orderdate AS valid_from, CASE WHEN l_shipdate > o_orderdate THEN l_shipdate END AS valid_to FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
THEN, LATER = "TIMESTAMP '1996-03-01 00:00:00'", "TIMESTAMP '1997-03-01 00:00:00'"
_AT = "valid_from <= {t} AND (valid_to IS NULL OR valid_to > {t})"
_DELTA = f"""{DATED}, eb AS (SELECT DISTINCT source_id, target_id, kind FROM dated WHERE {_AT.format(t=THEN)}), ea AS (SELECT DISTINCT source_id, target_id, kind FROM dated WHERE {_AT.format(t=LATER)}),
delta AS (SELECT *, 'added' AS change FROM (FROM ea EXCEPT FROM eb) UNION ALL SELECT *, 'removed' FROM (FROM eb EXCEPT FROM ea))"""


def dated(spark, d):
    """Access edges with the time in which they hold."""
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    li = load(spark, d, "lineitem").join(o, "l_orderkey")
    kind = F.when(F.col("l_linestatus") == "F", "READS").otherwise("WRITES")
    return li.select(
        g.part_id(F.col("l_partkey")).alias("source_id"), F.concat(F.lit("data:order:"), F.col("l_orderkey").cast("string")).alias("target_id"), kind.alias("kind"),
        F.col("o_orderdate").alias("valid_from"), F.when(F.col("l_shipdate") > F.col("o_orderdate"), F.col("l_shipdate")).alias("valid_to"),
    )


@query("SELECT count(*) AS n FROM versions WHERE valid_to IS NULL")
def current_node_count(spark, d):
    return temporal.current(g.versions(spark, d)).agg(F.count("*").alias("n"))


@query(f"""{_REACH.format(near="target_id", far="source_id").replace("SELECT CAST(m.d + 1 AS INTEGER) AS depth,", ", w AS (SELECT CAST(m.d + 1 AS INTEGER) AS depth,", 1)}), p AS (FROM w ORDER BY depth, source_id, target_id LIMIT 100)
SELECT *, (SELECT count(*) >= 100 FROM p) AS truncated, CAST(CASE WHEN (SELECT count(*) >= 100 FROM p) THEN (SELECT max(depth) FROM p) ELSE least(3, coalesce((SELECT max(depth) FROM p), 0) + 1) END AS INTEGER) AS depth_reached FROM p""")
def callers_page(spark, d):
    return answers.walk_page(g.calls(spark, d), _entries(spark, d), 3, 100, backwards=True)


_FIRST = "(SELECT {k}, string_agg({v}, ',' ORDER BY {v}) FILTER (WHERE r <= 10) AS {n}, count(*) AS n_{n} FROM (SELECT {k}, {v}, row_number() OVER (PARTITION BY {k} ORDER BY {v}) AS r FROM (SELECT DISTINCT {k}, {v} FROM {t})) GROUP BY {k})"


@query(f"""SELECT s.id, s.name, callers, coalesce(n_callers, 0) AS n_callers, callees, coalesce(n_callees, 0) AS n_callees FROM symbols s
LEFT JOIN {_FIRST.format(k="target_id", v="source_id", n="callers", t="calls")} a ON a.target_id = s.id LEFT JOIN {_FIRST.format(k="source_id", v="target_id", n="callees", t="calls")} b ON b.source_id = s.id""")
def symbol_answers(spark, d):
    return answers.symbol_answer(g.symbols(spark, d), g.calls(spark, d))


@query(f"""SELECT split_part(key, '|', 1) AS entity_id, split_part(key, '|', 2) AS kind, symbols, n_symbols FROM {_FIRST.format(k="key", v="source_id", n="symbols", t="(SELECT target_id || '|' || kind AS key, source_id FROM access)")}""")
def data_accessors(spark, d):
    return answers.accessors(g.access(spark, d))


@query("""SELECT x.source_id, x.contract_id, coalesce(n, 0) AS n_exposers, f AS first_exposer, n IS NULL AS server_exposer_missing FROM (
SELECT DISTINCT 'customer:' || o_custkey AS source_id, 'http.GET./' || CASE WHEN l_tax = 0 THEN 'v2/' ELSE '' END || lower(replace(substr(o_orderpriority, 3), ' ', '-')) || '/' || l_returnflag AS contract_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey) x
LEFT JOIN (SELECT target_id, count(DISTINCT source_id) AS n, min(source_id) AS f FROM exposes GROUP BY 1) e ON e.target_id = x.contract_id""")
def contract_slices(spark, d):
    return answers.contract_slice(clients(spark, d), g.exposes(spark, d))


def clients(spark, d):
    """source_id, contract_id: customers as callers of contracts."""
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    li = load(spark, d, "lineitem").select("l_orderkey", "l_tax", "l_returnflag").join(o, "l_orderkey")
    name = F.lower(F.replace(F.substring("o_orderpriority", 3, 100), F.lit(" "), F.lit("-")))
    raw = F.concat(F.when(F.col("l_tax") == 0, "v2//").otherwise("/"), name, F.lit("/"), F.col("l_returnflag"), F.lit("/?page=1"))  # another spelling of the same path
    return li.select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("source_id"), contract_id(F.lit("get"), raw).alias("contract_id"))


@query("""SELECT component_id, n_symbols, coalesce(i, 0) AS n_inside, coalesce(x, 0) AS n_across FROM (SELECT component_id, count(*) AS n_symbols FROM symbols GROUP BY 1) LEFT JOIN (
SELECT component_id, count(*) FILTER (WHERE inside) AS i, count(*) FILTER (WHERE NOT inside) AS x FROM (
SELECT a.component_id, a.component_id = b.component_id AS inside FROM calls JOIN symbols a ON a.id = source_id JOIN symbols b ON b.id = target_id
UNION ALL SELECT b.component_id, false FROM calls JOIN symbols a ON a.id = source_id JOIN symbols b ON b.id = target_id WHERE a.component_id <> b.component_id) GROUP BY 1) USING (component_id)""")
def component_map(spark, d):
    return answers.component_map(g.symbols(spark, d), g.calls(spark, d))


TERMS = ["brass", "widget", "of", "Brand#1", "economy"]
_SEEDS = """, rel AS (SELECT id, """ + " + ".join(f"CAST(contains(name, '{t.lower()}') OR contains(id, '{t.lower()}') OR contains(lower(component_id || ' ' || path), '{t.lower()}') AS INTEGER)" for t in TERMS if len(t) > 2) + """ AS relevance FROM symbols),
seeds AS (SELECT id, relevance FROM rel WHERE relevance > 0 ORDER BY relevance DESC, id LIMIT 20)"""


def _seeds(spark, d):
    return answers.flow_seeds(g.symbols(spark, d).withColumn("signature", F.concat_ws(" ", "component_id", "path")), TERMS)


@query(f"{_SEEDS} SELECT id, CAST(relevance AS INTEGER) AS relevance FROM seeds")
def flow_seeds(spark, d):
    return _seeds(spark, d)


@query(f"{_SEEDS} SELECT DISTINCT source_id, target_id, kind FROM edges WHERE source_id IN (SELECT id FROM seeds) OR target_id IN (SELECT id FROM seeds) ORDER BY kind, source_id, target_id LIMIT 200")
def flow_neighbours(spark, d):
    return answers.one_hop(g.edges(spark, d), _seeds(spark, d))


@query(""", ends AS (SELECT string_split(min('/srv/' || path), '/') AS a, string_split(max('/srv/' || path), '/') AS b FROM symbols), c AS (SELECT a, i, a[i] AS x, bool_and(lower(a[i]) = lower(b[i])) OVER (ORDER BY i) AS same FROM ends, range(1, 20) r(i) WHERE i <= least(len(a), len(b)))
SELECT string_agg(x, '/' ORDER BY i) AS prefix FROM c WHERE same AND i < len(a)""")
def root_prefix(spark, d):
    return answers.root_prefix(g.symbols(spark, d).select(F.concat(F.lit("/srv/"), "path").alias("path")), "path")


@query(f"""{ROLE_PATHS}, wide AS (SELECT id, coalesce(n, 0) AS in_degree FROM symbols LEFT JOIN (SELECT target_id AS id, count(*) AS n FROM calls GROUP BY 1) USING (id) ORDER BY 2 DESC, 1 LIMIT 400)
SELECT id, CAST(CASE role WHEN 'product' THEN 0 WHEN 'support' THEN 2 ELSE 3 END AS INTEGER) AS path_rank, in_degree FROM wide JOIN roles USING (id) ORDER BY path_rank, in_degree DESC, id LIMIT 40""")
def hot_symbols(spark, d):
    return answers.hot_symbols(placed(spark, d), g.calls(spark, d), 40)


@query("SELECT 'data:order:' || o_orderkey AS id, coalesce(n, 0) AS in_degree FROM orders LEFT JOIN (SELECT target_id, count(*) AS n FROM access GROUP BY 1) ON target_id = 'data:order:' || o_orderkey ORDER BY 2 DESC, 1 LIMIT 100")
def busiest_entities(spark, d):
    entities = load(spark, d, "orders").select(F.concat(F.lit("data:order:"), F.col("o_orderkey").cast("string")).alias("id"))
    return answers.busiest_entities(entities, g.access(spark, d), 100)


@query(f"""SELECT kind, n, sources FROM (SELECT kind, count(*) AS n FROM edges GROUP BY 1) JOIN (SELECT kind, string_agg(source_id, ',' ORDER BY source_id) AS sources FROM (SELECT DISTINCT kind, source_id FROM edges)
WHERE true GROUP BY kind, false HAVING false UNION ALL SELECT kind, string_agg(source_id, ',' ORDER BY source_id) FROM (SELECT kind, source_id FROM (SELECT DISTINCT kind, source_id FROM edges) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY source_id) <= 5) GROUP BY kind) USING (kind)""")
def project_overview(spark, d):
    return answers.overview(g.edges(spark, d))


@query("SELECT target_id AS id, count(*) AS in_degree FROM calls GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 50")
def high_fan_in(spark, d):
    return answers.fan_in(g.calls(spark, d), g.symbols(spark, d), least=2)


@query("SELECT user_id, event_id, event_type FROM events WHERE (user_id, event_id) > (3, 1000) ORDER BY user_id, event_id LIMIT 100", graph=False)
def keyset_page(spark, d):
    return answers.keyset_page(load(spark, d, "events").select("user_id", "event_id", "event_type"), (3, 1000), ["user_id", "event_id"], 100)


@query("SELECT o_custkey AS project_id, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)", graph=False)
def tenant_rows(spark, d):
    projects = load(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_nationkey").alias("organisation_id"))
    return answers.within_tenant(load(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), "o_orderkey"), projects, 3)


@query("SELECT o_custkey AS project_id, year(o_orderdate) AS validated_generation, o_orderkey FROM orders o WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders p WHERE p.o_custkey = o.o_custkey)", graph=False)
def current_generation(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.year("o_orderdate").cast("long").alias("validated_generation"), "o_orderkey")
    return answers.at_generation(o, o.groupBy("project_id").agg(F.max("validated_generation").alias("generation")))


_SUMMARIES = "su AS (SELECT l_orderkey AS target_id, l_partkey * 100 + l_linenumber AS summary_id, CASE WHEN l_returnflag = 'A' THEN 'x' END AS superseded_by, l_shipdate AS generated_at, l_linestatus AS run_id FROM lineitem)"


def _summaries(spark, d):
    return load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("target_id"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("summary_id"), F.when(F.col("l_returnflag") == "A", "x").alias("superseded_by"),
        F.col("l_shipdate").alias("generated_at"), F.col("l_linestatus").alias("run_id"),
    )


@query(f"WITH {_SUMMARIES}, n AS (SELECT target_id, arg_max(summary_id, (generated_at, summary_id)) AS summary_id FROM su WHERE superseded_by IS NULL GROUP BY 1) SELECT n.*, o_orderstatus AS status FROM n JOIN orders ON o_orderkey = target_id", graph=False)
def summaries_of_nodes(spark, d):
    nodes = load(spark, d, "orders").select(F.col("o_orderkey").alias("target_id"), F.col("o_orderstatus").alias("status"))
    return answers.current_summaries(_summaries(spark, d)).join(nodes, "target_id")


@query(f"WITH {_SUMMARIES} SELECT summary_id, run_id, CASE WHEN superseded_by IS NULL AND run_id <> 'F' AND summary_id NOT IN (SELECT p_partkey * 100 + 1 FROM part WHERE p_size < 25) THEN 'closed' ELSE superseded_by END AS superseded_by FROM su", graph=False)
def retired_summaries(spark, d):
    retained = load(spark, d, "part").filter("p_size < 25").select((F.col("p_partkey") * 100 + 1).alias("summary_id"))
    return publication.retired(_summaries(spark, d), "F", retained, "closed")


@query("SELECT p_brand AS model, count(*) AS n, bool_and(p_size < 49) AS stub_only FROM part GROUP BY 1", graph=False)
def summaries_by_model(spark, d):
    return load(spark, d, "part").groupBy(F.col("p_brand").alias("model")).agg(F.count("*").alias("n"), F.bool_and(F.col("p_size") < 49).alias("stub_only"))


@query("SELECT o_orderkey AS attempt_id, count(l_orderkey) FILTER (WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY) AS n_in_time FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1", graph=False)
def attempts_in_time(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("attempt_id"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("deadline"))
    return answers.within_deadline(o, load(spark, d, "lineitem").select(F.col("l_orderkey").alias("attempt_id"), F.col("l_shipdate").alias("at")))


@query()
def value_search(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text", "lang")
    return answers.matches(docs, r"[0-9]{3,}", "text", "doc_id", F.col("lang") == "fr")


@query(f"{_DELTA} SELECT * FROM delta")
def edge_delta(spark, d):
    return publication.edge_delta(dated(spark, d), F.expr(THEN), F.expr(LATER))


@query(f"{_DELTA} SELECT kind, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed FROM delta GROUP BY 1")
def edge_delta_counts(spark, d):
    x = publication.edge_delta(dated(spark, d), F.expr(THEN), F.expr(LATER))
    return x.groupBy("kind").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))


@query(f"{_DELTA} SELECT target_id AS id, count(DISTINCT source_id) AS n_callers FROM eb WHERE target_id IN (SELECT target_id FROM delta) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def change_impact(spark, d):
    e = dated(spark, d)
    changed = publication.edge_delta(e, F.expr(THEN), F.expr(LATER)).select(F.col("target_id").alias("id"))
    return publication.change_impact(changed, temporal.as_of(e, F.expr(THEN))).orderBy(F.desc("n_callers"), "id").limit(200)


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'insert' WHEN p_partkey % 7 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'keep' ELSE 'close' END WHEN p_partkey % 2 = 0 AND p_partkey % 5 <> 0 THEN 'unchanged'
WHEN p_partkey % 5 = 0 THEN 'downgrade_ignored' WHEN p_partkey % 3 = 0 THEN 'conflict' ELSE 'replace' END AS action FROM part WHERE NOT (p_partkey % 11 = 0 AND p_partkey % 7 = 0)""", graph=False)
def publication_actions(spark, d):
    k = F.col("p_partkey")
    p = load(spark, d, "part")
    owners = F.when(k % 3 == 0, F.array(F.lit("events"), F.lit("manual"))).otherwise(F.array(F.lit("events")))
    now = p.filter("p_partkey % 11 <> 0").select(k.alias("id"), F.lit("old").alias("payload"), F.lit("asserted").alias("certainty"), owners.alias("owners"), F.expr(BEFORE).alias("valid_from"))
    stage = p.filter("p_partkey % 7 <> 0").select(k.alias("id"), F.when(k % 2 == 0, "old").otherwise("new").alias("payload"), F.when(k % 5 == 0, "inferred").otherwise("asserted").alias("certainty"), F.array(F.lit("events")).alias("owners"))
    return temporal.promote(now, stage, ["events"], F.expr(AFTER)).select("id", "action")


@query("SELECT p_partkey AS id, p_size AS v FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 20)", graph=False)
def union_staged(spark, d):
    p = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v"))
    return publication.union_staged(p.filter("v >= 10"), p.filter("v < 20"))


@query("SELECT l_returnflag AS type, l_orderkey AS id, min(l_partkey * 100 + l_linenumber) AS place FROM lineitem GROUP BY 1, 2", graph=False)
def first_evidence(spark, d):
    return publication.first_evidence(load(spark, d, "lineitem").select(F.col("l_returnflag").alias("type"), F.col("l_orderkey").alias("id"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("place")))


@query("""SELECT o_orderkey AS run_id, array_to_string(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'status' END, CASE WHEN o_orderkey % 5 = 0 THEN 'generation' END, CASE WHEN o_orderkey % 7 = 0 THEN 'sources_missing' END,
CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 THEN 'sources_order' END, CASE WHEN o_orderkey % 11 = 0 THEN 'seal_before_start' END, CASE WHEN o_orderkey % 13 = 0 THEN 'publish_before_seal' END, CASE WHEN o_orderkey % 17 = 0 THEN 'counts_negative' END], lambda x: x IS NOT NULL), ',') AS faults FROM orders""", graph=False)
def receipt_faults(spark, d):
    k = F.col("o_orderkey")
    sources = F.when(k % 7 == 0, F.expr("cast(array() as array<string>)")).when(k % 3 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    at = lambda hours, bad, n: F.col("o_orderdate") + F.make_dt_interval(hours=F.when(k % n == 0, bad).otherwise(hours))
    counts = F.create_map(*[x for name in publication.COUNTS for x in (F.lit(name), F.when((k % 17 == 0) & F.lit(name == "nodes"), -1).otherwise(k))])
    runs = load(spark, d, "orders").select(
        k.alias("run_id"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("success").alias("status"), k.alias("base_generation"), (k + F.when(k % 5 == 0, 2).otherwise(1)).alias("generation"),
        sources.alias("sources"), F.col("o_orderdate").alias("started_at"), at(F.lit(1), F.lit(-1), 11).alias("sealed_at"), at(F.lit(2), F.lit(-2), 13).alias("published_at"), F.lit(None).cast("timestamp").alias("completed_at"), counts.alias("counts"),
    )
    return publication.receipt_faults(runs).withColumn("faults", F.array_join("faults", ","))


@query(f"""SELECT c_custkey AS project_id, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS generation, CASE WHEN c_custkey % 2 = 1 THEN {AFTER} WHEN c_custkey % 4 = 0 THEN {AFTER} + INTERVAL 1 MICROSECOND ELSE {AFTER} + INTERVAL 1 DAY END AS published_at, c_custkey % 2 = 0 AS published FROM customer""", graph=False)
def next_heads(spark, d):
    c = load(spark, d, "customer").withColumn("nation", F.col("c_nationkey").cast("long"))
    heads = c.select(F.col("c_custkey").alias("project_id"), F.col("nation").alias("generation"), F.expr(AFTER).alias("published_at"))
    later = F.when(F.col("c_custkey") % 4 == 0, F.expr(BEFORE)).otherwise(F.expr(f"{AFTER} + INTERVAL 1 DAY"))
    requests = c.select(F.col("c_custkey").alias("project_id"), (F.col("nation") + F.col("c_custkey") % 2).alias("expected"), later.alias("at"))
    return publication.next_heads(heads, requests)


@query("SELECT p_partkey AS run_id, CASE WHEN p_size % 3 = 0 THEN 'a,b' WHEN p_size % 3 = 1 THEN 'b,c' END AS sources, p_size % 3 = 0 AND p_size % 2 = 0 AS refused FROM part", graph=False)
def sealed_runs(spark, d):
    p = load(spark, d, "part").select(F.col("p_partkey").alias("run_id"), F.col("p_size").alias("s"))
    ab, bc = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"), F.lit("b"))
    runs = p.select("run_id", F.when(F.col("s") % 3 == 0, ab).alias("sources"), F.when(F.col("s") % 3 == 0, F.expr(BEFORE)).alias("sealed_at"))
    asked = p.filter("s % 3 <> 2").select("run_id", F.when((F.col("s") % 3 == 0) & (F.col("s") % 2 == 1), ab).otherwise(bc).alias("sources"), F.expr(AFTER).alias("at"))
    return publication.sealed(runs, asked).select("run_id", F.array_join("sources", ",").alias("sources"), "refused")


@query("""SELECT l_orderkey, sha256('evidence[' || string_agg('{"part":' || l_partkey || ',"flag":"' || l_returnflag || '"}', ',' ORDER BY '{"part":' || l_partkey || ',"flag":"' || l_returnflag || '"}') || ']') AS evidence_hash FROM lineitem GROUP BY 1""", graph=False)
def evidence_hash(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", F.to_json(F.struct(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))).alias("item"))
    return publication.evidence_hash(li, "l_orderkey", "item")


@query("""WITH RECURSIVE i AS (SELECT l_orderkey, place, size, row_number() OVER (PARTITION BY l_orderkey ORDER BY place) AS k FROM (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS place, CAST(l_quantity AS BIGINT) AS size FROM lineitem)),
r AS (SELECT l_orderkey, place, k, 0 AS pack, 2 + size AS held FROM i WHERE k = 1 UNION ALL
SELECT i.l_orderkey, i.place, i.k, r.pack + CAST(r.held + size + 1 > 60 AS INTEGER), CASE WHEN r.held + size + 1 > 60 THEN 2 + size ELSE r.held + size + 1 END FROM r JOIN i ON i.l_orderkey = r.l_orderkey AND i.k = r.k + 1) SELECT l_orderkey, place, CAST(pack AS BIGINT) AS pack FROM r""", graph=False)
def evidence_packs(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("place"), F.rint("l_quantity").cast("long").alias("size"))
    return publication.packed(li, "l_orderkey", 60)


@query(f"""WITH r AS (SELECT o_orderkey AS run_id, o_custkey AS project_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'queued' ELSE 'success' END AS status, o_orderdate AS t FROM orders)
SELECT run_id, project_id, CASE WHEN status = 'running' AND t < {_END} - INTERVAL 6 HOUR THEN 'failed' WHEN status = 'queued' AND run_id <> first_value(run_id) OVER (PARTITION BY project_id, status ORDER BY t DESC, run_id DESC) THEN 'coalesced' ELSE status END AS status FROM r""", graph=False)
def swept_runs(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "queued").otherwise("success")
    runs = load(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("project_id"), status.alias("status"), F.col("o_orderdate").alias("started_at"))
    return publication.swept(runs, F.expr(_END), 6)


@query("SELECT run_id, count(*) AS n_producers, coalesce(string_agg(producer, ',' ORDER BY producer) FILTER (WHERE NOT sure), '') AS gaps, bool_or(NOT sure) AS partial FROM (SELECT l_orderkey AS run_id, l_returnflag AS producer, bool_or(l_linestatus = 'F') AS sure FROM lineitem GROUP BY 1, 2) GROUP BY 1", graph=False)
def run_coverage(spark, d):
    return publication.run_coverage(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("producer"), (F.col("l_linestatus") == "F").alias("authoritative")))


@query("SELECT o_custkey AS project_id, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN 'insufficient' WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'partial' ELSE 'complete' END AS status FROM orders GROUP BY 1", graph=False)
def coverage_report(spark, d):
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("project_id"))
    return publication.coverage_status(o.agg(F.count_if(F.col("o_orderstatus") == "F").alias("symbols"), F.count_if(F.col("o_orderstatus") == "P").alias("gaps"), F.lit(0).alias("skipped")))


@query("""SELECT l_returnflag AS owner, l_orderkey AS "table", string_agg('c' || l_linenumber || ':' || l_linestatus, ',' ORDER BY l_linenumber, 'c' || l_linenumber, l_linestatus) AS columns FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2""", graph=False)
def catalog_tables(spark, d):
    c = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("owner"), F.col("l_orderkey").alias("table"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("column"), F.col("l_linestatus").alias("type"), F.col("l_linenumber").alias("ordinal"))
    t = publication.catalog_tables(c, ("n",))
    return t.withColumn("columns", F.array_join(F.transform("columns", lambda x: F.concat_ws(":", x["name"], x["type"])), ","))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders ORDER BY orders.o_orderkey LIMIT 100", graph=False)
def table_sample(spark, d):
    return publication.table_sample(load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), 1000, "o_orderkey")


@query("SELECT kind, count(*) AS n, min(source_id) AS least FROM edges GROUP BY 1")
def stored_edges(spark, d):
    t = publication.write_partitioned(g.edges(spark, d), shared_folder(spark, "edges"), "kind")
    return t.groupBy("kind").agg(F.count("*").alias("n"), F.min("source_id").alias("least"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"omitted":"raw_payload"}' ELSE props END AS value FROM events""", graph=False)
def omitted_payloads(spark, d):
    key = F.when(F.col("event_id") % 3 == 0, "request_body").otherwise("request_id")
    e = load(spark, d, "events").select("event_id", publication.omitted(F.create_map(key, "props")).alias("m"))
    return e.select("event_id", F.map_values("m")[0].alias("value"))


_CALLS = "oc AS (SELECT target_id, CASE WHEN s % 13 = 0 THEN 'x' ELSE CAST(s % 3 AS VARCHAR) END AS errors, CAST(t % 4 AS VARCHAR) AS n FROM calls)"
_OPAQUE = f"""{_CALLS}, oy AS (SELECT target_id, sum(TRY_CAST(errors AS BIGINT)) AS errors, sum(CAST(n AS BIGINT)) AS calls FROM oc WHERE TRY_CAST(errors AS BIGINT) IS NOT NULL AND n <> '0'
AND target_id IN (SELECT id FROM symbols WHERE component_id LIKE 'Brand#1%') GROUP BY 1)"""


def _opaque(spark, d):
    calls = g.calls(spark, d).select("target_id", F.when(F.col("s") % 13 == 0, "x").otherwise((F.col("s") % 3).cast("string")).alias("errors"), (F.col("t") % 4).cast("string").alias("calls"))
    components = g.symbols(spark, d).select("id", F.when(F.col("component_id").startswith("Brand#1"), "opaque").otherwise("clear").alias("opacity"))
    return review.opaque_failures(calls, components)


@query(f", {_OPAQUE} SELECT target_id, CAST(errors AS BIGINT) AS errors, CAST(calls AS BIGINT) AS calls, round_even(errors / greatest(calls, 1), 4) AS error_ratio FROM oy WHERE errors / greatest(calls, 1) >= 0.1")
def opaque_failures(spark, d):
    return _opaque(spark, d)


_TAGS = ", ".join(f"({c!r}, {i}, {f + ': ' + r!r})" for i, (c, f, r) in enumerate(review.REQUIREMENTS))
_CWE = ", ".join(f"({k!r}, {c!r})" for k, c in review.CWE.items())


@query(f"""{_FOUND}, cw(kind, cwe) AS (VALUES {_CWE}), tg(cwe, i, tag) AS (VALUES {_TAGS}), ta AS (SELECT cwe, string_agg(tag, '; ' ORDER BY i) AS tags FROM tg GROUP BY 1)
SELECT kind, subject_id, cwe, coalesce(tags, '') AS tags FROM fd LEFT JOIN cw USING (kind) LEFT JOIN ta USING (cwe)""")
def findings_advice(spark, d):
    return review.advised(_found(spark, d)).select("kind", "subject_id", "cwe", "tags")


def _paged(spark, d):
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("finding_id"), (F.col("o_orderkey") % 101).cast("int").alias("risk_score"), F.col("o_orderdate").alias("last_seen_at"))


@query("SELECT o_orderkey AS finding_id, CAST(o_orderkey % 101 AS INTEGER) AS risk_score FROM orders ORDER BY o_orderkey % 101 DESC, o_orderdate DESC, o_orderkey LIMIT 500", graph=False)
def findings_by_risk(spark, d):
    return findings.page(_paged(spark, d), 10_000).select("finding_id", "risk_score")


@query("SELECT o_orderkey AS finding_id, CAST(o_orderkey % 101 AS INTEGER) AS risk_score FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50", graph=False)
def findings_recent(spark, d):
    return findings.page(_paged(spark, d), 50, "recent").select("finding_id", "risk_score")


_BILLS = """bill AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'done' END AS status, o_orderkey % 5 <> 0 AS priced, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_totalprice AS DECIMAL(20,2)) END AS reported,
CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_totalprice AS DECIMAL(20,2)) END AS estimated, CAST(o_totalprice AS DECIMAL(20,2)) AS reserved FROM orders),
ex AS (SELECT coalesce(sum(reported), 0) AS reported_spend, coalesce(sum(estimated) FILTER (WHERE reported IS NULL), 0) AS estimated_spend, coalesce(sum(coalesce(reported, estimated)), 0) AS known_spend, coalesce(sum(reserved) FILTER (WHERE status = 'open'), 0) AS authorized_reservation,
coalesce(sum(reserved) FILTER (WHERE status = 'done' AND reported IS NULL AND estimated IS NULL), 0) AS unknown_exposure, count(*) FILTER (WHERE status = 'done' AND reported IS NULL AND estimated IS NULL) AS unknown_calls, count(*) FILTER (WHERE NOT priced) AS unpriced_calls, count(*) FILTER (WHERE status = 'open') AS open_calls FROM bill)"""


def _bills(spark, d):
    money, k = F.col("o_totalprice").cast("decimal(20,2)"), F.col("o_orderkey")
    return load(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"), (k % 5 != 0).alias("priced"), F.when(k % 3 == 0, money).alias("reported"), F.when(k % 3 == 1, money).alias("estimated"), money.alias("reserved"), "o_orderpriority"
    )


@query(f"WITH {_BILLS} SELECT * FROM ex", graph=False)
def budget_exposure(spark, d):
    return ledger.full_exposure(_bills(spark, d))


@query(f"""{_OF}, {_BILLS}, fp AS (SELECT CASE WHEN status = 'resolved' AND risk_score % 4 = 0 THEN 'false_positive' ELSE status END AS status, risk_score FROM fi)
SELECT CAST(sum(risk_score) FILTER (WHERE status = 'resolved') AS BIGINT) AS risk_eliminated, count(*) FILTER (WHERE status = 'resolved') AS findings_resolved, count(*) FILTER (WHERE status = 'false_positive') AS false_positives,
CAST(sum(risk_score) FILTER (WHERE status = 'open') AS BIGINT) AS open_risk, round_even(count(*) FILTER (WHERE status = 'resolved') / count(*) FILTER (WHERE status <> 'open'), 3) AS precision,
CASE WHEN (SELECT unknown_calls = 0 AND known_spend > 0 FROM ex) THEN 1.0 END AS risk_per_usd FROM fp""")
def return_on_cost(spark, d):
    f = _orders_as_findings(spark, d)
    f = f.withColumn("status", F.when((F.col("status") == "resolved") & (F.col("risk_score") % 4 == 0), "false_positive").otherwise(F.col("status")))
    return ledger.return_on_cost(f, ledger.full_exposure(_bills(spark, d)).select("known_spend", "unknown_calls"))


@query("SELECT l_returnflag AS model, count(*) AS n, CAST(sum(CASE WHEN l_tax > 0 THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS tokens_in, CAST(sum(l_linenumber) AS BIGINT) AS tokens_out, count(*) FILTER (WHERE NOT l_tax > 0) AS n_unknown FROM lineitem GROUP BY 1", graph=False)
def cost_rollup(spark, d):
    li = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.when(F.col("l_tax") > 0, F.col("l_quantity").cast("long")).alias("tokens_in"), F.col("l_linenumber").cast("long").alias("tokens_out"))
    return ledger.cost_by(li, "model")


@query(f"WITH {_BILLS}, b AS (SELECT o_orderpriority, o_orderstatus = 'O' AS o, CASE WHEN o_orderpriority <> '1-URGENT' OR o_orderkey % 2 = 0 THEN CAST(o_totalprice AS DECIMAL(20,2)) END AS m FROM orders) SELECT o_orderpriority, CASE WHEN count(*) FILTER (WHERE o AND m IS NULL) = 0 THEN sum(m) FILTER (WHERE o) END AS reserved, count(*) FILTER (WHERE o AND m IS NULL) AS n_unpriced, count(*) FILTER (WHERE o) AS n_open FROM b GROUP BY 1", graph=False)
def reservations(spark, d):
    money = F.when((F.col("o_orderpriority") != "1-URGENT") | (F.col("o_orderkey") % 2 == 0), F.col("o_totalprice").cast("decimal(20,2)"))
    o = load(spark, d, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"), money.alias("reserved"))
    return ledger.reservations(o, "o_orderpriority")


@query("""WITH r AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 365 DAY) SELECT o_orderpriority AS fallback_reason, count(*) AS n, round_even(count(*) / CAST((SELECT count(*) FROM r) AS DOUBLE), 3) AS rate FROM r WHERE o_orderstatus = 'P' GROUP BY 1""", graph=False)
def fallbacks_recent(spark, d):
    o = load(spark, d, "orders").select("o_orderdate", F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("fallback_reason"))
    return ledger.fallbacks(o, "o_orderdate", F.expr(_END), 1000)


@query(", cl AS (SELECT DISTINCT l_orderkey, 'part:' || l_partkey AS id FROM lineitem), fa AS (SELECT id, CASE k % 3 WHEN 0 THEN 'inferred' WHEN 1 THEN 'asserted' ELSE 'verified' END AS certainty FROM symbols WHERE NOT is_entry_point) SELECT certainty, count(*) AS n FROM cl JOIN fa USING (id) GROUP BY 1")
def evidence_certainty(spark, d):
    claims = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.collect_set(g.part_id(F.col("l_partkey"))).alias("evidence"))
    names = F.array(F.lit("inferred"), F.lit("asserted"), F.lit("verified"))
    facts = g.symbols(spark, d).filter("NOT is_entry_point").select("id", F.get(names, (F.col("k") % 3).cast("int")).alias("certainty"))
    return ledger.evidence_certainty(claims, facts)


def _diffs(spark, d):
    """Documents as diffs: a file name, then every line added."""
    body = F.concat(F.lit("+++ b/"), "source", F.lit("\n+"), F.regexp_replace("text", "\n", "\n+"), F.lit("\n+ TODO order of "), F.col("doc_id").cast("string"), F.lit("\n-fixme\n+delete from t_"), "lang", F.lit(";\n+select * from orders\n+fetch('/v1//7/')\n-MapGet(\"/v1/{id}\")"))
    return load(spark, d, "documents").select("doc_id", body.alias("diff"))


_LINES = """WITH l AS (SELECT doc_id, source, unnest(x) AS body, generate_subscripts(x, 1) AS i, len(x) AS n, lang FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
ad AS (SELECT doc_id, source, i + 1 AS line, body FROM l), tail AS (SELECT DISTINCT doc_id, source, lang, n FROM l)"""


@query(rf"""{_LINES} SELECT doc_id, severity, rule, 'b/' || source || ':' || line AS location FROM (
SELECT doc_id, source, line, unnest([CASE WHEN regexp_matches(body, '(?i)(password|pwd|secret|api[_-]?key|bearer)\s*[:=]\s*[''"][^''"]{{4,}}') THEN {{'severity': 'error', 'rule': 'hardcoded_secret'}} END,
CASE WHEN regexp_matches(body, '(?i)Server=.*;(User(\s*Id)?|UID)=.+;Password=.+') THEN {{'severity': 'error', 'rule': 'hardcoded_mssql_conn'}} END, CASE WHEN regexp_matches(body, '(?i)oracle://[^/]+:[^@]+@') THEN {{'severity': 'error', 'rule': 'hardcoded_oracle_conn'}} END,
CASE WHEN regexp_matches(body, '(?i)\b(drop\s+table|truncate\s+table|update\s+\w+\s+set\s+[^;]*;|delete\s+from\s+\w+\s*;)') THEN {{'severity': 'error', 'rule': 'forbidden_sql'}} END, CASE WHEN regexp_matches(body, '(?i)\b(todo|fixme|xxx)\b') THEN {{'severity': 'warning', 'rule': 'todo_added'}} END], recursive := true) FROM ad
UNION ALL SELECT doc_id, source, n + 2, 'warning', 'todo_added' FROM tail UNION ALL SELECT doc_id, source, n + 4, 'error', 'forbidden_sql' FROM tail) WHERE rule IS NOT NULL""", graph=False)
def diff_rules(spark, d):
    return review.review_lines(review.diff_lines(_diffs(spark, d), "doc_id", "diff"), "doc_id")


@query(f"""{_LINES} SELECT doc_id, 'http.GET./v1/{{id}}' AS contract_id, 'b/' || source || ':' || (n + CASE WHEN doc_id % 2 = 0 THEN 7 ELSE 6 END) AS location, CASE WHEN doc_id % 2 = 0 THEN 'contract_exposer_removed' ELSE 'new_http_contract' END AS rule,
CASE WHEN doc_id % 2 = 0 THEN 'critical' ELSE 'warning' END AS severity FROM tail""", graph=False)
def diff_contracts(spark, d):
    lines = review.diff_lines(_diffs(spark, d), "doc_id", "diff")
    known = spark.range(1).select(F.lit("http.GET./v1/{id}").alias("id"))
    even, odd = (lines.filter(F.pmod("doc_id", F.lit(2)) == r) for r in (0, 1))
    return review.review_contracts(even, "doc_id", known).unionAll(review.review_contracts(odd, "doc_id", known.filter("false")))


@query(f"""{_LINES} SELECT doc_id, location, name, rule, severity FROM (SELECT doc_id, 'b/' || source || ':' || (n + 4) AS location, 't_' || lang AS name, CASE WHEN lang = 'fr' THEN 'sensitive_entity_access' ELSE 'write_against_delete' END AS rule, 'critical' AS severity FROM tail
UNION ALL SELECT doc_id, 'b/' || source || ':' || (n + 5), 'orders', 'select_star', 'info' FROM tail)""", graph=False)
def diff_access(spark, d):
    entities = load(spark, d, "documents").select(F.concat(F.lit("T_"), "lang").alias("name"), (F.col("lang") == "fr").alias("is_sensitive")).distinct()
    return review.review_access(review.diff_lines(_diffs(spark, d), "doc_id", "diff"), "doc_id", entities)


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '[SCRUBBED]' WHEN 1 THEN 'select ''?'' from ' || event_type || ' 10.1.2.3'
WHEN 4 THEN '***' WHEN 5 THEN 'sel***' ELSE 'select ''' || user_id || ''' from ' || event_type || ' [IP]' END AS value FROM events""", graph=False)
def scrubbed_spans(spark, d):
    keys = F.array(*[F.lit(k) for k in ("http.request.body", "DB.statement", "http.route", "peer", "x.API-key", "peer.name")])
    value = F.concat(F.lit("select '"), F.col("user_id").cast("string"), F.lit("' from "), "event_type", F.lit(" 10.1.2.3"))
    return load(spark, d, "events").select("event_id", review.scrub(F.get(keys, (F.col("event_id") % 6).cast("int")), value).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'fallback' WHEN o_orderkey % 3 = 0 THEN 'hypothesis' WHEN o_orderkey % 4 = 0 THEN 'invalid' WHEN n > 0 THEN 'grounded' ELSE 'stale' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey", graph=False)
def grounding_status(spark, d):
    n = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    k = F.col("o_orderkey")
    return load(spark, d, "orders").join(n, "o_orderkey", "left").select("o_orderkey", review.grounding(k % 5 == 0, k % 3 == 0, k % 4 == 0, F.coalesce("n", F.lit(0))).alias("status"))


@query(f"""{ROLE_PATHS} SELECT CAST(count(*) FILTER (WHERE role IN ('product', 'support')) AS BIGINT) AS n FROM roles""")
def product_scope(spark, d):
    s = placed(spark, d).select(lexical.role(F.col("path")).alias("role"))
    return s.agg(F.count_if(F.col("role").isin("product", "support")).alias("n"))


@query("""WITH RECURSIVE li AS (SELECT l_suppkey AS supplier, 'order:' || l_orderkey || ':' || l_linenumber AS item FROM lineitem),
it AS (SELECT supplier, k, item, sum(strlen(item) + 3) OVER (PARTITION BY supplier ORDER BY k) AS z
  FROM (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY item) AS k FROM li)),
st AS (SELECT supplier, max(k) AS whole, strlen('{"supplier":' || supplier || ',"lines":[]}') - 1 AS base FROM it GROUP BY 1),
w AS (SELECT supplier, 0 AS i, whole AS n FROM st UNION ALL
  SELECT w.supplier, i + 1, CASE WHEN base + z <= 4096 THEN n ELSE least(n, greatest(1, CAST(floor(n * greatest(0.02::DOUBLE, least(0.75::DOUBLE, 4096::DOUBLE / (base + z)::DOUBLE * 0.9::DOUBLE))) AS BIGINT))) END
  FROM w JOIN st ON st.supplier = w.supplier JOIN it ON it.supplier = w.supplier AND k = n WHERE i < 8)
SELECT w.supplier, CAST(n AS INTEGER) AS n_lines, n < whole AS truncated, '{"supplier":' || w.supplier || ',"lines":[' || string_agg('"' || item || '"', ',' ORDER BY k) || ']}' AS artifact
FROM w JOIN st ON st.supplier = w.supplier JOIN it ON it.supplier = w.supplier AND k <= n WHERE i = 8 GROUP BY w.supplier, n, whole""", graph=False)
def budgeted_artifacts(spark, d):
    li = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.concat_ws(":", F.lit("order"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("item"))
    lists = li.groupBy("supplier").agg(F.sort_array(F.collect_list("item")).alias("lines"))
    return budget.within_bytes(lists, ["supplier"], ["lines"], ceiling=budget.LEAST).drop("n_bytes")
