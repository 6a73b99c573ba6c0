"""Registered queries: every operator over the projected graph, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masking, paths
from ..operators import aggregates as agg
from ..operators import findings, ledger, overlay, runtime, search, temporal, traverse
from ..streaming import observations as stream
from ..tables import cut, load, load_stream, shared_folder
from . import projection as g

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW = "TIMESTAMP '2024-06-01 00:00:00'"
BEFORE, AFTER = "TIMESTAMP '2024-01-10 00:00:00'", "TIMESTAMP '2024-01-20 00:00:00'"
QUERY_TEXT = "where is the blue large widget"


def query(sql: str | None = None, graph: bool = True):
    """Registers a query under its function's name; sql is its oracle, after the projected graph's WITH clause."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {g.GRAPH_SQL} {sql}" if graph else sql
        return f

    return add


def _entries(spark, d):
    return g.symbols(spark, d).filter("is_entry_point").select("id")


_REACH = """, r(id, d) AS (SELECT id, 0 FROM symbols WHERE is_entry_point UNION SELECT c.{far}, r.d + 1 FROM r JOIN calls c ON c.{near} = r.id WHERE r.d < 2),
m AS (SELECT id, min(d) AS d FROM r GROUP BY id)
SELECT CAST(m.d + 1 AS INTEGER) AS depth, c.source_id, c.target_id FROM m JOIN calls c ON c.{near} = m.id"""


@query(_REACH.format(near="target_id", far="source_id"))
def find_callers(spark: SparkSession, d: str) -> DataFrame:
    return traverse.callers(g.calls(spark, d), _entries(spark, d), 3)


@query(_REACH.format(near="source_id", far="target_id"))
def find_callees(spark, d):
    return traverse.callees(g.calls(spark, d), _entries(spark, d), 3)


@query("""SELECT c.source_id, c.target_id FROM calls c JOIN symbols s ON s.id = c.target_id WHERE s.is_entry_point""")
def find_direct_callers(spark, d):
    return traverse.callers(g.calls(spark, d), _entries(spark, d), 1).select("source_id", "target_id")


@query(""", r(id, d) AS (SELECT id, 0 FROM symbols WHERE is_entry_point UNION SELECT c.source_id, r.d + 1 FROM r JOIN calls c ON c.target_id = r.id WHERE r.d < 3),
a AS (SELECT id, min(d) AS depth FROM r WHERE d > 0 GROUP BY id), e AS (SELECT id FROM a UNION SELECT id FROM symbols WHERE is_entry_point)
SELECT id, CAST(depth AS INTEGER) AS depth, 'caller' AS what FROM a WHERE id IS NOT NULL
UNION ALL SELECT DISTINCT target_id, 0, 'data_entity' FROM access WHERE source_id IN (SELECT id FROM e)""")
def impact_analysis(spark, d):
    return traverse.impact(g.calls(spark, d), g.access(spark, d), _entries(spark, d), 3)


@query(""", r(id, d) AS (SELECT id, 0 FROM symbols WHERE is_entry_point UNION SELECT c.target_id, r.d + 1 FROM r JOIN seen c ON c.source_id = r.id WHERE r.d < 5),
m AS (SELECT id, min(d) AS d FROM r GROUP BY id), f AS (SELECT c.target_id AS id, m.d + 1 AS depth, c.source_id, c.hit_count FROM m JOIN seen c ON c.source_id = m.id WHERE m.d < 5),
ch AS (SELECT id, depth, hit_count FROM f WHERE id NOT IN (SELECT id FROM symbols WHERE is_entry_point) QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth, source_id, hit_count) = 1)
SELECT id, CAST(depth AS INTEGER) AS depth, CAST((SELECT min(hit_count) FROM ch) AS BIGINT) AS frequency FROM ch""")
def find_runtime_path(spark, d):
    return traverse.runtime_path(cut(g.seen(g.calls(spark, d))), _entries(spark, d), 5)


@query(""", q AS (SELECT 'part:' || p_partkey AS id, p_name || ' ' || p_size AS name FROM part),
h AS (SELECT DISTINCT c.source_id, q.name FROM calls c JOIN q ON q.id = c.target_id),
f AS (SELECT h.source_id, h.name, q.id FROM h JOIN q ON q.name = h.name AND q.id <> h.source_id)
SELECT DISTINCT source_id, min(id) AS target_id FROM f GROUP BY source_id, name HAVING count(*) = 1""")
def call_linking(spark, d):
    names = load(spark, d, "part").select(g.part_id(F.col("p_partkey")).alias("id"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"))
    mentions = g.calls(spark, d).select("source_id", F.col("target_id").alias("id")).join(names, "id").select("source_id", "name").distinct()
    return traverse.link_by_name(names, mentions)


@query("SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def edge_kinds(spark, d):
    return agg.count_by(g.edges(spark, d), "kind")


@query("SELECT certainty, count(*) AS n FROM calls GROUP BY certainty")
def certainty_source(spark, d):
    return agg.count_by(g.calls(spark, d), "certainty")


_VIEW = """SELECT c.*, h.action, s.hit_count, CASE WHEN h.action = 'confirm' AND c.certainty = 'inferred' THEN 'asserted' ELSE c.certainty END AS effective_certainty,
coalesce(s.hit_count, 0) > 0 AS exercised FROM calls c LEFT JOIN human h USING (source_id, target_id) LEFT JOIN seen s USING (source_id, target_id)"""


def _view(spark, d):
    c = g.calls(spark, d)
    return overlay.read_view(c, g.human(c), g.seen(c).select("source_id", "target_id", "hit_count"))


@query(f", v AS ({_VIEW}) SELECT effective_certainty, count(*) AS n FROM v GROUP BY 1")
def certainty_effective(spark, d):
    return agg.count_by(_view(spark, d), "effective_certainty")


@query(f", v AS ({_VIEW}) SELECT source_id, target_id, action, effective_certainty, exercised, CAST(coalesce(hit_count, 0) AS BIGINT) AS hit_count FROM v")
def edge_read_view(spark, d):
    return _view(spark, d).select("source_id", "target_id", "action", "effective_certainty", "exercised", F.coalesce("hit_count", F.lit(0)).alias("hit_count"))


@query("SELECT kind, count(DISTINCT source_id) AS n FROM edges GROUP BY kind")
def inventory(spark, d):
    return agg.distinct_ids(g.edges(spark, d), "kind", "source_id")


_DEGREE = "SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id"


@query(_DEGREE)
def degrees(spark, d):
    return agg.degree(g.edges(spark, d))


@query(f", dg AS ({_DEGREE}) SELECT s.id, s.name, coalesce(degree, 0) AS degree FROM symbols s LEFT JOIN dg USING (id) ORDER BY degree DESC, s.id LIMIT 200")
def degree_ranked_nodes(spark, d):
    return agg.top(agg.with_degree(g.symbols(spark, d), g.edges(spark, d)), 200, F.desc("degree"), "id").select("id", "name", "degree")


@query("SELECT id, count(*) AS blast FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges WHERE target_id <> source_id) GROUP BY id")
def blast_radius(spark, d):
    return agg.blast_radius(g.edges(spark, d))


@query("SELECT target_id AS id, count(*) AS in_degree FROM calls GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60")
def most_called(spark, d):
    return agg.top(agg.in_degree(g.calls(spark, d)), 60, F.desc("in_degree"), "id")


@query("SELECT target_id AS id, count(*) AS in_degree FROM access GROUP BY 1 HAVING count(*) >= 6")
def busy_entities(spark, d):
    return agg.in_degree(g.access(spark, d)).filter("in_degree >= 6")


@query("SELECT target_id, count(*) AS n FROM exposes GROUP BY 1 HAVING count(*) > 1")
def duplicate_endpoints(spark, d):
    return agg.duplicate_owners(g.exposes(spark, d))


@query("""SELECT c.source_id, c.target_id FROM calls c WHERE c.source_id IN (SELECT id FROM symbols WHERE component_id LIKE '%1') AND c.target_id IN (SELECT id FROM symbols WHERE component_id LIKE '%1')""")
def component_edges(spark, d):
    nodes = g.symbols(spark, d).filter(F.col("component_id").endswith("1"))
    return agg.induced(g.calls(spark, d), nodes).select("source_id", "target_id")


@query(""", b AS (SELECT source_id AS id, 'out' AS direction, kind, target_id, source_id FROM edges UNION ALL SELECT target_id, 'in', kind, target_id, source_id FROM edges)
SELECT id, direction, kind, target_id, source_id, CAST(row_number() OVER (PARTITION BY id, direction ORDER BY kind, target_id, source_id) AS INTEGER) AS rank FROM b
QUALIFY row_number() OVER (PARTITION BY id, direction ORDER BY kind, target_id, source_id) <= 10""")
def top_neighbours(spark, d):
    return agg.neighbours(g.edges(spark, d), 10)


@query(""", x AS (SELECT s.id, s.is_entry_point, coalesce(n, 0) AS in_degree FROM symbols s LEFT JOIN (SELECT target_id AS id, count(*) AS n FROM calls GROUP BY 1) USING (id)),
y AS (SELECT id, CASE WHEN is_entry_point THEN 0 WHEN in_degree > 0 THEN 1 ELSE 2 END AS tier, in_degree FROM x)
SELECT id, CAST(tier AS INTEGER) AS tier, in_degree FROM y ORDER BY tier, CASE tier WHEN 1 THEN -in_degree ELSE 0 END, id LIMIT 300""")
def priority_symbols(spark, d):
    return agg.priority(g.symbols(spark, d), g.calls(spark, d), 300)


@query("SELECT split_part(path, '/', 1) AS directory, count(*) AS n FROM symbols GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def top_directories(spark, d):
    return agg.top(agg.count_by(g.symbols(spark, d).select(agg.top_directory(F.col("path")).alias("directory")), "directory"), 15, F.desc("n"), "directory")


@query("SELECT source_id AS id, count(*) FILTER (WHERE kind = 'READS') AS n_reads, count(*) FILTER (WHERE kind = 'WRITES') AS n_writes FROM access GROUP BY 1")
def data_access(spark, d):
    return g.access(spark, d).groupBy(F.col("source_id").alias("id")).agg(F.count_if(F.col("kind") == "READS").alias("n_reads"), F.count_if(F.col("kind") == "WRITES").alias("n_writes"))


@query("SELECT target_id AS id, count(*) AS n_exposers, min(source_id) AS first_exposer FROM exposes GROUP BY 1")
def contracts(spark, d):
    return g.exposes(spark, d).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n_exposers"), F.min("source_id").alias("first_exposer"))


@query("""SELECT s.id, s.name, (SELECT count(*) FROM calls c WHERE c.target_id = s.id) AS n_callers, (SELECT count(*) FROM calls c WHERE c.source_id = s.id) AS n_callees FROM symbols s""")
def symbol_cards(spark, d):
    c = g.calls(spark, d)
    callers, callees = (c.groupBy(F.col(k).alias("id")).agg(F.count("*").alias(n)) for k, n in (("target_id", "n_callers"), ("source_id", "n_callees")))
    s = g.symbols(spark, d).select("id", "name").join(callers, "id", "left").join(callees, "id", "left")
    return s.select("id", "name", F.coalesce("n_callers", F.lit(0)).alias("n_callers"), F.coalesce("n_callees", F.lit(0)).alias("n_callees"))


@query("""SELECT id, bool_or(coalesce(hit_count, 0) > 0) AS exercised FROM (SELECT source_id AS id, hit_count FROM calls LEFT JOIN seen USING (source_id, target_id)
UNION ALL SELECT target_id, hit_count FROM calls LEFT JOIN seen USING (source_id, target_id)) GROUP BY id""")
def exercised_subjects(spark, d):
    v = _view(spark, d)
    return v.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"), "exercised").groupBy("id").agg(F.bool_or("exercised").alias("exercised"))


@query("SELECT id, kind, value, valid_from FROM versions WHERE valid_to IS NULL")
def current_versions(spark, d):
    return temporal.current(g.versions(spark, d)).select("id", "kind", "value", "valid_from")


@query(f"SELECT id, kind, value, valid_from FROM versions WHERE valid_from <= {AFTER} AND (valid_to IS NULL OR valid_to > {AFTER})")
def as_of_versions(spark, d):
    return temporal.as_of(g.versions(spark, d), F.expr(AFTER)).select("id", "kind", "value", "valid_from")


_LIVE = "valid_from <= {t} AND (valid_to IS NULL OR valid_to > {t})"
_DIFF = f""", b AS (SELECT id, kind, valid_from FROM versions WHERE {_LIVE.format(t=BEFORE)}), a AS (SELECT id, kind, valid_from FROM versions WHERE {_LIVE.format(t=AFTER)}),
df AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.kind, b.kind) AS kind, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM a FULL JOIN b ON a.id = b.id WHERE a.valid_from IS DISTINCT FROM b.valid_from)"""


@query(f"{_DIFF} SELECT * FROM df")
def compare_runs(spark, d):
    return temporal.diff(g.versions(spark, d), F.expr(BEFORE), F.expr(AFTER))


@query(f"{_DIFF} SELECT kind, change, count(*) AS n FROM df GROUP BY 1, 2")
def compare_runs_counts(spark, d):
    return agg.count_by(temporal.diff(g.versions(spark, d), F.expr(BEFORE), F.expr(AFTER)), "kind", "change")


@query(f""", s AS (SELECT id, kind, value FROM versions WHERE {_LIVE.format(t=AFTER)}), c AS (SELECT id, kind, value FROM versions WHERE {_LIVE.format(t=BEFORE)})
SELECT CASE WHEN c.id IS NULL THEN 'insert' WHEN s.id IS NULL THEN 'close' WHEN c.kind = s.kind AND c.value = s.value THEN 'unchanged' ELSE 'replace' END AS action, count(*) AS n
FROM c FULL JOIN s ON c.id = s.id GROUP BY 1""")
def publication_receipt(spark, d):
    return temporal.receipt(_publication(spark, d))


def _publication(spark, d):
    v = g.versions(spark, d).withColumn("payload", F.to_json(F.struct("kind", "value"))).withColumn("certainty", F.lit("asserted")).withColumn("owners", F.array(F.lit("events")))
    return temporal.promote(temporal.as_of(v, F.expr(BEFORE)), temporal.as_of(v, F.expr(AFTER)), ["events"], F.expr(AFTER))


@query(f""", s AS (SELECT id, kind, value FROM versions WHERE {_LIVE.format(t=AFTER)}), c AS (SELECT id, kind, value, valid_from FROM versions WHERE {_LIVE.format(t=BEFORE)}),
j AS (SELECT coalesce(c.id, s.id) AS id, c.valid_from, c.id IS NOT NULL AS old, s.id IS NOT NULL AS new, c.kind = s.kind AND c.value = s.value AS same FROM c FULL JOIN s ON c.id = s.id)
SELECT id, valid_from, CASE WHEN new AND same THEN NULL ELSE {AFTER} END AS valid_to FROM j WHERE old
UNION ALL SELECT id, {AFTER}, NULL FROM j WHERE new AND NOT (old AND same)""")
def published_snapshot(spark, d):
    return temporal.snapshot(_publication(spark, d)).select("id", "valid_from", "valid_to")


_STAGED = """, x AS (SELECT l_orderkey AS id, CAST(l_shipdate AS VARCHAR) AS payload, CASE l_linestatus WHEN 'F' THEN 'verified' ELSE 'inferred' END AS certainty, l_returnflag AS source_name, l_linenumber * 100000 + date_diff('day', DATE '1990-01-01', l_shipdate) AS ordinal FROM lineitem)
SELECT id, arg_max(payload, (certainty = 'verified', ordinal)) AS payload, max(certainty) AS certainty, string_agg(DISTINCT source_name, ',' ORDER BY source_name) AS owners,
count(DISTINCT payload) > 1 AND count(DISTINCT source_name) > 1 AS conflict FROM x GROUP BY id"""


@query(_STAGED)
def stage_reducer(spark, d):
    certainty = F.when(F.col("l_linestatus") == "F", "verified").otherwise("inferred")
    li = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("payload"), certainty.alias("certainty"), F.col("l_returnflag").alias("source_name"), (F.col("l_linenumber") * 100000 + F.date_diff("l_shipdate", F.lit("1990-01-01"))).alias("ordinal")
    )
    return temporal.staged(li).withColumn("owners", F.array_join("owners", ",")).select("id", "payload", "certainty", "owners", "conflict")


_OLD = f"valid_from < {NOW} - INTERVAL 30 DAY"
_FOUND = f""", v AS ({_VIEW}), fd AS (
SELECT 'duplicate_endpoint' AS kind, 'error' AS severity, target_id AS subject_id FROM exposes GROUP BY target_id HAVING count(*) > 1
UNION ALL SELECT 'unverified_claim', 'info', source_id || '->' || target_id FROM v WHERE {_OLD} AND effective_certainty = 'inferred'
UNION ALL SELECT 'dynamic_call_detected', 'warning', source_id || '->' || target_id FROM v WHERE certainty = 'asserted' AND via_runtime
UNION ALL SELECT 'dead_path_suspected', 'info', source_id || '->' || target_id FROM v WHERE {_OLD} AND NOT exercised
UNION ALL SELECT 'schema_mismatch', 'warning', source_id || '->' || target_id FROM access a WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE 'data:order:' || o_orderkey = a.target_id AND o_orderstatus <> 'P'))"""


def _found(spark, d):
    entities = load(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.concat(F.lit("data:order:"), F.col("o_orderkey").cast("string")).alias("id"))
    return findings.detect(_view(spark, d), g.exposes(spark, d), g.access(spark, d), entities, F.expr(NOW))


@query(f"{_FOUND} SELECT * FROM fd")
def detectors(spark, d):
    return _found(spark, d)


@query(f"{_FOUND} SELECT kind, severity, count(*) AS n FROM fd GROUP BY 1, 2")
def findings_by_kind(spark, d):
    return agg.count_by(_found(spark, d), "kind", "severity")


@query(f"""{_FOUND}, bl AS (SELECT id, count(*) AS blast FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges WHERE target_id <> source_id) GROUP BY id),
ex AS (SELECT source_id AS id FROM v WHERE exercised UNION SELECT target_id FROM v WHERE exercised),
sc AS (SELECT fd.kind, subject_id, greatest(0, least(100, CAST(round_even(CASE severity WHEN 'info' THEN 10::DOUBLE WHEN 'warning' THEN 40::DOUBLE ELSE 75::DOUBLE END
* CASE WHEN ex.id IS NULL THEN 1::DOUBLE ELSE 1.3::DOUBLE END + least(20.0, 4 * sqrt(CAST(coalesce(blast, 0) AS DOUBLE))), 0) AS INTEGER))) AS risk_score
FROM fd LEFT JOIN bl ON bl.id = fd.subject_id LEFT JOIN ex ON ex.id = fd.subject_id)
SELECT *, CASE WHEN risk_score >= 75 THEN 'P1' WHEN risk_score >= 50 THEN 'P2' WHEN risk_score >= 25 THEN 'P3' ELSE 'P4' END AS priority FROM sc""")
def findings_scored(spark, d):
    return findings.scored(_found(spark, d), g.edges(spark, d), exercised_subjects(spark, d).filter("exercised")).select("kind", "subject_id", "risk_score", "priority")


@query(f"{_FOUND} SELECT sha256(length('p1') || ':p1' || octet_length(encode(kind)) || ':' || kind || octet_length(encode(subject_id)) || ':' || subject_id) AS identity_key FROM fd")
def finding_identity(spark, d):
    return _found(spark, d).select(findings.identity(F.lit("p1"), F.col("kind"), F.col("subject_id")).alias("identity_key"))


def _orders_as_findings(spark, d):
    o = load(spark, d, "orders")
    li = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    done = F.col("o_orderstatus") == "F"
    return o.join(li, "o_orderkey", "left").select(
        F.when(done, "resolved").otherwise("open").alias("status"), F.col("o_orderdate").alias("first_seen_at"), F.when(done, F.col("shipped")).alias("resolved_at"), (F.col("o_orderkey") % 101).cast("int").alias("risk_score")
    )


_OF = """, fi AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'resolved' ELSE 'open' END AS status, o_orderdate AS first_seen_at, CASE o_orderstatus WHEN 'F' THEN shipped END AS resolved_at,
o_orderkey % 101 AS risk_score FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) USING (o_orderkey))"""
_END = "TIMESTAMP '1998-08-01 00:00:00'"


@query(f"""{_OF} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'open' AND risk_score >= 75) AS open_p1, count(*) FILTER (WHERE status = 'open') AS n_open, count(*) FILTER (WHERE status = 'resolved') AS n_resolved,
CAST(round_even(avg(risk_score) FILTER (WHERE status = 'open'), 0) AS INTEGER) AS risk_index,
round_even(avg(epoch(resolved_at) - epoch(first_seen_at)) FILTER (WHERE resolved_at >= first_seen_at) / 3600, 1) AS mttr_hours,
count(*) FILTER (WHERE first_seen_at >= {_END} - INTERVAL 7 DAY) AS new_7d, count(*) FILTER (WHERE resolved_at >= {_END} - INTERVAL 7 DAY) AS resolved_7d FROM fi""")
def findings_summary(spark, d):
    return findings.summary(_orders_as_findings(spark, d), F.expr(_END))


@query(f"""{_OF}, s AS (SELECT {_END} - INTERVAL 365 DAY AS t0), mk AS (
SELECT CAST(floor((epoch(first_seen_at) - epoch(t0)) / 604800) AS BIGINT) AS bucket, 1 AS o, 0 AS r FROM fi, s WHERE first_seen_at >= t0 AND first_seen_at < {_END}
UNION ALL SELECT CAST(floor((epoch(resolved_at) - epoch(t0)) / 604800) AS BIGINT), 0, 1 FROM fi, s WHERE resolved_at >= t0 AND resolved_at < {_END})
SELECT b AS bucket, CAST(coalesce(sum(o), 0) AS BIGINT) AS opened, CAST(coalesce(sum(r), 0) AS BIGINT) AS resolved FROM range(53) x(b) LEFT JOIN mk ON bucket = b GROUP BY b""")
def findings_trend(spark, d):
    return findings.trend(_orders_as_findings(spark, d), F.expr(_END), 365, 7)


def _searchable(spark, d):
    return g.symbols(spark, d).withColumn("signature", F.concat_ws(" ", "component_id", "path"))


def _search_sql(terms: list[str], n: int) -> str:
    """The score spelt out; names and paths here are lower-case words, so identifiers are cut at other characters only."""
    starts = lambda tokens, t: f"len(list_filter({tokens}, lambda x: {f'starts_with(x, {t!r}) OR ' if len(t) >= 3 else ''}length(x) >= 4 AND starts_with({t!r}, x))) > 0"
    rule = lambda t: f"CASE WHEN name = {t!r} THEN 12.0 WHEN list_contains(tokens, {t!r}) THEN 8.0 WHEN {starts('tokens', t)} THEN 2.0 WHEN list_contains(places, {t!r}) OR {starts('places', t)} THEN 1.5 WHEN contains(name, {t!r}) THEN 1.0 WHEN contains(signature, {t!r}) THEN 0.5 ELSE 0.0 END"
    hit = " OR ".join([*(f"contains({c}, {t!r})" for t in terms for c in ("id", "name", "signature")), *(f"contains({c}, {t[:4]!r})" for t in terms if len(t) >= 6 for c in ("id", "name"))])
    tier = f"CASE WHEN name IN ({', '.join(map(repr, terms))}) THEN 0 WHEN {' OR '.join(f'starts_with(name, {t!r})' for t in terms)} THEN 1 ELSE 2 END"
    each = ", ".join(f"{rule(t)} AS s{i}" for i, t in enumerate(terms))
    names = [f"s{i}" for i in range(len(terms))]
    return f""", b AS (SELECT id, name, lower(component_id || ' ' || path) AS signature, list_distinct(regexp_extract_all(name, '[a-z]+|[0-9]+')) AS tokens,
list_concat(regexp_extract_all(path, '[a-z]+|[0-9]+'), regexp_extract_all(id, '[a-z]+|[0-9]+')) AS places FROM symbols),
c AS (SELECT *, {tier} AS tier FROM b WHERE {hit} ORDER BY tier, id LIMIT 2000), e AS (SELECT id, name, tier, {each} FROM c)
SELECT id, name, CAST(tier AS INTEGER) AS tier, CAST({' + '.join(names)} + CASE WHEN {' AND '.join(f'{x} > 0' for x in names)} THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score FROM e
WHERE {' + '.join(names)} > 0 ORDER BY score DESC, tier, id LIMIT {n}"""


@query(_search_sql(search.query_terms(QUERY_TEXT), 50))
def search_symbols(spark, d):
    return search.search(_searchable(spark, d), QUERY_TEXT, 50)


@query("SELECT id, name FROM symbols WHERE contains(lower(id), '77') ORDER BY id LIMIT 200")
def id_search(spark, d):
    return g.symbols(spark, d).filter(F.contains(F.lower("id"), F.lit("77"))).orderBy("id").limit(200).select("id", "name")


@query("""SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id LIMIT 40""", graph=False)
def vector_search(spark, d):
    e = load(spark, d, "embeddings")
    first = e.orderBy("vec_id").select("embedding").first()[0]
    return search.vector_top(e, first, 40).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("""SELECT id, sum(CAST(1 AS DOUBLE) / (60 + rank)) AS score FROM (
SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier QUALIFY row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) <= 40
UNION ALL SELECT l_suppkey, row_number() OVER (ORDER BY n DESC, l_suppkey) FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, l_suppkey) <= 40) GROUP BY id""", graph=False)
def rank_fusion(spark, d):
    a = load(spark, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(40).withColumnRenamed("s_suppkey", "id")
    b = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(40)
    return search.fused(search.ranked(a, "balance", F.desc("s_acctbal"), "id").unionAll(search.ranked(b, "lines", F.desc("n"), "id")))


ROLE_PATHS = """, placed AS (SELECT id, k, CASE k % 7 WHEN 0 THEN 'src/Vendor/' WHEN 1 THEN 'a/tests/' WHEN 2 THEN 'out/dist/' WHEN 3 THEN 'Docs/' WHEN 4 THEN 'latest/' WHEN 5 THEN 'docs/test/' ELSE '' END || path AS path FROM symbols),
roles AS (SELECT id, path, CASE WHEN list_has_any(string_split(lower(path), '/'), ['vendored', 'vendor', 'third_party', 'thirdparty', 'node_modules']) THEN 'vendored' WHEN list_has_any(string_split(lower(path), '/'), ['tests', 'test', '__tests__']) THEN 'test'
WHEN list_has_any(string_split(lower(path), '/'), ['build', 'dist', 'coverage']) THEN 'generated' WHEN list_has_any(string_split(lower(path), '/'), ['tools', 'scripts', 'fixtures', 'examples', 'docs']) THEN 'support' ELSE 'product' END AS role FROM placed)"""


def placed(spark, d):
    """Symbols under folders of every role."""
    folders = F.array(*[F.lit(x) for x in ("src/Vendor/", "a/tests/", "out/dist/", "Docs/", "latest/", "docs/test/", "")])
    return g.symbols(spark, d).withColumn("path", F.concat(F.get(folders, (F.col("k") % 7).cast("int")), "path"))


@query(f"{ROLE_PATHS} SELECT id, role FROM roles")
def source_roles(spark, d):
    return placed(spark, d).select("id", search.role(F.col("path")).alias("role"))


@query("""SELECT o_orderpriority AS key, count(*) AS n_rows, round_even(avg(CASE WHEN o_totalprice IS NULL THEN 1.0 ELSE 0.0 END), 4) AS null_ratio, count(DISTINCT o_totalprice) AS n_distinct,
min(o_totalprice) AS least, max(o_totalprice) AS greatest, round(avg(o_totalprice), 4) AS mean, list_sort(list(o_totalprice))[CAST(floor(count(o_totalprice) / 2) AS BIGINT) + 1] AS p50 FROM orders GROUP BY 1""", graph=False)
def column_profile(spark, d):
    p = agg.profile(load(spark, d, "orders"), "o_totalprice", "o_orderpriority").withColumnRenamed("o_orderpriority", "key")
    return p.withColumn("mean", F.round("mean", 4))


@query("SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", graph=False)
def top_values(spark, d):
    return agg.top_values(load(spark, d, "part"), "p_name", 10)


@query("""SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS greatest, list_sort(list(value))[least(count(*) - 1, CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT)) + 1] AS p95 FROM events GROUP BY 1""", graph=False)
def stage_latency(spark, d):
    e = load(spark, d, "events").withColumnRenamed("event_type", "stage")
    return agg.ranked_quantile(e, ["stage"], "value", 0.95).select("stage", "n", F.round("mean", 6).alias("mean"), "greatest", F.col("quantile").alias("p95"))


@query()
def masked_documents(spark, d):
    return load(spark, d, "documents").select("doc_id", masking.mask_formats(F.col("text")).alias("masked"))


@query()
def personal_numbers(spark, d):
    found = masking.scan(F.col("text"))
    named = F.transform(found, lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["end"].cast("string")))
    return load(spark, d, "documents").select("doc_id", F.array_join(named, ",").alias("found"))


@query()
def masked_values(spark, d):
    return load(spark, d, "documents").select("doc_id", masking.mask_values(F.col("text")).alias("masked"))


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 3 THEN '***' ELSE substr(c_name, 1, 3) || '***' END AS name, '***' AS password FROM customer", graph=False)
def masked_columns(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("password"))
    return masking.mask_rows(c)[0].select(F.col("c_custkey").cast("long").alias("c_custkey"), "name", "password")


@query("""SELECT o_orderkey, 'http.GET.' || CASE WHEN o_orderkey % 2 = 0 THEN '/orders/{id}' ELSE '/orders/{key}/lines' END AS contract FROM orders""", graph=False)
def contract_ids(spark, d):
    o = load(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("orders//"), F.col("o_orderkey").cast("string"), F.lit("/?x=1"))).otherwise(F.lit("/orders/:key/lines/"))
    return o.select("o_orderkey", paths.contract_id(F.lit("get"), raw).alias("contract"))


@query(f"""SELECT service, operation, kind, CAST(count(*) AS BIGINT) AS seen_count, min(t) AS first_seen_at, max(t) AS last_seen_at FROM (
SELECT DISTINCT 'user:' || user_id AS service, event_type AS operation, 'CALLS' AS kind, CASE WHEN event_id % 2 = 0 THEN {BEFORE} ELSE {AFTER} END AS t FROM events) GROUP BY 1, 2, 3""", graph=False)
def runtime_observations(spark, d):
    e = load(spark, d, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("service"), F.col("event_type").alias("operation"), F.lit("CALLS").alias("kind"), (F.col("event_id") % 2).alias("batch"))
    none = spark.createDataFrame([], "service string, operation string, kind string, seen_count long, first_seen_at timestamp, last_seen_at timestamp")
    first = runtime.observed(none, e.filter("batch = 0"), F.expr(BEFORE))
    return runtime.observed(first, e.filter("batch = 1"), F.expr(AFTER))


@query("SELECT operation AS event_type, user_id, seen_count, first_seen_at, last_seen_at FROM observations")
def streamed_observations(spark, d):
    return stream.drain(stream.running_counts(load_stream(spark, d, "events")), shared_folder(spark, "observed"))


@query(""", o AS (SELECT DISTINCT 'seen:' || source_id AS observation_id, source_id AS operation FROM seen),
f AS (SELECT observation_id, c.source_id, c.target_id FROM o JOIN calls c ON c.source_id = o.operation QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY c.source_id, c.target_id) = 1)
SELECT o.observation_id, f.source_id, f.target_id FROM o LEFT JOIN f USING (observation_id)""")
def reconcile_observations(spark, d):
    c = cut(g.calls(spark, d))
    o = g.seen(c).select(F.concat(F.lit("seen:"), "source_id").alias("observation_id"), F.col("source_id").alias("operation"), F.lit("CALLS").alias("kind")).distinct()
    return runtime.reconcile(o, c.select("source_id", "target_id", F.lit("CALLS").alias("kind"), F.col("source_id").alias("operation")))


@query("SELECT user_id AS actor, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM events WHERE starts_with(event_type, 'c') GROUP BY 1", graph=False)
def sessions(spark, d):
    return ledger.sessions(load(spark, d, "events").select(F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.col("ts").alias("occurred_at")), "c")


@query("""SELECT count(*) AS n, coalesce(sum(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_totalprice AS DECIMAL(20,2)) END), 0) AS reported, coalesce(sum(CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_totalprice AS DECIMAL(20,2)) END), 0) AS estimated,
coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(20,2)) END), 0) AS reserved, count(*) FILTER (WHERE o_orderkey % 3 = 2) AS unknown FROM orders""", graph=False)
def ledger_exposure(spark, d):
    o = load(spark, d, "orders")
    money, r = F.col("o_totalprice").cast("decimal(20,2)"), F.col("o_orderkey") % 3
    x = ledger.exposure(o.select(F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"), F.when(r == 0, money).alias("reported"), F.when(r == 1, money).alias("estimated"), money.alias("reserved")))
    return x.select("n", *[F.col(c).cast("decimal(38,2)").alias(c) for c in ("reported", "estimated", "reserved")], "unknown")


@query("SELECT o_orderpriority AS fallback_reason, count(*) AS n, round_even(count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE), 3) AS rate FROM orders WHERE o_orderstatus = 'P' GROUP BY 1", graph=False)
def fallback_breakdown(spark, d):
    return ledger.fallbacks(load(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("fallback_reason")))


@query(f"SELECT event_id FROM events WHERE NOT (ts < {AFTER} - INTERVAL 14 DAY AND event_type = 'click')", graph=False)
def retention(spark, d):
    return ledger.retained(load(spark, d, "events"), "ts", F.expr(AFTER), 14, F.col("event_type") == "click").select("event_id")


@query("SELECT event_id, CASE WHEN user_id = 7 THEN 'redacted:7' ELSE 'user:' || user_id END AS actor, CASE WHEN user_id <> 7 THEN props END AS details FROM events", graph=False)
def actor_redaction(spark, d):
    e = load(spark, d, "events").select("event_id", F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("actor"), F.col("props").alias("details"))
    return ledger.redacted(e, "7").select("event_id", "actor", "details")


@query(""", cl AS (SELECT l_orderkey AS claim_id, 'part:' || l_partkey AS id FROM lineitem), f AS (SELECT id, 1 AS rank FROM symbols WHERE NOT is_entry_point)
SELECT claim_id, bool_and(f.rank IS NOT NULL) AS ok, CAST(min(f.rank) AS INTEGER) AS rank FROM cl LEFT JOIN f USING (id) GROUP BY 1""")
def claim_grounding(spark, d):
    claims = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.collect_set(g.part_id(F.col("l_partkey"))).alias("evidence"))
    return ledger.grounded(claims, g.symbols(spark, d).filter("NOT is_entry_point").select("id", F.lit(1).alias("rank")))


@query(""", x AS (SELECT count(*) FILTER (WHERE t.source_id IS NOT NULL AND c.source_id IS NOT NULL) AS tp, count(c.source_id) AS found, count(t.source_id) AS truth
FROM (SELECT source_id, target_id FROM calls WHERE certainty <> 'inferred') c FULL JOIN (SELECT source_id, target_id FROM seen) t ON c.source_id = t.source_id AND c.target_id = t.target_id)
SELECT tp, found, truth, CAST(tp AS DOUBLE) / found AS precision, CAST(tp AS DOUBLE) / truth AS recall, round(CAST(2 * tp AS DOUBLE) / (found + truth), 9) AS f1 FROM x""")
def extraction_accuracy(spark, d):
    c = cut(g.calls(spark, d))
    return agg.accuracy(c.filter("certainty <> 'inferred'"), g.seen(c), "source_id", "target_id").withColumn("f1", F.round("f1", 9))


@query("SELECT id FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id")
def distinct_endpoints(spark, d):
    return agg.endpoints(g.edges(spark, d)).distinct()


@query("SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1", graph=False)
def latest_sample(spark, d):
    return agg.first_per(load(spark, d, "events"), ["user_id"], 1, F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "value")


@query("SELECT s.id FROM symbols s WHERE s.id NOT IN (SELECT target_id FROM calls) AND NOT is_entry_point")
def uncalled_symbols(spark, d):
    s = g.symbols(spark, d).filter("NOT is_entry_point").select("id")
    return s.join(g.calls(spark, d).select(F.col("target_id").alias("id")), "id", "left_anti")


@query("SELECT source_id, target_id, CAST(hit_count AS BIGINT) AS hit_count FROM calls JOIN seen USING (source_id, target_id) WHERE certainty = 'verified'")
def exercised_edges(spark, d):
    c = g.calls(spark, d)
    return c.filter("certainty = 'verified'").join(g.seen(c).select("source_id", "target_id", "hit_count"), ["source_id", "target_id"]).select("source_id", "target_id", "hit_count")


@query("SELECT 'user:' || user_id AS edge, event_type AS observation_id, count(*) AS applied, greatest(0, count(*) - 10) AS delta FROM events GROUP BY 1, 2")
def hit_accumulation(spark, d):
    e = load(spark, d, "events").groupBy(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("edge"), F.col("event_type").alias("observation_id")).agg(F.count("*").alias("seen"))
    cursor = e.select("edge", "observation_id", F.least(F.lit(10), "seen").alias("applied"))
    return overlay.accumulate_hits(cursor, e)


@query("SELECT p_partkey, round(p_retailprice, 2) AS price FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50 OFFSET 50", graph=False)
def paged(spark, d):
    return load(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").offset(50).limit(50).select("p_partkey", F.round("p_retailprice", 2).alias("price"))
