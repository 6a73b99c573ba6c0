"""Registered queries over nested documents and guarded statements, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import guard, masking, nested
from ..tables import load
from .catalogue import query

_DEEP = '{"a":{"b":{"c":{"d":{"e":1}}}}}'


def _documents(spark, d):
    """Events with their properties deep in a document of every kind of value."""
    long = F.concat(F.lit('"'), F.repeat(F.lit("x"), 500 + F.col("event_id").cast("int") % 30), F.lit('"'))
    items = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), 48 + F.col("event_id").cast("int") % 5), lambda i: i.cast("string")), ","), F.lit("]"))
    fields = [("user_id", F.col("user_id").cast("string")), ("text", long), ("props", F.col("props")), ("Request", F.col("props")), ("my_raw", F.lit("1")), ("items", items), ("deep", F.lit(_DEEP)),
              ("nested", F.concat(F.lit('[{"z":null,"payload":'), "props", F.lit(',"a":'), "props", F.lit("}]")))]
    text = F.concat(F.lit("{"), *[x for i, (k, v) in enumerate(fields) for x in (F.lit(("," if i else "") + f'"{k}" : '), v)], F.lit("}"))
    return load(spark, d, "events").select("event_id", "event_type", text.alias("data"))


_SHOWN = """SELECT *, replace(props, ' ', '') AS p, 500 + event_id % 30 AS n, 48 + event_id % 5 AS m FROM events"""
_TEXT = """CASE WHEN n > 512 THEN '{"omitted":"large_string","chars":' || n || '}' ELSE '"' || repeat('x', CAST(n AS INTEGER)) || '"' END"""


@query(f"""WITH e AS ({_SHOWN}) SELECT event_id, '{{"Request":{{"omitted":"raw_payload"}},"deep":{{"a":{{"b":{{"c":{{"d":{{"omitted":"max_depth"}}}}}}}}}},"items":['
|| array_to_string(range(1, least(m, 50) + 1), ',') || CASE WHEN m > 50 THEN ',{{"__truncated_items__":' || (m - 50) || '}}' ELSE '' END || '],"my_raw":{{"omitted":"raw_payload"}},"nested":[{{"a":' || p
|| ',"payload":{{"omitted":"raw_payload"}},"z":null}}],"props":' || p || ',"text":' || {_TEXT} || ',"user_id":' || user_id || '}}' AS data FROM e""", graph=False)
def redacted_documents(spark, d):
    return _documents(spark, d).select("event_id", nested.redacted(F.col("data")).alias("data"))


@query(f"""WITH e AS ({_SHOWN}) SELECT event_id, sha256('{{"certainty":"asserted","created_by":["events"],"data":{{"Request":' || p || ',"deep":{_DEEP.replace('{', '{{').replace('}', '}}')},"items":['
|| array_to_string(range(1, m + 1), ',') || '],"my_raw":1,"nested":[{{"a":' || p || ',"payload":' || p || ',"z":null}}],"props":' || p || ',"text":"' || repeat('x', CAST(n AS INTEGER)) || '","user_id":'
|| user_id || '}},"kind":"' || event_type || '"}}') AS hash FROM e""".replace("{{", "{").replace("}}", "}"), graph=False)
def semantic_hashes(spark, d):
    e = _documents(spark, d)
    h = nested.semantic_hash(kind=F.col("event_type"), data=nested.parsed(F.col("data")), certainty=F.lit("asserted"), created_by=F.array(F.lit("events")))
    return e.select("event_id", h.alias("hash"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS k, '***' AS a, '***' AS b, CASE WHEN length(c_name) <= 3 THEN '***' ELSE substr(c_name, 1, 3) || '***' END AS label, c_mktsegment AS plain FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), '***', '***', substr('all ' || c_name, 1, 3) || '***', 'one' FROM customer WHERE c_custkey % 2 = 0""", graph=False)
def masked_by_origin(spark, d):
    """A statement that hides where its columns come from, landed: names, functions, unions and subqueries uncover nothing."""
    view = f"cards_{uuid.uuid4().hex}"
    c = load(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.concat(F.lit("pw"), "c_name").alias("password"))
    c.createOrReplaceTempView(view)
    statement = f"""WITH w AS (SELECT c_custkey, password AS x, name AS y, segment FROM {view})
    SELECT c_custkey AS k, upper(substr(x, 1, 9)) AS a, (SELECT max(x) FROM w) AS b, y AS label, segment AS plain FROM w
    UNION ALL SELECT c_custkey, 'none', x, concat('all ', y), 'one' FROM w WHERE c_custkey % 2 = 0"""
    # the cap is beyond all rows: what is shown here is the mask
    landed = guard.land(spark, statement, cap=2_000_000_000)
    spark.catalog.dropTempView(view)
    return landed.rows
