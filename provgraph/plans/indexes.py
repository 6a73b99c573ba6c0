"""Registered queries over indexes and the record source, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells, trigrams
from ..sources.record_source import RecordSource
from ..tables import load, shared_folder
from .catalogue import query

TERMS = ("Licensed UNDER the", "ouè eau", "zzz no such term")
PATTERN = r"Licensed under the [A-Z][a-z]+ License"


def _postings(spark, docs):
    return trigrams.write(docs, "doc_id", "text", folder=shared_folder(spark, "postings"))


@query("SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{t.lower()}')" for t in TERMS), graph=False)
def term_postings(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    return trigrams.any_term(docs, _postings(spark, docs), "doc_id", ["text"], list(TERMS)).rows.select("doc_id")


@query(f"SELECT doc_id, substr(regexp_extract(text, '{PATTERN}'), 1, 80) AS found FROM documents WHERE regexp_matches(text, '{PATTERN}')", graph=False)
def pattern_postings(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    rows = trigrams.pattern(docs, _postings(spark, docs), "doc_id", "text", PATTERN).rows
    return rows.select("doc_id", F.regexp_extract(trigrams.snippet(F.col("text"), PATTERN), PATTERN, 0).alias("found"))


@query()
def vector_neighbours(spark, d):
    """The ten nearest others of every vector whose id is divisible by 20, against all vectors."""
    e = load(spark, d, "embeddings")
    index = cells.build(e, "vec_id", "embedding", 10)
    return cells.neighbours(index, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("id")), 10)


@query("""SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS record_type, CASE WHEN event_id % 7 = 0 THEN 'no JSON' END AS reason, count(*) AS n,
sum(CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END) AS k FROM events GROUP BY 1, 2""", graph=False)
def record_source(spark, d):
    """Events written as JSON lines, some of them cut short, and read through the record source."""
    e = load(spark, d, "events")
    line = F.to_json(F.struct(F.col("event_type").alias("record_type"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("source_name"), F.parse_json("props").alias("data")))
    folder = shared_folder(spark, "records")
    e.select(F.when(F.col("event_id") % 7 == 0, F.left(line, F.lit(20))).otherwise(line).alias("value")).write.text(folder)
    spark.dataSource.register(RecordSource)
    r = spark.read.format("analyzer_records").option("range_bytes", 1 << 20).load(folder)
    return r.groupBy("record_type", "reason").agg(F.count("*").alias("n"), F.sum(F.get_json_object("data", "$.k").cast("long")).alias("k"))
