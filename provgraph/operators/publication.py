"""Publication: sealed sources, heads, receipts and their checks, coverage, summaries that a new run retires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import nested
from ..tables import cut
from . import temporal
from .answers import clamp

COUNTS = ("inserted", "replaced", "closed", "kept", "unchanged", "downgrade_ignored", "conflict", "total", "nodes", "edges")
TERMINAL = ("success", "partial")


def sealed(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """runs: run_id, sources (null while open), sealed_at; requests: run_id, sources, at. A seal is written once; the same set may come again."""
    j = runs.join(requests.select("run_id", F.array_sort(F.array_distinct("sources")).alias("asked"), "at"), "run_id", "left")
    refused = F.col("sources").isNotNull() & F.col("asked").isNotNull() & (F.col("sources") != F.col("asked"))
    return j.select("run_id", F.coalesce("sources", "asked").alias("sources"), F.coalesce("sealed_at", F.when(F.col("sources").isNull(), F.col("at"))).alias("sealed_at"), F.coalesce(refused, F.lit(False)).alias("refused"))


def next_heads(heads: DataFrame, requests: DataFrame) -> DataFrame:
    """heads: project_id, generation, published_at; requests: project_id, expected, at. The heads after a compare-and-set.

    A request that expects another generation changes nothing; times grow by a microsecond at least.
    """
    j = heads.join(requests, "project_id", "left")
    ok = F.coalesce(F.col("expected") == F.col("generation"), F.lit(False))
    later = F.greatest("at", F.col("published_at") + F.expr("INTERVAL 0.000001 SECOND"))
    return j.select("project_id", F.when(ok, F.col("generation") + 1).otherwise(F.col("generation")).alias("generation"), F.when(ok, later).otherwise(F.col("published_at")).alias("published_at"), ok.alias("published"))


def receipt_faults(runs: DataFrame) -> DataFrame:
    """run_id, faults: the names of the checks that a run's receipt fails, in order.

    runs: run_id, status, base_generation, generation, sources, sealed_at, started_at, published_at, completed_at, counts (map).
    """
    c = F.col
    checks = [
        ("status", ~c("status").isin(*TERMINAL)),
        ("generation", ~c("generation").eqNullSafe(c("base_generation") + 1)),
        ("sources_missing", c("sources").isNull() | (F.size("sources") == 0)),
        ("sources_order", ~c("sources").eqNullSafe(F.array_sort(F.array_distinct("sources")))),
        ("seal_before_start", c("sealed_at").isNull() | (c("sealed_at") < c("started_at"))),
        ("publish_before_seal", c("published_at").isNull() | (c("published_at") < c("sealed_at"))),
        ("complete_before_publish", c("completed_at").isNotNull() & (c("completed_at") < c("published_at"))),
        ("counts_missing", ~F.forall(F.array(*[F.lit(k) for k in COUNTS]), lambda k: F.coalesce(F.map_contains_key("counts", k), F.lit(False)))),
        ("counts_negative", F.exists(F.map_values("counts"), lambda n: n < 0)),
    ]
    return runs.select("run_id", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in checks])).alias("faults"))


def union_staged(published: DataFrame, staged: DataFrame, key: str = "id") -> DataFrame:
    """Staged rows, and published ones that no staged row replaces."""
    return staged.unionByName(published.join(staged.select(key), key, "left_anti"))


def first_evidence(rows: DataFrame) -> DataFrame:
    """rows: type, id, place and more. The first row of each type and id."""
    held = [c for c in rows.columns if c not in ("type", "id")]
    return rows.groupBy("type", "id").agg(F.min(F.struct("place", *[c for c in held if c != "place"])).alias("r")).select("type", "id", "r.*")


def edge_delta(edges: DataFrame, before: Column, after: Column) -> DataFrame:
    """source_id, target_id, kind, change of edges (with validity) that live at one of two times only; one scan."""
    live = lambda t: F.bool_or((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))
    g = edges.groupBy("source_id", "target_id", "kind").agg(live(before).alias("b"), live(after).alias("a")).filter("a <> b")
    return g.select("source_id", "target_id", "kind", F.when(F.col("a"), "added").otherwise("removed").alias("change"))


def change_impact(changed: DataFrame, before: DataFrame) -> DataFrame:
    """changed: id. How many sources reached each changed target in the graph before, most first."""
    b = before.join(changed.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi")
    return b.groupBy(F.col("target_id").alias("id")).agg(F.count_distinct("source_id").alias("n_callers"))


def comparison(nodes: DataFrame, edges: DataFrame, before: Column, after: Column, limit: int = 40) -> DataFrame:
    """What has changed between two times, as one answer: part, kind, change, id, n, items.

    nodes: id, kind, valid_from, valid_to; edges: source_id, target_id, kind, valid_from, valid_to.
    nodes: a row a kind and change (added, removed, modified) with the number of ids and the first `limit` of them.
    edges: a row a kind and change with the number. impact: the `limit` removed or modified nodes with most callers (edges CALLS at the earlier time), the number of
    callers and the first ten. summary: a row a total. Ids are in order of their names, and limits cut nothing that is counted.
    """
    limit = clamp(limit, 1, 200)
    earlier, later = F.least(before, after), F.greatest(before, after)
    texts = F.array().cast("array<string>")
    shape = lambda df, part, kind, change, node, n, items: df.select(
        F.lit(part).alias("part"), kind.alias("kind"), change.alias("change"), node.alias("id"), n.cast("long").alias("n"), items.alias("items")
    )
    no, c = F.lit(None).cast("string"), F.col
    changed = cut(temporal.diff(nodes, earlier, later))
    place = F.row_number().over(W.partitionBy("kind", "change").orderBy("id"))
    first = changed.withColumn("place", place).filter(c("place") <= limit).groupBy("kind", "change").agg(F.array_sort(F.collect_list("id")).alias("items"))  # at most limit each
    counts = changed.groupBy("kind", "change").agg(F.count("*").alias("n"))
    listed = shape(counts.join(first, ["kind", "change"]), "nodes", c("kind"), c("change"), no, c("n"), c("items"))
    moved = cut(edge_delta(edges, earlier, later).groupBy("kind", "change").agg(F.count("*").alias("n")))
    hit = changed.filter("change IN ('removed', 'modified')").select(c("id").alias("target_id"), "change")
    callers = temporal.as_of(edges, earlier).filter("kind = 'CALLS'").select("source_id", "target_id").distinct().join(hit, "target_id")
    reach = callers.groupBy("target_id", "change").agg(F.count("*").alias("n"))
    top = reach.orderBy(F.desc("n"), "target_id").limit(limit)
    ten = callers.join(F.broadcast(top.select("target_id")), "target_id").withColumn("place", F.row_number().over(W.partitionBy("target_id").orderBy("source_id"))).filter("place <= 10")
    named = ten.groupBy("target_id").agg(F.array_sort(F.collect_list("source_id")).alias("items"))
    impact = cut(shape(top.join(named, "target_id"), "impact", no, c("change"), c("target_id"), c("n"), c("items")))
    totals = changed.agg(*[F.count_if(c("change") == x).alias(f"nodes_{x}") for x in ("added", "removed", "modified")])
    totals = totals.crossJoin(moved.agg(*[F.coalesce(F.sum(F.when(c("change") == x, c("n"))), F.lit(0)).alias(f"edges_{x}") for x in ("added", "removed")]))
    totals = totals.crossJoin(impact.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("impacted_callers")))  # three single rows
    sums = totals.select(F.inline(F.array(*[F.struct(F.lit(x).alias("change"), c(x).cast("long").alias("n")) for x in totals.columns])))
    out = listed.unionAll(shape(moved, "edges", c("kind"), c("change"), no, c("n"), texts)).unionAll(impact)
    return out.unionAll(shape(sums, "summary", no, c("change"), no, c("n"), texts))


def evidence_hash(evidence: DataFrame, key: str, item: str) -> DataFrame:
    """key, hash of the set of its evidence items (texts), whatever their order; a key's evidence is a short list."""
    joined = F.array_join(F.array_sort(F.collect_list(item)), ",")
    return evidence.groupBy(key).agg(F.sha2(F.concat(F.lit("evidence["), joined, F.lit("]")), 256).alias("evidence_hash"))


def packed(items: DataFrame, key: str, budget: int) -> DataFrame:
    """items: key, place, size (bytes). Greedy packs in order: brackets and commas count, an item over the budget is alone.

    A key's items are the evidence of one file, a bounded list. Items without a place come last; of items at one place the smaller comes first.
    An item of unknown size leaves its own pack (unless it is the first) and all later ones unknown.
    """
    placed = "array<struct<place: bigint, pack: bigint>>"
    start = F.struct(F.lit(0).alias("pack"), F.lit(1).alias("held"), F.array().cast(placed).alias("out")).cast(f"struct<pack: bigint, held: bigint, out: {placed}>")

    def add(acc, x):
        grown = acc["held"] + x["size"] + 1  # its comma; the first item has none, so an empty list holds 1
        full = (F.size(acc["out"]) > 0) & (grown > budget)
        pack = acc["pack"] + full.cast("long")
        placed = F.struct(x["place"].alias("place"), pack.alias("pack"))
        return F.struct(pack.alias("pack"), F.when(full, x["size"] + 2).otherwise(grown).alias("held"), F.concat(acc["out"], F.array(placed)).alias("out"))

    item = F.struct(F.col("place").cast("long").alias("place"), F.col("size").cast("long").alias("size"))
    lists = items.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    nowhere = lambda x: x["place"].isNull()
    last = F.concat(F.filter("items", lambda x: ~nowhere(x)), F.filter("items", nowhere))
    ordered = F.when(nowhere(F.get("items", 0)), last).otherwise(F.col("items"))  # nulls come first in sorted arrays
    return lists.select(key, F.inline(F.aggregate(ordered, start, add)["out"]))


def swept(runs: DataFrame, now: Column, hours: int) -> DataFrame:
    """Runs that are still running after the hours fail; of a project's queued ones the newest stays, the others coalesce."""
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL {hours} HOUR"))
    newest = runs.filter("status = 'queued'").groupBy("project_id").agg(F.max(F.struct("started_at", "run_id"))["run_id"].alias("newest"))
    j = runs.join(newest, "project_id", "left")
    status = F.when(stale, "failed").when((F.col("status") == "queued") & (F.col("run_id") != F.col("newest")), "coalesced").otherwise(F.col("status"))
    return j.select("run_id", "project_id", status.alias("status"))


def retired(summaries: DataFrame, run_id, retained: DataFrame, marker: str) -> DataFrame:
    """Summaries that nothing supersedes and that are neither of this run nor retained (summary_id) get the closure marker."""
    j = summaries.join(retained.select("summary_id").distinct().withColumn("kept", F.lit(True)), "summary_id", "left")
    close = F.col("superseded_by").isNull() & ~F.coalesce(F.col("run_id") == F.lit(run_id), F.lit(False)) & F.col("kept").isNull()
    return j.select("summary_id", "run_id", F.when(close, marker).otherwise(F.col("superseded_by")).alias("superseded_by"))


def run_coverage(files: DataFrame) -> DataFrame:
    """files: run_id, producer, authoritative. Per run: producers without authority (gaps), and whether it is partial."""
    p = files.groupBy("run_id", "producer").agg(F.bool_or("authoritative").alias("sure"))
    gaps = F.array_sort(F.collect_list(F.when(~F.col("sure"), F.col("producer"))))
    return p.groupBy("run_id").agg(F.count("*").alias("n_producers"), F.array_join(gaps, ",").alias("gaps"), F.count_if(~F.col("sure")).alias("n")).select("run_id", "n_producers", "gaps", (F.col("n") > 0).alias("partial"))


def coverage_status(projects: DataFrame) -> DataFrame:
    """projects: project_id, symbols, gaps, skipped. insufficient without symbols, partial with gaps or skips, else complete."""
    status = F.when(F.col("symbols") == 0, "insufficient").when((F.col("gaps") > 0) | (F.col("skipped") > 0), "partial").otherwise("complete")
    return projects.select("project_id", status.alias("status"))


def catalog_tables(columns: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """columns: owner, table, column, type, ordinal. One row a table with its columns in order, without the excluded owners."""
    some = columns.filter(~F.upper("owner").isin(*[x.upper() for x in excluded])) if excluded else columns
    in_order = F.array_sort(F.collect_list(F.struct("ordinal", "column", "type")))
    return some.groupBy("owner", "table").agg(F.transform(in_order, lambda x: F.struct(x["column"].alias("name"), x["type"].alias("type"))).alias("columns"))


def table_sample(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows (1 to 100) in order, every value as text."""
    return df.orderBy(*order).limit(clamp(n, 1, 100)).select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def write_partitioned(df: DataFrame, folder: str, *keys: str) -> DataFrame:
    """Writes df as Parquet, a folder a key; few files a key whatever the input's partitions. Returns the table read again."""
    df.repartition(*[F.col(k) for k in keys], F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("error").partitionBy(*keys).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def omitted(m: Column) -> Column:
    """A map of texts without raw payloads and long texts, which say how long they were. See `nested.redacted` for JSON."""
    long = lambda v: F.concat(F.lit('{"omitted":"large_string","chars":'), F.length(v).cast("string"), F.lit("}"))
    return F.transform_values(m, lambda k, v: F.when(nested.is_raw(k), F.lit('{"omitted":"raw_payload"}')).otherwise(F.when(F.length(v) > nested.CHARS, long(v)).otherwise(v)))
