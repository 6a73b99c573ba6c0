"""Bounded breadth-first walks: a loop of at most ten joins, each level cut through the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut


def walk(edges: DataFrame, start: DataFrame, depth: int, backwards: bool = False, limit: int | None = None) -> DataFrame:
    """depth, source_id, target_id of the edges met from the ids in start (column id).

    An edge into a node met before is still returned, but the node is not left again. Edges are
    ordered by depth, source, target where a limit cuts them.
    """
    edges = cut(edges.select("source_id", "target_id"))
    here, there = ("target_id", "source_id") if backwards else ("source_id", "target_id")
    frontier = cut(start.select("id").distinct())
    met, out = frontier, None
    for level in range(1, depth + 1):
        step = cut(edges.join(frontier, F.col(here) == F.col("id"), "left_semi").withColumn("depth", F.lit(level)))
        out = step if out is None else out.unionAll(step)
        frontier = cut(step.select(F.col(there).alias("id")).distinct().join(met, "id", "left_anti"))
        if not frontier.limit(1).count():
            break
        met = met.unionAll(frontier)
    out = out.select("depth", "source_id", "target_id")
    return out.orderBy("depth", "source_id", "target_id").limit(limit) if limit else out


def callers(edges: DataFrame, start: DataFrame, depth: int = 3, limit: int | None = None) -> DataFrame:
    return walk(edges, start, depth, True, limit)


def callees(edges: DataFrame, start: DataFrame, depth: int = 3, limit: int | None = None) -> DataFrame:
    return walk(edges, start, depth, False, limit)


def impact(calls: DataFrame, data_edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """id, depth (least), what: the callers affected, and the data entities that they or the start touch.

    The start is not counted as met, so a cycle lists it among the affected.
    """
    met = walk(calls, start, depth, True)
    affected = met.groupBy(F.col("source_id").alias("id")).agg(F.min("depth").alias("depth"))
    every = affected.select("id").unionAll(start.select("id")).distinct()
    touched = data_edges.join(every, F.col("source_id") == F.col("id"), "left_semi").select(F.col("target_id").alias("id")).distinct()
    return affected.withColumn("what", F.lit("caller")).unionAll(touched.select("id", F.lit(0).alias("depth"), F.lit("data_entity").alias("what")))


def reached(edges: DataFrame, roots: DataFrame, depth: int = 3, backwards: bool = False) -> DataFrame:
    """root, id, depth (least): for each root (column id) by itself the nodes met within depth steps; the root where a cycle meets it again.

    All roots walk together: a level is one join by id, whatever their number.
    """
    here, there = ("target_id", "source_id") if backwards else ("source_id", "target_id")
    steps = cut(edges.select(F.col(here).alias("id"), F.col(there).alias("next")).distinct())
    frontier = cut(roots.select(F.col("id").alias("root"), "id").distinct())
    found = None
    for level in range(1, depth + 1):
        fresh = steps.join(frontier, "id").select("root", F.col("next").alias("id")).distinct()
        if found is not None:
            fresh = fresh.join(found, ["root", "id"], "left_anti")
        fresh = cut(fresh.withColumn("depth", F.lit(level)))
        found = fresh if found is None else found.unionAll(fresh)
        frontier = fresh.filter("id <> root").select("root", "id")
        if not frontier.limit(1).count():
            break
    return found


def impact_of_each(calls: DataFrame, data_edges: DataFrame, roots: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(root, id, depth) of the callers that a change of each root affects; (root, id) of the data entities that they or the root touch."""
    affected = reached(calls, roots, depth, True)
    every = affected.select("root", "id").unionAll(roots.select(F.col("id").alias("root"), "id")).distinct()
    touched = data_edges.select(F.col("source_id").alias("id"), "target_id").join(every, "id").select("root", F.col("target_id").alias("id")).distinct()
    return affected, touched


def runtime_path(seen: DataFrame, start: DataFrame, depth: int = 5, since=None) -> DataFrame:
    """id, depth, frequency: nodes reached over exercised edges; frequency is the least hit count over all edges of their discovery, the chain."""
    live = seen.filter("hit_count > 0")
    if since is not None:
        live = live.filter(F.col("last_seen_at") >= since)
    met = walk(live, start, depth).join(live.select("source_id", "target_id", "hit_count"), ["source_id", "target_id"])
    first = met.groupBy(F.col("target_id").alias("id")).agg(F.min(F.struct("depth", "source_id", "hit_count")).alias("f"))
    chain = cut(first.join(start, "id", "left_anti").select("id", F.col("f.depth").alias("depth"), F.col("f.hit_count").alias("hit_count")))
    least = chain.agg(F.coalesce(F.min("hit_count"), F.lit(0)).alias("frequency"))
    return chain.select("id", "depth").crossJoin(F.broadcast(least))  # one row


def link_by_name(symbols: DataFrame, mentions: DataFrame) -> DataFrame:
    """source_id, target_id of mentions (source_id, name) that name exactly one other symbol.

    Symbols are summed by name first, so a common name is one row whatever its number of mentions.
    """
    by = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))
    own = mentions.join(symbols.select(F.col("id").alias("source_id"), "name", F.lit(1).alias("own")), ["source_id", "name"], "left")
    one = own.join(by, "name").filter(F.col("n") - F.coalesce("own", F.lit(0)) == 1)
    target = F.when(F.col("least") == F.col("source_id"), F.col("most")).otherwise(F.col("least"))
    return one.select("source_id", target.alias("target_id")).distinct()
