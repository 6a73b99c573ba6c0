"""Answers to questions about the graph: pages with flags, cards with lists, rankings, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import masking
from .aggregates import first_per, in_degree
from .search import ROLES, role
from .traverse import walk

MOST_DEPTH, MOST_EDGES = 5, 1000


def clamp(n: int, least: int, most: int) -> int:
    return max(least, min(most, n))


def walk_page(edges: DataFrame, start: DataFrame, depth: int, limit: int, backwards: bool = False) -> DataFrame:
    """The first edges of a walk, with truncated (as many as the limit) and depth_reached (an empty last level counts)."""
    depth, limit = clamp(depth, 1, MOST_DEPTH), clamp(limit, 1, MOST_EDGES)
    page = walk(edges, start, depth, backwards, limit)
    facts = page.agg((F.count("*") >= limit).alias("truncated"), F.max("depth").alias("last"))
    reached = F.when(F.col("truncated"), F.col("last")).otherwise(F.least(F.lit(depth), F.coalesce("last", F.lit(0)) + 1))
    return page.crossJoin(F.broadcast(facts.select("truncated", reached.alias("depth_reached"))))  # one row


def listed(df: DataFrame, key: str, value: str, name: str, n: int = 10) -> DataFrame:
    """Per key the first n values in order, joined by commas, and how many there are (n_name)."""
    first = first_per(df.select(key, value).distinct(), [key], n, value)
    shown = first.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias(name))
    return shown.join(df.groupBy(key).agg(F.count_distinct(value).alias(f"n_{name}")), key)


def symbol_answer(symbols: DataFrame, calls: DataFrame, n: int = 10) -> DataFrame:
    """id, name, callers and callees (the first n of each) and their numbers."""
    into = listed(calls.select(F.col("target_id").alias("id"), "source_id"), "id", "source_id", "callers", n)
    out = listed(calls.select(F.col("source_id").alias("id"), "target_id"), "id", "target_id", "callees", n)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    s = symbols.select("id", "name").join(into, "id", "left").join(out, "id", "left")
    return s.select("id", "name", "callers", zero("n_callers"), "callees", zero("n_callees"))


def accessors(access: DataFrame, n: int = 10) -> DataFrame:
    """Per entity and kind: how many symbols reach it, and the first n."""
    key = access.select(F.concat_ws("|", "target_id", "kind").alias("key"), "source_id")
    out = listed(key, "key", "source_id", "symbols", n)
    parts = F.split("key", r"\|")
    return out.select(parts[0].alias("entity_id"), parts[1].alias("kind"), "symbols", "n_symbols")


def contract_slice(clients: DataFrame, exposes: DataFrame) -> DataFrame:
    """clients: source_id, contract_id. Each client's contract with its exposers; a contract that nobody exposes is marked."""
    by = exposes.groupBy(F.col("target_id").alias("contract_id")).agg(F.count_distinct("source_id").alias("n_exposers"), F.min("source_id").alias("first_exposer"))
    j = clients.distinct().join(by, "contract_id", "left")
    return j.select("source_id", "contract_id", F.coalesce("n_exposers", F.lit(0)).alias("n_exposers"), "first_exposer", F.col("n_exposers").isNull().alias("server_exposer_missing"))


def component_map(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Per component: its symbols, the edges within it and those that leave or enter it."""
    of = symbols.select("id", "component_id")
    e = edges.select("source_id", "target_id")
    for end in ("source", "target"):
        e = e.join(of.select(F.col("id").alias(f"{end}_id"), F.col("component_id").alias(end)), f"{end}_id", "left")
    inside = F.col("source").eqNullSafe(F.col("target"))
    ends = e.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("component_id"), inside.alias("inside")).filter("component_id IS NOT NULL")
    counts = ends.groupBy("component_id").agg(F.count_if("inside").alias("n_inside"), F.count_if(~F.col("inside")).alias("n_across"))
    sizes = symbols.groupBy("component_id").agg(F.count("*").alias("n_symbols"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sizes.join(counts, "component_id", "left").select("component_id", "n_symbols", zero("n_inside"), zero("n_across"))


def flow_seeds(symbols: DataFrame, terms: list[str], n: int = 20) -> DataFrame:
    """The symbols that match most of the terms of three letters or more, by name, id or signature."""
    terms = [t.lower() for t in terms if len(t) >= 3]
    hit = lambda t: F.lower("name").contains(t) | F.lower("id").contains(t) | F.lower("signature").contains(t)
    relevance = F.lit(0)
    for t in terms:
        relevance = relevance + F.coalesce(hit(t), F.lit(False)).cast("int")
    return symbols.withColumn("relevance", relevance).filter("relevance > 0").orderBy(F.desc("relevance"), "id").limit(n).select("id", "relevance")


def one_hop(edges: DataFrame, seeds: DataFrame, n: int = 200) -> DataFrame:
    """The first n edges that touch a seed, in either direction."""
    ids = F.broadcast(seeds.select("id"))  # at most as many as flow_seeds gives
    near = edges.join(ids.withColumnRenamed("id", "_s"), F.col("source_id") == F.col("_s"), "left_semi")
    into = edges.join(ids.withColumnRenamed("id", "_s"), F.col("target_id") == F.col("_s"), "left_semi")
    return near.unionAll(into).distinct().orderBy("kind", "source_id", "target_id").limit(n)


def root_prefix(paths: DataFrame, column: str) -> DataFrame:
    """One row: the directories that all absolute paths share, ignoring case; none if there are none."""
    ends = paths.filter(F.col(column).startswith("/")).agg(F.min(column).alias("a"), F.max(column).alias("b"))
    a, b = F.split("a", "/"), F.split("b", "/")
    same = F.transform(F.sequence(F.lit(0), F.least(F.size(a), F.size(b)) - 1), lambda i: F.lower(F.get(a, i)) == F.lower(F.get(b, i)))
    n = F.array_position(F.concat(same, F.array(F.lit(False))), F.lit(False)).cast("int") - 1
    n = F.when(n >= F.size(a), F.size(a) - 1).otherwise(n)
    return ends.select(F.nullif(F.array_join(F.slice(a, F.lit(1), n), "/"), F.lit("")).alias("prefix"))


def path_rank(path: Column) -> Column:
    """3 for vendored, test and generated files, 2 for support, 1 without a path, else 0."""
    r = role(path)
    return F.when(F.coalesce(path, F.lit("")) == "", 1).when(r.isin(*[x for x in ROLES if x != "support"]), 3).when(r == "support", 2).otherwise(0)


def hot_symbols(symbols: DataFrame, calls: DataFrame, n: int) -> DataFrame:
    """The most called symbols, ten times as many as asked for (20 to 1,000), then by path rank, calls and id."""
    d = symbols.join(in_degree(calls), "id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    wide = d.orderBy(F.desc("in_degree"), "id").limit(clamp(n * 10, 20, 1000)).withColumn("path_rank", path_rank(F.col("path")))
    return wide.orderBy("path_rank", F.desc("in_degree"), "id").limit(n).select("id", "path_rank", "in_degree")


def busiest_entities(entities: DataFrame, access: DataFrame, n: int) -> DataFrame:
    """The data entities that most edges reach, then the rest by id."""
    d = entities.join(in_degree(access), "id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    return d.orderBy(F.desc("in_degree"), "id").limit(n).select("id", "in_degree")


def overview(edges: DataFrame, n: int = 5) -> DataFrame:
    """Per kind of edge: how many, and the first n sources."""
    names = listed(edges, "kind", "source_id", "sources", n).drop("n_sources")
    return edges.groupBy("kind").agg(F.count("*").alias("n")).join(names, "kind")


def fan_in(calls: DataFrame, symbols: DataFrame, least: int = 20, most: int = 50) -> DataFrame:
    """Symbols that are called at least so often: the most called."""
    hot = in_degree(calls).filter(F.col("in_degree") >= least).join(symbols.select("id"), "id", "left_semi")
    return hot.orderBy(F.desc("in_degree"), "id").limit(most)


def keyset_page(df: DataFrame, after: tuple, keys: list[str], n: int) -> DataFrame:
    """The next n rows after a key."""
    later = F.struct(*keys) > F.struct(*[F.lit(x).cast(df.schema[k].dataType).alias(k) for k, x in zip(keys, after)])
    return df.filter(later).orderBy(*keys).limit(n)


def within_tenant(df: DataFrame, projects: DataFrame, organisation) -> DataFrame:
    """Rows of projects (project_id, organisation_id) of an organisation; no organisation sees nothing."""
    mine = projects.filter(F.coalesce(F.col("organisation_id") == F.lit(organisation), F.lit(False))).select("project_id")
    return df.join(mine, "project_id", "left_semi")


def at_generation(df: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows validated for the generation that is their project's head (heads: project_id, generation)."""
    return df.join(heads.select("project_id", F.col("generation").alias("validated_generation")), ["project_id", "validated_generation"], "left_semi")


def current_summaries(summaries: DataFrame) -> DataFrame:
    """Of the summaries that none supersedes, the newest of each target."""
    live = summaries.filter(F.col("superseded_by").isNull())
    newest = live.groupBy("target_id").agg(F.max_by("summary_id", F.struct("generated_at", "summary_id")).alias("summary_id"))
    return newest


def within_deadline(attempts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per attempt (attempt_id, started_at, deadline): the candidates (attempt_id, at) that came in time; also none."""
    j = attempts.join(candidates, "attempt_id", "left")
    in_time = (F.col("at") >= F.col("started_at")) & (F.col("at") <= F.col("deadline"))
    return j.groupBy("attempt_id").agg(F.count_if(F.coalesce(in_time, F.lit(False))).alias("n_in_time"))


def matches(samples: DataFrame, pattern: str, column: str, newest: str, sensitive: Column | None = None, n_samples: int = 200, n_hits: int = 50, shown: int = 80) -> DataFrame:
    """The newest hits of a pattern in the newest samples: the key and the beginning of the value, masked. Sensitive samples show nothing."""
    some = samples.orderBy(F.desc(newest)).limit(n_samples).filter(F.col(column).rlike(pattern))
    if sensitive is not None:
        some = some.filter(~F.coalesce(sensitive, F.lit(False)))
    return some.orderBy(F.desc(newest)).limit(n_hits).select(newest, F.substring(masking.mask_values(F.col(column)), 1, shown).alias("snippet"))
