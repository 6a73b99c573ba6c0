"""Counts, degrees, rankings and roll-ups over the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import cut


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def distinct_ids(df: DataFrame, kind: str = "kind", key: str = "id") -> DataFrame:
    return df.groupBy(kind).agg(F.count_distinct(key).alias("n"))


def endpoints(edges: DataFrame) -> DataFrame:
    """Both ends of every edge; a self-loop once."""
    return edges.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"))


def degree(edges: DataFrame) -> DataFrame:
    """Every end counts, a self-loop twice."""
    both = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return both.groupBy("id").agg(F.count("*").alias("degree"))


def blast_radius(edges: DataFrame) -> DataFrame:
    """Edges that touch a node; a self-loop once."""
    return endpoints(edges).groupBy("id").agg(F.count("*").alias("blast"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("in_degree"))


def top(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (column id)."""
    ids = nodes.select("id")
    one = edges.join(ids.withColumnRenamed("id", "_a"), F.col("source_id") == F.col("_a"), "left_semi")
    return one.join(ids.withColumnRenamed("id", "_b"), F.col("target_id") == F.col("_b"), "left_semi")


def first_per(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """The first n rows of each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def neighbours(edges: DataFrame, n: int = 10) -> DataFrame:
    """The first n edges of each node and direction, by kind, target, source."""
    side = lambda id, direction: F.struct(F.col(id).alias("id"), F.lit(direction).alias("direction"))
    both = edges.select(F.explode(F.array(side("source_id", "out"), side("target_id", "in"))).alias("e"), "kind", "target_id", "source_id")
    return first_per(both.select("e.id", "e.direction", "kind", "target_id", "source_id"), ["id", "direction"], n, "kind", "target_id", "source_id")


def priority(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Entry points, then the most called, then the rest by id: the first n."""
    d = nodes.join(in_degree(edges), "id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    tier = F.when(F.col("is_entry_point"), 0).when(F.col("in_degree") > 0, 1).otherwise(2)
    return d.withColumn("tier", tier).orderBy("tier", F.when(F.col("tier") == 1, -F.col("in_degree")).otherwise(0), "id").limit(n).select("id", "tier", "in_degree")


def duplicate_owners(edges: DataFrame) -> DataFrame:
    """Targets with more than one edge into them."""
    return edges.groupBy("target_id").agg(F.count("*").alias("n")).filter("n > 1")


def top_directory(path: Column) -> Column:
    return F.split(path, "/")[0]


def at_ranks(df: DataFrame, keys: list[str], column: str, rank) -> DataFrame:
    """keys, n and value: the value at a rank (a function of n, from 0) of each key.

    Rows are counted by value before anything is sorted; the counts are range-partitioned by key and value, and
    ranks follow from the sums of the partitions. So no group is gathered, and a hot key is many tasks.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("value")).agg(F.count("*").alias("c"))
    parts = cut(counts.repartitionByRange(*keys, "value").withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("part", *keys).agg(F.sum("c").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)))  # a row a partition
    totals = sums.groupBy(*keys).agg(F.sum("s").alias("n"))
    places = before.join(totals, keys).withColumn("lo", F.coalesce("before", F.lit(0))).withColumn("at", rank(F.col("n")))
    mine = places.filter((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("lo") + F.col("s")))  # one partition of each key holds the rank
    inside = parts.join(F.broadcast(mine.select("part", *keys, "n", "lo", "at")), ["part", *keys])  # a row a key
    run = inside.withColumn("until", F.col("lo") + F.sum("c").over(W.partitionBy(*keys).orderBy("value")))
    return run.filter(F.col("until") > F.col("at")).groupBy(*keys).agg(F.first("n").alias("n"), F.min("value").alias("value"))


def profile(df: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """rows, null ratio (4 places), distinct values; for numbers least, greatest, mean and the upper median."""
    c, x = F.col(column), F.expr(f"try_cast(`{column}` AS double)")
    rows = F.count("*")
    g = df.groupBy(key) if key else df.groupBy()
    out = g.agg(rows.alias("n_rows"), F.bround(F.sum(c.isNull().cast("int")) / rows, 4).alias("null_ratio"), F.count_distinct(c).alias("n_distinct"), F.min(x).alias("least"), F.max(x).alias("greatest"), F.avg(x).alias("mean"))
    if key is None:
        return out
    p50 = at_ranks(df.select(key, x.alias("x")), [key], "x", lambda n: F.floor(n / 2)).select(F.col(key).alias("_k"), F.col("value").alias("p50"))
    return out.join(p50, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values; ties by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def ranked_quantile(df: DataFrame, keys: list[str], column: str, q: float) -> DataFrame:
    """Per key: n, mean, greatest and the value at half-even-rounded rank q * (n - 1), without gathering a group."""
    r = df.filter(F.col(column).isNotNull())
    at = at_ranks(r, keys, column, lambda n: F.least(n - 1, F.bround(F.lit(q) * (n - 1)).cast("long"))).drop("n").withColumnRenamed("value", "quantile")
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.max(column).alias("greatest")).join(at, keys)


def accuracy(found: DataFrame, truth: DataFrame, *key: str) -> DataFrame:
    """Set-based precision, recall and F1."""
    j = found.select(*key).distinct().withColumn("f", F.lit(1)).join(truth.select(*key).distinct().withColumn("t", F.lit(1)), list(key), "full")
    s = j.agg(F.count_if((F.col("f") == 1) & (F.col("t") == 1)).alias("tp"), F.count("f").alias("found"), F.count("t").alias("truth"))
    p, r = F.try_divide("tp", "found"), F.try_divide("tp", "truth")
    return s.select("tp", "found", "truth", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))
