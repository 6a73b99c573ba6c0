"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins, all combinable before the shuffle; each round is
written to the shared folder, so a lost executor costs one round. No group is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _minimum(both: DataFrame) -> DataFrame:
    """u -> the least of u and its neighbours; written, so that the join on u can split a hub."""
    return common.written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "cc-min")


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """links: u, v. Returns written rows u, component (the least node reachable) for every linked node."""
    links = common.written(links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-links")
    before = None
    while True:
        both = _both(links)
        least = _minimum(both)
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.written(large, "cc-large")
        common.drop_written(least, links)
        least = _minimum(large)  # here v <= u always
        small = large.join(least, "u")
        small = small.select("v", "m").unionAll(least.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = common.written(small.filter(F.col("u") != F.col("v")).distinct(), "cc-links")
        common.drop_written(least, large)
        state = links.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
        if state == before:
            break
        before = state
    roots = links.select(F.col("v").alias("u")).distinct()
    return common.written(links.unionAll(roots.select("u", F.col("u").alias("v"))).select("u", F.col("v").alias("component")), "cc")
