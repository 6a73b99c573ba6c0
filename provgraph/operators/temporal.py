"""Bitemporal filters, snapshot comparison, and publication of a staged snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import certainty_rank


def current(df: DataFrame) -> DataFrame:
    return df.filter(F.col("valid_to").isNull())


def live_at(t: Column) -> Column:
    """Half-open validity: from valid_from, before valid_to."""
    return (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))


def as_of(df: DataFrame, t: Column) -> DataFrame:
    return df.filter(live_at(t))


def diff(versions: DataFrame, before: Column, after: Column) -> DataFrame:
    """id, kind, change for ids added, removed or modified (another valid_from) between two times.

    One scan: both snapshots are conditional aggregates over the same grouping.
    """
    at = lambda t, c: F.max(F.when(live_at(t), F.col(c)))
    g = versions.filter(live_at(before) | live_at(after)).groupBy("id").agg(
        at(before, "valid_from").alias("b"), at(after, "valid_from").alias("a"),
        F.coalesce(F.max_by("kind", F.when(live_at(after), F.col("valid_from"))), F.max_by("kind", F.when(live_at(before), F.col("valid_from")))).alias("kind"),
    )
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return g.select("id", "kind", change.alias("change")).filter("change IS NOT NULL")


def staged(candidates: DataFrame) -> DataFrame:
    """Reduces candidates (id, payload, certainty, source_name, ordinal) to one row an id.

    Equal payloads unite their sources. Another payload from another source is a conflict. The same
    source's last payload wins, unless it would lower the certainty.
    """
    best = F.struct(certainty_rank(F.col("certainty")), "ordinal")
    g = candidates.groupBy("id").agg(
        F.max_by("payload", best).alias("payload"), F.max_by("certainty", best).alias("certainty"), F.array_sort(F.collect_set("source_name")).alias("owners"), F.count_distinct("payload").alias("payloads"),
    )
    return g.select("id", "payload", "certainty", "owners", ((F.col("payloads") > 1) & (F.size("owners") > 1)).alias("conflict"))


def promote(current_rows: DataFrame, stage: DataFrame, authoritative: list[str], at: Column) -> DataFrame:
    """Every row of the next snapshot with its action; one full outer join.

    current_rows: id, payload, certainty, owners, valid_from; stage: id, payload, certainty, owners.
    unchanged keeps valid_from (owners unite); replace closes the old row and opens a new one; a lower
    certainty is ignored; a payload that foreign owners hold is a conflict; what no stage row
    mentions is closed if all its owners are authoritative, else kept.
    """
    c = current_rows.select("id", *[F.col(x).alias(f"c_{x}") for x in ("payload", "certainty", "owners", "valid_from")])
    s = stage.select("id", *[F.col(x).alias(f"s_{x}") for x in ("payload", "certainty", "owners")])
    sealed = F.array(*[F.lit(x) for x in authoritative]) if authoritative else F.expr("cast(array() as array<string>)")
    same = F.col("c_payload").eqNullSafe(F.col("s_payload")) & F.col("c_certainty").eqNullSafe(F.col("s_certainty"))
    foreign = F.size(F.array_except("c_owners", "s_owners")) > 0
    action = (
        F.when(F.col("c_owners").isNull(), "insert")
        .when(F.col("s_owners").isNull(), F.when(F.size(F.array_except("c_owners", sealed)) == 0, "close").otherwise("keep"))
        .when(same, "unchanged")
        .when(certainty_rank(F.col("s_certainty")) < certainty_rank(F.col("c_certainty")), "downgrade_ignored")
        .when(foreign & ~F.col("c_payload").eqNullSafe(F.col("s_payload")), "conflict")
        .otherwise("replace")
    )
    return c.join(s, "id", "full").withColumn("action", action).withColumn("published_at", at)


def snapshot(decided: DataFrame) -> DataFrame:
    """The rows of the next snapshot, closed versions included."""
    take = lambda x, to: [F.col("id"), *[F.col(f"{x}_{c}").alias(c) for c in ("payload", "certainty")]]
    owners = F.array_sort(F.array_union(F.coalesce("c_owners", F.array()), F.coalesce("s_owners", F.array())))
    kept = decided.filter(F.col("action").isin("keep", "unchanged", "downgrade_ignored", "conflict"))
    kept = kept.select(*take("c", None), F.when(F.col("action") == "unchanged", owners).otherwise(F.col("c_owners")).alias("owners"), F.col("c_valid_from").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    closed = decided.filter(F.col("action").isin("close", "replace")).select(*take("c", None), F.col("c_owners").alias("owners"), F.col("c_valid_from").alias("valid_from"), F.col("published_at").alias("valid_to"))
    opened = decided.filter(F.col("action").isin("insert", "replace")).select(*take("s", None), F.col("s_owners").alias("owners"), F.col("published_at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    return kept.unionByName(closed).unionByName(opened)


def receipt(decided: DataFrame) -> DataFrame:
    return decided.groupBy("action").agg(F.count("*").alias("n"))


def duplicate_current(rows: DataFrame, *key: str) -> DataFrame:
    """Keys with more than one current row: none in a sound snapshot."""
    return current(rows).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def uncovered(current_rows: DataFrame, covered: list[str]) -> DataFrame:
    """Current rows with an owner that a full rebuild does not cover: must be empty."""
    return current_rows.filter(F.size(F.array_except("owners", F.array(*[F.lit(x) for x in covered]))) > 0)
