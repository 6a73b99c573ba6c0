"""What an agent is given for a task: a pack for each symbol, and an index of the project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import budget, traverse
from .aggregates import first_per
from .answers import busiest_entities, clamp, hot_symbols

LEAST_ITEMS, MOST_ITEMS = 5, 200


def _first(df: DataFrame, name: str, n: int) -> DataFrame:
    """df: id, item. Per id the first n distinct items in order, as an array of at most n."""
    some = first_per(df.select("id", "item").distinct(), ["id"], n, "item")
    return some.groupBy("id").agg(F.array_sort(F.collect_list("item")).alias(name))


def _packs(targets: DataFrame, names: list[str], parts: dict[str, DataFrame], items: int, ceiling: int, summaries: DataFrame | None = None) -> DataFrame:
    """parts: id, item. The targets' names, artifact, n_bytes, truncated and, per list, n_<list> and <list>_full.

    summaries: target_id, summary_id, text, superseded_by, generated_at; the newest that none supersedes is the pack's summary (of equal ones the greatest text).
    """
    pack = targets.select(*names)
    for name, df in parts.items():
        pack = pack.join(_first(df, name, items), "id", "left")
    texts: tuple[str, ...] = ()
    if summaries is not None:
        newest = summaries.filter("superseded_by IS NULL").groupBy(F.col("target_id").alias("id")).agg(F.max_by("text", F.struct("generated_at", "summary_id", "text")).alias("summary"))
        pack, texts = pack.join(newest, "id", "left"), ("summary",)
    full = {f"{name}_full": F.coalesce(F.size(name), F.lit(0)) >= items for name in parts}
    flags = pack.select("id", *[c.alias(name) for name, c in full.items()])
    return budget.within_bytes(pack, names, list(parts), texts, ceiling).join(flags, "id")


def task_packs(symbols: DataFrame, calls: DataFrame, access: DataFrame, found: DataFrame, items: int = 50, ceiling: int = budget.MOST) -> DataFrame:
    """id, name, artifact, n_bytes, truncated (by bytes) and, per list, n_<list> and <list>_full, whether it reached the number of items.

    The lists are callers, callees, data_access (kind and entity) and findings (severity and kind; found: id, severity, kind).
    """
    items = clamp(items, LEAST_ITEMS, MOST_ITEMS)
    parts = {
        "callers": calls.select(F.col("target_id").alias("id"), F.col("source_id").alias("item")),
        "callees": calls.select(F.col("source_id").alias("id"), F.col("target_id").alias("item")),
        "data_access": access.select(F.col("source_id").alias("id"), F.concat_ws(" ", "kind", "target_id").alias("item")),
        "findings": found.select("id", F.concat_ws(" ", "severity", "kind").alias("item")),
    }
    return _packs(symbols, ["id", "name"], parts, items, ceiling)


def symbol_packs(
    targets: DataFrame, calls: DataFrame, access: DataFrame, exposes: DataFrame, found: DataFrame, summaries: DataFrame, depth: int = 3, items: int = 50, ceiling: int = budget.MOST
) -> DataFrame:
    """Packs of the symbols asked for (id, name), with all that a change of them needs: as in task_packs, and contracts (which the symbol exposes),
    impact_callers (least depth and id), impact_data (entities that the symbol or those callers touch) and the summary.

    All of them walk together, each its own callers, so the work grows with the symbols asked for and what reaches them.
    """
    items = clamp(items, LEAST_ITEMS, MOST_ITEMS)
    asked = targets.select("id").distinct()
    affected, touched = traverse.impact_of_each(calls, access, asked, depth)
    parts = {
        "callers": calls.select(F.col("target_id").alias("id"), F.col("source_id").alias("item")),
        "callees": calls.select(F.col("source_id").alias("id"), F.col("target_id").alias("item")),
        "data_access": access.select(F.col("source_id").alias("id"), F.concat_ws(" ", "kind", "target_id").alias("item")),
        "contracts": exposes.select(F.col("source_id").alias("id"), F.col("target_id").alias("item")),
        "findings": found.select("id", F.concat_ws(" ", "severity", "kind").alias("item")),
    }
    parts = {name: df.join(asked, "id", "left_semi") for name, df in parts.items()}
    parts["impact_callers"] = affected.select(F.col("root").alias("id"), F.concat_ws(" ", F.col("depth").cast("string"), F.col("id")).alias("item"))
    parts["impact_data"] = touched.select(F.col("root").alias("id"), F.col("id").alias("item"))
    return _packs(targets, ["id", "name"], parts, items, ceiling, summaries.join(asked, F.col("target_id") == F.col("id"), "left_semi"))


def contract_packs(exposes: DataFrame, clients: DataFrame, found: DataFrame, summaries: DataFrame, items: int = 50, ceiling: int = budget.MOST) -> DataFrame:
    """Packs of all contracts that are exposed or called (clients: source_id, contract_id): exposers, callers, findings and the summary."""
    items = clamp(items, LEAST_ITEMS, MOST_ITEMS)
    by = exposes.select(F.col("target_id").alias("id"), F.col("source_id").alias("item"))
    called = clients.select(F.col("contract_id").alias("id"), F.col("source_id").alias("item"))
    parts = {"exposers": by, "callers": called, "findings": found.select("id", F.concat_ws(" ", "severity", "kind").alias("item"))}
    return _packs(by.select("id").unionAll(called.select("id")).distinct(), ["id"], parts, items, ceiling, summaries)


def entity_packs(entities: DataFrame, access: DataFrame, found: DataFrame, summaries: DataFrame, items: int = 50, ceiling: int = budget.MOST) -> DataFrame:
    """Packs of data entities (id): accessors (kind and symbol), findings and the summary."""
    items = clamp(items, LEAST_ITEMS, MOST_ITEMS)
    accessors = access.select(F.col("target_id").alias("id"), F.concat_ws(" ", "kind", "source_id").alias("item"))
    parts = {"accessors": accessors, "findings": found.select("id", F.concat_ws(" ", "severity", "kind").alias("item"))}
    return _packs(entities.select("id").distinct(), ["id"], parts, items, ceiling, summaries)


def project_index(symbols: DataFrame, edges: DataFrame, calls: DataFrame, n: int = 10) -> DataFrame:
    """section, item, n: nodes and edges by kind, certainty of calls, and the n hottest symbols and busiest data entities."""

    def rows(section: str, df: DataFrame, item: str, count: str) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.col(item).alias("item"), F.col(count).cast("long").alias("n"))

    access = edges.filter(F.col("kind").isin("READS", "WRITES"))
    entities = access.select(F.col("target_id").alias("id")).distinct()
    contracts = edges.filter("kind = 'EXPOSES'").select("target_id").distinct()
    out = symbols.agg(F.lit("Symbol").alias("item"), F.count("*").alias("n"))
    out = out.unionAll(entities.agg(F.lit("DataEntity"), F.count("*"))).unionAll(contracts.agg(F.lit("Contract"), F.count("*")))
    return (
        rows("nodes", out, "item", "n")
        .unionAll(rows("edges", edges.groupBy("kind").agg(F.count("*").alias("n")), "kind", "n"))
        .unionAll(rows("certainty", calls.groupBy("certainty").agg(F.count("*").alias("n")), "certainty", "n"))
        .unionAll(rows("hot_symbols", hot_symbols(symbols, calls, n), "id", "in_degree"))
        .unionAll(rows("data_entities", busiest_entities(entities, access, n), "id", "in_degree"))
    )


def edge_packs(edges: DataFrame, symbols: DataFrame, found: DataFrame, items: int = 50, ceiling: int = budget.MOST) -> DataFrame:
    """Packs whose target is an edge: id (source->target), the ends with their names (null where unknown), and findings (found: id, severity, kind)."""
    items = clamp(items, LEAST_ITEMS, MOST_ITEMS)
    pack = edges.select(F.concat_ws("->", "source_id", "target_id").alias("id"), "source_id", "target_id").distinct()
    for end in ("source", "target"):
        pack = pack.join(symbols.select(F.col("id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name")), f"{end}_id", "left")
    related = found.select("id", F.concat_ws(" ", "severity", "kind").alias("item"))
    pack = pack.join(_first(related, "findings", items), "id", "left")
    out = budget.within_bytes(pack, ["id", "source_id", "source_name", "target_id", "target_name"], ["findings"], ceiling=ceiling)
    return out.withColumn("findings_full", F.col("n_findings") >= items)


def finding_packs(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """Packs whose target is a finding: subject_id, kind, severity, subject (node or edge), and the names of the subject's ends; null where unknown."""
    ends = F.split("subject_id", "->")
    pack = found.select("subject_id", "kind", "severity", F.when(F.size(ends) > 1, "edge").otherwise("node").alias("subject"), ends[0].alias("source_id"), F.get(ends, F.lit(1)).alias("target_id"))
    for end in ("source", "target"):
        pack = pack.join(symbols.select(F.col("id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name")), f"{end}_id", "left")
    return pack.select("subject_id", "kind", "severity", "subject", "source_name", "target_name")
