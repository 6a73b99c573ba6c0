"""Checks of a publication's receipt against the run that made it and the head that points at it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses and scopes of runs that have published, the fields of a receipt, its counts, the state of a head that may be read.
PUBLISHED = ("published", "completed", "partial")
SCOPES = ("full", "incremental")
FIELDS = ("contract_version", "generation", "base_generation", "published_at", "authoritative_sources", "coverage_sealed_at", "counts", "atomic")
COUNTS = (
    "nodes_inserted", "nodes_closed", "nodes_unchanged", "nodes_downgrade_ignored", "edges_inserted", "edges_closed", "edges_unchanged", "edges_downgrade_ignored", "stale_nodes_closed",
    "stale_edges_closed",
)
READY = "ready"

_UTC = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|\+00:00)$"


def _keys(m: str) -> Column:
    return F.sort_array(F.map_keys(m))


def _named(names) -> Column:
    return F.array(*[F.lit(n) for n in sorted(names)])


def _whole(v: Column) -> Column:
    """The number if it is a whole one as JSON has it, else null."""
    return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def _is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _failed(checks, *earlier: Column) -> Column:
    """The names of the checks that fail, in order and joined by commas, null if there is none."""
    found = F.concat_ws(",", *earlier, *[F.when(~F.coalesce(good, F.lit(False)), name) for name, good in checks])
    return F.when(found != "", found)


def faults(runs: DataFrame, heads: DataFrame, contract: str) -> DataFrame:
    """run_id, fault (the first check that fails, or null) and faults (all that fail, in order).

    runs: run_id, project_id, status, scope, started_at, completed_at, base_generation, sources (array), sealed_at, receipt (JSON text);
    heads: head_id (a run), head_project, state, head_generation, head_published_at; runs to which no head points are checked without one.
    contract: the version that receipts must name. A check that cannot be made for lack of a value fails.
    A receipt is parsed once: each step is a projection of its own, whose columns the next ones use more than once.
    """
    c = F.col
    text = lambda name: F.when(_is_text(c(name)), F.try_variant_get(c(name), "$", "string"))
    known = ["run_id", "project_id", "status", "scope", "started_at", "completed_at", "base_generation", "sources", "sealed_at"]
    parsed = runs.select(*known, F.try_variant_get(F.try_parse_json("receipt"), "$", "map<string,variant>").alias("receipt"))
    fields = parsed.select(
        *known, c("receipt").isNotNull().alias("has_receipt"), (_keys("receipt") == _named(FIELDS)).alias("shape"), *[F.try_element_at("receipt", F.lit(name)).alias(f"r_{name}") for name in FIELDS]
    )
    typed = fields.select(
        *known, "has_receipt", "shape", F.array_sort(F.array_distinct("sources")).alias("canonical"), text("r_contract_version").alias("version"), (F.schema_of_variant("r_atomic") == "BOOLEAN").alias("is_flag"),
        F.try_variant_get("r_atomic", "$", "boolean").alias("atomic"), _whole(c("r_generation")).alias("generation"), _whole(c("r_base_generation")).alias("base"), text("r_coverage_sealed_at").alias("sealed_text"),
        text("r_published_at").alias("published_text"), F.try_variant_get("r_authoritative_sources", "$", "array<string>").alias("named"), F.try_variant_get("r_counts", "$", "map<string,variant>").alias("counts"),
    )
    moment = lambda name: F.when(c(name).rlike(_UTC), c(name).try_cast("timestamp"))
    r = typed.select(
        *known, "has_receipt", "shape", "canonical", "version", "is_flag", "atomic", "generation", "base", "named", moment("sealed_text").alias("sealed"), moment("published_text").alias("published"),
        (_keys("counts") == _named(COUNTS)).alias("counts_shape"), F.transform(F.map_values("counts"), _whole).alias("numbers"),
    )
    sealed, published, done = c("sealed"), c("published"), c("status") != "published"
    checks = [
        ("status", c("status").isin(*PUBLISHED)), ("scope", c("scope").isin(*SCOPES)), ("started_at", c("started_at").isNotNull()),
        ("receipt", c("has_receipt")), ("contract_version", c("version") == contract),
        ("atomic", c("is_flag")), ("atomic_true", c("atomic")),
        ("base_generation", c("base_generation") >= 0), ("base_mismatch", c("base") == c("base_generation")), ("generation", c("generation") == c("base_generation") + 1),
        ("sources_missing", F.forall("sources", lambda s: s.isNotNull() & (F.trim(s) != ""))), ("sources_order", c("sources") == c("canonical")), ("sources_mismatch", c("named") == c("canonical")),
        ("seal_missing", c("sealed_at").isNotNull()), ("seal_timestamp", sealed.isNotNull()), ("seal_mismatch", sealed == c("sealed_at")), ("seal_before_start", c("started_at") <= sealed),
        ("publication_timestamp", published.isNotNull()), ("publication_before_seal", sealed <= published),
        ("counts", c("numbers").isNotNull()), ("counts_shape", c("counts_shape")), ("counts_whole", F.forall("numbers", lambda n: n.isNotNull())), ("counts_negative", F.forall("numbers", lambda n: n >= 0)),
        ("shape", c("shape")),
        ("completed_early", done | c("completed_at").isNull()), ("completed_missing", ~done | c("completed_at").isNotNull()), ("completed_before_publication", ~done | (c("completed_at") >= published)),
    ]
    judged = r.select("run_id", "project_id", "generation", "published", _failed(checks).alias("own"))
    pointed = c("head_id").isNotNull()
    checks = [
        ("head_state", ~pointed | (c("state") == READY)), ("head_project", ~pointed | (c("head_project") == c("project_id"))), ("head_generation", ~pointed | (c("head_generation") == c("generation"))),
        ("head_published_at", ~pointed | (c("head_published_at") == published)),
    ]
    j = judged.join(heads, judged["run_id"] == heads["head_id"], "left")  # what a join carries of a receipt is short
    found = j.select("run_id", _failed(checks, c("own")).alias("found"))
    return found.select("run_id", F.split_part("found", F.lit(","), F.lit(1)).alias("fault"), F.when(c("found").isNull(), F.array().cast("array<string>")).otherwise(F.split("found", ",")).alias("faults"))
