"""Reads only: a statement is parsed by Spark's own parser, refused if it writes, and capped."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession

from .masking import mask_by_origin

CAP = 10_000
#: Plan nodes of a plain read; anything else in the tree is refused.
READS = frozenset(
    "Project UnresolvedRelation Filter Aggregate Sort GlobalLimit LocalLimit Limit Join SubqueryAlias UnresolvedWith CTERelationRef CTERelationDef WithCTE Union Distinct Except Intersect "
    "UnresolvedHaving UnresolvedInlineTable LocalRelation OneRowRelation WithWindowDefinition Generate UnresolvedSubqueryColumnAliases LateralJoin Pivot Unpivot Sample UnresolvedTableValuedFunction Offset".split()
)


#: Functions that run code or read what no table names.
UNSAFE = ("reflect", "java_method", "try_reflect", "read_files")
#: Marks of workload statistics, which need consent.
WORKLOAD = ("awr", "dba_hist_", "v$", "gv$")


@dataclass(frozen=True)
class Verdict:
    allowed: bool
    reason: str
    clamp: str
    limit: int
    tables: tuple[str, ...]


def _walk(plan, gateway):
    """The plan and every plan below it: children, common table expressions, subqueries."""
    yield plan
    for side in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for i in range(side.size()):
            child = side.apply(i)
            if is_instance_of(gateway, child, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"):
                yield from _walk(child, gateway)


def judge(spark: SparkSession, statement: str, cap: int = CAP, forbidden: tuple[str, ...] = ()) -> Verdict:
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception:
        return Verdict(False, "parse error", "none", cap, ())
    names, tables = [], []
    for node in _walk(plan, spark.sparkContext._gateway):
        name = node.getClass().getSimpleName()
        names.append(name)
        if name == "UnresolvedRelation":
            tables.append(node.tableName().lower())
    if bad := [n for n in names if n not in READS]:
        return Verdict(False, bad[0], "none", cap, tuple(tables))
    if files := [t for t in tables if re.match(r"(parquet|orc|json|csv|text|avro|binaryfile|delta)\.|.*[/:]", t)]:
        return Verdict(False, f"file {files[0]}", "none", cap, tuple(tables))
    tokens = set(re.findall(r"\w+", statement.lower()))
    if hit := [f for f in UNSAFE if f in tokens]:
        return Verdict(False, f"function {hit[0]}", "none", cap, tuple(tables))
    if hit := [f for f in forbidden if f.lower() in tokens]:
        return Verdict(False, f"sensitive table {hit[0]}", "none", cap, tuple(tables))
    if hit := [t for t in tables if t.rpartition(".")[2] in {f.lower() for f in forbidden}]:
        return Verdict(False, f"sensitive table {hit[0]}", "none", cap, tuple(tables))
    if plan.getClass().getSimpleName() in ("GlobalLimit", "Limit"):
        asked = plan.limitExpr().toString()
        if asked.isdigit() and int(asked) <= cap:
            return Verdict(True, "", "none", int(asked), tuple(tables))
        return Verdict(True, "", "clamped", cap, tuple(tables))
    return Verdict(True, "", "added", cap, tuple(tables))


def run(spark: SparkSession, statement: str, cap: int = CAP, forbidden: tuple[str, ...] = ()) -> tuple[DataFrame, Verdict]:
    """The capped result of a read; PermissionError for anything else."""
    v = judge(spark, statement, cap, forbidden)
    if not v.allowed:
        raise PermissionError(v.reason)
    return spark.sql(statement).limit(v.limit), v


def needs_consent(statement: str) -> bool:
    """Whether a statement reads workload statistics."""
    return any(t in statement.lower() for t in WORKLOAD)


def _field(token: str, value: int, low: int, high: int) -> bool:
    for part in token.split(","):
        m = re.fullmatch(r"\s*(\*|\d+(?:-\d+)?)?(?:/(\d+))?\s*", part)
        if not m or not part.strip() or m[2] and not int(m[2]) or not (m[1] or m[2]):
            continue
        a, b = (low, high) if m[1] in (None, "*") else (int(m[1].split("-")[0]), int(m[1].split("-")[-1]))
        if low <= a <= b <= high and a <= value <= b and (value - a) % int(m[2] or 1) == 0:
            return True
    return False


def in_window(windows: list[str], now: datetime) -> bool:
    """Whether a time lies in one of the windows of five fields (minute, hour, day, month, weekday from Sunday); without windows it does."""
    at = [(now.minute, 0, 59), (now.hour, 0, 23), (now.day, 1, 31), (now.month, 1, 12), (now.isoweekday() % 7, 0, 6)]
    fields = [w.split() for w in windows]
    return not windows or any(len(f) == 5 and all(_field(t, *x) for t, x in zip(f, at)) for f in fields)


@dataclass(frozen=True)
class Landing:
    rows: DataFrame | None
    verdict: Verdict
    truncated: bool
    log: dict


def land(spark: SparkSession, statement: str, *, enabled: bool = True, windows: list[str] = (), consent: bool = False, now: datetime | None = None, cap: int = CAP, forbidden: tuple[str, ...] = (), mask=mask_by_origin) -> Landing:
    """A guarded read: cap, guard, switch, policy, mask, then one row more than the cap tells whether it was cut.

    Columns are masked by where they come from, so another name or a function does not uncover them. mask: another way, or None.
    """
    v = judge(spark, statement, cap, forbidden)
    reason = v.reason or ("disabled" if not enabled else "consent" if needs_consent(statement) and not consent else "" if in_window(list(windows), now or datetime.now()) else "window")
    log = {"statement": statement, "allowed": not reason, "reason": reason, "limit": v.limit, "tables": list(v.tables)}
    if reason:
        return Landing(None, v, False, log)
    wide = spark.sql(statement).limit(v.limit + 1)
    truncated = wide.count() > v.limit
    rows = wide.limit(v.limit)
    return Landing(mask(rows) if mask else rows, v, truncated, log | {"truncated": truncated})
