"""Contract paths and other text forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(c: Column) -> Column:
    """Drops the query, leads with a slash, names :x and {x} alike, numbers become {id}, slashes are single, none trails."""
    p = F.split(F.coalesce(c, F.lit("")), r"\?")[0]
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    p = F.regexp_replace(p, r":([A-Za-z_][A-Za-z0-9_]*)", r"{$1}")
    p = F.regexp_replace(p, r"(?<=/)[0-9]+(?=/|$)", "{id}")
    p = F.regexp_replace(p, "/+", "/")
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


def contract_id(method: Column, path: Column) -> Column:
    return F.concat(F.lit("http."), F.upper(method), F.lit("."), normal_path(path))


def window_seconds(text: str) -> int | None:
    """Seconds of "24h", "7d" or "4w"; None for anything else."""
    m = re.fullmatch(r"\s*(\d+)([hdw])\s*", text or "")
    return int(m[1]) * {"h": 3600, "d": 86400, "w": 604800}[m[2]] if m else None


def relative_path(path: Column, root: str) -> Column:
    root = root.rstrip("/")
    return F.when(F.lower(path).startswith(root.lower() + "/"), F.right(path, F.length(path) - (len(root) + 1))).otherwise(path)


def scrub_statement(c: Column) -> Column:
    """Quoted literals become '?'."""
    return F.regexp_replace(c, "'[^']*'", "'?'")


def statement_tables(c: Column) -> Column:
    """(kind, table) of each statement: reads after FROM, writes after INTO or UPDATE."""
    pick = lambda pattern, kind: F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda t: F.struct(F.lit(kind).alias("kind"), F.lower(t).alias("table")))
    return F.concat(pick(r"(?i)\bselect\b[^;]*?\bfrom\s+([A-Za-z0-9_.]+)", "READS"), pick(r"(?i)\b(?:insert\s+into|update|delete\s+from|merge\s+into)\s+([A-Za-z0-9_.]+)", "WRITES"))
