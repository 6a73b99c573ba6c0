"""Reviews: opaque components, advice for findings, rules over the added lines of a diff, span scrubbing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import masking
from ..functions.paths import contract_id, scrub_statement

#: The weakness that a kind of finding stands for.
CWE = {"duplicate_endpoint": "CWE-1041", "dynamic_call_detected": "CWE-470", "dead_path_suspected": "CWE-561", "schema_mismatch": "CWE-1078", "opaque_component_failing": "CWE-1357"}
#: Requirements of public frameworks that a weakness touches.
REQUIREMENTS = [
    ("CWE-1041", "NIST 800-53", "CM-2 Baseline Configuration"),
    ("CWE-470", "OWASP Top 10", "A03:2021 Injection"),
    ("CWE-470", "PCI DSS v4.0", "6.2.4 Secure coding — injection flaws"),
    ("CWE-470", "NIST 800-53", "SI-10 Information Input Validation"),
    ("CWE-561", "NIST 800-53", "CM-7 Least Functionality"),
    ("CWE-1078", "OWASP Top 10", "A04:2021 Insecure Design"),
    ("CWE-1078", "NIST 800-53", "SA-11 Developer Testing and Evaluation"),
    ("CWE-89", "OWASP Top 10", "A03:2021 Injection"),
    ("CWE-89", "PCI DSS v4.0", "6.2.4 Secure coding — injection flaws"),
    ("CWE-89", "NIST 800-53", "SI-10 Information Input Validation"),
    ("CWE-200", "OWASP Top 10", "A01:2021 Broken Access Control"),
    ("CWE-200", "PCI DSS v4.0", "3.4 Protect stored cardholder data"),
    ("CWE-200", "NIST 800-53", "AC-3 Access Enforcement"),
    ("CWE-1357", "OWASP Top 10", "A06:2021 Vulnerable and Outdated Components"),
    ("CWE-1357", "PCI DSS v4.0", "6.3.2 Inventory of bespoke and custom software"),
    ("CWE-1357", "NIST 800-53", "SR-3 Supply Chain Controls and Processes"),
]
ADVICE = {
    "duplicate_endpoint": "Keep one owner of the contract and send the others' callers to it.",
    "unverified_claim": "Cover the edge by a test or a trace, so that it is more than a guess.",
    "dynamic_call_detected": "Name the target of the dynamic call, or call it directly.",
    "dead_path_suspected": "Make sure that nothing reaches the code in other ways, then remove it.",
    "schema_mismatch": "Bring the code's view and the database's schema together.",
    "opaque_component_failing": "Give the component a contract or an analyser, so that it can be seen into.",
}
OTHER_ADVICE = "Look at the details and plan a change."
#: Rules over added lines.
LINE_RULES = [
    ("error", "hardcoded_secret", r"(?i)(password|pwd|secret|api[_-]?key|bearer)\s*[:=]\s*['\"][^'\"]{4,}"),
    ("error", "hardcoded_mssql_conn", r"(?i)Server=.*;(User(\s*Id)?|UID)=.+;Password=.+"),
    ("error", "hardcoded_oracle_conn", r"(?i)oracle://[^/]+:[^@]+@"),
    ("error", "forbidden_sql", r"(?i)\b(drop\s+table|truncate\s+table|update\s+\w+\s+set\s+[^;]*;|delete\s+from\s+\w+\s*;)"),
    ("warning", "todo_added", r"(?i)\b(todo|fixme|xxx)\b"),
]
#: Statements and routes in a line.
STATEMENT = r"(?i)\b(?:select\s+(\*|[^\n]+?)\s+from|(insert\s+into|update|delete\s+from))\s+([A-Za-z_][\w.]*)"
ROUTE = r"(?i)(?:\[Http(Get|Post|Put|Delete|Patch)\(\"([^\"]+)\"\)\]|\bfetch\(\s*[\"']([^\"']+)[\"']|Map(Get|Post|Put|Delete|Patch)\(\"([^\"]+)\")"
SENSITIVE = r"(?i)(http\.request\.body|http\.response\.body|db\.statement|auth|password|token)"


def opaque_failures(calls: DataFrame, components: DataFrame, floor: float = 0.1) -> DataFrame:
    """calls: target_id, errors, calls (texts); components: id, opacity. Opaque targets whose error ratio reaches the floor."""
    hidden = components.filter(F.col("opacity").isin("opaque", "binary")).select(F.col("id").alias("target_id"))
    c = calls.join(hidden, "target_id", "left_semi").select("target_id", F.expr("try_cast(errors AS bigint)").alias("e"), F.expr("try_cast(calls AS bigint)").alias("c"))
    g = c.filter("e IS NOT NULL AND c <> 0").groupBy("target_id").agg(F.sum("e").alias("errors"), F.sum("c").alias("calls"))
    ratio = F.col("errors") / F.greatest("calls", F.lit(1))
    return g.filter(ratio >= floor).select("target_id", "errors", "calls", F.bround(ratio, 4).alias("error_ratio"))


def advised(findings: DataFrame) -> DataFrame:
    """findings with cwe, advice and the framework requirements, as text in order."""
    spark = findings.sparkSession
    kinds = spark.createDataFrame([(k, CWE.get(k), a) for k, a in ADVICE.items()], "kind string, cwe string, advice string")
    tags = spark.createDataFrame([(c, i, f"{f}: {r}") for i, (c, f, r) in enumerate(REQUIREMENTS)], "cwe string, i int, tag string")
    tags = tags.groupBy("cwe").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "tag"))), lambda x: x["tag"]), "; ").alias("tags"))
    known = kinds.join(tags, "cwe", "left")  # fixed tables of a few rows
    return findings.join(F.broadcast(known), "kind", "left").withColumn("advice", F.coalesce("advice", F.lit(OTHER_ADVICE))).withColumn("tags", F.coalesce("tags", F.lit("")))


def diff_lines(diffs: DataFrame, key: str, column: str) -> DataFrame:
    """key, line (from 1), file, sign, body of the added and removed lines of each diff; file is the last one named before.

    A diff is cut at the lines that name a file; each piece goes on alone, with the number of its first line.
    """
    pieces = F.split(F.concat(F.lit("\n"), F.col(column)), r"\n\+\+\+ ")
    breaks = F.transform(pieces, lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))))
    first = F.array(F.lit(0)).cast("array<int>")
    # where a piece begins: the line that names its file; what stands before any such line begins at 0
    starts = F.aggregate(F.sequence(F.lit(0), F.size(pieces) - 1), first, lambda acc, i: F.array_append(acc, F.element_at(acc, -1) + F.get(breaks, i) + 1))
    d = diffs.filter(F.col(column).isNotNull()).select(key, F.posexplode(F.arrays_zip(pieces.alias("text"), starts.alias("start"))).alias("p", "x")).filter("x.text IS NOT NULL")
    lines = F.split(F.col("x.text"), "\n")
    d = d.select(key, F.when(F.col("p") == 0, "?").otherwise(F.trim(lines[0])).alias("file"), F.col("x.start").alias("start"), F.posexplode(lines).alias("i", "raw")).filter("i > 0")
    sign = F.substring("raw", 1, 1)
    kept = sign.isin("+", "-") & ~F.col("raw").startswith("+++") & ~F.col("raw").startswith("---")
    return d.filter(kept).select(key, (F.col("start") + F.col("i")).alias("line"), "file", sign.alias("sign"), F.substring("raw", 2, 1 << 30).alias("body"))


_ANY_RULE = "|".join(f"(?:{p})" for _, _, p in LINE_RULES)


def review_lines(lines: DataFrame, key: str) -> DataFrame:
    """Findings of LINE_RULES over added lines: key, severity, rule, location. One pattern of all rules goes first."""
    rules = F.array(*[F.when(F.col("body").rlike(p), F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, p in LINE_RULES])
    some = lines.filter((F.col("sign") == "+") & F.col("body").rlike(_ANY_RULE))
    hit = some.select(key, F.concat_ws(":", "file", "line").alias("location"), F.explode(F.array_compact(rules)).alias("r"))
    return hit.select(key, "r.severity", "r.rule", "location")


def review_contracts(lines: DataFrame, key: str, contracts: DataFrame) -> DataFrame:
    """Routes in added lines that no contract (id) has, and in removed lines that one has."""
    pick = lambda i: F.regexp_extract_all("body", F.lit(ROUTE), F.lit(i))
    routes = F.arrays_zip(*[pick(i).alias(n) for i, n in ((1, "a"), (2, "ap"), (3, "f"), (4, "m"), (5, "mp"))])
    r = lines.filter(F.col("body").rlike(ROUTE)).select(key, "sign", F.concat_ws(":", "file", "line").alias("location"), F.explode(routes).alias("r"))
    method = F.when(F.col("r.f") != "", "GET").otherwise(F.concat("r.a", "r.m"))
    r = r.select(key, "sign", "location", contract_id(method, F.concat("r.ap", "r.f", "r.mp")).alias("contract_id"))
    j = r.join(contracts.select(F.col("id").alias("contract_id"), F.lit(True).alias("known")), "contract_id", "left")
    rule = F.when((F.col("sign") == "+") & F.col("known").isNull(), "new_http_contract").when((F.col("sign") == "-") & F.col("known"), "contract_exposer_removed")
    severity = F.when(F.col("sign") == "+", "warning").otherwise("critical")
    return j.select(key, "contract_id", "location", rule.alias("rule"), severity.alias("severity")).filter("rule IS NOT NULL")


def review_access(lines: DataFrame, key: str, entities: DataFrame) -> DataFrame:
    """The first statement of an added line: of a sensitive entity (name, is_sensitive), a write, or all columns."""
    part = lambda i: F.regexp_extract("body", STATEMENT, i)
    s = lines.filter((F.col("sign") == "+") & F.col("body").rlike(STATEMENT)).select(
        key, F.concat_ws(":", "file", "line").alias("location"), part(1).alias("columns"), F.lower(F.substring_index(F.regexp_replace(part(2), r"\s+", " "), " ", 1)).alias("verb"), F.lower(part(3)).alias("name")
    )
    hidden = entities.filter("is_sensitive").select(F.lower("name").alias("name"), F.lit(True).alias("hidden")).distinct()
    j = s.join(hidden, "name", "left")
    rule = F.when(F.col("hidden"), "sensitive_entity_access").when(F.col("verb") != "", F.concat(F.lit("write_against_"), F.col("verb"))).when(F.trim("columns") == "*", "select_star")
    severity = F.when(F.col("hidden") | (F.col("verb") == "delete"), "critical").when(F.col("verb") != "", "warning").otherwise("info")
    return j.select(key, "location", "name", rule.alias("rule"), severity.alias("severity")).filter("rule IS NOT NULL")


def scrub(key: Column, value: Column) -> Column:
    """A span's attribute: literals of statements become '?', other sensitive values [SCRUBBED], what is left is masked by its name and formats."""
    statement = F.lower(key).endswith("db.statement")
    hidden = F.when(value.isNotNull(), "[SCRUBBED]")
    return F.when(statement, scrub_statement(value)).when(key.rlike(SENSITIVE), hidden).otherwise(masking.masked_by(value, key))


def grounding(fallback: Column, flow: Column, flow_error: Column, n_claims: Column) -> Column:
    """The first that holds: fallback, hypothesis (a flow), invalid (a flow in error), grounded (claims), stale."""
    return F.when(fallback, "fallback").when(flow, "hypothesis").when(flow_error, "invalid").when(n_claims > 0, "grounded").otherwise("stale")
