"""Detectors, risk, and the life of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import duplicate_owners, endpoints

#: Weight of a severity in the risk score.
SEVERITY = {"info": 10, "warning": 40, "error": 75}
OTHER_SEVERITY = 40
#: The detectors, the statuses of findings that are not done, the priorities.
DETECTORS = ("duplicate_endpoint", "unverified_claim", "dynamic_call_detected", "dead_path_suspected", "schema_mismatch", "opaque_component_failing")
LIVE = ("open", "acknowledged")
PRIORITIES = ("P1", "P2", "P3", "P4")
STALE_DAYS = 30


def risk(severity: Column, blast: Column, exercised: Column) -> Column:
    """Weight, a third more if exercised, plus up to 20 for reach; half-even, 0 to 100."""
    weight = F.lit(float(OTHER_SEVERITY))
    for name, w in SEVERITY.items():
        weight = F.when(severity == name, float(w)).otherwise(weight)
    x = weight * F.when(exercised, 1.3).otherwise(1.0) + F.least(F.lit(20.0), 4 * F.sqrt(blast.cast("double")))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(x).cast("int")))


def priority(score: Column) -> Column:
    return F.when(score >= 75, "P1").when(score >= 50, "P2").when(score >= 25, "P3").otherwise("P4")


def identity(*parts: Column) -> Column:
    """SHA-256 of the length-prefixed parts."""
    return F.sha2(F.concat(*[F.concat(F.octet_length(F.coalesce(p, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts]), 256)


def detect_rows(df: DataFrame, kind: str, severity: str, subject: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), subject.alias("subject_id"))


def detect(calls: DataFrame, exposes: DataFrame, access: DataFrame, entities: DataFrame, now: Column, opaque: DataFrame | None = None) -> DataFrame:
    """kind, severity, subject_id of every finding. calls is a read view (effective_certainty, exercised); opaque: rows of review.opaque_failures."""
    old = F.col("valid_from") < now - F.expr(f"INTERVAL {STALE_DAYS} DAY")
    edge = F.concat_ws("->", "source_id", "target_id")
    row = detect_rows
    found = row(duplicate_owners(exposes), "duplicate_endpoint", "error", F.col("target_id"))
    # the three rules over calls share one scan
    rules = F.array(
        F.when(old & (F.col("effective_certainty") == "inferred"), F.struct(F.lit("unverified_claim").alias("kind"), F.lit("info").alias("severity"))),
        F.when((F.col("certainty") == "asserted") & F.col("via_runtime"), F.struct(F.lit("dynamic_call_detected").alias("kind"), F.lit("warning").alias("severity"))),
        F.when(old & ~F.col("exercised"), F.struct(F.lit("dead_path_suspected").alias("kind"), F.lit("info").alias("severity"))),
    )
    hits = calls.select(F.explode(F.array_compact(rules)).alias("r"), edge.alias("subject_id")).select("r.kind", "r.severity", "subject_id")
    lost = access.join(entities, F.col("target_id") == F.col("id"), "left_anti")
    found = found.unionAll(hits).unionAll(row(lost, "schema_mismatch", "warning", edge))
    return found if opaque is None else found.unionAll(row(opaque, "opaque_component_failing", "warning", F.col("target_id")))


def run_stats(found: DataFrame, stored: DataFrame) -> DataFrame:
    """name, n of a detector run: what each detector found (nothing, too), what is new, what reopens, and what resolves by itself.

    found: kind, identity_key; stored: identity_key, status, resolved_by, as they were before the run.
    """
    kinds = found.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    all_kinds = found.sparkSession.createDataFrame([(k,) for k in DETECTORS], "name string")
    j = stored.select("identity_key", "status", "resolved_by").join(found.select("identity_key").distinct().withColumn("_f", F.lit(True)), "identity_key", "full")
    here, known = F.coalesce("_f", F.lit(False)), F.col("status").isNotNull()
    life = j.agg(
        F.count_if(here & ~known).alias("new"), F.count_if(here & (F.col("status") == "resolved") & (F.col("resolved_by") == "system")).alias("reopened"),
        F.count_if(~here & F.col("status").isin(*LIVE)).alias("auto_resolved"),
    )
    rows = life.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in life.columns])))
    return all_kinds.join(kinds, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n")).unionAll(rows)


def scored(findings: DataFrame, edges: DataFrame, exercised: DataFrame) -> DataFrame:
    """Findings with blast, risk_score and priority. exercised: id of the nodes that an exercised edge begins or ends at.

    Subjects that are edges have no reach and are not exercised.
    """
    nodes = findings.filter(~F.col("subject_id").contains("->")).select("subject_id").distinct()  # subjects that are nodes can have reach
    reach = endpoints(edges).withColumnRenamed("id", "subject_id").join(nodes, "subject_id", "left_semi").groupBy("subject_id").agg(F.count("*").alias("blast"))
    f = findings.join(reach, "subject_id", "left").withColumn("blast", F.coalesce("blast", F.lit(0)))
    seen = exercised.select(F.col("id").alias("subject_id")).distinct().join(nodes, "subject_id", "left_semi").withColumn("_seen", F.lit(True))
    f = f.join(seen, "subject_id", "left").withColumn("risk_score", risk(F.col("severity"), F.col("blast"), F.coalesce("_seen", F.lit(False)))).drop("_seen")
    return f.withColumn("priority", priority(F.col("risk_score")))


def page(findings: DataFrame, n: int, by: str = "risk") -> DataFrame:
    """The first n findings (1 to 500): by risk, then the last seen; or the last seen first."""
    order = [F.desc("risk_score"), F.desc("last_seen_at")] if by == "risk" else [F.desc("last_seen_at")]
    return findings.orderBy(*order, "finding_id").limit(max(1, min(500, n)))


def reconciled(stored: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Stored findings after a run: new ones open, missing ones resolve, system-resolved ones reopen.

    stored: identity_key, status, resolved_by, first_seen_at, last_seen_at; found: identity_key.
    """
    j = stored.join(found.select("identity_key").distinct().withColumn("_f", F.lit(True)), "identity_key", "full")
    here, known = F.coalesce("_f", F.lit(False)), F.col("status").isNotNull()
    reopen = here & (F.col("status") == "resolved") & (F.col("resolved_by") == "system")
    gone = ~here & F.col("status").isin(*LIVE)
    status = F.when(~known, "open").when(reopen, "open").when(gone, "resolved").otherwise(F.col("status"))
    by = F.when(gone, "system").when(reopen, F.lit(None)).otherwise(F.col("resolved_by"))
    return j.select("identity_key", status.alias("status"), by.alias("resolved_by"), F.coalesce("first_seen_at", now).alias("first_seen_at"), F.when(here, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"))


def trend(findings: DataFrame, now: Column, days: int, bucket_days: int) -> DataFrame:
    """bucket, opened, resolved: half-open buckets from now - days, empty ones too."""
    days, bucket_days = max(7, min(365, days)), max(1, min(30, bucket_days))
    n = -(-days // bucket_days)
    start = now - F.expr(f"INTERVAL {days} DAY")
    place = lambda c: F.when((F.col(c) >= start) & (F.col(c) < now), F.floor((F.unix_timestamp(c) - F.unix_timestamp(start)) / (86400 * bucket_days)))
    marks = findings.select(F.explode(F.array(F.struct(place("first_seen_at").alias("bucket"), F.lit(1).alias("o"), F.lit(0).alias("r")), F.struct(place("resolved_at").alias("bucket"), F.lit(0).alias("o"), F.lit(1).alias("r")))).alias("m")).select("m.*")
    sums = marks.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("o").alias("opened"), F.sum("r").alias("resolved"))
    skeleton = findings.sparkSession.range(n).withColumnRenamed("id", "bucket")
    return skeleton.join(sums, "bucket", "left").select("bucket", F.coalesce("opened", F.lit(0)).alias("opened"), F.coalesce("resolved", F.lit(0)).alias("resolved"))


def summary(findings: DataFrame, now: Column) -> DataFrame:
    """One row: all, open (acknowledged ones too) and resolved counts, mean open risk, hours to resolve (1 place), seven-day flows, open ones of the first priority."""
    hours = (F.unix_timestamp("resolved_at") - F.unix_timestamp("first_seen_at")) / 3600
    week, alive = now - F.expr("INTERVAL 7 DAY"), F.col("status").isin(*LIVE)
    return findings.agg(
        F.count("*").alias("total"), F.count_if(alive).alias("n_open"), F.count_if(alive & (priority(F.col("risk_score")) == "P1")).alias("open_p1"), F.count_if(F.col("status") == "resolved").alias("n_resolved"),
        F.coalesce(F.bround(F.avg(F.when(alive, F.col("risk_score")))).cast("int"), F.lit(0)).alias("risk_index"),
        F.bround(F.avg(F.when(hours >= 0, hours)), 1).alias("mttr_hours"),
        F.count_if(F.col("first_seen_at") >= week).alias("new_7d"), F.count_if(F.col("resolved_at") >= week).alias("resolved_7d"),
    )


def breakdown(findings: DataFrame) -> DataFrame:
    """dimension, value, n: open findings by priority (all four), all findings by status and by kind. findings: status, kind, risk_score."""
    g = findings.groupBy("status", "kind", priority(F.col("risk_score")).alias("p")).agg(F.count("*").alias("n"))
    marks = F.array(
        F.when(F.col("status").isin(*LIVE), F.struct(F.lit("priority").alias("dimension"), F.col("p").alias("value"))), F.struct(F.lit("status").alias("dimension"), F.col("status").alias("value")),
        F.struct(F.lit("kind").alias("dimension"), F.col("kind").alias("value")),
    )
    sums = g.select("n", F.explode(F.array_compact(marks)).alias("m")).select("m.dimension", "m.value", "n")
    none = findings.sparkSession.createDataFrame([("priority", p, 0) for p in PRIORITIES], "dimension string, value string, n long")
    return sums.unionAll(none).groupBy("dimension", "value").agg(F.sum("n").alias("n"))
