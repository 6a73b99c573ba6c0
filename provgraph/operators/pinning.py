"""Reads pinned to a generation, and runs that pushes ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STAMP = ("run_id", "generation", "overlay_generation", "published_at")
#: Why a run that was asked for twice, or before a newer one, does not happen.
DUPLICATE, SUPERSEDED = "duplicate_webhook_job", "superseded_by_newer_webhook:"


def stamps(runs: DataFrame, overlays: DataFrame, at: Column) -> DataFrame:
    """The head of each project as it is at a time: project_id, ready, run_id, generation, overlay_generation, published_at.

    runs: project_id, run_id, published_at, ready; overlays: project_id, at. A project that has published nothing has no head.
    """
    seen = runs.filter(F.col("published_at") <= at)
    last = seen.groupBy("project_id").agg(F.max(F.struct("published_at", "run_id", "ready")).alias("r"), F.count("*").alias("generation"))
    over = overlays.filter(F.col("at") <= at).groupBy("project_id").agg(F.count("*").alias("n"))
    return last.join(over, "project_id", "left").select("project_id", "r.ready", "r.run_id", "generation", F.coalesce("n", F.lit(0)).alias("overlay_generation"), "r.published_at")


def revalidated(before: DataFrame, after: DataFrame, projects: DataFrame) -> DataFrame:
    """project_id, status of a read between two stamps, generation and now: unavailable without a ready head at either, changed, or current."""
    b = before.filter("ready").select("project_id", F.struct(*STAMP).alias("b"))
    a = after.filter("ready").select("project_id", F.struct(*STAMP).alias("a"))
    j = projects.select("project_id").join(b, "project_id", "left").join(a, "project_id", "left")
    status = F.when(F.col("b").isNull() | F.col("a").isNull(), "unavailable").when(F.col("a") != F.col("b"), "changed").otherwise("current")
    return j.select("project_id", status.alias("status"), F.col("b.generation").alias("generation"), F.col("a.generation").alias("now"))


def after_pushes(runs: DataFrame, bucket: str = "month") -> DataFrame:
    """run_id, status, reason of runs once every push is taken in.

    runs: run_id, project_id, status, pushed, job_id, created_at. Of a project's pushed runs with one job the first counts, the others
    are cancelled. A pushed run still queued gives way to the next one created later; runs created at once leave each other alone.
    The next run is sought within a bucket of time first, then among the buckets, so a busy project is not sorted in one task.
    """
    job = runs.filter("pushed").groupBy("project_id", "job_id").agg(F.min(F.struct("created_at", "run_id")).alias("first"))
    moments = job.groupBy("project_id", F.col("first.created_at").alias("created_at")).agg(F.min("first.run_id").alias("least")).withColumn("b", F.date_trunc(bucket, "created_at"))
    opening = moments.groupBy("project_id", "b").agg(F.min(F.struct("created_at", "least"))["least"].alias("opening"))
    opening = opening.select("project_id", "b", F.lead("opening").over(W.partitionBy("project_id").orderBy("b")).alias("after_bucket"))
    within = F.lead("least").over(W.partitionBy("project_id", "b").orderBy("created_at"))
    following = moments.withColumn("within", within).join(opening, ["project_id", "b"]).select("project_id", "created_at", F.coalesce("within", "after_bucket").alias("next_run"))
    j = runs.join(job.select("project_id", "job_id", F.col("first.run_id").alias("first_run")), ["project_id", "job_id"], "left").join(following, ["project_id", "created_at"], "left")
    again = F.col("pushed") & (F.col("first_run") != F.col("run_id"))
    passed = F.col("pushed") & (F.col("status") == "queued") & F.col("next_run").isNotNull()
    reason = F.when(again, DUPLICATE).when(passed, F.concat(F.lit(SUPERSEDED), F.col("next_run").cast("string")))
    return j.select("run_id", F.when(again | passed, "cancelled").otherwise(F.col("status")).alias("status"), reason.alias("reason"))
