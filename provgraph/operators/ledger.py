"""Usage and audit ledgers: conditional sums in one pass, retention and redaction as rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exposure(calls: DataFrame) -> DataFrame:
    """calls: status, reported, estimated, reserved (decimal). One row of sums by what is known."""
    known, guessed = F.col("reported").isNotNull(), F.col("reported").isNull() & F.col("estimated").isNotNull()
    zero = F.lit(0).cast("decimal(20,10)")
    return calls.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.when(known, F.col("reported"))), zero).alias("reported"), F.coalesce(F.sum(F.when(guessed, F.col("estimated"))), zero).alias("estimated"),
        F.coalesce(F.sum(F.when(F.col("status") == "open", F.col("reserved"))), zero).alias("reserved"), F.count_if(~known & ~guessed).alias("unknown"),
    )


def full_exposure(calls: DataFrame) -> DataFrame:
    """calls: status, priced, reported, estimated, reserved. What is known, what is only authorised, and what has no price."""
    zero = F.lit(0).cast("decimal(20,2)")
    known, guessed = F.col("reported").isNotNull(), F.col("reported").isNull() & F.col("estimated").isNotNull()
    ended, open_ = F.col("status") == "done", F.col("status") == "open"
    money = lambda when, c: F.coalesce(F.sum(F.when(when, F.col(c))), zero)
    return calls.agg(
        money(known, "reported").alias("reported_spend"), money(guessed, "estimated").alias("estimated_spend"),
        F.coalesce(F.sum(F.coalesce("reported", "estimated")), zero).alias("known_spend"), money(open_, "reserved").alias("authorized_reservation"),
        money(ended & ~known & ~guessed, "reserved").alias("unknown_exposure"), F.count_if(ended & ~known & ~guessed).alias("unknown_calls"),
        F.count_if(~F.col("priced")).alias("unpriced_calls"), F.count_if(open_).alias("open_calls"),
    )


def return_on_cost(findings: DataFrame, cost: DataFrame, since: Column | None = None) -> DataFrame:
    """findings: status, risk_score, resolved_at; cost: one row known_spend, unknown_calls. One row of what triage has brought."""
    f = F.col
    live = f("status").isin("open", "acknowledged")
    inside = ~live & (F.lit(True) if since is None else F.coalesce(f("resolved_at") >= since, F.lit(False)))
    done, wrong = inside & (f("status") == "resolved"), inside & (f("status") == "false_positive")
    x = findings.agg(
        F.coalesce(F.sum(F.when(done, f("risk_score"))), F.lit(0)).alias("risk_eliminated"), F.count_if(done).alias("findings_resolved"),
        F.count_if(wrong).alias("false_positives"), F.coalesce(F.sum(F.when(live, f("risk_score"))), F.lit(0)).alias("open_risk"),
    ).crossJoin(cost)  # fmt: skip  # two single rows
    sure = (f("known_spend") > 0) & (f("unknown_calls") == 0)
    return x.select(
        "risk_eliminated", "findings_resolved", "false_positives", "open_risk", F.bround(F.try_divide("findings_resolved", f("findings_resolved") + f("false_positives")), 3).alias("precision"),
        F.when(sure, F.bround(f("risk_eliminated") / f("known_spend").cast("double"), 1)).alias("risk_per_usd"),
    )


def cost_by(calls: DataFrame, *keys: str) -> DataFrame:
    """calls: tokens_in, tokens_out (null where unknown)."""
    return calls.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count_if(F.col("tokens_in").isNull() | F.col("tokens_out").isNull()).alias("n_unknown"))


def reservations(attempts: DataFrame, *keys: str) -> DataFrame:
    """attempts: status, reserved. Sums of open reservations; a sum with an attempt that has no price is not known."""
    open_ = F.col("status") == "open"
    unpriced = F.count_if(open_ & F.col("reserved").isNull())
    return attempts.groupBy(*keys).agg(F.when(unpriced == 0, F.sum(F.when(open_, F.col("reserved")))).alias("reserved"), unpriced.alias("n_unpriced"), F.count_if(open_).alias("n_open"))


def fallbacks(calls: DataFrame, at: str | None = None, now: Column | None = None, days: int | None = None) -> DataFrame:
    """reason, n, rate (3 places) of calls that fell back; within the last days (1 to 365), if given."""
    if days is not None:
        calls = calls.filter(F.col(at) >= now - F.expr(f"INTERVAL {max(1, min(365, days))} DAY"))
    total = calls.agg(F.count("*").alias("total"))
    by = calls.filter("fallback_reason IS NOT NULL").groupBy("fallback_reason").agg(F.count("*").alias("n"))
    return by.join(F.broadcast(total)).select("fallback_reason", "n", F.bround(F.col("n") / F.col("total"), 3).alias("rate"))


def sessions(audit: DataFrame, prefix: str) -> DataFrame:
    return audit.filter(F.col("action").startswith(prefix)).groupBy("actor").agg(F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), F.count("*").alias("n"))


def retained(df: DataFrame, at: str, now: Column, days: int, only: Column | None = None) -> DataFrame:
    """Rows within the days, and rows that the rule does not cover."""
    old = F.col(at) < now - F.expr(f"INTERVAL {days} DAY")
    return df.filter(~(old & (only if only is not None else F.lit(True))))


def evidence_certainty(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """certainty, n: how certain the facts (id, certainty) are that claims (claim_id, evidence array) rest on."""
    e = claims.select(F.explode("evidence").alias("id")).join(facts.select("id", "certainty"), "id")
    return e.groupBy("certainty").agg(F.count("*").alias("n"))


def redacted(audit: DataFrame, actor: str) -> DataFrame:
    mine = F.col("actor") == f"user:{actor}"
    return audit.withColumn("details", F.when(~mine, F.col("details"))).withColumn("actor", F.when(mine, f"redacted:{actor}").otherwise(F.col("actor")))


def grounded(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claim_id, ok: every evidence id of the claim (claim_id, evidence array) is a current fact; certainty is the weakest of them."""
    e = claims.select("claim_id", F.explode_outer("evidence").alias("id")).join(facts.select("id", "rank"), "id", "left")
    return e.groupBy("claim_id").agg(F.bool_and(F.col("rank").isNotNull()).alias("ok"), F.min("rank").alias("rank"))
