import random

from pyspark.sql import functions as F

from provgraph.operators import findings, ledger, overlay, review, runtime, temporal, traverse


def test_walk_matches_model(spark):
    rng = random.Random(3)
    edges = list({(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(25)})
    df = spark.createDataFrame(edges, "source_id string, target_id string")
    got = {tuple(r) for r in traverse.callees(df, spark.createDataFrame([("n0",)], "id string"), 4).collect()}
    frontier, met, expected = {"n0"}, {"n0"}, set()
    for level in range(1, 5):
        step = {(level, s, t) for s, t in edges if s in frontier}
        expected |= step
        frontier = {t for _, _, t in step} - met
        met |= frontier
    assert got == expected


def test_impact_lists_the_start_of_a_cycle(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "a")], "source_id string, target_id string")
    data = spark.createDataFrame([("b", "data:x")], "source_id string, target_id string")
    got = {(r["id"], r["what"]) for r in traverse.impact(calls, data, spark.createDataFrame([("a",)], "id string"), 3).collect()}
    assert got == {("a", "caller"), ("b", "caller"), ("data:x", "data_entity")}


def _promoted(spark, current, stage, sealed):
    c = spark.createDataFrame(current, "id string, payload string, certainty string, owners array<string>, valid_from timestamp")
    s = spark.createDataFrame(stage, "id string, payload string, certainty string, owners array<string>")
    return temporal.promote(c, s, sealed, F.expr("TIMESTAMP '2024-02-01 00:00:00'"))


def test_promotion_actions(spark):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    current = [("same", "p", "asserted", ["a"], t), ("new", "p", "asserted", ["a"], t), ("gone", "p", "asserted", ["a"], t), ("foreign", "p", "asserted", ["b"], t), ("low", "p", "verified", ["a"], t), ("fight", "p", "asserted", ["b"], t)]
    stage = [("same", "p", "asserted", ["c"]), ("new", "q", "asserted", ["a"]), ("low", "q", "asserted", ["a"]), ("fight", "q", "asserted", ["a"]), ("add", "p", "asserted", ["a"])]
    decided = _promoted(spark, current, stage, ["a"])
    assert {r["id"]: r["action"] for r in decided.collect()} == {"same": "unchanged", "new": "replace", "gone": "close", "foreign": "keep", "low": "downgrade_ignored", "fight": "conflict", "add": "insert"}
    rows = temporal.snapshot(decided)
    assert temporal.duplicate_current(rows, "id").count() == 0
    same = rows.filter("id = 'same'").first()
    assert same["owners"] == ["a", "c"] and same["valid_from"] == t
    assert temporal.uncovered(temporal.current(rows), ["a", "c"]).count() == 2


def test_confirmation_lifts_only_inferred(spark):
    df = spark.createDataFrame([("inferred", "confirm"), ("inferred", "dispute"), ("verified", "confirm"), ("asserted", None)], "c string, a string")
    assert [r[0] for r in df.select(overlay.effective(F.col("c"), F.col("a"))).collect()] == ["asserted", "inferred", "verified", "asserted"]


def test_replay_adds_only_the_difference(spark):
    cursor = spark.createDataFrame([("e", "o", 5)], "edge string, observation_id string, applied long")
    got = {r["observation_id"]: (r["applied"], r["delta"]) for r in overlay.accumulate_hits(cursor, spark.createDataFrame([("e", "o", 5), ("e", "o", 8), ("e", "p", 2)], "edge string, observation_id string, seen long")).collect()}
    assert got == {"o": (8, 3), "p": (2, 2)}


def test_exercised_subjects_score_higher(spark):
    found = spark.createDataFrame([("k", "warning", "x"), ("k", "warning", "y"), ("k", "error", "a->b")], "kind string, severity string, subject_id string")
    edges = spark.createDataFrame([("x", "z"), ("y", "z")], "source_id string, target_id string")
    got = {r["subject_id"]: (r["risk_score"], r["priority"]) for r in findings.scored(found, edges, spark.createDataFrame([("x",), ("x",), ("a",)], "id string")).collect()}
    assert got == {"x": (56, "P2"), "y": (44, "P3"), "a->b": (75, "P1")}


def test_findings_resolve_and_reopen(spark):
    stored = spark.createDataFrame([("k1", "open", None), ("k2", "resolved", "system"), ("k3", "resolved", "alice")], "identity_key string, status string, resolved_by string")
    stored = stored.withColumn("first_seen_at", F.expr("TIMESTAMP '2024-01-01 00:00:00'")).withColumn("last_seen_at", F.col("first_seen_at"))
    found = spark.createDataFrame([("k2",), ("k3",), ("k4",)], "identity_key string")
    got = {r["identity_key"]: r["status"] for r in findings.reconciled(stored, found, F.expr("TIMESTAMP '2024-02-01 00:00:00'")).collect()}
    assert got == {"k1": "resolved", "k2": "open", "k3": "resolved", "k4": "open"}


def test_spans_and_observations(spark):
    trace = '{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"shop"}}]},"scopeSpans":[{"spans":[{"name":"x","kind":2,"attributes":[{"key":"http.route","value":{"stringValue":"/a/{id}"}}]},{"name":"y","kind":3,"attributes":[]}]}]}]}'
    s = runtime.spans(spark.createDataFrame([(trace,), (trace,)], "trace string"))
    assert {tuple(r) for r in s.collect()} == {("shop", "/a/{id}", "EXPOSES"), ("shop", "y", "CALLS")}
    now = F.expr("TIMESTAMP '2024-01-01 00:00:00'")
    empty = spark.createDataFrame([], "service string, operation string, kind string, seen_count long, first_seen_at timestamp, last_seen_at timestamp")
    once = runtime.observed(empty, s, now)
    assert {r["seen_count"] for r in runtime.observed(once, s, now).collect()} == {2}


def test_grounding(spark):
    claims = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "zz"])], "claim_id int, evidence array<string>")
    facts = spark.createDataFrame([("a", 2), ("b", 1)], "id string, rank int")
    assert {r["claim_id"]: (r["ok"], r["rank"]) for r in ledger.grounded(claims, facts).collect()} == {1: (True, 1), 2: (False, 2)}


def test_lines_of_a_diff(spark):
    diff = "head\n-old\n+++ b/one.py \n+a\n context\n-b\n@@\n+++ b/two.py\n---x\n++ c\n+\n+++ b/empty\n+++ b/last\n+z"
    rows = [(1, diff), (2, None), (3, ""), (4, "+++ only"), (5, "+x"), (1, diff)]
    got = review.diff_lines(spark.createDataFrame(rows, "k int, d string"), "k", "d").collect()
    lines = [(2, "?", "-", "old"), (4, "b/one.py", "+", "a"), (6, "b/one.py", "-", "b"), (10, "b/two.py", "+", "+ c"), (11, "b/two.py", "+", ""), (14, "b/last", "+", "z")]
    assert sorted(tuple(r) for r in got) == sorted([(1, *x[:3], x[3]) for x in lines] * 2 + [(5, 1, "?", "+", "x")])
