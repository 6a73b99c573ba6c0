import datetime
import json

from pyspark.sql import functions as F

from provgraph.operators import context, pinning


def test_pushes_run_one_after_another(spark):
    """Against the pushes taken in one by one; a month apart, at once, twice for one job, and by hand."""
    t = [datetime.datetime(2024, 1, 30), datetime.datetime(2024, 1, 31), datetime.datetime(2024, 2, 1), datetime.datetime(2024, 5, 1)]
    rows = [
        (1, "p", "queued", True, "a", t[0]), (2, "p", "queued", True, "b", t[0]), (3, "p", "running", True, "c", t[1]), (4, "p", "queued", True, "a", t[2]),
        (5, "p", "queued", True, "d", t[2]), (6, "p", "queued", False, "e", t[2]), (7, "p", "queued", True, "f", t[3]), (8, "q", "queued", True, "a", t[0]),
    ]
    state = {r[0]: [r[2], None] for r in rows}
    jobs, queued = set(), []
    for moment in t:
        new = [r for r in rows if r[5] == moment and r[3] and r[1] == "p"]
        fresh = [r for r in new if r[4] not in jobs]
        for r in new:
            if r in fresh:
                jobs.add(r[4])
            else:
                state[r[0]] = ["cancelled", "duplicate_webhook_job"]
        for old in [x for x in queued if fresh]:
            state[old] = ["cancelled", f"superseded_by_newer_webhook:{fresh[0][0]}"]
            queued.remove(old)
        queued += [r[0] for r in fresh if r[2] == "queued"]
    runs = spark.createDataFrame(rows, "run_id long, project_id string, status string, pushed boolean, job_id string, created_at timestamp")
    assert {r["run_id"]: [r["status"], r["reason"]] for r in pinning.after_pushes(runs).collect()} == state
    assert pinning.after_pushes(runs.filter("false")).count() == 0


def test_a_read_across_a_publication_is_told(spark):
    t = "timestamp'2024-01-0{} 00:00:00'"
    runs = spark.sql(f"select * from values ('a', 1, {t.format(1)}, true), ('a', 2, {t.format(3)}, true), ('b', 3, {t.format(1)}, true), ('c', 4, {t.format(1)}, false), ('e', 5, {t.format(1)}, true) as x(project_id, run_id, published_at, ready)")
    overlays = spark.sql(f"select 'e' as project_id, {t.format(3)} as at")
    before, after = (pinning.stamps(runs, overlays, F.expr(t.format(n))) for n in (2, 4))
    projects = spark.createDataFrame([(x,) for x in "abcde"], "project_id string")
    got = {r["project_id"]: r["status"] for r in pinning.revalidated(before, after, projects).collect()}
    assert got == {"a": "changed", "b": "current", "c": "unavailable", "d": "unavailable", "e": "changed"}


def test_packs_keep_the_first_items_and_say_so(spark):
    symbols = spark.createDataFrame([("s", "main"), ("lone", None)], "id string, name string")
    calls = spark.createDataFrame([(f"c{i}", "s") for i in range(9)] + [("c0", "s")], "source_id string, target_id string")
    access = spark.createDataFrame([("s", "data:x", "READS")], "source_id string, target_id string, kind string")
    found = spark.createDataFrame([], "id string, severity string, kind string")
    got = {r["id"]: r for r in context.task_packs(symbols, calls, access, found, items=1).collect()}
    assert got["s"]["n_callers"] == context.LEAST_ITEMS and got["s"]["callers_full"] and not got["s"]["data_access_full"]
    assert '"data_access":["READS data:x"]' in got["s"]["artifact"] and not got["s"]["truncated"]
    assert got["lone"]["n_callers"] == 0 and not got["lone"]["callers_full"]


def test_packs_of_edges_and_findings(spark):
    symbols = spark.createDataFrame([("s", "main")], "id string, name string")
    edges = spark.createDataFrame([("s", "gone")], "source_id string, target_id string")
    found = spark.createDataFrame([("s->gone", "warning", "k"), ("s->gone", "info", "k")], "id string, severity string, kind string")
    (edge,) = context.edge_packs(edges, symbols, found).collect()
    assert (edge["source_name"], edge["target_name"], edge["n_findings"], edge["findings_full"]) == ("main", None, 2, False)
    got = {tuple(r) for r in context.finding_packs(found.unionByName(found.limit(1).selectExpr("'s' AS id", "severity", "kind")).withColumnRenamed("id", "subject_id"), symbols).collect()}
    assert ("s", "k", "warning", "node", "main", None) in got and ("s->gone", "k", "info", "edge", "main", None) in got


def test_packs_with_impact_contracts_and_summaries(spark):
    """Each target walks by itself; cycles end; the newest summary that none supersedes is taken."""
    targets = spark.createDataFrame([("a", "A"), ("d", "D"), ("lone", "L")], "id string, name string")
    calls = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("e", "d"), ("f", "e"), ("b", "a")], "source_id string, target_id string")
    access = spark.createDataFrame([("c", "data:x", "READS"), ("f", "data:y", "WRITES")], "source_id string, target_id string, kind string")
    exposes = spark.createDataFrame([("a", "http.GET./x")], "source_id string, target_id string")
    found = spark.createDataFrame([("a", "info", "k")], "id string, severity string, kind string")
    said = spark.createDataFrame(
        [("a", 1, "old", None, 1), ("a", 2, "new", None, 2), ("a", 3, "gone", "x", 3), ("q", 4, "other", None, 1)], "target_id string, summary_id long, text string, superseded_by string, generated_at int"
    )
    got = {r["id"]: json.loads(r["artifact"]) for r in context.symbol_packs(targets, calls, access, exposes, found, said).collect()}
    assert got["a"]["impact_callers"] == ["1 b", "2 c", "3 a", "3 d"] and got["a"]["impact_data"] == ["data:x"]
    assert got["a"]["contracts"] == ["http.GET./x"] and got["a"]["summary"] == "new" and got["a"]["findings"] == ["info k"]
    assert got["d"]["impact_callers"] == ["1 e", "2 f"] and got["d"]["impact_data"] == ["data:y"] and got["d"]["summary"] == ""
    assert got["lone"]["impact_callers"] == [] and got["lone"]["callers"] == []


def test_packs_of_contracts_and_entities(spark):
    exposes = spark.createDataFrame([("s", "http.GET./x")], "source_id string, target_id string")
    clients = spark.createDataFrame([("u", "http.GET./x"), ("u", "http.GET./x"), ("u", "http.GET./y")], "source_id string, contract_id string")
    found = spark.createDataFrame([("http.GET./x", "error", "k"), ("data:x", "info", "k")], "id string, severity string, kind string")
    said = spark.createDataFrame([("data:x", 1, "t", None, 1)], "target_id string, summary_id long, text string, superseded_by string, generated_at int")
    got = {r["id"]: json.loads(r["artifact"]) for r in context.contract_packs(exposes, clients, found, said).collect()}
    assert got == {
        "http.GET./x": {"id": "http.GET./x", "exposers": ["s"], "callers": ["u"], "findings": ["error k"], "summary": ""},
        "http.GET./y": {"id": "http.GET./y", "exposers": [], "callers": ["u"], "findings": [], "summary": ""},
    }
    entities = spark.createDataFrame([("data:x",), ("data:x",)], "id string")
    access = spark.createDataFrame([("p", "data:x", "READS")], "source_id string, target_id string, kind string")
    (pack,) = context.entity_packs(entities, access, found, said).collect()
    assert json.loads(pack["artifact"]) == {"id": "data:x", "accessors": ["READS p"], "findings": ["info k"], "summary": "t"}
