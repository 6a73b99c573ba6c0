import datetime
import json

import pytest

from provgraph.operators import receipts

T = datetime.datetime(2024, 5, 1, 12)
RUN = "run_id int, project_id string, status string, scope string, started_at timestamp, completed_at timestamp, base_generation long, sources array<string>, sealed_at timestamp, receipt string"
HEAD = "head_id int, head_project string, state string, head_generation long, head_published_at timestamp"


def stamp(hours):
    return (T + datetime.timedelta(hours=hours)).isoformat() + "Z"


def receipt(**change):
    r = {"contract_version": "v1", "generation": 4, "base_generation": 3, "published_at": stamp(2), "authoritative_sources": ["a", "b"], "coverage_sealed_at": stamp(1), "counts": {n: 0 for n in receipts.COUNTS}, "atomic": True}
    return {k: v for k, v in (r | change).items() if v != "gone"}


CASES = [
    ({}, {}, {}, None),
    ({"status": "running"}, {}, {}, "status"), ({"scope": "odd"}, {}, {}, "scope"), ({"started_at": None}, {}, {}, "started_at"), ({"receipt": None}, {}, {}, "receipt"), ({"receipt": "[1]"}, {}, {}, "receipt"),
    ({"receipt": "{"}, {}, {}, "receipt"), ({}, {"contract_version": "v2"}, {}, "contract_version"), ({}, {"atomic": "true"}, {}, "atomic"), ({}, {"atomic": False}, {}, "atomic_true"),
    ({"base_generation": -1}, {}, {}, "base_generation"), ({}, {"base_generation": 2}, {}, "base_mismatch"), ({}, {"generation": 5}, {}, "generation"), ({}, {"generation": "4"}, {}, "generation"),
    ({"sources": None}, {}, {}, "sources_missing"), ({"sources": ["a", " "]}, {}, {}, "sources_missing"), ({"sources": ["b", "a"]}, {}, {}, "sources_order"), ({}, {"authoritative_sources": ["a"]}, {}, "sources_mismatch"),
    ({"sealed_at": None}, {}, {}, "seal_missing"), ({}, {"coverage_sealed_at": "2024-05-01T13:00:00"}, {}, "seal_timestamp"), ({}, {"coverage_sealed_at": "2024-05-01T14:00:00+01:00"}, {}, "seal_timestamp"), ({}, {"coverage_sealed_at": stamp(1.5)}, {}, "seal_mismatch"),
    ({"started_at": T + datetime.timedelta(hours=1.2)}, {}, {}, "seal_before_start"), ({}, {"published_at": 7}, {}, "publication_timestamp"), ({}, {"published_at": stamp(0)}, {}, "publication_before_seal"),
    ({}, {"counts": 3}, {}, "counts"), ({}, {"counts": {"nodes_inserted": 1}}, {}, "counts_shape"), ({}, {"counts": {n: 0.5 for n in receipts.COUNTS}}, {}, "counts_whole"),
    ({}, {"counts": {n: -(n == "nodes_closed") for n in receipts.COUNTS}}, {}, "counts_negative"), ({}, {"more": 1}, {}, "shape"),
    ({"status": "published"}, {}, {}, "completed_early"), ({"completed_at": None}, {}, {}, "completed_missing"), ({"completed_at": T}, {}, {}, "completed_before_publication"),
    ({}, {}, {"state": "needs_rebuild"}, "head_state"), ({}, {}, {"head_project": "q"}, "head_project"), ({}, {}, {"head_generation": 3}, "head_generation"), ({}, {}, {"head_published_at": None}, "head_published_at"),
    ({}, {}, {"head_id": 999, "state": "needs_rebuild"}, None), ({"status": "published", "completed_at": None}, {}, {}, None), ({}, {"published_at": "2024-05-01T14:00:00.000000+00:00"}, {}, None),
]


@pytest.fixture(scope="module")
def found(spark):
    runs, heads = [], []
    for i, (run, change, head, _) in enumerate(CASES):
        r = {"run_id": i, "project_id": "p", "status": "completed", "scope": "full", "started_at": T, "completed_at": T + datetime.timedelta(hours=3), "base_generation": 3, "sources": ["a", "b"], "sealed_at": T + datetime.timedelta(hours=1), "receipt": json.dumps(receipt(**change))} | run
        h = {"head_id": i, "head_project": "p", "state": "ready", "head_generation": 4, "head_published_at": T + datetime.timedelta(hours=2)} | head
        runs.append(tuple(r.values()))
        heads.append(tuple(h.values()))
    got = receipts.faults(spark.createDataFrame(runs, RUN), spark.createDataFrame(heads, HEAD), "v1")
    return {r["run_id"]: r for r in got.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_first_fault(found, i):
    assert found[i]["fault"] == CASES[i][3], found[i]["faults"]
    assert len(found) == len(CASES)
