"""Queries give their SQL's rows on tables with nulls, zeros, fractions and ends of ranges, which the given tables do not hold."""

import datetime
import json

import pytest

from provgraph.operators import receipts
from provgraph.plans import answers, catalogue  # noqa: F401  they register their queries

LINES = """(1, 1, 10, 3, 0.0), (1, 2, 10, 3, 57.0), (1, 3, 10, 3, 1.0),
    (2, 1, 10, 3, 0.0), (2, 2, 10, 3, 0.0), (2, 3, 10, 3, 55.0), (2, 4, 10, 3, 0.0),
    (3, 1, 10, 3, 27.5), (3, 2, 10, 3, 28.5), (3, 3, 10, 3, 0.5), (3, 4, 10, 3, 1.5),
    (4, 1, 10, 3, 5.0), (4, 2, 10, 3, NULL), (4, 3, 10, 3, 50.0), (4, 4, 10, 3, 50.0),
    (5, 1, 10, 3, NULL), (5, 2, 10, 3, 50.0), (6, 1, NULL, 3, 30.0), (6, 2, 10, 3, 40.0), (6, 3, 10, 3, 1.0),
    (7, 1, 10, 3, 99.0), (7, 2, 10, 3, 1.0), (7, 3, 10, 3, 58.0), (7, 4, 10, 3, 59.0), (8, 1, -10, -3, 20.0), (8, 2, -20000, -3, 40.0)"""


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    import duckdb

    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE lineitem AS SELECT CAST(a AS BIGINT) AS l_orderkey, CAST(b AS INTEGER) AS l_linenumber, CAST(c AS BIGINT) AS l_partkey, CAST(d AS BIGINT) AS l_suppkey, CAST(e AS DOUBLE) AS l_quantity FROM (VALUES {LINES}) t(a, b, c, d, e)")
    con.execute(f"COPY lineitem TO '{folder}/lineitem.parquet'")
    return con, str(folder)


def test_evidence_packs(spark, odd):
    con, folder = odd
    df = catalogue.QUERIES["evidence_packs"](spark, folder)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLES['evidence_packs']})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


RUN = "run_id int, project_id string, status string, scope string, started_at timestamp, completed_at timestamp, base_generation long, sources array<string>, sealed_at timestamp, receipt string"
HEAD = "head_id int, head_project string, state string, head_generation long, head_published_at timestamp"


def test_receipts_are_parsed_once(spark):
    hour = lambda h: datetime.datetime(2024, 5, 1, h)
    good = {n: 0 for n in receipts.COUNTS}
    odd = {
        "{}": ["counts_shape"], "3": ["counts", "counts_shape", "counts_whole", "counts_negative"], "null": ["counts", "counts_shape", "counts_whole", "counts_negative"], json.dumps(good | {"edges_closed": 4.0}): ["counts_whole", "counts_negative"],
        json.dumps(good | {"edges_closed": "4"}): ["counts_whole", "counts_negative"], json.dumps(good | {"more": 1}): ["counts_shape"], json.dumps(good | {"edges_closed": -1}): ["counts_negative"], json.dumps(good): [],
    }
    rest = '"contract_version": "v1", "generation": 4, "base_generation": 3, "published_at": "2024-05-01T14:00:00Z", "authoritative_sources": ["a"], "coverage_sealed_at": "2024-05-01T13:00:00Z", "atomic": true'
    runs = [(i, "p", "completed", "full", hour(12), hour(15), 3, ["a"], hour(13), f'{{{rest}, "counts": {x}}}') for i, x in enumerate(odd)]
    df = receipts.faults(spark.createDataFrame(runs, RUN), spark.createDataFrame([(0, "p", "odd", 4, hour(14))], HEAD), "v1")
    want = list(odd.values())
    want[0] = [*want[0], "head_state"]
    assert {r["run_id"]: r["faults"] for r in df.collect()} == dict(enumerate(want))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1
