"""Every query with SQL gives the SQL's rows on the smallest tables."""

import datetime
import decimal
import os

import pytest

from provgraph.plans import answers, catalogue, contexts, indexes, landing, reports, streams  # noqa: F401  they register their queries

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    r = con.sql(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(r.columns)
    at = [list(r.columns).index(c) for c in columns]
    assert sorted(tuple(plain(x[c]) for c in columns) for x in df.collect()) == sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())
