import json
import os
import random

import pytest
from pyspark.sql import functions as F

from provgraph.operators import publication
from provgraph.sources import live_catalog, record_source
from provgraph.streaming.hits import run


def record(i, **more):
    return json.dumps({"record_type": "edge", "source_name": f"s{i}", "data": {"id": i, "é": "x" * (i % 50)}} | more, ensure_ascii=False).encode()


@pytest.fixture
def source(spark):
    spark.dataSource.register(record_source.RecordSource)
    return lambda folder, stream=False, **o: (spark.readStream if stream else spark.read).format("analyzer_records").options(**o).load(str(folder))


def test_lines_of_any_kind(source, tmp_path):
    lines = [record(1), b"", b"not json", b"[1]", b"\xff\xfe", record(2, source_version=3), b"{" + b" " * 5000 + b"}", record(3) + b"\r", b'{"data":null}']
    (tmp_path / "a.jsonl").write_bytes(b"\n".join(lines) + b"\n" + record(4)[:-5])  # the last line has no end yet
    (tmp_path / "_hidden").write_bytes(record(9) + b"\n")
    (tmp_path / "empty.jsonl").write_bytes(b"")
    rows = sorted(source(tmp_path, max_bytes=1000).collect(), key=lambda r: r["offset"])
    assert [r["reason"] for r in rows] == [None, "no JSON", "no object", "no UTF-8", None, "too long", None, None]
    assert [r["source_name"] for r in rows if not r["reason"]] == ["s1", "s2", "s3", None] and rows[4]["source_version"] is None
    whole = (tmp_path / "a.jsonl").read_bytes()
    assert all(whole[r["offset"] : r["offset"] + 1] in (b"{", b"n", b"[", b"\xff") for r in rows)
    assert json.loads(rows[0]["data"]) == {"id": 1, "é": "x"}


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 10**6])
def test_ranges_hold_each_line_once(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(record_source, "STEP", 53)
    rng = random.Random(size)
    lines = [bytes(rng.choice(b"ab{}") for _ in range(rng.choice([0, 1, 5, 80, 200]))) for _ in range(120)]
    (tmp_path / "f").write_bytes(b"".join(x + b"\n" for x in lines))
    reader = record_source._Reader({"path": str(tmp_path), "range_bytes": size})
    got = [x for r in reader.ranges({}, reader.ends({})) for x in record_source._lines(str(tmp_path), r, 100)]
    starts = [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]
    assert got == [(at, x if len(x) <= 100 else None) for at, x in zip(starts, lines)]


def test_stream_equals_batch_and_restarts_read_nothing_twice(spark, source, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    sink = lambda batch, number: seen.append((number, sorted((os.path.basename(r["file"]), r["offset"]) for r in batch.collect())))

    def go():
        run(source(folder, stream=True, range_bytes=100), sink, f"file://{tmp_path}/state", "append")
        return sorted(x for _, rows in seen for x in rows)

    def batch():
        return sorted((os.path.basename(r["file"]), r["offset"]) for r in source(folder).collect())

    (folder / "a").write_bytes(b"".join(record(i) + b"\n" for i in range(20)) + b'{"half')
    assert go() == batch()
    with open(folder / "a", "ab") as f:
        f.write(b'":1}\n' + record(21) + b"\n")
    (folder / "b").write_bytes(record(30) + b"\n")
    assert go() == batch() and len(batch()) == 23
    assert go() == batch()  # nothing has come, nothing comes again
    assert len({x for _, rows in seen for x in rows}) == sum(len(rows) for _, rows in seen) == 23


def test_live_catalog_over_several_reads(spark, tmp_path):
    url = "jdbc:derby:memory:catalog;create=true"
    jvm = spark._jvm
    jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    con = jvm.java.sql.DriverManager.getConnection(url)
    try:
        s = con.createStatement()
        for statement in ("CREATE SCHEMA shop", "CREATE TABLE shop.orders (id BIGINT, placed DATE, note VARCHAR(20), a INT, b INT, c INT, d INT, e INT, f INT, g INT)", "CREATE TABLE shop.parts (id INT, name VARCHAR(40))"):
            s.execute(statement)
        c = live_catalog.columns(spark, url, "derby", partitions=3, widest=9)
        assert c.rdd.getNumPartitions() == 3 and len([n for n in c.groupBy(F.spark_partition_id()).count().collect() if n["count"]]) == 3
        tables = {(r["owner"], r["table"]): [(x["name"], x["type"]) for x in r["columns"]] for r in publication.catalog_tables(c, live_catalog.SYSTEM_OWNERS["derby"]).collect()}
        assert set(tables) == {("SHOP", "ORDERS"), ("SHOP", "PARTS")}
        assert tables["SHOP", "PARTS"] == [("ID", "INTEGER"), ("NAME", "VARCHAR(40)")] and [n for n, _ in tables["SHOP", "ORDERS"]] == ["ID", "PLACED", "NOTE", *"ABCDEFG"]
    finally:
        con.close()
