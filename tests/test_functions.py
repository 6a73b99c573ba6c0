import datetime
import json
import random

from pyspark.sql import functions as F

from provgraph.functions import guard, masking, paths
from provgraph.operators import aggregates, answers, search, traverse
from provgraph.sources import records


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_paths(spark):
    for raw, expected in {"orders/12/?q=1": "/orders/{id}", "/a//:name/": "/a/{name}", "": "/", "/v1/7/x9": "/v1/{id}/x9"}.items():
        assert one(spark, raw, paths.normal_path) == expected
    assert paths.window_seconds("7d") == 604800 and paths.window_seconds("x") is None


def test_masking(spark):
    assert one(spark, "mail a.b@c.de now", masking.mask_values) == "mail [EMAIL] now"
    assert one(spark, "id 900101-1234568", masking.mask_values).startswith("id [")
    assert one(spark, "card 4111 1111 1111 1111!", lambda c: masking.labelled(c, masking.CARD, lambda m: F.when(masking.luhn(m), "[CARD]").otherwise("?"))) == "card [CARD]!"
    assert masking.column_rule("user_password") == "value" and masking.column_rule("password") == "full" and masking.column_rule("email") == "partial"
    df = spark.createDataFrame([("ab", "x"), ("abcdef", "y")], "name string, id string")
    rows, flags = masking.mask_rows(df)
    assert [r["name"] for r in rows.collect()] == ["***", "abc***"]
    assert flags.first().asDict() == {"name": True, "id": False}


def test_guard(spark):
    assert guard.judge(spark, "select * from t").clamp == "added"
    assert guard.judge(spark, "select * from t limit 5").limit == 5
    assert guard.judge(spark, "select * from t limit 50000").clamp == "clamped"
    for bad in ("delete from t", "insert into t select 1", "drop table t", "create table a as select 1", "select 1; drop table t", "with x as (update t set a = 1) select 1"):
        assert not guard.judge(spark, bad).allowed, bad
    assert not guard.judge(spark, "select * from (select * from pay.cards) x", forbidden=("cards",)).allowed


def test_search_terms_and_order(spark):
    assert search.query_terms("Where is the get_user API") == ["get_user", "get", "user", "api"]
    rows = [("a1", "overflowing", "src/a.py"), ("a2", "flow", "src/b.py"), ("a3", "runFlow", "tests/c.py"), ("a4", "flowRunner", "src/d.py")]
    df = spark.createDataFrame(rows, "id string, name string, path string").withColumn("signature", F.lit(""))
    assert [r["id"] for r in search.search(df, "flow").collect()] == ["a2", "a4", "a3", "a1"]


def test_records(spark, tmp_path):
    good = {"record_type": "symbol", "source_name": "py", "data": {"id": "s1", "name": "f", "location": {"file": "a\\b.py"}}}
    lines = [good, {**good, "record_type": "contract"}, {**good, "data": {"id": ""}}, {**good, "data": {"id": "x", "certainty": "sure"}}, {**good, "data": {"id": "y", "location": {"file": "/etc/x"}}}, {**good, "record_type": "data_entity", "data": {"id": "d", "name": "pg_class"}}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    got = records.validated(records.read(spark, str(tmp_path / "r.jsonl")), "symbols").collect()
    assert [r["reason"] for r in got] == [None, "record type", "id", "certainty", "path outside root", None, "malformed"]
    assert got[0]["file"] == "a/b.py" and got[0]["certainty"] == "asserted"
    assert not got[5]["stored"] and got[0]["stored"]


def test_guard_refuses_what_hides_a_table(spark):
    spark.range(3).createOrReplaceTempView("cards")
    for statement in ("select * from identifier('cards')", "select reflect('java.lang.System', 'getProperty', 'x')", "select * from parquet.`/x/part.parquet`", "select * from cards", "select 1 from (select * from CARDS) t", "select * from read_files('/x')"):
        assert not guard.judge(spark, statement, forbidden=("cards", "part")).allowed, statement
    assert guard.judge(spark, "select * from cards", forbidden=("card",)).allowed
    got = guard.land(spark, "select id from cards order by id", cap=2, mask=lambda df: df.select((F.col("id") + 1).alias("id")))
    assert [r["id"] for r in got.rows.collect()] == [1, 2] and got.truncated and got.log["limit"] == 2
    assert guard.land(spark, "select 1", enabled=False).log["reason"] == "disabled"
    assert guard.land(spark, "select 1 as awr_x").log["reason"] == "consent" and guard.land(spark, "select 1 as awr_x", consent=True).rows.count() == 1
    assert guard.land(spark, "drop table cards").rows is None


def test_windows():
    at = datetime.datetime(2024, 3, 3, 22, 30)  # a Sunday
    for window, inside in {"* * * * *": True, "30 22 * * 0": True, "*/15 20-23 * 3 *": True, "0-29 * * * *": False, "30 22 * * 7": False, "30": False, "x * * * *": False, "10,30 * 1-5 * *": True, "5/25 * * * *": False}.items():
        assert guard.in_window([window], at) == inside, window
    assert guard.in_window([], at) and guard.in_window(["bad", "* 22 * * *"], at)


def test_resident_numbers_need_a_date(spark):
    def number(head):
        digits = [int(x) for x in head]
        return head + str((11 - sum(a * b for a, b in zip(digits, masking.RRN_WEIGHTS)) % 11) % 10)

    assert one(spark, number("900101123456"), masking.rrn) and not one(spark, number("901301123456"), masking.rrn) and not one(spark, number("900132123456"), masking.rrn)


def test_search_tiers_scope_and_no_terms(spark):
    rows = [(f"s{i}", n, p, "") for i, (n, p) in enumerate([("largest", "src/a"), ("bluefish", "docs/b"), ("large", "tests/c"), ("blue", "src/d")])]
    df = spark.createDataFrame(rows, "id string, name string, path string, signature string")
    got = {r["name"]: r["tier"] for r in search.search(df, "blue large").collect()}
    assert got == {"largest": 1, "bluefish": 1, "large": 0, "blue": 0}
    assert {r["name"] for r in search.search(df, "blue large", scope="product").collect()} == {"largest", "bluefish", "blue"}
    assert [r["id"] for r in search.search(df, "the of", top_k=2).collect()] == ["s0", "s1"]
    hits = search.search(df, "blue")
    assert search.confident(hits, ["blue"]).first()[0] and not search.confident(hits.filter("false"), ["blue"]).first()[0]
    assert not search.confident(hits, []).first()[0]
    named = lambda name, score: spark.createDataFrame([("s", name, score, 0)], "id string, name string, score double, tier int")
    assert search.confident(named("authHandler", 3.0), ["authentication", "handler"]).first()[0]  # a stem and a part
    assert not search.confident(named("statusIndex", 3.0), ["search", "index"]).first()[0]
    assert search.confident(named("saveCache", 5.0), ["save_cache", "other"]).first()[0] and not search.confident(named("Connection", 5.0), ["connection", "lost"]).first()[0]


def test_records_schema_stays(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"record_type": "symbol"}\nno json\n')
    before = list(records.RECORD.names)
    assert sorted(r["record_type"] or "" for r in records.read(spark, str(tmp_path / "r.jsonl")).collect()) == ["", "symbol"] and records.RECORD.names == before


def test_quantiles_by_counts(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.8 else "k" + str(rng.randrange(3)), rng.randrange(50) / 2 if rng.random() < 0.9 else None) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r["quantile"] for r in aggregates.ranked_quantile(df, ["k"], "x", 0.95).collect()}
    for k in {k for k, _ in rows}:
        values = sorted(x for y, x in rows if y == k and x is not None)
        assert got[k] == values[min(len(values) - 1, round(0.95 * (len(values) - 1)))]


def test_links_by_name(spark):
    symbols = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z"), ("e", "z"), ("f", "z")], "id string, name string")
    mentions = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y"), ("d", "z"), ("q", "x"), ("q", "y")], "source_id string, name string")
    assert {tuple(r) for r in traverse.link_by_name(symbols, mentions).collect()} == {("a", "b"), ("b", "c"), ("q", "c")}


def test_masked_documents_equal_plain_patterns(spark):
    texts = ["mail a.b@c.de and 10.0.0.1.", "none", "x@y", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(masking.mask_formats(F.col("t"))).collect()] == ["mail [EMAIL] and [IP].", "none", "x@y", None]


def test_scan_equals_brute_force(spark):
    """Spans of checked numbers, also beside marks that the masks use and characters beyond 16 bits."""
    import re

    def plain(text):
        weights = masking.RRN_WEIGHTS
        out = []
        for m in re.finditer(masking.NUMERIC_ID, text):
            d = re.sub("[^0-9]", "", m[0])
            check = (11 - sum(int(a) * b for a, b in zip(d, weights)) % 11) % 10
            if 1 <= int(d[2:4]) <= 12 and 1 <= int(d[4:6]) <= 31 and check == int(d[12]):
                out.append(("RRN", *m.span()))
            elif d[6] in "5678" and (check + 2) % 10 == int(d[12]):
                out.append(("FOREIGNER_ID", *m.span()))
        for m in re.finditer(masking.CARD, text):
            d = [int(x) for x in reversed(re.sub("[^0-9]", "", m[0]))]
            if sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2]) in range(0, 1000, 10):
                out.append(("CARD", *m.span()))
        for m in re.finditer(masking.LICENCE, text):
            if 11 <= int(m[0][:2]) <= 28:
                out.append(("DRIVERS_LICENSE", *m.span()))
        return out

    rng = random.Random(5)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    dated = lambda: f"{rng.randrange(10, 99)}{rng.randrange(1, 13):02}{rng.randrange(1, 29):02}-{number(7)}"
    makers = [dated, lambda: number(13), lambda: number(16), lambda: "4111 1111 1111 1111", lambda: f"{number(2)}-{number(2)}-{number(6)}-{number(2)}", lambda: "\x01 word \U0001f600 \x02", lambda: "x" + number(16)]
    rows = [(i, " ".join(rng.choice(makers)() for _ in range(30))) for i in range(60)] + [(60, ""), (61, None), (62, "no digits")]
    got = {r["i"]: r["found"] for r in spark.createDataFrame(rows, "i int, t string").select("i", masking.scan(F.col("t")).alias("found")).collect()}
    assert got[61] is None and got[62] == [] and sum(len(got[i]) for i in range(60)) > 50
    assert {x["label"] for i in range(60) for x in got[i]} == {"RRN", "FOREIGNER_ID", "CARD", "DRIVERS_LICENSE"}
    for i, t in rows[:61]:
        assert [tuple(x) for x in got[i]] == plain(t), t


def test_budget(spark):
    """Lists go before texts, texts before the names; nothing is over the ceiling, and what fits stays whole."""
    from provgraph.operators import budget

    item = "y" * 60
    rows = [("whole", [item] * 3, "short"), ("lists", [item] * 900, "short"), ("texts", [item] * 900, "\u00e9" * 90_000), ("none", None, None), ("wide", ["z" * 9000], "short")]
    df = spark.createDataFrame(rows, "id string, items array<string>, note string")
    got = {r["id"]: r for r in budget.within_bytes(df, ["id"], ["items"], ("note",), budget.LEAST).collect()}
    assert all(r["n_bytes"] == len(r["artifact"].encode()) <= budget.LEAST for r in got.values())
    assert [got[k]["truncated"] for k in ("whole", "lists", "texts", "none", "wide")] == [False, True, True, False, True]
    assert json.loads(got["whole"]["artifact"]) == {"id": "whole", "items": [item] * 3, "note": "short"}
    lists, texts = json.loads(got["lists"]["artifact"]), json.loads(got["texts"]["artifact"])
    assert lists["note"] == "short" and len(lists["items"]) == got["lists"]["n_items"] > 30
    assert texts["items"] and 1000 < len(texts["note"]) < 90_000
    assert json.loads(got["none"]["artifact"]) == {"id": "none", "items": [], "note": ""} and json.loads(got["wide"]["artifact"]) == {"id": "wide"}


def test_value_search_hides_and_masks(spark):
    rows = [(i, f"call 555-123-{1000 + i} now", i % 4 == 0) for i in range(300)] + [(400, "no number", False), (401, None, False), (402, "x" * 100 + " 777", None), (403, "mail a.b@c.org 123", True)]
    df = spark.createDataFrame(rows, "id int, value string, hidden boolean")
    got = [tuple(r) for r in answers.matches(df, r"[0-9]{3}", "value", "id", F.col("hidden"), n_hits=5).collect()]
    assert got == [(402, "x" * 80)] + [(i, "call [PHONE] now") for i in (299, 298, 297, 295)]


def test_masks_need_a_mark(spark):
    """Texts without an @ or a digit of any script stay as they are; all others equal plain replacement."""
    texts = ["plain", "a@b.cc", "٠١٠-٢٣٤-٥٦٧٨", "10.0.0.1 and me@x.yz", "02-333-4444", None, "", "@", "1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.col("t")
    for label, pattern in masking.VALUES:
        plain = F.regexp_replace(plain, "(?U)" + pattern, f"[{label}]")
    assert [r[0] for r in df.select(masking.mask_formats(F.col("t"))).collect()] == [r[0] for r in df.select(plain).collect()]


def test_statements_paths_and_manifests(spark):
    got = one(spark, "select a from Shop.Orders where x; insert into log values ('it''s'); UPDATE t SET y", paths.statement_tables)
    assert [(r["kind"], r["table"]) for r in got] == [("READS", "shop.orders"), ("WRITES", "log"), ("WRITES", "t")]
    assert one(spark, "select 'a', 'b c'", paths.scrub_statement) == "select '?', '?'"
    assert [one(spark, p, lambda c: paths.relative_path(c, "/Root/")) for p in ("/root/a/b.py", "/rooted/x", "c.py")] == ["a/b.py", "/rooted/x", "c.py"]
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("gone", "1"), ("d", "1")], "producer string, fingerprint string")
    after = spark.createDataFrame([("a", "1", True), ("b", "2", True), ("new", "1", True), ("d", "1", False)], "producer string, fingerprint string, cacheable boolean")
    assert {r["producer"]: r["state"] for r in records.manifest_diff(before, after).collect()} == {"a": "unchanged", "b": "changed", "gone": "removed", "new": "changed", "d": "changed"}


def test_files_are_relative_to_the_root(spark):
    files = ["/Work/app/src/a.py", "C:\\\\work\\\\b.py", "src/c.py", "/work/application/d.py", "../e.py", "src/../../f.py", "src/..g.py"]
    rows = [("symbol", "s", '{"id":"x%d","location":{"file":"%s"}}' % (i, f)) for i, f in enumerate(files)]
    r = spark.createDataFrame(rows, "record_type string, source_name string, data string")
    got = {x["id"]: (x["file"], x["reason"]) for x in records.validated(r, "symbols", root="/work/app/").collect()}
    outside = "path outside root"
    assert got == {"x0": ("src/a.py", None), "x1": ("C:/work/b.py", outside), "x2": ("src/c.py", None), "x3": ("/work/application/d.py", outside), "x4": ("../e.py", outside), "x5": ("src/../../f.py", outside), "x6": ("src/..g.py", None)}
    assert records.validated(r, "symbols", root="c:/work").filter("id = 'x1'").first()["file"] == "b.py"
    assert records.validated(r, "symbols").filter("id = 'x0'").first()["reason"] == outside
