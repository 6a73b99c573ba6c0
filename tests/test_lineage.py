import pytest

from provgraph.functions import guard, lineage, masking


NAMES = {"password", "name", "n", "info", "props", "doc", "tags", "token", "secret", "$.ssn"}


@pytest.fixture
def cards(spark):
    df = spark.sql("SELECT 'hunter22222' AS password, 'Ann Smith' AS name, 7 AS n, named_struct('token', 'abcdef', 'size', 1) AS info, map('secret', 'm') AS props, '{\"ssn\":\"j\"}' AS doc, array('one', 'two') AS tags")
    df.createOrReplaceTempView("cards")
    yield df
    spark.catalog.dropTempView("cards")


@pytest.mark.parametrize(
    "statement, want",
    [
        ("SELECT password AS x FROM cards", [{"password"}]),
        ("SELECT substr(password, 1, 9) AS x, n + 1 AS y, 5 AS z FROM cards", [{"password"}, {"n"}, set()]),
        ("SELECT name AS x FROM cards UNION ALL SELECT password FROM cards", [{"name", "password"}]),
        ("WITH c AS (SELECT password AS p, n FROM cards), d AS (SELECT p AS q, n FROM c) SELECT q, n FROM d", [{"password"}, {"n"}]),
        ("SELECT (SELECT max(password) FROM cards) AS x", [{"password"}]),
        ("SELECT n, x FROM (SELECT n, collect_list(password) AS x FROM cards GROUP BY n)", [{"n"}, {"password"}]),
        ("SELECT first_value(password) OVER (ORDER BY n) AS x FROM cards", [{"password", "n"}]),
        ("SELECT a.n, b.password AS x FROM cards a JOIN cards b ON a.n = b.n", [{"n"}, {"password"}]),
        ("SELECT t FROM cards LATERAL VIEW explode(array(password, name)) e AS t", None),
        ("SELECT info.token AS x FROM cards", [{"info", "token"}]),
        ("SELECT props['secret'] AS x, get_json_object(doc, '$.ssn') AS y FROM cards", [{"props", "secret"}, {"doc", "$.ssn"}]),
        ("SELECT * FROM (SELECT password, name FROM cards) AS t(a, b)", [{"password"}, {"name"}]),
        ("SELECT x FROM cards PIVOT (max(password) AS p FOR n IN (7 AS x))", None),
        ("SELECT CASE WHEN n > 1 THEN password END AS x FROM cards INTERSECT SELECT name FROM cards", [{"n", "password", "name"}]),
    ],
)
def test_origins(spark, cards, statement, want):
    got = lineage.origins(spark.sql(statement))
    if want is None:
        assert "password" in got[0]
    else:
        assert [x & NAMES for x in got] == want


@pytest.mark.parametrize(
    "select", ["password AS x", "substr(password, 1, 9) AS x", "reverse(password) AS x", "info.token AS x", "props['secret'] AS x", "get_json_object(doc, '$.ssn') AS x", "(SELECT password FROM cards) AS x", "concat(n, password) AS x"]
)
def test_landing_masks_what_comes_from_a_secret(spark, cards, select):
    assert [r[0] for r in guard.land(spark, f"SELECT {select} FROM cards").rows.collect()] == ["***"]


def test_other_columns_and_repeated_names(spark, cards):
    rows = guard.land(spark, "SELECT n AS x, name AS x, upper(name) AS y, 'plain' AS z FROM cards").rows
    assert rows.columns == ["x", "x", "y", "z"] and [tuple(r) for r in rows.collect()] == [("7", "Ann***", "ANN***", "plain")]
    assert masking.mask_by_origin(spark.sql("SELECT name AS password FROM cards")).first()[0] == "***"
