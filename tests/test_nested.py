import hashlib
import json
import random

from pyspark.sql import functions as F

from provgraph.functions import nested


def show(v, key, depth, top_key=False):
    if (key.lower() if top_key else key) == "signature":
        if not isinstance(v, str) or not v:
            return None
        first = (v.strip().splitlines() or [""])[0].strip()
        return first if len(first) <= 240 else first[:240] + f"... [truncated chars={len(v)}]"
    if key.lower() in nested.RAW_KEYS or key.lower().endswith(nested.RAW_ENDINGS):
        return {"omitted": "raw_payload"}
    if depth >= 4:
        return {"omitted": "max_depth"}
    if isinstance(v, str) and len(v) > 512:
        return {"omitted": "large_string", "chars": len(v)}
    if isinstance(v, list):
        more = [{"__truncated_items__": len(v) - 50}] if len(v) > 50 else []
        return [show(x, key, depth + 1, top_key) for x in v[:50]] + more
    if isinstance(v, dict):
        names = sorted(v)
        out = {k: show(v[k], k, depth + 1) for k in names[:80]}
        return out | ({"__truncated_keys__": len(names) - 80} if len(names) > 80 else {})
    return v


def test_redaction_of_random_json(spark):
    rng = random.Random(9)
    names = ["a", "B", "name", "signature", "Signature", "payload", "REQUEST", "x_raw", "my_Blob", "code", "é\"q", "list", "deep"]

    def value(depth):
        kind = rng.randrange(9 if depth < 7 else 6)
        if kind < 6:
            return [None, True, rng.randrange(-(10**12), 10**12), rng.randrange(1000) / 8, "x\n é\\" + "y" * rng.choice([1, 300, 600]), "  one line \r\nnext"][kind]
        if kind == 6:
            return [value(depth + 1) for _ in range(rng.choice([0, 2, 3]))]
        return {rng.choice(names) + str(rng.choice(["", i])): value(depth + 1) for i in range(rng.randrange(6))}

    docs = [{k: value(0) for k in rng.sample(names, 6)} for _ in range(300)]
    docs += [{}, {"big": {f"k{i:03}": i for i in range(95)}, "many": list(range(60)), "signature": ["s" * 300, 5]}, {f"k{i:03}": i for i in range(95)}, {"Signature": "q" * 300}, {"in": {"Signature": "q" * 600}}]
    df = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=bool(i % 2))) for i, d in enumerate(docs)], "i int, j string")
    got = {r["i"]: r for r in df.select("i", nested.redacted(F.col("j")).alias("r"), nested.canonical(F.col("j")).alias("c")).collect()}
    for i, d in enumerate(docs):
        want = {k: show(d[k], k, 0, True) for k in sorted(d)}
        assert json.loads(got[i]["r"]) == want, d
        assert list(json.loads(got[i]["r"])) == list(want)
        assert json.loads(got[i]["c"]) == d and got[i]["c"] == json.dumps(json.loads(got[i]["c"]), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_what_is_no_object(spark):
    df = spark.createDataFrame([(None,), ("",), ("[1]",), ("{",), ("7",)], "j string")
    assert {r[0] for r in df.select(nested.redacted(F.col("j"))).collect()} == {None}
    assert [r[0] for r in df.select(nested.canonical(F.col("j"))).collect()] == [None, None, "[1]", None, "7"]


def test_hash_does_not_depend_on_order(spark):
    df = spark.createDataFrame([('{"b":{"y":1,"x":[2]},"a":"é"}',), ('{ "a":"é", "b":{"x":[2], "y":1} }',)], "j string")
    h = nested.semantic_hash(kind=F.lit("node"), data=nested.parsed(F.col("j")), certainty=F.lit(None).cast("string"), created_by=F.array(F.lit("s")))
    want = json.dumps({"kind": "node", "data": {"b": {"y": 1, "x": [2]}, "a": "é"}, "certainty": None, "created_by": ["s"]}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert {r[0] for r in df.select(h).collect()} == {hashlib.sha256(want.encode()).hexdigest()}
