"""Personal data: fixed patterns, plus boosted trees over high-recall candidates. DataFrame operations only.

Base spans come from four patterns with their checks, leftmost and non-overlapping per kind. The
patterns are written so that a search never re-reads a run of characters: starts are pinned to
the start of a run (or the end of the last match), and repeats do not give back.

The method adds spans. Two generators propose candidates that may overlap (digit groups with
loose separators; addresses with spelled or spaced separators). Gradient-boosted trees score
them on what is left when the separators are taken away (digits, their groups, check digit, dotted
parts, end of the address) and on the words before them; what only the base patterns ask for (a
plus, an at sign, certain separators) is no feature. Labels do not come from the base spans: a
candidate is positive if it holds up without its separators (`_holds`). The candidates of all
documents are written once; the trees learn from about `SAMPLE_ROWS` of each kind and label (by hash
of the id, three quarters at most), so that rare failures are among them. All others set the
thresholds, in one grouped sum: per kind, the lowest score from which the precision reaches
`PRECISION`, both over all their candidates and over those that overlap no base span. A candidate
above it that overlaps no base span is added (a card only with its check digit); of overlapping ones
the best-scored stays.

Positions: matches are bracketed by two control characters (any in the text are replaced by
another first) and the lengths of the parts summed, in blocks, so a text with very many matches
costs little more than its length. Every row is handled on its own: no join, and no shuffle but of the small sums.

Null and empty texts have no spans. Repeated rows, and rows with equal or null ids, are scored each by itself. Of
overlapping candidates with equal scores the one that starts first, then ends first, stays. Where no candidate
fails, each scores 1; where none holds, nothing is added. An empty table gives none. Extra columns
are carried through `redact` under whatever names; elsewhere only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
GENERATORS = {
    "digits": (r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,}+", "[0-9]"),
    "address": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,64}+ ?(?:\.|\(dot\)|\[dot\]) ?(?:[A-Za-z0-9-]{1,63}+(?:\.| \. | ?\(dot\) ?| ?\[dot\] ?)){0,8}[A-Za-z]{2,24}+", r"@|\(at\)|\[at\]"),
}
CONTEXT = ("card|visa|credit|pay|karte|carte|tarjeta", "tel|phone|call|mobile|fax|handy", r"\bip\b|host|addr|server", "mail|contact|write")
CONTEXT_CHARS = 24
#: A word that says what follows at once is a telephone number.
CALLED = r"\b(?:tel|telephone|phone|call|mobile|cell|fax|handy)\b[^a-z0-9]*$"
#: Ends of addresses; of two letters not after a dot and a space, which is how sentences go on.
ENDS = r"[.)\]] ?(?:com|org|net|edu|gov|mil|int|info|biz|name|dev|app|example|test)$|(?:[^ ]\.| \. |[)\]] ?)[a-z]{2}$"
#: Lengths of the digit groups of cards and of telephone numbers without a country mark.
CARD_GROUPS = r"^(?:1[4-9]|4-4-4-[2-4]|4-4-4-4-[1-3]|4-6-[45])$"
PHONE_GROUPS = r"^(?:[1-3]-)?3-3-4$"
OPEN, CLOSE = "\x01", "\x02"
BLOCK = 256
NEAR = 64
SAMPLE_ROWS = 500
TREES, DEPTH = 12, 3
PRECISION = 0.98


def _parts(clean: Column, pattern: str, needs: str) -> Column:
    marked = F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), OPEN, -1)
    return F.when(clean.rlike(needs), marked).otherwise(F.array(clean))


def _starts(parts: Column) -> Column:
    """Where each part after the first begins in the text; blocks keep the growing arrays short."""
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    block = lambda c: F.slice(rest, c * BLOCK + 1, F.lit(BLOCK))
    width = lambda p: F.length(p).cast("long") - 1
    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(parts) - 2, F.lit(0)) / BLOCK).cast("int"))
    grow = lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    sums = F.transform(blocks, lambda c: F.aggregate(block(c), F.lit(0).cast("long"), lambda a, p: a + width(p)))
    bases = F.aggregate(sums, F.array(F.length(parts[0]).cast("long")), grow)
    return F.flatten(F.zip_with(blocks, F.slice(bases, F.lit(1), F.size(blocks)), lambda c, b: F.slice(F.aggregate(block(c), F.array(b), lambda a, p: grow(a, width(p))), F.lit(1), F.size(block(c)))))


def _matches(df: DataFrame, name: str, pattern: str, needs: str) -> DataFrame:
    """Adds column `name`: array of (s, m, before) for every match."""
    df = df.withColumn("_p", _parts(F.col("_clean"), pattern, needs)).withColumn("_s", _starts(F.col("_p")))
    match = lambda s, i: F.struct(s.alias("s"), F.substring_index(F.col("_p")[i + 1], CLOSE, 1).alias("m"), F.right(F.col("_p")[i], F.lit(CONTEXT_CHARS)).alias("before"))
    some = F.when(F.size("_p") > 1, F.transform("_s", match)).otherwise(F.transform(F.slice("_s", F.lit(1), F.lit(0)), match))
    return df.withColumn(name, some).drop("_p", "_s")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column) -> Column:
    small = lambda x: F.when(F.length(F.ltrim(x, F.lit("0"))) <= 3, F.coalesce(F.ltrim(x, F.lit("0")).try_cast("int"), F.lit(0)) <= 255).otherwise(False)
    return F.forall(F.split(m, r"\."), small)


def _valid(kind: str, m: Column) -> Column:
    d = _digits(m)
    return {
        "email": F.lit(True), "ip": _octets(m), "card": F.when(F.length(d).between(14, 19), F.call_function("luhn_check", d)).otherwise(False), "phone": F.length(d).between(10, 15),
    }[kind]


def with_base(docs: DataFrame) -> DataFrame:
    """docs with _clean, _base (sorted array of (s, k, e)) and _n (matches a kind)."""
    df = docs.withColumn("_clean", F.translate(F.coalesce("text", F.lit("")), OPEN + CLOSE, "\x03\x03"))
    for kind in KINDS:
        df = _matches(df, f"_{kind}", PATTERNS[kind], NEEDS[kind])

    def spans(k: int, kind: str) -> Column:
        keep = F.filter(f"_{kind}", lambda x: _valid(kind, x["m"]))
        return F.transform(keep, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), (x["s"] + F.length(x["m"])).alias("e")))

    def number(k: int) -> Column:
        return F.size(F.filter("_base", lambda x: x["k"] == k)).cast("long")

    df = df.withColumn("_base", F.array_sort(F.concat(*[spans(k, kind) for k, kind in enumerate(KINDS)]))).drop(*(f"_{kind}" for kind in KINDS))
    return df.withColumn("_n", F.array(*[number(k) for k in range(len(KINDS))]))


def _features(x: Column) -> Column:
    m, d = x["m"], _digits(x["m"])
    groups = F.transform(F.regexp_extract_all(m, F.lit("([0-9]+)")), lambda g: F.length(g))
    shape = F.array_join(F.transform(groups, lambda n: n.cast("string")), "-")
    bare = F.regexp_replace(m, " ", "")
    dotted = F.when(bare.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), _octets(bare)).otherwise(False)
    before = F.lower(x["before"])
    address = m.rlike("@|\\(at\\)|\\[at\\]")
    luhn = F.call_function("luhn_check", d) & (F.length(d) > 0)
    flags = [*[~address & c for c in (luhn, shape.rlike(CARD_GROUPS), shape.rlike(PHONE_GROUPS), dotted)], address, address & m.rlike(ENDS), before.rlike(CALLED), *[before.rlike(c) for c in CONTEXT]]
    numbers = [F.length(d), F.size(groups), F.coalesce(F.array_max(groups), F.lit(0))]
    return F.array(*[F.when(address, 0.0).otherwise(c.cast("double")) for c in numbers], *[c.cast("double") for c in flags])


def _kind(f: Column, m: Column) -> Column:
    """The kind that a candidate would be: -1 for none."""
    return F.when(f[7] == 1, 0).when(f[6] == 1, 1).when(~m.startswith("+") & f[0].between(14, 19), 2).when(f[0].between(10, 15), 3).otherwise(-1)


def _holds(m: Column, f: Column, k: Column) -> Column:
    """Whether a candidate is of its kind by what is left without separators: a known end of the address, four octets, the check digit in groups of a card, or the groups of a telephone number, a word for one before it or a country mark."""
    return F.when(k == 0, f[8] == 1).when(k == 1, f[6] == 1).when(k == 2, (f[3] == 1) & (f[4] == 1)).when(k == 3, (f[5] == 1) | (f[9] == 1) | m.startswith("+")).otherwise(False)


def with_candidates(df: DataFrame) -> DataFrame:
    """Adds _cand: array of (s, e, f, k, y) from both generators; k is -1 where no kind fits, y says whether it holds."""
    for name, (pattern, needs) in GENERATORS.items():
        df = _matches(df, f"_{name}", pattern, needs)
    proposed = F.concat(*[F.col(f"_{name}") for name in GENERATORS])
    df = df.withColumn("_cand", F.transform(proposed, lambda x: F.struct(x["s"].alias("s"), x["m"].alias("m"), _features(x).alias("f"))))
    df = df.drop(*(f"_{name}" for name in GENERATORS))
    df = df.withColumn("_cand", F.transform("_cand", lambda c: F.struct(c["s"].alias("s"), (c["s"] + F.length(c["m"])).alias("e"), c["m"].alias("m"), c["f"].alias("f"), _kind(c["f"], c["m"]).alias("k"))))
    return df.withColumn("_cand", F.transform("_cand", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["f"].alias("f"), c["k"].alias("k"), _holds(c["m"], c["f"], c["k"]).alias("y"))))


def _eligible(c: Column) -> Column:
    """A kind fits, and a card has its check digit, as in the base."""
    return (c["k"] >= 0) & ((c["k"] != 2) | (c["f"][3] == 1))


def _blocked(spans: str) -> Column:
    """Spans, sorted by start, in runs of NEAR with the reach of each run, so that a search for overlaps skips most."""
    part = lambda i: F.slice(spans, i * NEAR + 1, F.lit(NEAR))
    last = lambda i: F.aggregate(part(i), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b["e"]))
    runs = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / NEAR).cast("int"))
    made = F.transform(runs, lambda i: F.struct(F.get(spans, i * NEAR)["s"].alias("s"), last(i).alias("e"), part(i).alias("part")))
    return F.filter(made, lambda r: r["e"] > 0)


def _overlaps(c: Column, blocked: str, also=lambda b: F.lit(True)) -> Column:
    """Whether c overlaps one of the spans for which `also` holds."""
    apart = lambda x: (x["s"] < c["e"]) & (c["s"] < x["e"])
    return F.exists(blocked, lambda r: F.when(apart(r), F.exists(r["part"], lambda b: apart(b) & also(b))).otherwise(False))


def fit(docs: DataFrame):
    """(score expression over `c.f`, threshold a kind); None where no candidate holds."""
    df = with_candidates(with_base(docs.select("doc_id", "text")))
    of = lambda c: F.struct(c["k"].alias("k"), c["y"].alias("y"), c["f"].alias("f"), _eligible(c).alias("eligible"), (~_overlaps(c, "_near")).alias("free"))
    each = F.when(F.size("_near") >= 0, F.transform("_cand", of))  # named twice, or the runs would be computed again for each candidate
    rows = df.withColumn("_near", _blocked("_base")).select("doc_id", F.explode_outer(each).alias("c")).filter("c.k >= 0")  # outer: else the array is computed again in a filter
    rows = common.written(rows.select("c", common.hashed("doc_id", F.lit(5)).alias("h")), "pii-candidates")
    n = {(r["k"], r["y"]): r["n"] for r in rows.groupBy("c.k", "c.y").agg(F.count("*").alias("n")).collect()}  # at most 8 rows
    if not any(y for _, y in n):
        common.drop_written(rows)
        return None
    share = lambda k, y: common.hash_share(min(0.75, SAMPLE_ROWS / n.get((k, y), 1)))
    shares = F.array(*[F.lit(share(k, y)) for k in range(len(KINDS)) for y in (False, True)])
    sampled = F.col("h") < shares[F.col("c.k") * 2 + F.col("c.y").cast("int")]
    train = rows.filter(sampled).select(array_to_vector("c.f").alias("features"), F.col("c.y").cast("double").alias("label")).repartition(1).persist()  # bounded by SAMPLE_ROWS
    classes = {r["label"] for r in train.select("label").distinct().collect()}
    score = "1D"  # none fails: all hold
    if len(classes) == 2:
        score = _score_sql(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=3).fit(train))
    train.unpersist()
    limits = _limits(rows.filter(~sampled & F.col("c.eligible")), score)
    common.drop_written(rows)
    return score, limits


def _limits(rows: DataFrame, score: str) -> list[float]:
    """Per kind, the lowest score from which the precision is reached, over all candidates and over those that could be added; 1.1 for none."""
    table = rows.groupBy(F.col("c.k").alias("k"), F.floor(F.expr(score) * 50).alias("bin"), F.col("c.free").alias("free")).agg(F.sum(F.col("c.y").cast("long")).alias("yes"), F.count("*").alias("all")).collect()  # at most 4 x 51 x 2 rows
    limits = []
    for k in range(len(KINDS)):
        yes, every = {True: 0, False: 0}, {True: 0, False: 0}
        limit = 1.1
        bins = sorted({r["bin"] for r in table if r["k"] == k}, reverse=True)
        for b, lower in zip(bins, [*bins[1:], 0]):
            for r in table:
                if r["k"] == k and r["bin"] == b:
                    yes[r["free"]] += r["yes"]
                    every[r["free"]] += r["all"]
            if sum(yes.values()) >= PRECISION * sum(every.values()) and yes[True] >= PRECISION * every[True]:
                limit = max(0.5, min(b, lower + 1) / 50)
        limits.append(limit)
    return limits


def _score_sql(model) -> str:
    """The boosted trees as one SQL expression: the probability of the positive class."""

    def node(n) -> str:
        if n.numDescendants() == 0:
            return repr(float(n.prediction()))
        return f"CASE WHEN c.f[{n.split().featureIndex()}] <= {float(n.split().threshold())!r}D THEN {node(n.leftChild())} ELSE {node(n.rightChild())} END"

    trees = [f"{float(w)!r}D * ({node(t._java_obj.rootNode())})" for w, t in zip(model.treeWeights, model.trees)]
    return f"1D / (1D + exp(-2D * ({' + '.join(trees)})))"


def with_spans(docs: DataFrame, model) -> DataFrame:
    """docs with _n, _base and _spans: sorted array of (s, k, e), base spans and added ones."""
    df = with_base(docs)
    if model is None:
        return df.withColumn("_spans", F.col("_base"))
    score, limits = model
    df = with_candidates(df)
    limit = F.array(*[F.lit(float(x)) for x in limits])
    df = df.withColumn("_near", _blocked("_base"))
    df = df.withColumn("_cand", F.when(F.size("_near") >= 0, F.filter("_cand", lambda c: _eligible(c) & ~_overlaps(c, "_near"))))
    df = df.withColumn("_cand", F.expr(f"transform(_cand, c -> struct(c.s AS s, c.e AS e, c.k AS k, {score} AS p))"))
    df = df.withColumn("_cand", F.array_sort(F.filter("_cand", lambda c: c["p"] >= limit[c["k"]])))
    df = df.withColumn("_near", _blocked("_cand"))
    better = lambda c: lambda d: (d["p"] > c["p"]) | ((d["p"] == c["p"]) & (F.struct(d["s"], d["e"], d["k"]) < F.struct(c["s"], c["e"], c["k"])))
    best = F.when(F.size("_near") >= 0, F.filter("_cand", lambda c: ~_overlaps(c, "_near", better(c))))
    added = F.transform(best, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))
    return df.withColumn("_spans", F.array_sort(F.array_distinct(F.concat("_base", added)))).drop("_cand", "_near")


def _listed(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base matches), base (listed), spans (listed)."""
    d = docs.select("doc_id", "text")
    df = with_spans(d, fit(d))
    return df.select("doc_id", *[F.col("_n")[k].alias(f"n_{kind}") for k, kind in enumerate(KINDS)], _listed("_base").alias("base"), _listed("_spans").alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; overlapping spans become one, named after the first. n_chars, if there, follows."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))  # the caller's columns apart from those made here
    df = with_spans(held, fit(docs.select("doc_id", "text")))
    merge = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] > x["s"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.element_at(acc, -1)["k"].alias("k"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(x)))
    df = df.withColumn("_m", F.aggregate("_spans", F.slice("_spans", F.lit(1), F.lit(0)), merge))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    before = lambda i: F.when(i > 0, F.get("_m", i - 1)["e"]).otherwise(F.lit(0).cast("long"))
    piece = lambda x, i: F.concat(F.substring(F.col("text"), (before(i) + 1).cast("int"), (x["s"] - before(i)).cast("int")), tags[x["k"]])
    last = F.element_at("_m", -1)["e"]
    text = F.concat(F.array_join(F.transform("_m", piece), ""), F.substring(F.col("text"), (last + 1).cast("int"), F.length("text")))
    df = df.withColumn("text", F.when(F.size("_m") > 0, text).otherwise(F.col("text")))

    def column(c: str) -> Column:
        if c.lower() == "text":
            return F.col("text").alias(c)
        if c.lower() == "n_chars":
            return F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema[c].dataType).alias(c)
        return F.col("row").getField(c).alias(c)

    return df.select(*[column(c) for c in docs.columns])
