"""Ranked lexical search, vector search, and fusion of rankings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words that carry no meaning in a question.
STOPWORDS = frozenset(
    """the a an of to in on at for with and or is are was were be been am being do does did doing how what where which who
    whom why when this that these those it its as by from into about me my mine i you your we our us they them their can could
    will would shall should may might must here there so but if then than such via per work works working""".split()
)
#: Score of a term by where it is found.
WEIGHTS = {"name": 12.0, "token": 8.0, "stem": 2.0, "path": 1.5, "in_name": 1.0, "signature": 0.5}
#: Path segments that mark a file's role, the strongest first.
ROLES = {
    "vendored": ["vendored", "vendor", "third_party", "thirdparty", "node_modules"],
    "test": ["tests", "test", "__tests__"],
    "generated": ["build", "dist", "coverage"],
    "support": ["tools", "scripts", "fixtures", "examples", "docs"],
}
#: Fixed value: candidates that are scored at most, the best tiers first.
MOST_CANDIDATES = 2000
CAMEL = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"


def query_terms(query: str) -> list[str]:
    """Lower-cased words in order, a snake_case word whole and in parts, without stopwords and repeats."""
    out: dict[str, None] = {}
    for word in re.findall(r"[A-Za-z0-9_]+", query.lower()):
        for t in [word, *(word.split("_") if "_" in word else [])]:
            if t.strip("_") and t not in STOPWORDS:
                out[t] = None
    return list(out)


def identifier_tokens(c: Column) -> Column:
    """Parts of an identifier: cut at other characters and at changes of case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(CAMEL), F.lit(0)), F.lower))


def stem_match(tokens: Column, term: str) -> Column:
    """A token starts with the term (3 letters or more), or the term with a token (4 or more)."""
    ahead = F.exists(tokens, lambda t: t.startswith(term)) if len(term) >= 3 else F.lit(False)
    return ahead | F.exists(tokens, lambda t: (F.length(t) >= 4) & F.lit(term).startswith(t))


def role(path: Column) -> Column:
    parts = F.split(F.lower(path), r"[/\\]")
    out = F.lit("product")
    for name in reversed(ROLES):
        out = F.when(F.arrays_overlap(parts, F.array(*[F.lit(x) for x in ROLES[name]])), name).otherwise(out)
    return out


def path_factor(r: Column) -> Column:
    """Vendored, test and generated files weigh least."""
    return F.when(r.isin("vendored", "test", "generated"), 0.55).when(r == "support", 0.75).otherwise(1.0)


def score(terms: list[str], name: Column, path: Column, signature: Column, node_id: Column) -> Column:
    """Per term the first rule that holds; one more if all terms are found; by the file's role."""
    tokens, places = identifier_tokens(name), F.concat(identifier_tokens(path), identifier_tokens(node_id))
    total, every = F.lit(0.0), F.lit(True)
    for t in terms:
        s = (
            F.when(F.lower(name) == t, WEIGHTS["name"])
            .when(F.array_contains(tokens, t), WEIGHTS["token"])
            .when(stem_match(tokens, t), WEIGHTS["stem"])
            .when(F.array_contains(places, t) | stem_match(places, t), WEIGHTS["path"])
            .when(F.lower(name).contains(t), WEIGHTS["in_name"])
            .when(F.lower(signature).contains(t), WEIGHTS["signature"])
            .otherwise(0.0)
        )
        total, every = total + s, every & (s > 0)
    return (total + F.when(every & F.lit(bool(terms)), 1.0).otherwise(0.0)) * path_factor(role(path))


def candidates(df: DataFrame, terms: list[str]) -> DataFrame:
    """Rows whose id, name or signature contain a term, or (6 letters or more) whose id or name contain its first four."""
    hit = F.lit(False)
    for t in terms:
        for c in ("id", "name", "signature"):
            hit = hit | F.lower(c).contains(t)
        if len(t) >= 6:
            hit = hit | F.lower("id").contains(t[:4]) | F.lower("name").contains(t[:4])
    return df.filter(F.coalesce(hit, F.lit(False)))


def search(df: DataFrame, query: str, top_k: int = 20, scope: str = "all", path_prefix: str = "") -> DataFrame:
    """id, name, tier, score: symbols (id, name, path, signature) by score, then tier (exact, prefix, other), then id."""
    terms, name = query_terms(query), F.lower("name")
    if terms:
        prefix = F.lit(False)
        for t in terms:
            prefix = prefix | name.startswith(t)
        tier = F.when(name.isin(terms), 0).when(prefix, 1).otherwise(2)
        s = score(terms, F.col("name"), F.col("path"), F.coalesce("signature", F.lit("")), F.col("id"))
        found = candidates(df, terms).withColumn("tier", tier).orderBy("tier", "id").limit(MOST_CANDIDATES).withColumn("score", s).filter("score > 0")
    else:  # a question without terms lists symbols by id
        found = df.orderBy("id").limit(MOST_CANDIDATES).withColumn("tier", F.lit(2)).withColumn("score", F.lit(0.0))
    if scope != "all":
        found = found.filter(role(F.col("path")).isin("product", "support") if scope == "product" else role(F.col("path")) == "test")
    if start := path_prefix.lower().rstrip("/"):
        found = found.filter((F.lower("path") == start) | F.lower("path").startswith(start + "/"))
    return found.orderBy(F.desc("score"), "tier", "id").limit(max(1, min(200, top_k))).select("id", "name", "tier", "score")


def confident(hits: DataFrame, terms: list[str], n: int = 5) -> DataFrame:
    """One row: whether one of the first n hits answers the question.

    It must score 3 or more and be neither data nor contract; with several terms two of them must hit its name (a part of it, a
    stem, or anywhere within), or it scores 5 or more and its name has two parts. A question without terms has no answer.
    """
    parts = identifier_tokens(F.col("name"))
    top = hits.orderBy(F.desc("score"), "tier", "id").limit(n).filter(~F.col("id").startswith("data:") & ~F.col("id").startswith("contract:"))
    named = F.lit(0)
    for t in terms:
        named = named + (F.array_contains(parts, t) | stem_match(parts, t) | F.lower("name").contains(t)).cast("int")
    enough = F.lit(True) if len(terms) < 2 else (named >= 2) | ((F.col("score") >= 5) & (F.size(parts) >= 2))
    return top.agg(F.coalesce(F.bool_or((F.col("score") >= 3) & enough & F.lit(bool(terms))), F.lit(False)).alias("confident"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays over their common length; 0 where one has no norm."""
    n = F.least(F.size(a), F.size(b))
    x, y = (F.transform(F.slice(v, F.lit(1), n), lambda e: e.cast("double")) for v in (a, b))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, e: s + e)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((n > 0) & (norm > 0), dot(x, y) / norm).otherwise(0.0)


def vector_top(df: DataFrame, query: list[float], k: int) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("similarity", cosine(F.col("embedding"), q)).orderBy(F.desc("similarity"), "vec_id").limit(k)


def fused(rankings: DataFrame, k: int = 60) -> DataFrame:
    """rankings: list, id, rank (from 1). Reciprocal rank fusion."""
    return rankings.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """id with its place in an order over an already limited list."""
    return df.select(F.lit(name).alias("list"), "id", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)).alias("rank"))
