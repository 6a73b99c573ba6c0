"""How far the sources of a language differ in their words, by bitmaps of count levels.

Terms are runs of ASCII letters and non-ASCII characters, with only A-Z lower-cased. A language keeps the terms of at
least `DOCUMENTS` of its documents; V of them. A group is a (lang, source) that occurs. With count occurrences of a term
and N those of all kept terms, p = 1 + floor(10^9 (count + 1) / (N + V)); two p's differ by f = floor((p - q)^2 / q).

1. `counts`: every task counts the terms of its documents by group, and documents by term, and hands on sums.
2. `cells`: kept terms get an id in their language: a block (by hash, about `BLOCK` terms) and a place in it.
3. `bitmaps`: for each (group, count) the set of the ids of its terms, as bits; kept as the 64-bit words that are not
   nought, so that a count which one term has costs one word.
4. `pairs`: in each block, the words of two groups are ANDed; popcounts give how many terms have count a here and b there, and
   each such joint cell adds that number times f. Counts of zero are not stored: what a level's popcount has over its joint
   cells is zero in the other group, and what the block has over the union of both is zero in both.
5. `terms`: f of each term against the language, the first `RANKS` a group.

All arithmetic is on integers. p is at most 10^9 + 1 and the p - 1 of a group sum up to at most 10^9, so a sum of f is below
(2 * 10^9)^2 and fits a long. A task holds the words of one block, of all sources of the language, and the sums of
`SLICE` of them with all others; the answer has all pairs of sources, so it grows with their square.

Null text, lang and source count as ''. Empty texts, and texts without a term, still make their group occur; without any kept
term its pairs are 0 and it has no terms. Repeated rows count as often as they occur, also for `DOCUMENTS`. Ties
in value go by item, in the order of UTF-8 bytes. Long texts are cut between terms while counting, not in what is
counted. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

DOCUMENTS = 3
ONE = 1_000_000_000
RANKS = 200
BLOCK = 512
SLICE = 64
SALTS = 256  # tasks among which the terms of one language are dealt
ENTRIES = 400_000  # of a task's counts before it hands them on
CHARS = 1 << 20
CELLS = 1 << 20
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def tokens(text: bytes):
    """Lists of terms of a text, about CHARS bytes at a time."""
    plain, at = text.translate(LETTERS), 0
    while at < len(plain):
        to = plain.find(b" ", at + CHARS)
        to = len(plain) if to < 0 else to
        yield plain[at:to].split(b" ")
        at = to


def _count(batches):
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def handed():
        for (lang, source), (n, df) in found.items():
            n[b""], df[b""] = 0, 0  # the group occurs
            k, terms = len(n), list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * k), pa.array([source] * k), pa.array(terms, pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in terms], pa.int64())],
                names=["lang", "source", "term", "n", "df"],
            )

    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for text, lang, source in zip(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
            n, df = found.setdefault((lang, source), (Counter(), Counter()))
            before, once = len(n), set()
            for run in tokens(text.as_py()):
                n.update(run)
                once.update(run)
            df.update(once)
            size += len(n) - before
            if size > ENTRIES:
                yield from handed()
                found, size = {}, 0
    yield from handed()


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (UTF-8), n, df (documents); the empty term stands for the group. Written."""
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    found = d.mapInArrow(_count, "lang string, source string, term binary, n long, df long")
    return common.written(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "divergence-counts")


def _level(count: Column, total: Column, terms: Column) -> Column:
    """p."""
    return 1 + F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(ONE).cast("decimal(10,0)"), (total + terms).cast("decimal(20,0)"))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def cells(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """found: counts(). Three written tables:

    a row per group and kept term with count > 0 (lang, at, source, term, n, p, q, block, place, last_slice),
    a row per group (lang, at: its place among the sources, source, zero: p of the count 0),
    a row per block (lang, block, terms).
    """
    real = found.filter(F.length("term") > 0)
    kept = real.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).filter(F.col("df") >= DOCUMENTS).drop("df")
    kept = common.written(kept, "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS))
    copies = langs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    placed = kept.withColumn("salt", salt).join(copies, ["lang", "salt"]).withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / BLOCK)))
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1)
    placed = placed.withColumn("q", _level(F.col("lang_n"), F.col("lang_total"), F.col("v"))).select("lang", "term", "q", "block", "place")
    placed = common.written(placed, "divergence-terms")
    here = common.written(real.select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "divergence-here")
    sums = here.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = found.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left").fillna(0, ["total", "v"])
    groups = groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = groups.withColumn("last_slice", F.expr(f"(max(at) over (partition by lang)) div {SLICE}").cast("int"))
    zero = F.when(F.col("v") > 0, _level(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(F.lit(1).cast("long"))
    groups = common.written(groups.withColumn("zero", zero), "divergence-groups")
    out = here.join(groups.select("lang", "source", "at", "last_slice", "total", "v"), ["lang", "source"]).withColumn("p", _level(F.col("n"), F.col("total"), F.col("v"))).drop("total", "v")
    out = common.written(out, "divergence-cells")
    blocks = common.written(placed.groupBy("lang", "block").agg(F.count("*").alias("terms")), "divergence-blocks")
    common.drop_written(kept, here, placed)
    return out, groups.select("lang", "at", "source", "zero"), blocks


def bitmaps(found: DataFrame) -> DataFrame:
    """found: rows of cells(). The words, not nought, of the bitmap of each (lang, source, count): lang, block, word, at, n, p, bits (and last_slice of the language)."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % 64)
    return found.groupBy("lang", "block", F.expr("place div 64").alias("word"), "at", "n", "p", "last_slice").agg(F.bit_or(bit).alias("bits"))


def _joint(key: tuple[pa.Scalar, ...], frame: pa.Table, words: pa.Table) -> pa.Table:
    """Sums of f over the terms of a block, for each source of a slice with each other source."""
    lang, number = key[0].as_py(), key[2].as_py()
    info = frame.slice(0, 1).to_pylist()[0]
    names, zero = info["sources"], np.array(info["zeros"], dtype=np.int64)
    first = number * info["width"]
    last = min(len(names), first + info["width"])
    mine = zero[first:last]
    total, joint, size = np.zeros((last - first, len(names)), dtype=np.int64), np.zeros((last - first, len(names)), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
    where, at, p, bits = (words[c].to_numpy() for c in ("word", "at", "p", "bits"))
    order = np.lexsort((at, where))
    where, at, p, bits = where[order], at[order], p[order], bits[order].view(np.uint64)
    pop = np.bitwise_count(bits).astype(np.int64)
    np.add.at(size, at, pop)
    for lo, hi in zip(*_runs(where)):
        a, b, w, n = at[lo:hi], p[lo:hi], bits[lo:hi], pop[lo:hi]
        here = np.nonzero((a >= first) & (a < last))[0]
        met = np.zeros((last - first, hi - lo), dtype=np.int64)  # terms of each level that a source of the slice has as well
        for cut in range(0, len(here), step := max(1, CELLS // (hi - lo))):
            rows = here[cut : cut + step]
            both = w[rows][:, None] & w
            i, j = np.nonzero(both)
            cell = np.bitwise_count(both[i, j]).astype(np.int64)
            i_at, i_p, q = a[rows] - first, b[rows], b[j]
            np.add.at(total, (i_at[i], a[j]), cell * ((i_p[i] - q) ** 2 // q))
            np.add.at(joint, (i_at[i], a[j]), cell)
            np.add.at(met, (i_at[i], j), cell)
            own = np.zeros((len(rows), len(names)), dtype=np.int64)
            np.add.at(own, (i, a[j]), cell)
            np.add.at(total, i_at, (n[rows][:, None] - own) * ((i_p[:, None] - zero) ** 2 // zero))  # here, and zero there
        np.add.at(total.T, a, ((n - met) * ((mine[:, None] - b) ** 2 // b)).T)  # zero here
    neither = info["terms"] - (size[first:last, None] + size - joint)
    total += neither * ((mine[:, None] - zero) ** 2 // zero)
    i, j = np.nonzero(np.arange(first, last)[:, None] != np.arange(len(names)))
    names = pa.array(names, pa.string())
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "source": names.take(pa.array(i + first)), "item": names.take(pa.array(j)), "value": pa.array(total[i, j])})


def _runs(ordered: np.ndarray):
    """Starts and ends of runs of equal values."""
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    return ([0, *cuts], [*cuts, len(ordered)]) if len(ordered) else ([], [])


def pairs(words: DataFrame, groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language), value."""
    named = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "source", "zero"))).alias("g"))  # a row per source of a language
    frame = named.select("lang", F.col("g.source").alias("sources"), F.col("g.zero").alias("zeros")).join(blocks, "lang", "left").fillna(0, ["block", "terms"])
    frame = frame.withColumn("slice", F.explode(F.sequence(F.lit(0), F.expr(f"(size(sources) - 1) div {SLICE}").cast("int")))).withColumn("width", F.lit(SLICE))
    dealt = words.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("last_slice")))).drop("last_slice")
    keys = ["lang", "block", "slice"]
    found = frame.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_joint, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def terms(found: DataFrame, ranks: int = RANKS) -> DataFrame:
    """found: rows of cells(). lang, source, item (a term commoner in the group than in the language), value, rank."""
    t = found.filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").cast("string").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    return t.withColumn("rank", F.row_number().over(_falling())).filter(F.col("rank") <= ranks)


def _falling():
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    found = counts(docs)
    rows, groups, blocks = cells(found)
    common.drop_written(found)
    stored = common.written(bitmaps(rows), "divergence-bitmaps")
    between = pairs(stored, groups, blocks).withColumn("rank", F.row_number().over(_falling()))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return between.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms(rows).withColumn("part", F.lit("term")).select(*columns))


SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as rid from documents),
g as (select distinct lang, source from d),
t as (select rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
k as (select lang, term, count(*) as n from t group by lang, term having count(distinct rid) >= 3),
v as (select lang, count(*) as v, sum(n) as total from k group by lang),
c as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by lang, source, term),
s as (select g.lang, g.source, v.v, coalesce((select sum(n) from c where c.lang = g.lang and c.source = g.source), 0) as total from g join v using (lang)),
p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)::hugeint) // (s.total + s.v)::hugeint as p,
             1 + (1000000000 * (k.n + 1)::hugeint) // (v.total + v.v)::hugeint as q
      from s join k using (lang) join v using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
pair as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
         from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
          from g a join g b on a.lang = b.lang and a.source <> b.source left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value from p where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= 200
"""
