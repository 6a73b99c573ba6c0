"""Substring and pattern search over a table of postings: which rows hold which three characters in a row.

A text that contains a term contains all its trigrams, so the rows that hold all of them are candidates, and only candidates are
read and verified. Postings are dealt and sorted by (trigram, key): a search reads the row groups of its trigrams, and a trigram that
most rows hold is spread over many files. Terms of fewer than three characters, and patterns that require no
literal of three, have no trigram: then everything is scanned, and `Plan.scanned` says so.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 3


def grams(text: str) -> list[str]:
    return sorted({text[i : i + SIZE] for i in range(len(text) - SIZE + 1)})


def _postings(batches):
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        for lo in range(0, len(texts), 64):  # long texts have many trigrams
            found = [grams(t) for t in texts[lo : lo + 64]]
            at = pa.array([lo + i for i, g in enumerate(found) for _ in g], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x for g in found for x in g], pa.string()), keys.take(at)], names=["gram", "key"])


def postings(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """gram, key of every trigram of the lower-cased texts; trigrams never reach from one column into the next."""
    kind = df.schema[key].dataType.simpleString()
    each = F.array_compact(F.array(*[F.lower(c) for c in columns]))
    d = df.select(F.col(key).alias("key"), F.explode(each).alias("text"))
    out = d.mapInArrow(_postings, f"gram string, key {kind}")
    return out.distinct() if len(columns) > 1 else out


def write(df: DataFrame, key: str, *columns: str, folder: str) -> DataFrame:
    """The postings, dealt and sorted, in a folder; read again."""
    p = postings(df, key, *columns)
    p.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(p.schema).parquet(folder)


def literals(pattern: str) -> list[str]:
    """Runs of ASCII characters that every match of a pattern holds, lower-cased; none for patterns that this reading does not know."""
    try:
        parsed = re._parser.parse(pattern)
    except Exception:
        return []
    out, run = [], []

    def end():
        if len(run) >= SIZE:
            out.append("".join(run).lower())
        run.clear()

    def walk(items):
        for op, arg in items:
            name = str(op)
            if name == "LITERAL" and arg < 128:
                run.append(chr(arg))
            elif name == "SUBPATTERN" and not arg[1] and not arg[2]:
                walk(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
                end()
                for _ in range(arg[0] if arg[0] == arg[1] and arg[0] < 64 else 1):
                    walk(arg[2])
                if arg[0] != arg[1]:
                    end()
            elif name == "AT":
                pass
            else:  # alternatives, classes and what may be absent
                end()

    walk(parsed)
    end()
    return sorted(set(out))


@dataclass(frozen=True)
class Plan:
    rows: DataFrame
    scanned: bool


def _holding(index: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """key, term of the rows that hold all trigrams of a term; wanted: the trigrams of each."""
    spark = index.sparkSession
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("term", "gram")] + [T.StructField("need", T.LongType())])
    q = spark.createDataFrame([(t, g, len(gs)) for t, gs in wanted.items() for g in gs], schema)
    some = index.filter(F.col("gram").isin(sorted({g for gs in wanted.values() for g in gs})))
    met = some.join(F.broadcast(q), "gram").groupBy("term", "key", "need").agg(F.count("*").alias("n"))  # q: a row a trigram of the question
    return met.filter("n = need").select("key", "term")


def any_term(df: DataFrame, index: DataFrame, key: str, columns: list[str], terms: list[str]) -> Plan:
    """Rows of which a column contains one of the terms, in any case; index: postings of these columns. Keys of df are distinct."""
    terms = [t.lower() for t in terms]
    verified = F.lit(False)
    for c in columns:
        for t in terms:
            verified = verified | F.coalesce(F.lower(c).contains(t), F.lit(False))
    wanted = {t: grams(t) for t in terms}
    if not terms or not all(wanted.values()):
        return Plan(df.filter(verified), bool(terms))
    keys = _holding(index, wanted).select(F.col("key").alias(key)).distinct()
    return Plan(df.join(keys, key, "left_semi").filter(verified), False)


def pattern(df: DataFrame, index: DataFrame, key: str, column: str, text: str) -> Plan:
    """Rows of which a column matches a pattern, as rlike reads it; index: postings of the column."""
    found = literals(text)
    verified = df[column].rlike(text)
    if not found:
        return Plan(df.filter(verified), True)
    wanted = {"all": sorted({g for t in found for g in grams(t)})}
    keys = _holding(index, wanted).select(F.col("key").alias(key))
    return Plan(df.join(keys, key, "left_semi").filter(verified), False)


def snippet(column: Column, text: str, around: int = 80) -> Column:
    """What a pattern matches first and what follows it, a bounded piece."""
    return F.substring(column, F.regexp_instr(column, F.lit(text)), F.lit(around))
