"""Corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the
shared folder and gives it, read again, to the next stage. All stages but the last return the
columns of `documents`, and any others that docs has, whatever their names. Decisions are taken row by row:
rows that share an id, or have none, are judged by their own texts. Null and empty texts are not toxic
unless the machine says so, have no copies, hold no benchmark item and no personal data, and are packed as a lone end id.
Of rows equal in words one stays. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph.llm import common, decontamination, minhash, packing, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic; it learns from all labels of its input."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.kept(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the first with the least id."""
    return minhash.deduplicated(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs within the edit budget."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with spans of personal data replaced by their kind."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.digest(packing.pack(docs, public_tokenizers.path(packing.TOKENIZER)))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: No SQL: fitted models, signatures and edit distances are not expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.drop_written(before)  # what is written does not need it any more
    return docs
