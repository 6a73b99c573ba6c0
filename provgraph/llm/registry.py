"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, embedding_dedup, exact_dedup, hmm, kneser_ney, minhash, packing, pii, rendering, sstable, toxicity, whitening
from .common import remainder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 5) == 0
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out, ~held_out)


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return hmm.score(docs, remainder(docs["doc_id"], 7) == 2)


def op3_concat_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER)))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.rendered(table(spark, sf_dir, "pages"))


def op6_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked(table(spark, sf_dir, "embeddings"))


def op8_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write(table(spark, sf_dir, "documents"), public_tokenizers.path(sstable.TOKENIZER))
    return sstable.digest(sstable.read(spark, manifest))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents, by id, stand for what is known already; the result is that of all."""
    return exact_dedup.dedup(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 2) == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_hmm, op3_concat_pack, op4_kneser_ney, op5_layout_text, op6_edit_decontamination, op7_projection_dedup, op8_sstable, op9_pii, op10_dart_minhash,
        op11_source_divergence, op12_whitening, op13_exact_dedup,
    )
}
ORACLES: dict[str, str] = {"op11_source_divergence": divergence.SQL, "op13_exact_dedup": exact_dedup.SQL}
