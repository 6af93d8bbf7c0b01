"""A pipeline over the documents table: toxicity, near copies, benchmark leaks, secrets, tokens.

Each stage takes the documents that its predecessor kept and decides on all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varsift.llm import bpe, common, decontaminate, near_copies, secrets_scan, toxicity


def _begin(spark: SparkSession) -> None:
    """Each stage finds small Arrow batches and executors that hold nothing of the stage before."""
    common.small_batches(spark)
    common.give_back_heap(spark)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    _begin(spark)
    return toxicity.remove_toxic(docs, common.table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with five-word similarity of 0.8 or more, the one of the smallest doc_id stays."""
    _begin(spark)
    return near_copies.keep_one(docs)


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars after texts were changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go; from the others, every passage of a
    window or of a whole shorter item is cut."""
    _begin(spark)
    bench = common.table(spark, sf_dir, "benchmark")
    return _with_length(decontaminate.strip_spans(docs, bench, drop_contaminated=True))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    _begin(spark)
    return _with_length(secrets_scan.mask(docs, secrets_scan.train(docs)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, with the byte offsets at which tokens end, and the bytes that the ids decode to."""
    _begin(spark)
    done = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "offsets", "decoded")


STAGES = [
    ("toxicity", remove_toxic),
    ("near_copies", one_of_near_copies),
    ("decontamination", remove_leaks),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]

#: The stages learn models and walk automata, which SQL can't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}", docs)
    return docs
