"""A training-data pipeline over ``documents``: STAGES, each an operator of ``lanescope.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes each stage's result to shared storage and reads it for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanescope.llm import byte_pairs, decontamination, passages, simhash, toxicity
from lanescope.llm.shared import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, trained on the labels of ``docs``, rejects."""
    return toxicity.reject(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked fingerprints, the one with the smallest id."""
    return simhash.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that repeat an earlier document's; keeps all documents."""
    return passages.deduplicate(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that share ten words in a row, or a whole shorter item, with an item."""
    return decontamination.clean(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and byte offsets; ``text`` is what decoding the ids gives, an empty text for null."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    kept = tuple(c for c in docs.columns if c != "text")
    encoded = byte_pairs.encode(docs, path, keep=kept)
    decoded = byte_pairs.decode(encoded, path, to="text")
    return decoded.withColumn("text", F.col("text").cast("string"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("byte_pair_encoding", encode),
]
#: A trained model and hashes that SQL lacks: the tests compare with plain restatements instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
