"""The training corpus in five stages: quality, near-duplicates, repeated passages, mix, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns what the
next one gets as docs, once written as Parquet. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nudgetrail.llm import bagminhash, mixing, packing, pu_quality, substrings
from nudgetrail.llm.common import Stages

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return pu_quality.accepted(docs, pu_quality.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, with or without a doc_id."""
    return bagminhash.without_copies(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds as well."""
    return substrings.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document."""
    mixed, x = mixing.mix(docs, F.array("source"))
    copies = mixed.withColumn(f"{x}copy", F.explode(f"{x}routed"))
    return copies.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("mixture", mixture),
    ("packed", packed),
]

#: A trained classifier and a tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next one reads it."""
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stages.cut(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
