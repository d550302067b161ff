"""The whole job over ``documents``: filter, join, decontaminate, mix, encode.

Each stage is written as Parquet and read again, so a lost executor costs a part
of one stage, and each stage plans on what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import decontamination, jaccard, mixing, quality
from sheaf.llm.queries import cycle_weight, ids_by_key, table
from sheaf.llm.store import new_path

#: Near duplicates: sets of five words, similarity 0.8 or more.
NEAR = jaccard.Rule(5, 80)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; the model is fitted on the labelled ones among them."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the one with the smallest doc_id."""
    return jaccard.keep_one(docs, NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the weights of their sources."""
    return mixing.mix(docs, cycle_weight(), share=1.5, repeats=2.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, written as shards and read back by key."""
    return ids_by_key(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]

#: Boosted trees and a tokenizer's merges are beyond SQL; the tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
