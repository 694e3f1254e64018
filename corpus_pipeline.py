"""The corpus pipeline: five of the training-data operators, one after the other.

`STAGES` lists (name, function); each function takes (spark, docs, sf_dir) and
returns the rows that go on, with the columns of `documents` (the last one
returns the packed pieces). `run` writes every stage as Parquet into the
session's shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hostshelf.llm import content_sort, phrase_automata, quality_risk, simhash_cover, window_packing
from hostshelf.llm.common import documents, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_risk.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return content_sort.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return simhash_cover.keep_one(docs, shingle=4, radius=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in several places are cut out; documents of which nothing is left go."""
    return phrase_automata.cleaned(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes training sequences."""
    return window_packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup),
          ("substring dedup", substring_dedup), ("packing", packing)]

#: The near-dedup stage hashes with XXH64 and packing runs a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"{i}-{name.replace(' ', '-')}")
    return docs
