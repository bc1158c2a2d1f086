"""From raw documents to packed training tokens: five stages, each a table read by the next one.

Quality rules reject documents; of each group of near-duplicates one stays; documents that hold a
benchmark passage go; sources are mixed to their target weights, a document that the mix reads twice
being there twice; what is left is written as bit-packed token files, and the rows name its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, mixing, nearduplicates, quality, tokens
from tidemark.llm.common import benchmark, documents, settle


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearduplicates.keep_one(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, benchmark(spark, sf_dir))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.taken_documents(docs)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.packed(docs)


STAGES = [("quality", _quality), ("near_duplicates", _near_duplicates), ("decontamination", _decontamination),
          ("mixing", _mixing), ("tokens", _tokens)]

# Near-duplicate components, hash orders and a tokenizer have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; rows of the last one."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
