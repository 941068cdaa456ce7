"""Corpus pipeline: stages over ``documents``, each calling an operator of ``reviewlens.llm``.

Every stage takes what its predecessor kept, with the columns of ``documents``;
only the last returns tokens instead. Stages keep all rows they do not reject.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reviewlens.llm import bpe, mixing, rule_ensemble, simhash, toxicity
from reviewlens.llm.common import prepare, stored, table
from reviewlens.llm.queries import (
    MIX_WEIGHTS, QUALITY_FOLDS, QUALITY_HELD_OUT, QUALITY_THRESHOLD, TOXIC_FOLDS, TOXIC_HELD_OUT, TOXIC_THRESHOLD,
)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    prepare(spark)
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels"), "quality", QUALITY_FOLDS, QUALITY_HELD_OUT)
    return rule_ensemble.accepted(docs, model, QUALITY_THRESHOLD)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    prepare(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", TOXIC_FOLDS, TOXIC_HELD_OUT)
    return toxicity.clean(docs, model, TOXIC_THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the smallest id."""
    prepare(spark)
    return simhash.keep_one(docs, size=4, max_bits=4)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the sources' target weights, in shuffled order."""
    prepare(spark)
    return mixing.mixed_rows(docs, MIX_WEIGHTS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit), their number and digests per document."""
    prepare(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality", quality), ("non_toxic", non_toxic), ("near_dedup", near_dedup), ("source_mix", source_mix),
          ("tokenize", tokenize)]

# Classifier fits, component labels and byte-pair merges are loops that SQL does
# not express; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written as Parquet and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
