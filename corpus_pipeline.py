"""The corpus pipeline: stages over ``documents``, each calling one training-data operator.

A stage takes (spark, docs, sf_dir), where ``docs`` has the columns of ``documents`` as its
predecessor left them, and returns those columns, the last one token digests. ``run`` writes
every stage's rows to the shared folder and reads them back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keelson.llm import bpe, decontaminate, language, secrets, simhash
from keelson.llm.common import cut, tables, tune


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    tune(spark)
    return language.keep_identified(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    tune(spark)
    return simhash.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    tune(spark)
    return decontaminate.drop_contaminated(docs, tables(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced in their text."""
    tune(spark)
    return secrets.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each document."""
    tune(spark)
    return bpe.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identified),
    ("near_dedup", one_of_each),
    ("decontaminate", clean_of_benchmark),
    ("secrets", without_secrets),
    ("bpe", encoded),
]

#: Language prediction and tokenisation have no SQL; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
