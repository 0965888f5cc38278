"""Training-corpus pipeline over ``documents``.

Five stages, each a corpus operator on all that its predecessor kept, written
as Parquet to the shared checkpoint folder and read again:

1. language: texts in which no language is found (null text, no letter) go;
2. exact: one row of each group of equal texts stays;
3. near: one row of each class of near-duplicate texts stays;
4. mix: rows are repeated to the source weights of the temperature mix;
5. tokens: rows become SentencePiece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabscale.llm import exact_dedup, lang_id, mixing, ngram_join, sentencepiece
from tabscale.llm.common import materialise, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]

ORACLE_SQL = None  # the language and token stages have no SQL form; tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; every stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
