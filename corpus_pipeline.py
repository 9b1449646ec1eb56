"""A corpus pipeline of five stages: language, toxicity, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it to the shared folder as Parquet and
reads it again as the next stage's docs. All but the last return the columns of documents. Rows with nulls, repeated
rows, extra columns of any name and empty tables go through as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import bpe, common, language_evidence, language_id, mixing, ngram_join, toxicity

VOCABULARY = "word_bpe_49k.json"


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in learned languages, in one or in several, stay; those without a letter and in no such language go."""
    return language_evidence.accepted(docs, language_id.train(docs), language_evidence.train(docs))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def stage_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; of repeated rows, one."""
    return ngram_join.one_of_each(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", stage_language_id),
    ("toxicity", stage_toxicity),
    ("ngram_join", stage_ngram_join),
    ("mixing", stage_mixing),
    ("bpe", stage_bpe),
]
#: No stage of learned models or of splitting trees is SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.write_shared(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
