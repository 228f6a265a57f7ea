"""A training corpus from raw documents, in five stages.

Language ID, exact dedup, near-duplicate join, benchmark decontamination and source mixing.
Each stage takes what the one before wrote and works on all of it. The first four return the
columns of ``documents``; the last returns the mix, one row per document, in training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, exact_dedup, language_id, mixing, ngram_join
from lodestone.llm.store import stored
from lodestone.session import load

#: Documents whose language is less sure than this go, as do those without a letter.
LEAST_SCORE = 0.1


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without text or letters, and those whose language can't be told."""
    return language_id.identified(docs, language_id.train(docs), LEAST_SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id stays."""
    return exact_dedup.exact_dedup_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 on five-word shingles, the row with the smallest id stays; rows are told apart by themselves, not by their ids."""
    return ngram_join.distinct_rows(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark passage go."""
    return decontaminate.without_leaks(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, in the order of training."""
    plan = mixing.mix(docs).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken", "position")
    return plan.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


STAGES = [
    ("language_id", keep_identified),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
]

#: Language ID, near duplicates and SimHash can't be told in SQL. Tests hold the operators of stages 2 to 5 to brute force, and the stages to listed ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name).df
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
