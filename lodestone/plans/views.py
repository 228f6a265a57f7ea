"""The roles that the tables of a data folder play for the engine, as DataFrames. Both engines build them with the same arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import load

AS_OF = "2026-01-01 00:00:00"
#: Source types in the order in which document ids take them.
KINDS = ("docs", "github_release", "blog", "github_pr", "so_answer", "github_issue", "github_comment", "hn_story", "so_question", "reddit_post")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 10 + 1).cast("int"))
    role = F.when(F.col("doc_id") % 7 == 0, "maintainer").when(F.col("doc_id") % 7 == 1, "contributor").otherwise("none")
    day = F.date_add(F.lit("2016-01-01").cast("date"), (F.col("doc_id") % 3650).cast("int"))
    published = F.when(F.col("doc_id") % 11 != 0, day.cast("timestamp"))
    return load(spark, sf_dir, "documents").withColumns({"source_type": kind, "author_role": role, "popularity": F.col("n_chars"), "published_at": published, "accepted": F.col("doc_id") % 13 == 0})


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "supports").when(F.col("event_type") == "error", "contradicts").otherwise("explains")
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("claim"), (F.col("event_id") % 50).alias("source"), kind.alias("relation"), (0.35 + 0.05 * (F.col("event_id") % 13)).alias("trust"), F.least(F.col("value") / 200, F.lit(1.0)).alias("strength")
    )


def user_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")


def bench_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's passages as a batch of queries."""
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of the searches: every vector whose id is divisible by 20."""
    return load(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are part of regions, suppliers of nations."""
    nation = load(spark, sf_dir, "nation").select((F.col("n_nationkey") * 2).cast("long").alias("edge"), F.concat(F.lit("n"), "n_nationkey").alias("subject"), F.concat(F.lit("r"), "n_regionkey").alias("object"))
    supplier = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).cast("long").alias("edge"), F.concat(F.lit("s"), "s_suppkey").alias("subject"), F.concat(F.lit("n"), "s_nationkey").alias("object"))
    return nation.unionByName(supplier).withColumn("kind", F.lit("part-of"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    return load(spark, sf_dir, "events").select(F.col("event_type").alias("route"), F.col("ts").alias("at"), F.col("value").alias("ms"), status.alias("status"), F.col("event_id").alias("id"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    credits = F.when(F.col("event_type") == "purchase", 10).when(F.col("event_type") == "view", 0).otherwise(1)
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.to_date("ts").alias("day"), F.col("event_type").alias("endpoint"), credits.cast("long").alias("credits"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = F.when(F.col("event_type") == "purchase", "cited").when(F.col("event_type") == "click", "fetched").when(F.col("event_type") == "signup", "helpful").when(F.col("event_type") == "error", "unhelpful").otherwise("ignored")
    kind = F.when(F.col("event_id") % 3 == 0, "doc").otherwise("chk")
    rows = load(spark, sf_dir, "events").select(kind.alias("kind"), (F.col("event_id") % 200).alias("target"), signal.alias("signal"))
    return rows.groupBy("kind", "target", "signal").agg(F.count(F.lit(1)).alias("count"))
