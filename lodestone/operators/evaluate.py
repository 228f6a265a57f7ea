"""Retrieval metrics, regression gates, stale-answer scoring, latency figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T


def graded(ranking: DataFrame, judgments: DataFrame) -> DataFrame:
    """Ranking rows (query_id, id, rank) with the best grade any judgment (query_id, id, grade) gives; 0 without one."""
    best = judgments.groupBy("query_id", "id").agg(F.max("grade").alias("grade"))
    return ranking.join(best, ["query_id", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def _gain(grade: Column, place: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(place + 1)


def retrieval_metrics(ranking: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """Precision, recall, nDCG at k and reciprocal rank of each query of the ranking.

    Precision divides by k. Recall and nDCG are null for a query without relevant judgments; the
    ideal order is that of all judged ids, each with its best grade.
    """
    best = judgments.groupBy("query_id", "id").agg(F.max("grade").alias("grade"))
    ideal = best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")))
    pool = ideal.groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("relevant"), F.sum(F.when(F.col("place") <= k, _gain(F.col("grade"), F.col("place")))).alias("best"))
    top = graded(ranking, judgments)
    hit = F.col("grade") > 0
    own = top.groupBy("query_id").agg(
        F.count_if(hit & (F.col("rank") <= k)).alias("hits"),
        F.coalesce(F.sum(F.when(F.col("rank") <= k, _gain(F.col("grade"), F.col("rank")))), F.lit(0.0)).alias("dcg"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
    )
    return own.join(pool, "query_id", "left").select(
        "query_id",
        F.round(F.col("hits") / k, 4).alias("precision"),
        F.when(F.col("relevant") > 0, F.round(F.least(F.lit(1.0), F.col("hits") / F.col("relevant")), 4)).alias("recall"),
        F.when(F.col("best") > 0, F.round(F.col("dcg") / F.col("best"), 4)).alias("ndcg"),
        F.coalesce(F.round(1 / F.col("first"), 4), F.lit(0.0)).alias("mrr"),
    )


def nearest_rank(values: Column, percent: float) -> Column:
    """The value at the rounded (half to even) place percent / 100 * (n - 1) of an array."""
    return F.get(F.array_sort(values), F.bround(F.lit(percent / 100) * (F.size(values) - 1)).cast("int"))


def request_figures(log: DataFrame, last: int = 500) -> DataFrame:
    """Per route over its last requests: count, median, p95, largest time, and counts by status class (route, at, ms, status, id)."""
    recent = log.withColumn("n", F.row_number().over(Window.partitionBy("route").orderBy(F.desc("at"), F.desc("id")))).where(F.col("n") <= last)
    return recent.groupBy("route").agg(
        F.count(F.lit(1)).alias("requests"),
        nearest_rank(F.collect_list("ms"), 50).alias("p50"),
        nearest_rank(F.collect_list("ms"), 95).alias("p95"),
        F.max("ms").alias("slowest"),
        F.count_if(F.col("status") < 300).alias("ok"),
        F.count_if(F.col("status") >= 500).alias("failed"),
    )


def gate(history: DataFrame, metrics: tuple[str, ...], least: float = 0.9) -> DataFrame:
    """Each run against the one before of its engine and version; ``regressed`` if a metric fell below its share."""
    w = Window.partitionBy("engine", "version").orderBy("at", "run")
    out = history.withColumns({f"previous_{m}": F.lag(m).over(w) for m in metrics})
    bad = F.lit(False)
    for m in metrics:
        bad = bad | F.coalesce(F.col(m) < least * F.col(f"previous_{m}"), F.lit(False))
    return out.withColumn("regressed", bad)


def trap_rates(outcomes: DataFrame) -> DataFrame:
    """Pass, current, flagged and silent-stale rates overall (cohort null) and by cohort (cohort, current, stale, flagged)."""
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return outcomes.groupingSets([["cohort"], []], "cohort").agg(
        F.count(F.lit(1)).alias("traps"),
        rate(F.col("current") & F.col("flagged")).alias("passed"),
        rate(F.col("current")).alias("current_rate"),
        rate(F.col("flagged")).alias("flagged_rate"),
        rate(F.col("stale") & ~F.col("flagged")).alias("silent_stale"),
    )


def coverage(text: Column, needles: Column) -> Column:
    """Share of needles that a text holds, null without needles."""
    found = F.size(F.filter(needles, lambda x: F.lower(text).contains(F.lower(x))))
    return F.when(F.size(needles) > 0, F.round(found / F.size(needles), 4))


def holding(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(id, item) of documents (id, text) whose text holds that of an item (item, text).

    A text that holds a passage has each of its inner words as a word of its own, so only documents
    with the passage's longest inner word are compared; ids meet first, texts follow. Passages of fewer than
    three words have no inner word and match nothing.
    """
    words = F.slice(T.tokens(F.col("text")), F.lit(2), F.greatest(F.size(T.tokens(F.col("text"))) - 2, F.lit(0)))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    wanted = items.select(item_col, F.col("text").alias("passage"), longest.alias("word")).where("word is not null")
    met = docs.select(id_col, F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).join(wanted.select(item_col, "word"), "word").select(id_col, item_col)
    return met.join(docs.select(id_col, "text"), id_col).join(wanted.select(item_col, "passage"), item_col).where(F.col("text").contains(F.col("passage"))).select(id_col, item_col).distinct()
