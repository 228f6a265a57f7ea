"""Answers: a sentence for each claim, with the sources that hold it and those that dispute it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Claims of one answer at most.
MOST_CLAIMS = 6
#: The wording of a disputed point.
DISPUTE = ("Sources disagree on this: some hold that ", " ", ", while others contradict it ", ".")


def sides(evidence: DataFrame, provenance: DataFrame) -> DataFrame:
    """(claim, source, side) of edges (claim, source, relation): 0 supports, 1 contradicts.

    A claim that nothing supports is supported by the sources (claim, source) it was found in.
    """
    told = evidence.where("relation in ('supports', 'contradicts')").select("claim", "source", F.when(F.col("relation") == "supports", 0).otherwise(1).alias("side")).distinct()
    held = told.where("side = 0").select("claim").distinct()
    found = provenance.select("claim", "source").distinct().join(held, "claim", "left_anti").withColumn("side", F.lit(0))
    return told.unionByName(found)


def ranked(claims: DataFrame, most: int = MOST_CLAIMS) -> DataFrame:
    """Claims (answer, claim, text, confidence, disputed) with ``place`` in their answer: disputed ones first, then the surest."""
    order = Window.partitionBy("answer").orderBy(F.desc("disputed"), F.desc(F.coalesce("confidence", F.lit(0.0))), "claim")
    return claims.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def labelled(claims: DataFrame, told: DataFrame) -> DataFrame:
    """(answer, claim, source, side, label): the sources of an answer numbered by the first claim that refers to them, supporting ones first."""
    rows = claims.select("answer", "claim", "place").join(told, "claim")
    first = rows.groupBy("answer", "source").agg(F.min(F.struct("place", "side", "source")).alias("first"))
    numbers = first.select("answer", "source", F.row_number().over(Window.partitionBy("answer").orderBy("first")).alias("label"))  # a few sources for each answer
    return rows.join(numbers, ["answer", "source"]).select("answer", "claim", "source", "side", "label")


def _marks(labels: Column) -> Column:
    return F.array_join(F.transform(labels, lambda n: F.concat(F.lit("[S"), n.cast("string"), F.lit("]"))), "")


def cited(text: Column, labels: Column) -> Column:
    """A sentence with its sources; it gets a full stop if it ends without a mark."""
    body = F.rtrim(text)
    return F.concat(body, F.when((body == "") | body.rlike(r"[.!?]$"), F.lit("")).otherwise(F.lit(".")), F.lit(" "), _marks(labels))


def synthesized(claims: DataFrame, told: DataFrame, most: int = MOST_CLAIMS) -> DataFrame:
    """(answer, text, claims, disputed, sources) for each answer of ``claims`` (answer, claim, text, confidence, disputed).

    ``told`` comes from ``sides``. Claims without a source are left out; a disputed claim with sources on both sides says so.
    """
    best = ranked(claims, most)
    labels = labelled(best, told)
    side = lambda n: F.array_sort(F.collect_list(F.when(F.col("side") == n, F.col("label"))))
    sources = labels.groupBy("answer", "claim").agg(side(0).alias("held"), side(1).alias("against"))
    rows = best.join(sources, ["answer", "claim"])
    split = F.col("disputed") & (F.size("against") > 0)
    a, b, c, d = (F.lit(x) for x in DISPUTE)
    both = F.concat(a, F.regexp_replace("text", r"\.+$", ""), b, _marks(F.col("held")), c, _marks(F.col("against")), d)
    rows = rows.withColumn("sentence", F.when(split, both).when(F.size("held") > 0, cited(F.col("text"), F.col("held"))))
    listed = F.array_sort(F.collect_list(F.when(F.col("sentence").isNotNull(), F.struct("place", "sentence"))))
    answers = rows.groupBy("answer").agg(listed.alias("s"), F.count_if(split).alias("disputed"))
    counts = labels.groupBy("answer").agg(F.count_distinct("source").alias("sources"))
    return answers.join(counts, "answer").select("answer", F.array_join(F.col("s.sentence"), " ").alias("text"), F.size("s").cast("long").alias("claims"), "disputed", "sources")


def validated(text: Column, known: Column) -> Column:
    """The sentences of an answer that cite at least one of the ``known`` source numbers."""
    parts = F.split(F.trim(text), r"(?<=[.!?\]])\s+(?=[^\[\s])")
    cites = lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"\[S(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))
    return F.array_join(F.transform(F.filter(parts, lambda s: F.arrays_overlap(cites(s), known)), lambda s: F.trim(s)), " ")


def staleness_note(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: how many claims (disputed, superseded_by) are disputed or superseded, and how many hits (outdated) are of an old version."""
    a = claims.agg(F.count_if("disputed").alias("disputed"), F.count("superseded_by").alias("superseded"))
    return a.join(hits.agg(F.count_if("outdated").alias("outdated")), F.lit(True))  # one row each
