"""Stale-answer traps and report figures: does an answer give the current fact, repeat the old one, and say that it is old?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any_in(text: Column, needles: Column) -> Column:
    return F.exists(needles, lambda n: F.lower(text).contains(F.lower(n)))


def said(results: DataFrame, findings: DataFrame, points: DataFrame) -> DataFrame:
    """All that an engine said, one row for each text: (trap, text, disputed, superseded, ended, outdated).

    ``results``: trap, title, snippet, outdated. ``findings``: trap, text, superseded_by, valid_until.
    ``points`` (disputed ones): trap, text.
    """
    no = F.lit(False)
    rows = lambda df, text, **flags: df.select("trap", text.alias("text"), *(flags.get(f, no).alias(f) for f in ("disputed", "superseded", "ended", "outdated")))
    out = rows(results, F.concat_ws(" ", "title", "snippet"), outdated=F.coalesce("outdated", no))
    out = out.unionByName(rows(findings, F.col("text"), superseded=F.col("superseded_by").isNotNull(), ended=F.col("valid_until").isNotNull()))
    return out.unionByName(rows(points, F.col("text"), disputed=F.lit(True)))


def score_traps(traps: DataFrame, answers: DataFrame, cues: list[str]) -> DataFrame:
    """Outcome of every trap (trap, cohort, current, stale: arrays of markers) by what was said (``said``).

    A trap is passed if the current answer is given and the old one is flagged: by its structure
    (disputed, superseded, ended or outdated), or by a text with a cue where the old answer
    is repeated. A trap without any answer is an error and is not passed. All flags are maxima over rows,
    so an answer of any length is aggregated before it moves.
    """
    text = F.coalesce("text", F.lit(""))
    cue = F.lit(False)
    for c in cues:
        cue = cue | F.lower(text).contains(c.lower())
    rows = traps.join(answers, "trap", "left").withColumns({"c": _any_in(text, F.col("current")), "s": _any_in(text, F.col("stale")), "q": cue})
    top = lambda c: F.coalesce(F.max(c), F.lit(False))
    signs = ("disputed", "superseded", "ended", "outdated")
    out = rows.groupBy("trap", "cohort").agg(
        (F.count("text") == 0).alias("error"), top(F.col("c")).alias("surfaces_current"), top(F.col("s")).alias("repeats_stale"), top(F.col("q")).alias("cued"), *(F.count_if(F.col(f)).alias(f) for f in signs)
    )
    structural = F.greatest(*signs) > 0
    out = out.withColumns({"flagged_structurally": structural, "flags_stale": structural | (F.col("repeats_stale") & F.col("cued"))})
    return out.withColumns({"passes": F.col("surfaces_current") & F.col("flags_stale"), "silent_stale": F.col("repeats_stale") & ~F.col("flags_stale")}).drop("cued")


def verdict(rates: DataFrame, bar: float = 0.70) -> DataFrame:
    """Pass, fail or not_evaluated by cohort from ``evaluate.trap_rates`` with ``answered``, the number of traps with an answer."""
    return rates.withColumn("verdict", F.when(F.col("answered") == 0, "not_evaluated").when(F.col("passed") >= bar, "pass").otherwise("fail"))


def share_found(text: Column, needles: Column) -> Column:
    """Share of needles that stand in a text, in any case; null without needles."""
    return F.when(F.size(needles) > 0, F.round(F.size(F.filter(needles, lambda n: F.lower(text).contains(F.lower(n)))) / F.size(needles), 4))


def report_scores(tasks: DataFrame, reports: DataFrame) -> DataFrame:
    """(task, kind, coverage, source_recall, contradiction_recall, citation_accuracy) of reports by their tasks.

    ``tasks``: task, points, hints, disputes (arrays). ``reports``: task, kind, text, urls, disputed (text), findings, cited (counts).
    """
    return tasks.join(reports, "task").select(
        "task",
        "kind",
        share_found(F.col("text"), F.col("points")).alias("coverage"),
        share_found(F.array_join("urls", " "), F.col("hints")).alias("source_recall"),
        share_found(F.col("disputed"), F.col("disputes")).alias("contradiction_recall"),
        F.when(F.col("findings") > 0, F.round(F.col("cited") / F.col("findings"), 4)).alias("citation_accuracy"),
    )


def benchmark_means(scores: DataFrame) -> DataFrame:
    """Means by kind (search against research), over the tasks that have a figure."""
    return scores.groupBy("kind").agg(F.count(F.lit(1)).alias("tasks"), *(F.round(F.avg(c), 4).alias(c) for c in ("coverage", "source_recall", "contradiction_recall", "citation_accuracy")))


def claim_accuracy(claims: DataFrame, provenance: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row: claims, orphans (found nowhere), mean overlap with their best source text, share of 0.5 or more, share from relevant chunks, disputed share.

    ``claims``: claim, tokens, disputed. ``provenance``: claim, chunk, tokens of the chunk. ``relevant``: chunk.
    """
    own = claims.select("claim", F.col("tokens").alias("own"), "disputed")
    near = own.join(provenance, "claim", "left").join(relevant.select("chunk").distinct().withColumn("good", F.lit(1)), "chunk", "left")
    share = F.when(F.size("own") > 0, F.size(F.array_intersect("own", "tokens")) / F.size(F.array_distinct("own")))
    best = near.groupBy("claim").agg(F.max(share).alias("overlap"), F.max("good").alias("good"), F.first("disputed").alias("disputed"), F.count("chunk").alias("chunks"))
    mean = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return best.agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if(F.col("chunks") == 0).alias("orphans"),
        F.round(F.avg("overlap"), 4).alias("overlap"),
        mean(F.col("overlap") >= 0.5).alias("well_grounded"),
        mean(F.col("good") == 1).alias("from_relevant"),
        mean(F.col("disputed")).alias("disputed"),
    )


def ablation_deltas(figures: DataFrame, stages: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """Figures (stage, metrics) in the order of the stages, each with its difference to the stage before."""
    from pyspark.sql import Window

    place = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    order = Window.orderBy("place")  # one row for each stage
    return figures.withColumn("place", place).withColumns({f"{m}_delta": F.round(F.col(m) - F.lag(m).over(order), 4) for m in metrics})
