"""Credits, feedback counters and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import fixed as C

PERIOD_DAYS = 30


def research_cost(steps: Column) -> Column:
    """10 credits with 6 steps, 5 for each more, 25 at most."""
    extra = F.greatest(F.coalesce(steps, F.lit(6)) - 6, F.lit(0))
    return F.least(F.lit(25), 10 + 5 * extra)


def usage_by(ledger: DataFrame) -> DataFrame:
    """Calls and credits per key by endpoint (day null) and by day (endpoint null), of (key, day, endpoint, credits)."""
    return ledger.groupingSets([["key", "endpoint"], ["key", "day"]], "key", "endpoint", "day").agg(F.count(F.lit(1)).alias("calls"), F.sum("credits").alias("credits"))


def rolled(accounts: DataFrame, as_of: str) -> DataFrame:
    """Accounts (period_start, used) with periods of 30 days begun anew where they are over."""
    over = F.col("period_start").isNull() | (F.lit(as_of).cast("timestamp") - F.col("period_start") >= F.expr(f"interval {PERIOD_DAYS} days"))
    return accounts.withColumns({"used": F.when(over, F.lit(0)).otherwise(F.col("used")), "period_start": F.when(over, F.lit(as_of).cast("timestamp")).otherwise(F.col("period_start"))})


def net_signal(feedback: DataFrame) -> DataFrame:
    """(kind, target, net): weighted counts of (kind, target, signal, count)."""
    pairs = [F.lit(x) for kv in C.SIGNAL_WEIGHTS.items() for x in kv]
    weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("signal")), F.lit(0.0))
    return feedback.groupBy("kind", "target").agg(F.sum(weight * F.col("count")).alias("net"))


def chunk_usefulness(chunks: DataFrame, net: DataFrame) -> DataFrame:
    """(chunk, net): a chunk's own signal and that of its document (chunk, document)."""
    own = net.where("kind = 'chk'").select(F.col("target").alias("chunk"), F.col("net").alias("own"))
    doc = net.where("kind = 'doc'").select(F.col("target").alias("document"), F.col("net").alias("shared"))
    return chunks.join(own, "chunk", "left").join(doc, "document", "left").select("chunk", (F.coalesce("own", F.lit(0.0)) + F.coalesce("shared", F.lit(0.0))).alias("net"))


def admitted(calls: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Adds ``allowed`` to calls (key, at, id): at most ``limit`` allowed ones in any window; rejected calls use no slot.

    Each decision hangs on the ones before, so a key's calls are walked in order, batch by batch
    of Arrow rows: after a sort by key and time a task keeps only the allowed calls of one window.
    """

    def walk(batches):
        key, recent = object(), []
        for pdf in batches:
            out = []
            for k, t in zip(pdf["key"], pdf["at"].astype("int64") // 1_000):
                if k != key:
                    key, recent = k, []
                recent = [x for x in recent if t - x < seconds * 1_000_000]
                out.append(len(recent) < limit)
                if out[-1]:
                    recent.append(t)
            yield pdf.assign(allowed=out)

    schema = ", ".join(f"{n} {t}" for n, t in calls.dtypes) + ", allowed boolean"
    return calls.repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(walk, schema)
