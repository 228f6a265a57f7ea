"""Accounts: what a call costs, whether it may run, what is left, and where it went; feedback targets and cached answers."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.usage import research_cost, rolled

#: Credits by route, and routes that cost nothing.
COSTS = {"/search": 1, "/search/stream": 1, "/v1/web_search": 1, "/v1/extract": 1, "/research": 10, "/research/stream": 10}
FREE_PREFIXES = (
    "/health", "/contract", "/v1/tools", "/usage", "/account", "/signup", "/docs", "/redoc", "/openapi", "/source/", "/chunk/", "/claim/",
    "/graph", "/research/",
)
FREE_CREDITS = 1000
#: Handles of one feedback call that are read.
MOST_TARGETS = 50


def cost_for_path(path: Column, steps: Column | None = None, urls: Column | None = None) -> Column:
    """Credits of a call: by exact route first, research by its steps, extraction by its URLs; free routes and unknown ones cost nothing."""
    pairs = [F.lit(x) for kv in COSTS.items() for x in kv]
    plain = F.try_element_at(F.create_map(*pairs), path)
    by = F.when(path.isin("/research", "/research/stream"), research_cost(steps)) if steps is not None else F.lit(None).cast("int")
    by = F.coalesce(by, F.when(path == "/v1/extract", F.greatest(urls, F.lit(1)))) if urls is not None else by
    return F.coalesce(by, plain, F.lit(0)).cast("int")


def is_free(path: Column) -> Column:
    out = F.lit(False)
    for prefix in FREE_PREFIXES:
        out = out | path.startswith(prefix)
    return out & ~path.isin(*COSTS)


def admission(calls: DataFrame) -> DataFrame:
    """Adds ``verdict`` to calls (known, revoked, requests, quota, used, included, cost, in_window, rate): the first rule that a call breaks.

    The order is key, request quota, credits, rate; an account without an allowance (``included`` is null) is unmetered.
    """
    over = F.col("included").isNotNull() & (F.col("used") + F.col("cost") > F.col("included")) & (F.col("cost") > 0)
    rule = F.when(~F.coalesce("known", F.lit(False)) | F.coalesce("revoked", F.lit(False)), "invalid_key").when(F.col("quota").isNotNull() & (F.col("requests") >= F.col("quota")), "quota_exceeded")
    return calls.withColumn("verdict", rule.when(over, "credits_exhausted").when(F.col("in_window") >= F.col("rate"), "rate_limited").otherwise("ok"))


def charged(ledger: DataFrame, calls: DataFrame) -> DataFrame:
    """The ledger (key, day, endpoint, calls, credits) after calls (key, day, endpoint, credits); sums are partial aggregations, so a key with a third of the calls is no single task."""
    more = calls.select("key", "day", "endpoint", F.lit(1).cast("long").alias("calls"), F.col("credits").cast("long").alias("credits"))
    return ledger.unionByName(more).groupBy("key", "day", "endpoint").agg(F.sum("calls").alias("calls"), F.sum("credits").alias("credits"))


def account_view(accounts: DataFrame, as_of: str) -> DataFrame:
    """Accounts (key, period_start, used, included) as their owners see them: the period begun anew if it is over, and what remains (null: unmetered)."""
    return rolled(accounts, as_of).withColumn("remaining", F.when(F.col("included").isNotNull(), F.greatest(F.col("included") - F.col("used"), F.lit(0))))


def parse_targets(handles: Column) -> Column:
    """Array of (kind, number) of the handles chk_N and doc_N among the first fifty."""
    good = F.filter(F.slice(handles, 1, MOST_TARGETS), lambda h: h.rlike(r"^(?:chk|doc)_\d+$"))
    return F.transform(good, lambda h: F.struct(F.substring(h, 1, 3).alias("kind"), F.substring_index(h, "_", -1).cast("long").alias("target")))


class Memo:
    """Answers kept by the content that they were made from, as Parquet: (key, stage, value). The last one put under a key counts."""

    SCHEMA = "key string, stage string, value string, at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def key(stage: Column, content: Column) -> Column:
        return F.sha2(F.concat_ws(":", stage, content), 256)

    def _rows(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)

    def put(self, rows: DataFrame) -> None:
        """Rows (stage, content, value)."""
        rows.select(self.key(F.col("stage"), F.col("content")).alias("key"), "stage", "value", F.current_timestamp().alias("at")).write.mode("append").parquet(self.path)

    def get(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (stage, content) with ``value``, null where nothing is kept."""
        last = self._rows().groupBy("key").agg(F.max_by("value", "at").alias("value"))
        return wanted.withColumn("key", self.key(F.col("stage"), F.col("content"))).join(last, "key", "left").drop("key")

    def stats(self) -> DataFrame:
        """Entries and distinct keys of each stage."""
        return self._rows().groupBy("stage").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("key").alias("keys"))


@dataclass
class Timings:
    """Seconds of the stages of one request, and whether they keep within a budget."""

    budget: float | None = None
    seconds: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    @property
    def over_budget(self) -> bool:
        return self.budget is not None and sum(self.seconds.values()) > self.budget


def frames(rows: DataFrame, kind: str):
    """Server-sent event frames, one for each row as it comes, then ``done``; an error ends them with ``error``. Rows are fetched a partition at a time."""
    import json

    try:
        for row in rows.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
            yield f"event: {kind}\ndata: {row['j']}\n\n"
    except Exception as e:  # noqa: BLE001  what the reader of a stream must be told
        yield f"event: error\ndata: {json.dumps({'message': type(e).__name__})}\n\n"
        return
    yield "event: done\ndata: {}\n\n"
