"""Streams with state of their own: rate limits, the last requests of a route, and ingest into a stored table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.sources import upsert


def rate_limited(calls: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Decisions (key, id, at, allowed) on a stream of calls (key, at, id): at most ``limit`` allowed ones in any window.

    State is the allowed calls of one window for each key, so at most ``limit`` times; it goes when a key
    has been silent for a window after the watermark. Calls of one batch are decided in the order of
    time and id; a call that comes later than the watermark is dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        allowed = []
        for t in rows["at"].astype("datetime64[us]").astype("int64"):
            recent = [x for x in recent if t - x < seconds * 1_000_000]
            allowed.append(len(recent) < limit)
            if allowed[-1]:
                recent.append(int(t))
        state.update((recent,))
        state.setTimeoutTimestamp(int(rows["at"].max().timestamp() * 1000) + seconds * 1000 + max(0, state.getCurrentWatermarkMs() - int(rows["at"].max().timestamp() * 1000)) + 1)
        yield rows.assign(key=key[0], allowed=allowed)[["key", "id", "at", "allowed"]]

    kinds = dict(calls.dtypes)
    out = f"key {kinds['key']}, id {kinds['id']}, at {kinds['at']}, allowed boolean"
    return calls.withWatermark("at", f"{seconds} seconds").groupBy("key").applyInPandasWithState(step, out, "recent array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def last_requests(log: DataFrame, last: int = 500) -> DataFrame:
    """After each batch, for each route with new requests: (route, requests, p50, p95, slowest, ok, failed) over its last ones.

    ``log``: route, at, id, ms, status. State is the last ``last`` requests of a route.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get)) if state.exists else []
        for pdf in batches:  # batch by batch, so that a busy route never holds more than a batch and its last requests
            kept += list(zip(pdf["at"].astype("datetime64[us]").astype("int64").tolist(), pdf["id"].tolist(), pdf["ms"].tolist(), pdf["status"].tolist()))
            kept = sorted(kept, key=lambda r: r[:2])[-last:]
        state.update(tuple(list(c) for c in zip(*kept)))
        ms, status = sorted(r[2] for r in kept), [r[3] for r in kept]
        rank = lambda p: ms[round(p * (len(ms) - 1))]  # noqa: E731  half to even
        yield pd.DataFrame([(key[0], len(ms), rank(0.5), rank(0.95), ms[-1], sum(s < 300 for s in status), sum(s >= 500 for s in status))], columns=["route", "requests", "p50", "p95", "slowest", "ok", "failed"])

    out = "route string, requests long, p50 double, p95 double, slowest double, ok long, failed long"
    return log.select("route", "at", F.col("id").cast("long"), F.col("ms").cast("double"), F.col("status").cast("int")).groupBy("route").applyInPandasWithState(
        step, out, "at array<long>, id array<long>, ms array<double>, status array<int>", "update", GroupStateTimeout.NoTimeout
    )


class Store:
    """A table of documents kept as one folder for each version; readers take the last whole one, so a batch that dies leaves nothing half done."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _versions(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        done = [s.getPath() for s in fs.listStatus(at) if s.isDirectory()]
        return sorted(int(p.getName()[1:]) for p in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{p.toString()}/_SUCCESS")))

    def read(self) -> DataFrame:
        have = self._versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{have[-1]}") if have else self.spark.createDataFrame([], self.schema)


def ingest(stream: DataFrame, store: Store, key: str, hash_col: str, order: str, refreshed: tuple[str, ...], checkpoint: str) -> None:
    """Upserts a stream of documents into a store, all that is available now; of a key's rows in one batch the last by ``order`` counts.

    A version is named after its batch, so a batch that runs again writes the same version again.
    """
    columns = store.read().columns

    def put(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select("r.*")
        old = [v for v in store._versions() if v < epoch]
        before = store.spark.read.schema(store.schema).parquet(f"{store.path}/v{old[-1]}") if old else store.spark.createDataFrame([], store.schema)
        upsert(before, newest, key, hash_col, refreshed).select(*columns).write.mode("overwrite").parquet(f"{store.path}/v{epoch}")

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
