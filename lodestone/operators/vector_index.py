"""An inverted-file index of vectors: lists around trained centroids, probed by query.

Centroids are trained by a few rounds of k-means on the driver, on a sample bounded by
``SAMPLE`` rows. Every vector goes into the list of its nearest centroid, and lists are
written as folders, so a probe reads the folders it needs. A query probes the lists whose
centroids are nearest. How many it takes is measured when the index is built: for ``TRIALS`` of the
vectors, the lists that hold their exact neighbours are looked up, and as many lists are probed as
give the recall asked for (in few dimensions, or with clusters, a few; among unrelated vectors, many).
A batch of queries is dealt to its lists, and each part of a list
multiplies its rows by the queries dealt to it and keeps the best of each.

The index is kept in versions (``lodestone.versions``): ``add`` replaces the vectors of given ids,
``prune`` drops vectors whose id or model is no longer wanted. Both leave the same rows that a
rebuild around the same centroids would make. Null vectors are not indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.ranking import Best, _unit, neighbours
from lodestone.tables import written
from lodestone.versions import Versions

#: Rows that train the centroids at most, and lists at most.
SAMPLE, MOST_LISTS = 20_000, 4096
#: Rows of one list that one task scores, about; longer lists are split.
PART_ROWS = 50_000
#: Vectors that measure how many lists to probe, at most, and the recall of ten hits that it must give.
TRIALS, RECALL = 256, 0.95
_SCHEMA = "id long, vector array<double>, model string, list int"


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def centroids(vectors: DataFrame, rows: int, lists: int | None = None, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Centres of ``lists`` lists (about the square root of the rows), trained on rows chosen by a hash of the id."""
    lists = lists or int(min(MOST_LISTS, max(1, round(rows**0.5))))
    share = int(min(1.0, sample / max(rows, 1)) * (1 << 40))
    some = vectors.where(F.pmod(F.xxhash64("id", F.lit("centroids")), F.lit(1 << 40)) < share).limit(2 * sample).toArrow()
    x = _normal(_unit(some["vector"].combine_chunks())[np.argsort(some["id"].to_numpy())]) if some.num_rows else np.zeros((0, 1))
    if not len(x):
        return np.zeros((0, 1))
    centres = x[np.random.default_rng(5).choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([(x[a : a + 2048] @ centres.T).argmax(1) for a in range(0, len(x), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        sums[np.bincount(nearest, minlength=len(centres)) == 0] = x[0]
        centres = _normal(sums)
    return centres


class VectorIndex:
    """The index under ``root``; ``vectors`` have id, vector and model everywhere."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)

    def _centres(self) -> np.ndarray:
        rows = self.versions.read("centroids").orderBy("list").toArrow()  # MOST_LISTS rows at most
        return _unit(rows["centre"].combine_chunks()) if rows.num_rows else np.zeros((0, 1))

    def _listed(self, vectors: DataFrame, centres: np.ndarray) -> DataFrame:
        def run(batches):
            for batch in batches:
                x = _unit(batch["vector"])
                near = (_normal(x) @ centres.T).argmax(1) if len(x) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch["id"], batch["vector"], batch["model"], pa.array(near.astype(np.int32))], ["id", "vector", "model", "list"])

        return vectors.where("vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.col("model").cast("string").alias("model")).mapInArrow(run, _SCHEMA)

    def _dealt(self, listed: DataFrame) -> DataFrame:
        """Few files for each list: a list is written by one task, or by several if it is long (Spark splits them)."""
        return listed.hint("rebalance", "list")

    def build(self, vectors: DataFrame, lists: int | None = None, recall: float = RECALL) -> None:
        """Trains centroids, lists every vector and measures how many lists give ``recall``."""
        known = vectors.where("vector IS NOT NULL")
        centres = centroids(known.select("id", "vector"), known.count(), lists)
        if not len(centres):
            centres = np.zeros((1, 1))
            known = known.where(F.lit(False))
        table = self.spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "list int, centre array<double>")
        self.versions.commit({"centroids": self.versions.write(table, "centroids"), "lists": self.versions.write(self._dealt(self._listed(known, centres)), "lists", "list")})
        self.versions.commit({}, notes={"probes": self._measured(recall)})

    def _measured(self, recall: float, k: int = 10) -> int:
        """The smallest number of probes with the recall asked for, over ``TRIALS`` indexed vectors."""
        rows, centres = self.rows(), self._centres()
        share = int(min(1.0, TRIALS / max(rows.count(), 1)) * (1 << 40))
        trials = written(rows.where(F.pmod(F.xxhash64("id", F.lit("trials")), F.lit(1 << 40)) < share).limit(2 * TRIALS).select(F.col("id").alias("query_id"), "vector"), "trials")
        hits = neighbours(rows, trials, k, "id", "vector").select("query_id", "id")
        held = hits.join(rows.select("id", "list"), "id").groupBy("query_id").agg(F.collect_list("list").alias("lists"))  # k for each trial
        near = held.join(trials, "query_id").toArrow()
        if not near.num_rows:
            return len(centres)
        order = np.argsort(-(_normal(_unit(near["vector"].combine_chunks())) @ centres.T), axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        needed = np.sort(np.concatenate([place[i, lists] for i, lists in enumerate(near["lists"].to_pylist())])) + 1
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])

    def add(self, vectors: DataFrame) -> None:
        """New vectors; an id that is there already gets the new one. An id that comes twice has its last vector in the order of its numbers."""
        order = Window.partitionBy("id").orderBy(F.desc("vector"), "model")
        vectors = vectors.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        new = self.versions.write(self._listed(vectors, self._centres()).select("id", "vector", "model", "list"), "incoming")
        fresh = self.spark.read.schema(new["schema"]).parquet(*new["folders"])
        self._replace(self.versions.read("lists").join(fresh.select("id"), "id", "left_anti").unionByName(fresh, allowMissingColumns=True))

    def prune(self, live: DataFrame, model: str | None = None) -> None:
        """Drops vectors whose id is not in ``live`` (id), or that another model made."""
        kept = self.versions.read("lists").join(live.select("id"), "id", "left_semi")
        self._replace(kept if model is None else kept.where(F.col("model") == model))

    def stale(self, model: str) -> DataFrame:
        """Ids whose vectors another model made."""
        return self.versions.read("lists").where(~F.col("model").eqNullSafe(F.lit(model))).select("id")

    def _replace(self, rows: DataFrame) -> None:
        self.versions.commit({"lists": self.versions.write(self._dealt(rows.select("id", "vector", "model", "list")), "lists", "list")})

    def rows(self) -> DataFrame:
        return self.versions.read("lists").select("id", "vector", "model", "list")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): the k best of the ``probes`` lists nearest to each query (query_id, vector); without it, as many as were measured."""
        centres = self._centres()
        probes = probes or self.versions.manifest()["notes"].get("probes", len(centres))
        lists = self.rows()
        kind = queries.schema["query_id"].dataType.simpleString()

        def aim(batches):
            for batch in batches:
                x = _unit(batch["vector"])
                near = np.argsort(-(_normal(x) @ centres.T), axis=1, kind="stable")[:, :probes] if len(x) else np.zeros((0, 1), int)
                owner = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([batch["query_id"].take(owner), batch["vector"].take(owner), pa.array(near.ravel().astype(np.int32))], ["query_id", "vector", "list"])

        asked = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(aim, f"query_id {kind}, vector array<double>, list int")
        asked = written(asked, "probes")
        aimed = sorted(r["list"] for r in asked.select("list").distinct().collect())  # MOST_LISTS at most; other folders are not read
        lists = lists.where(F.col("list").isin(aimed)) if len(aimed) < len(centres) else lists
        # long lists are split into parts, and every part meets all queries of its list
        sizes = lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
        left = lists.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("list", "part", "id", "vector")
        right = asked.join(F.broadcast(sizes), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "part", "query_id", "vector")

        def score(own: pa.Table, asked: pa.Table) -> pa.Table:
            names = asked["query_id"].combine_chunks()
            best = Best(asked.num_rows, k)
            if own.num_rows and asked.num_rows:
                ids, x, q = own["id"].to_numpy(), _unit(own["vector"].combine_chunks()), _unit(asked["vector"].combine_chunks())
                for a in range(0, len(q), 512):
                    for b in range(0, len(x), 2048):
                        best.add(ids[b : b + 2048], np.round(x[b : b + 2048] @ q[a : a + 512].T, 6), np.arange(a, min(a + 512, len(q))))
            query, points, ids = best.cut()
            return pa.table([names.take(pa.array(query)), pa.array(ids.astype(np.int64)), pa.array(points)], ["query_id", "id", "score"])

        found = left.groupBy("list", "part").cogroup(right.groupBy("list", "part")).applyInArrow(score, f"query_id {kind}, id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, wanted, found, recall): how many of the k exact hits of each query were found."""
    want = exact.where(F.col("rank") <= k).select("query_id", "id")
    got = found.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit"))
    out = want.join(got, ["query_id", "id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))
    return out.withColumn("recall", F.round(F.col("found") / F.col("wanted"), 4))
