"""Live documents: a batch of fetched and evicted pages drives chunks, canonical ids, vectors and postings.

``LiveStore`` keeps five tables in versions: documents, chunks, canonical (id, canonical), vectors and the posting
blocks of ``KeywordIndex``. ``apply`` finds out what a batch changes, makes the chunks, vectors and postings of those documents
alone, and commits all tables as one version. A batch that is cut off before its commit leaves
nothing behind that a reader could see, and can be applied again. After any series of batches the
tables hold what one batch of the final documents would give.

Chunks of a document are numbered from its id, so ids stay the same however a document came in.
A refetched page whose content is the same keeps its chunks and is only marked as fetched. Rows are
added with the number of their version (``segment``) and outlived ones are listed (``gone``);
``compact`` writes the live rows anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import fixed as C
from lodestone.functions import text as T
from lodestone.functions.embed import Embedder, embedded
from lodestone.operators import evidence, sources
from lodestone.operators.keyword_index import KeywordIndex
from lodestone.tables import written
from lodestone.versions import Versions

#: Ordinals that a document's chunk ids leave room for, as a power of two.
ORDINAL_BITS = 20
_DOCUMENT = "document long, url string, title string, source_type string, published_at timestamp, text string, fetched_at timestamp, hash string, suspicious boolean, trust double, live boolean, deleted boolean, segment int"
_CHUNK = "id long, document long, ordinal int, heading string, text string, segment int"


def chunked(docs: DataFrame) -> DataFrame:
    """(id, document, ordinal, heading, text) of documents (document, text as markdown)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [((d << ORDINAL_BITS) + i, d, i, h, t) for d, x in zip(pdf["document"], pdf["text"]) for i, (h, t) in enumerate(T.chunks_of(x or ""))]
            yield pd.DataFrame(rows, columns=["id", "document", "ordinal", "heading", "text"])

    return docs.select("document", "text").mapInPandas(run, "id long, document long, ordinal int, heading string, text string")


def live_trust(docs: DataFrame, as_of: str) -> DataFrame:
    """Adds suspicious (signs of prompt injection) and trust, which is halved for suspicious text."""
    plain = evidence.trust(F.col("source_type"), F.lit("none"), F.lit(0), F.lit(False), F.col("published_at"), as_of)
    out = docs.withColumn("suspicious", F.size(sources.injection(F.col("text"))) > 0)
    return out.withColumn("trust", F.bround(plain * F.when(F.col("suspicious"), C.TRUST_PENALTY).otherwise(1.0), 4))


class LiveStore:
    """The store under ``root``."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder, as_of: str):
        self.spark, self.embedder, self.as_of = spark, embedder, as_of
        self.versions = Versions(spark, root)
        self.words = KeywordIndex(spark, root)

    # -- reading --------------------------------------------------------------

    def documents(self, number: int | None = None) -> DataFrame:
        """The newest row of each document that is not deleted."""
        rows = self.versions.read("documents", number)
        newest = rows.groupBy("document").agg(F.max_by(F.struct(*rows.columns), "segment").alias("r")).select("r.*")
        return newest.where("NOT deleted").drop("deleted", "segment")

    def _alive(self, name: str, number: int | None = None) -> DataFrame:
        return self.versions.read(name, number).join(self.versions.read("gone", number), ["id", "segment"], "left_anti")

    def chunks(self, number: int | None = None) -> DataFrame:
        """Live chunks, each with its canonical id (null if that is its own)."""
        rows = self._alive("chunks", number).drop("segment")
        names = self.versions.read("canonical", number).groupBy("id").agg(F.max_by("canonical", "segment").alias("canonical"))
        return rows.join(names, "id", "left")

    def vectors(self, number: int | None = None) -> DataFrame:
        return self._alive("vectors", number).drop("segment")

    # -- writing --------------------------------------------------------------

    def apply(self, batch: DataFrame) -> dict[str, int]:
        """Takes in a batch (document, url, title, source_type, published_at, text, fetched_at, deleted) and counts its outcomes.

        Of several rows of a document the last fetched counts. Rows without a document id are left out.
        """
        known = self.versions.manifest()
        first = "documents" not in known["tables"]
        segment = known["notes"].get("segment", 0) + 1
        columns = ["document", "url", "title", "source_type", "published_at", "text", "fetched_at", "deleted"]
        batch = batch.where("document IS NOT NULL").select(*columns).withColumn("deleted", F.coalesce("deleted", F.lit(False)))
        newest = batch.groupBy("document").agg(F.max_by(F.struct(*columns), F.struct(F.coalesce("fetched_at", F.lit("0001-01-01").cast("timestamp")), F.coalesce("text", F.lit("")))).alias("r")).select("r.*")
        newest = newest.withColumn("hash", sources.content_hash(F.col("url"), F.col("title"), F.col("text")))
        before = self.spark.createDataFrame([], "document long, old string") if first else self.documents().select("document", F.col("hash").alias("old"))
        outcome = (
            F.when(F.col("deleted"), F.when(F.col("old").isNull(), "absent").otherwise("deleted"))
            .when(F.col("old").isNull(), "inserted").when(F.col("old") == F.col("hash"), "unchanged").otherwise("updated")
        )
        rows = written(live_trust(newest.join(before, "document", "left").withColumn("outcome", outcome), self.as_of), "batch")
        counts = {r["outcome"]: r["n"] for r in rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
        entered = rows.where("outcome IN ('inserted', 'updated')")
        left = rows.where("outcome IN ('updated', 'deleted')").select("document")
        now = rows.where("outcome <> 'absent'").withColumn("live", F.lit(True)).withColumn("segment", F.lit(segment))
        names = [c.split()[0] for c in _DOCUMENT.split(", ")]
        tables = {"documents": self.versions.write(now.select(*names), "documents")}

        new = written(chunked(entered), "chunks")
        old = self.spark.createDataFrame([], _CHUNK) if first else written(self._alive("chunks").join(left, "document", "left_semi"), "old")
        tables["chunks"] = self.versions.write(new.withColumn("segment", F.lit(segment)), "chunks")
        vectors = embedded(new.select("id", "text"), self.embedder).select("id", "vector", F.lit(self.embedder.name).alias("model"), F.lit(segment).alias("segment"))
        tables["vectors"] = self.versions.write(vectors, "vectors")
        if first:
            words, notes = self.words.built(new.select("id", "text"))
            append: tuple[str, ...] = ()
        else:
            words, append, notes = self.words.refreshed(new.select("id", "text"), old.select("id"))
            append += ("documents", "chunks", "vectors", "canonical")
        tables |= words
        tables["canonical"] = self.versions.write(self._renamed(new, old, first).withColumn("segment", F.lit(segment)), "canonical")
        self._between_writes_and_commit()
        self.versions.commit(tables, append, notes)
        return counts

    def _between_writes_and_commit(self) -> None:
        """Everything is written and nothing can be seen yet."""

    def _renamed(self, new: DataFrame, old: DataFrame, first: bool) -> DataFrame:
        """Canonical ids of all live chunks whose text a batch brings or takes away."""
        mark = F.sha2(F.coalesce("text", F.lit("")), 256)
        touched = written(new.select(mark.alias("mark")).unionByName(old.select(mark.alias("mark"))).distinct(), "marks")
        stay = new.select("id", "text")
        if not first:
            stay = stay.unionByName(self._alive("chunks").join(old.select("id"), "id", "left_anti").select("id", "text"))
        same = stay.withColumn("mark", mark).join(touched, "mark", "left_semi").select("id", "mark")
        smallest = same.groupBy("mark").agg(F.min("id").alias("smallest"))
        return same.join(smallest, "mark").select("id", F.when(F.col("smallest") != F.col("id"), F.col("smallest")).alias("canonical"))

    def evict(self, cap: int, protected: DataFrame) -> dict[str, int]:
        """Deletes the longest-stored live documents above ``cap``, but none that ``protected`` (document) names."""
        docs = self.documents().where("live")
        gone = sources.evicted(docs.withColumnRenamed("document", "id"), protected.select(F.col("document").alias("id")), docs.count() - cap)
        return self.apply(gone.withColumnRenamed("id", "document").withColumn("deleted", F.lit(True)))

    def refetch(self, wanted: DataFrame) -> DataFrame:
        """Of ``wanted`` (document, tier), those whose stored copy is missing or older than its tier allows."""
        have = self.documents().select("document", "fetched_at")
        young = sources.fresh(F.col("tier"), F.col("fetched_at"), F.lit(self.as_of).cast("timestamp"))
        return wanted.join(have, "document", "left").where(~young).select(*wanted.columns)

    def compact(self) -> None:
        """Writes the live rows of all tables as one segment and drops versions that are no longer read."""
        docs, segment = self.documents(), self.versions.manifest()["notes"]["segment"]
        chunks = written(self.chunks(), "chunks")
        words, notes = self.words.built(chunks.select("id", "text"))
        again = lambda df, name: self.versions.write(df.withColumn("segment", F.lit(1)), name)
        tables = {"documents": again(docs.withColumn("deleted", F.lit(False)).select(*(c.split()[0] for c in _DOCUMENT.split(", ") if not c.startswith("segment"))), "documents")}
        tables |= {"chunks": again(chunks.drop("canonical"), "chunks"), "vectors": again(self.vectors(), "vectors"), "canonical": again(chunks.select("id", "canonical"), "canonical")}
        self.versions.commit(tables | words, notes=notes | {"compacted": segment})
        self.versions.clean()

