"""Connectors: protocols for what fetches documents, a Python data source over them, and the JSON-lines history."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lodestone.functions.markdown import cleaned, sitemap_urls
from lodestone.operators.sources import content_hash, upsert
from lodestone.tables import written
from lodestone.versions import Versions


@dataclass
class RawDoc:
    url: str
    title: str | None = None
    text: str = ""
    source_type: str = "docs"
    author: str | None = None
    author_role: str | None = None
    published_at: str | None = None
    popularity: int = 0


class Connector(Protocol):
    """Lists work items, and fetches the documents of one; an item that fails costs only itself."""

    def items(self) -> Iterable[str]: ...

    def fetch(self, item: str) -> Iterable[RawDoc]: ...


DOC_SCHEMA = "url string, title string, text string, source_type string, author string, author_role string, published_at string, popularity long"
#: Rows of a connector's source: documents, and one row with ``error`` for each item that failed.
SOURCE_SCHEMA = f"{DOC_SCHEMA}, item string, error string"
_FIELDS = [c.split()[0] for c in DOC_SCHEMA.split(", ")]


def fetched(connector: Connector, item: str) -> Iterator[tuple]:
    """The documents of one item; if it fails, what came before the failure and then why."""
    try:
        for doc in connector.fetch(item):
            yield (*asdict(doc).values(), item, None)
    except Exception as error:  # noqa: BLE001  one item costs only itself, and its row says why
        yield (*(None for _ in _FIELDS), item, f"{type(error).__name__}: {error}"[:500])


def connector_source(name: str, make) -> type[DataSource]:
    """A data source class for a connector (``make()`` builds it); each item is one partition.

    As a stream, the offset is the number of items that were dealt out, so a restart goes on with the next.
    """

    class Part(InputPartition):
        def __init__(self, item: str):
            self.item = item

    class Reader(DataSourceReader):
        def partitions(self):
            return [Part(i) for i in make().items()]

        def read(self, part) -> Iterator[tuple]:
            yield from fetched(make(), part.item)

    class StreamReader(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"items": 0}

        def latestOffset(self) -> dict:
            return {"items": len(list(make().items()))}

        def partitions(self, start: dict, end: dict):
            return [Part(i) for i in list(make().items())[start["items"] : end["items"]]]

        def read(self, part) -> Iterator[tuple]:
            yield from fetched(make(), part.item)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SOURCE_SCHEMA

        def reader(self, schema):
            return Reader()

        def streamReader(self, schema):
            return StreamReader()

    return Source


class Crawl:
    """Documents of a connector under ``root``: each run fetches the items that are not done yet, and failed ones again.

    Documents are known by URL. A run counts documents inserted, updated and unchanged, and items that failed; documents and items
    change in one version, so a run that is cut off is fetched again as a whole.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)

    def documents(self) -> DataFrame:
        found = self.versions.read("documents")
        return self.spark.createDataFrame([], f"{DOC_SCHEMA}, hash string") if found is None else found

    def items(self) -> DataFrame:
        """(item, error): every item that was fetched, and why it failed if it did."""
        found = self.versions.read("items")
        return self.spark.createDataFrame([], "item string, error string") if found is None else found

    def run(self, connector: Connector, limit: int | None = None) -> dict[str, int]:
        """Fetches up to ``limit`` pending items, in the order in which the connector lists them."""
        listed = self.spark.createDataFrame([(i, n) for n, i in enumerate(dict.fromkeys(connector.items()))], "item string, n long")
        pending = listed.join(self.items().where("error IS NULL"), "item", "left_anti").orderBy("n")
        pending = pending if limit is None else pending.limit(limit)

        def run(batches):
            for pdf in batches:
                for item in pdf["item"]:
                    yield pd.DataFrame(list(fetched(connector, item)), columns=[*_FIELDS, "item", "error"])

        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = written(pending.select("item").repartition(parts).mapInPandas(run, SOURCE_SCHEMA), "fetched")
        done = written(pending.select("item"), "tried").join(rows.where("error IS NOT NULL").groupBy("item").agg(F.first("error").alias("error")), "item", "left")
        content = content_hash(*(F.col(c) for c in _FIELDS if c != "popularity"))
        docs = rows.where("error IS NULL AND url IS NOT NULL").select(*_FIELDS, content.alias("hash"))
        docs = docs.groupBy("url").agg(F.max_by(F.struct(*docs.columns), "hash").alias("r")).select("r.*")  # of one URL, one
        after = written(upsert(self.documents(), docs, "url", "hash", ("popularity",)), "after")
        counts = {r["outcome"]: r["n"] for r in after.where("outcome <> 'kept'").groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
        failed = done.where("error IS NOT NULL").count()
        items = self.items().join(done.select("item"), "item", "left_anti").unionByName(done)
        self.versions.commit({"documents": self.versions.write(after.select(*_FIELDS, "hash"), "documents"), "items": self.versions.write(items, "items")})
        return {"inserted": 0, "updated": 0, "unchanged": 0} | counts | {"failed": failed, "items": done.count()}


class Sitemaps:
    """A connector over the pages that sitemaps list, child sitemaps included, ``depth`` levels deep.

    ``get`` fetches (body, content type) of a URL. A sitemap that fails or was read before lists nothing.
    """

    def __init__(self, roots: list[str], get: Callable[[str], tuple[str, str | None]], depth: int = 3, source_type: str = "docs"):
        self.roots, self.get, self.depth, self.source_type = roots, get, depth, source_type
        self.failed: dict[str, str] = {}

    def items(self) -> list[str]:
        pages: dict[str, None] = {}
        seen: set[str] = set()
        level = list(self.roots)
        for _ in range(self.depth):
            children: list[str] = []
            for url in level:
                if url in seen:
                    continue
                seen.add(url)
                try:
                    found, more = sitemap_urls(self.get(url)[0])
                except Exception as error:  # noqa: BLE001  kept for the caller
                    self.failed[url] = f"{type(error).__name__}: {error}"
                    continue
                pages |= dict.fromkeys(found)
                children += more
            level = children
        return list(pages)

    def fetch(self, item: str) -> Iterator[RawDoc]:
        body, kind = self.get(item)
        text = cleaned(body, kind)
        title = next((line.lstrip("#").strip() for line in text.splitlines() if line.startswith("#")), None)
        yield RawDoc(url=item, title=title, text=text, source_type=self.source_type)


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def load_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Past runs; lines that are no records are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col(rows.columns[0]).isNotNull())
