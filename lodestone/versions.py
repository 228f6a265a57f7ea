"""Several tables that change together, in versions.

A version is a manifest: for each table, the folders that make it up. New folders are written
first and the manifest last, under a name that no one reads before it is complete, so a batch that is cut off leaves
the version before as it was, and readers see all tables of one version or of the one before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Tables under ``root``, a folder that driver and executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def numbers(self) -> list[int]:
        fs, at = self._fs(f"{self.root}/versions")
        if not fs.exists(at):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json"))

    def manifest(self, number: int | None = None) -> dict:
        """Tables of a version (the newest): folders and schema of each, and ``notes``."""
        known = self.numbers()
        if not known:
            return {"tables": {}, "notes": {}}
        fs, at = self._fs(f"{self.root}/versions/{known[-1] if number is None else number}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, number: int | None = None) -> DataFrame | None:
        table = self.manifest(number)["tables"].get(name)
        if table is None:
            return None
        rows = self.spark.read.schema(table["schema"])
        return rows.parquet(*table["folders"]) if table["folders"] else self.spark.createDataFrame([], table["schema"])

    def write(self, df: DataFrame, name: str, by: str | None = None) -> dict:
        """Writes a folder that no version names yet; ``by``: a column whose values become subfolders."""
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        return {"folders": [path], "schema": ", ".join(f"`{n}` {t}" for n, t in df.dtypes)}

    def commit(self, tables: dict[str, dict], append: tuple[str, ...] = (), notes: dict | None = None) -> int:
        """A new version: ``tables`` as ``write`` returned them replace those of their names, or add to those named in ``append``; the others stay."""
        now = self.manifest()
        for name, table in tables.items():
            before = now["tables"].get(name, {"folders": []})["folders"] if name in append else []
            now["tables"][name] = {"folders": before + table["folders"], "schema": table["schema"]}
        now["notes"] |= notes or {}
        number = (self.numbers() or [0])[-1] + 1
        fs, at = self._fs(f"{self.root}/versions/{number}.json")
        _, draft = self._fs(f"{self.root}/versions/{number}.{uuid.uuid4().hex}.draft")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if not fs.rename(draft, at):
            raise RuntimeError(f"version {number} of {self.root} was written by someone else")
        return number

    def clean(self, keep: int = 1) -> None:
        """Deletes all but the newest ``keep`` versions, and the folders that none of those name."""
        known = self.numbers()
        kept = known[len(known) - keep :]
        named = {f for n in kept for t in self.manifest(n)["tables"].values() for f in t["folders"]}
        for n in known[: len(known) - keep]:
            fs, at = self._fs(f"{self.root}/versions/{n}.json")
            fs.delete(at, False)
        fs, at = self._fs(self.root)
        for table in fs.listStatus(at):
            if table.getPath().getName() != "versions":
                for folder in fs.listStatus(table.getPath()):
                    if folder.getPath().getName() not in {f.rsplit("/", 1)[1] for f in named}:
                        fs.delete(folder.getPath(), True)
