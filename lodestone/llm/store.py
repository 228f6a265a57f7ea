"""Tables written between the steps of an operator.

They go to the folder that all executors share, so a lost executor costs a re-read and
never a recomputation, and the shuffle files of the step that made them can go.
"""

from __future__ import annotations

import uuid
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import shared_dir

#: Held while a step is written: its shuffle files go when it ends; Python workers get rows of 8 MB at
#: once, an eighth of the default; a table bucketed by ``part`` need not be shuffled to be joined by (part, row).
_HELD = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


@contextmanager
def _set(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def writing(spark: SparkSession):
    """The settings under which steps are written."""
    with ExitStack() as held:
        for key, value in _HELD.items():
            held.enter_context(_set(spark, key, value))
        yield


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.deleteOnExit(at)


def written_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a path."""
    fs, at = _fs(spark, path)
    return fs.getContentSummary(at).getLength()


class Stored:
    """A written table: ``df`` reads it, ``drop`` deletes it once nothing reads it any more."""

    def __init__(self, spark: SparkSession, path: str, df: DataFrame):
        self.spark, self.path, self.df = spark, path, df

    def drop(self) -> None:
        delete(self.spark, self.path)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> Stored:
    """Write ``df`` to the shared folder. Files still there when the application ends are deleted then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with writing(spark):
        df.write.option("compression", codec).parquet(path)
    delete_on_exit(spark, path)
    return Stored(spark, path, spark.read.schema(df.schema).parquet(path))


class Steps:
    """The tables that one operator writes on its way; ``drop`` deletes them all once its result is written."""

    def __init__(self):
        self.made: list[Stored] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(stored(df, name))
        return self.made[-1].df

    def drop(self) -> None:
        for made in self.made:
            made.drop()
