"""Texts that are written once and stay where they were written.

``placed`` writes a table with a number for each row (``row``, whose upper bits are the number of
the task that wrote it), bucketed by ``part``, a value that all rows of one task share. So a task
writes one file, and nothing is shuffled; tasks take the buckets in turn. Later steps find out
something about some rows and need it beside their texts: ``beside`` sends these answers, a few
bytes for each row, to the buckets and joins them there by hash, so that no step moves or sorts
the texts. (Without the settings of ``store.writing`` the same plan would shuffle the texts.)
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.store import delete, delete_on_exit, writing
from lodestone.session import shared_dir


def _parts(spark: SparkSession, buckets: int) -> list[int]:
    """For each bucket the smallest number that Spark deals to it."""
    dealt = spark.range(40 * buckets).select(F.col("id").cast("int").alias("part")).groupBy(F.pmod(F.hash("part"), F.lit(buckets)).alias("bucket"))
    return [r["part"] for r in dealt.agg(F.min("part").alias("part")).orderBy("bucket").collect()]  # one row for each bucket


class Placed:
    """``df`` has part, row and the columns that were placed; ``drop`` deletes it once nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str, path: str, parts: list[int]):
        self.df, self.name, self.path, self.parts = df, name, path, parts

    def view(self, **columns: str) -> Placed:
        """The same rows with some of their columns, by new names."""
        return Placed(self.df.select("part", "row", *(F.col(c).alias(n) for n, c in columns.items())), self.name, self.path, self.parts)

    def dealt(self, answers: DataFrame, row: Column | None = None) -> DataFrame:
        """``answers`` with a column part, in the buckets of their rows."""
        return answers.withColumn("part", part_of(F.col("row") if row is None else row, self.parts)).repartition(len(self.parts), "part")

    def per_row(self, answers: DataFrame, *aggregates: Column) -> DataFrame:
        """``answers`` (with a column row) aggregated to one line for each row, where the bucket of the row is."""
        keyed = self.dealt(answers).groupBy("part", "row")
        return keyed.agg(*aggregates) if aggregates else keyed.count().drop("count")

    def beside(self, lines: DataFrame, how: str = "inner") -> DataFrame:
        """The placed rows joined with ``lines``, which come from ``per_row``; ``how``: inner, left or left_anti."""
        return self.df.join(lines.hint("shuffle_hash"), ["part", "row"], how)

    def drop(self) -> None:
        spark = self.df.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(spark, self.path)


def part_of(row: Column, parts: list[int]) -> Column:
    task = F.shiftright(row, 33)
    return F.get(F.split(F.lit(",".join(map(str, parts))), ",").cast("array<int>"), F.pmod(task, F.lit(len(parts))).cast("int"))


def placed(docs: DataFrame) -> Placed:
    """Writes ``docs`` to the shared folder; its columns must not be called row or part."""
    spark = docs.sparkSession
    name = f"placed_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    parts = _parts(spark, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    numbered = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("part", part_of(F.col("row"), parts))
    with writing(spark):
        numbered.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(len(parts), "part").saveAsTable(name)
    delete_on_exit(spark, path)
    return Placed(spark.table(name), name, path, parts)


def placed_whole(docs: DataFrame) -> tuple[Placed, dict[str, str]]:
    """All columns of ``docs``, and the names they have in the placed table."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return placed(docs.toDF(*names.values())), names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of the documents again."""
    return df.select(*(F.col(n).alias(c) for c, n in names.items()))
