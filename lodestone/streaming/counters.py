"""Counters over event streams: usage, errors, feedback, sessions.

Every function takes a streaming or a batch DataFrame of events and returns the aggregate. Streams
run in update mode: a batch gives the new counts of the keys that it touched, the watermark lets
the state of closed windows go, and what is later than it is dropped. ``feedback_counts`` has no time and
keeps one count for each target and signal. ``run_available`` drives a stream to the end of what
is there, with a checkpoint in the shared folder, and merges the batches by key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.session import shared_dir


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events of a Parquet file or folder as a stream; times are UTC."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_usage(events: DataFrame) -> DataFrame:
    day = F.window(F.col("ts"), "1 day")
    return events.withWatermark("ts", "1 day").groupBy(day.alias("w"), "user_id", "event_type").agg(F.count(F.lit(1)).alias("calls")).select(F.to_date("w.start").alias("day"), "user_id", "event_type", "calls")


def recent_errors(events: DataFrame, window: str = "300 seconds", slide: str = "60 seconds") -> DataFrame:
    rows = events.where("event_type = 'error'").withWatermark("ts", "10 minutes")
    return rows.groupBy(F.window("ts", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("errors")).select(F.col("w.start").alias("start"), "errors")


def feedback_counts(events: DataFrame) -> DataFrame:
    return events.groupBy((F.col("event_id") % 200).alias("target"), F.col("event_type").alias("signal")).agg(F.count(F.lit(1)).alias("count"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    rows = events.withWatermark("ts", "1 hour")
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def run_available(stream: DataFrame, keys: list[str] | None, mode: str = "update") -> DataFrame:
    """The result of a stream over all that is available now: of each key the row of the last batch that touched it (without keys all rows).

    Every batch writes a folder named after it, so one that runs again writes the same rows again.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(StructType(stream.schema.fields + [StructField("epoch", LongType())])).parquet(f"{base}/out")
    if keys is None:
        return out.drop("epoch")
    rest = [c for c in stream.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(*keys, "r.*").select(*stream.columns)
