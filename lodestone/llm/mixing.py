"""Mixing sources to target weights along a time-varying curriculum.

Sizes are word counts. Sources in code-point order (null last) take the given weights in
turn. Each source's share of all words is its target; a target stops at ``most`` times the
source's size and the excess goes to the others by weight, until none is above. The level
at which this stops is found by a few aggregations over the table of sources.

Inside a source the documents stand in the order of the MD5 of their id. Running word
counts (two levels: sums of hash-prefix buckets, then sums inside a bucket, so that a
source with a third of all rows is never one task) say how often each document is taken:
every whole pass over the source, and a part of the last one, cut at a word.

The curriculum: the weight of a source over training time 0..1 is a piecewise-linear
schedule. Its integral, scaled to the target, is the source's cumulative demand; inverting
it at a document's cumulative words gives the time at which the document is trained on.
``training_order`` lays out every pass of every document and range-sorts them by that time.

Null text has size 0. Null ids and repeated rows are documents like others: rows equal in id
and size are interchangeable. Documents of size 0 are never taken and have no position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.store import stored

#: Weights that sources take in turn.
WEIGHTS = (5, 2, 1)
#: For each weight, (time, relative rate) knots: heavy sources lead early, light ones late.
SCHEDULES = {5: ((0.0, 1.5), (1.0, 0.5)), 2: ((0.0, 1.0), (1.0, 1.0)), 1: ((0.0, 0.5), (1.0, 1.5))}
#: Documents of one source and hash prefix that one task sums in order, about.
BUCKET_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Runs of characters other than white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with its place (``_place``, from 0) in a total order, by range partitions and their counts."""
    spark = df.sparkSession
    ranged = stored(
        df.repartitionByRange(spark.sparkContext.defaultParallelism, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "numbered",
    ).df
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(parts.select("_part", before.alias("_before")), "_part").withColumn("_place", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3) -> DataFrame:
    """``sources`` (source, source_size) with weight and target."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    table = stored(numbered(sources, F.asc_nulls_last("source")).withColumn("weight", weight).drop("_place"), "sources").df
    cap = F.col("source_size") * F.lit(most)
    level = -1.0
    while True:
        full = cap < F.col("weight") * F.lit(level)
        row = table.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, cap)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        if not row["free"]:
            break
        new = (row["all"] - (row["full"] or 0)) / row["free"]
        if new == level:
            break
        level = new
    return table.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


@dataclass(frozen=True)
class Schedule:
    """A piecewise-linear rate over time 0..1, scaled to an integral of 1."""

    knots: tuple[tuple[float, float], ...]

    def time_at(self, done: Column) -> Column:
        """The time at which the share ``done`` (0..1) of the demand is met."""
        area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(self.knots, self.knots[1:]))
        out, sofar = None, 0.0
        pieces = []
        for (t0, w0), (t1, w1) in zip(self.knots, self.knots[1:]):
            a, b = w0 / area, w1 / area
            rest = done - F.lit(sofar)
            # a * d + slope / 2 * d**2 = rest, solved for d in the form that also holds for slope 0
            root = F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * (b - a) / (t1 - t0)) * rest, F.lit(0.0)))
            d = F.when(rest <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * rest / (F.lit(a) + root))
            sofar += (t1 - t0) * (a + b) / 2
            pieces.append((sofar, F.lit(t0) + d))
        for end, at in reversed(pieces):
            out = at if out is None else F.when(done <= end, at).otherwise(out)
        return F.least(out, F.lit(1.0))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, schedules=SCHEDULES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, source, weight, size, source_size, target, taken, before (words of its source before it), position.

    ``position`` is the training time of the document's first pass, null if it is not taken.
    """
    sizes = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes").df
    n = sizes.count()
    digits = 0
    while 16**digits * BUCKET_ROWS < n:
        digits += 1
    key = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    sizes = sizes.withColumn("key", key).withColumn("bucket", F.substring("key", 1, digits))
    buckets = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    # the buckets of one source: one row for each BUCKET_ROWS documents
    buckets = stored(buckets.withColumn("offset", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "buckets").df
    goal = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    offsets = buckets.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select(
        F.col("b.source").alias("source_of"), F.col("b.bucket").alias("bucket_of"), "offset", "source_size", "weight", "target"
    )
    placed = sizes.join(offsets, F.col("source").eqNullSafe(F.col("source_of")) & (F.col("bucket") == F.col("bucket_of")))
    inside = Window.partitionBy("source_of", "bucket_of").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0))
    placed = placed.withColumn("_passes", passes).withColumn("_rest", whole - F.col("_passes") * F.col("source_size"))
    taken = F.col("_passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("before")))
    placed = placed.withColumn("taken", taken.cast("long"))
    position = _position(schedules, F.col("before") / F.col("target"))
    return placed.select(
        "id", "source", "weight", "size", "source_size", "target", "taken", "before", F.when((F.col("taken") > 0), position).alias("position")
    )


def _position(schedules, done: Column) -> Column:
    out = F.lit(None).cast("double")
    for weight, knots in schedules.items():
        out = F.when(F.col("weight") == weight, Schedule(knots).time_at(done)).otherwise(out)
    return out


def training_order(plan: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """Every pass of every taken document (id, source, epoch, words, position), range-sorted by position."""
    most = F.ceil(F.col("taken") / F.col("size")).cast("int")
    out = plan.where("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), most - 1)))
    done = (F.col("before") + F.col("epoch") * F.col("source_size")) / F.col("target")
    out = out.withColumn("position", _position(schedules, done)).withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")))
    return out.select("id", "source", "epoch", "words", "position").repartitionByRange(plan.sparkSession.sparkContext.defaultParallelism, "position", "id").sortWithinPartitions("position", "id")
