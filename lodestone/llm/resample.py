"""Importance resampling towards a target corpus.

Features are the words and the pairs of neighbouring words of a text (A-Z in lower case),
hashed into ``BUCKETS`` buckets by CRC-32. Both corpora are counted by bucket; the gain of a
bucket is the floored logarithm of its smoothed share in the target over that in the source.
A document's weight is the floored mean of the gains of its features, read from an array of
``BUCKETS`` numbers that goes along with the scoring function. Weight and Gumbel noise (a
function of the id) make the score, and the documents with the highest scores are drawn.

The draw is exact and sorts nothing but what is drawn. ``kth_key`` finds the k-th key in the
order (score down, id up, null ids last, feature count, row) digit by digit: one pass counts
the rows for each value of a digit (2 ** ``DIGIT_BITS`` counters at most), the digit that the
k-th row falls into is kept, and the next pass looks at rows with that prefix only. The
rows up to that key are then range-sorted and numbered.

Null and empty texts have no features: weight 0, never drawn, since they have too few words.
A null id counts as an empty one in the noise. Rows that are alike in score, id and number of
features are told apart by where they were written. Without documents nothing is returned;
with an empty target all gains are those of ``t = T = 0``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.store import stored
from lodestone.llm.words import Tokens, slices

BUCKETS = 10_000
#: Bits of the key that one pass of the selection fixes.
DIGIT_BITS = 12
#: Bytes of a word that are hashed side by side with other words; longer ones are hashed alone.
_SIDE_BY_SIDE = 48

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, without the inversion at either end."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _passing() -> np.ndarray:
    """[length][byte of the state][its value]: a CRC state after ``length`` zero bytes; states add up by exclusive or."""
    out = np.zeros((_SIDE_BY_SIDE + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(_SIDE_BY_SIDE):
        out[n + 1] = _CRC[out[n] & np.uint32(255)] ^ (out[n] >> np.uint32(8))
    return out


_PASSING = _passing()


def _crcs(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of every word, and of every word with the next one (joined by a space), over text borders too."""
    size = tokens.end - tokens.begin
    n = len(size)
    state = np.full(n, 0xFFFFFFFF, np.uint32)  # after the word
    some, at = np.flatnonzero(size <= _SIDE_BY_SIDE), 0
    while len(some):
        s = state[some]
        state[some] = _CRC[(s ^ tokens.data[tokens.begin[some] + at]) & np.uint32(255)] ^ (s >> np.uint32(8))
        at += 1
        some = some[size[some] > at]
    long = np.flatnonzero(size > _SIDE_BY_SIDE)
    word = lambda i: tokens.data[tokens.begin[i] : tokens.end[i]].tobytes()
    for i in long:
        state[i] = zlib.crc32(word(i)) ^ 0xFFFFFFFF
    alone = ~state
    if n < 2:
        return alone, alone[:0]
    spaced = _CRC[(state[:-1] ^ np.uint32(0x20)) & np.uint32(255)] ^ (state[:-1] >> np.uint32(8))
    # the state moves past the bytes of the next word, which has its own CRC from the same start
    length = np.minimum(size[1:], _SIDE_BY_SIDE)
    start = spaced ^ np.uint32(0xFFFFFFFF)
    pair = alone[1:].copy()
    for k in range(4):
        pair ^= _PASSING[length, k, (start >> np.uint32(8 * k)) & np.uint32(255)]
    for i in long[long > 0]:
        pair[i - 1] = zlib.crc32(word(i), int(~spaced[i - 1]))
    return alone, pair


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Tokens]:
    """Buckets of the words, and of the pairs that begin with them (-1 for the last word of a text)."""
    tokens = Tokens(texts, _WORD, lower=True)
    alone, pair = _crcs(tokens)
    pairs = np.full(len(alone), -1, np.int64)
    pairs[:-1] = pair % np.uint32(BUCKETS)
    pairs[tokens.first[1:][tokens.counts > 0] - 1] = -1
    return (alone % np.uint32(BUCKETS)).astype(np.int64), pairs, tokens


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) over all of the one column of ``texts``; a task sends at most ``BUCKETS`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for a, b in slices(batch[0], 1 << 19):
                words, pairs, _ = _features(batch[0].slice(a, b - a))
                total += np.bincount(words, minlength=BUCKETS) + np.bincount(pairs[pairs >= 0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """The gain of every bucket, from its counts in either corpus."""
    s_all, t_all = sum(source.values()), sum(target.values())
    share = lambda b: ((target.get(b, 0) + 1.0) * (s_all + float(BUCKETS))) / ((source.get(b, 0) + 1.0) * (t_all + float(BUCKETS)))
    return np.array([math.floor(1000 * math.log(share(b))) for b in range(BUCKETS)], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``rows`` (id, text) as id, n_words, n_features and weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_place = np.append(gain, 0)  # place -1: no pair
        for batch in batches:
            for a, b in slices(batch["text"], 1 << 19):
                words, pairs, tokens = _features(batch["text"].slice(a, b - a))
                sums = np.append(0, np.cumsum(by_place[words] + by_place[pairs]))
                n = tokens.counts
                features = n + np.maximum(n - 1, 0)
                weight = (sums[tokens.first[1:]] - sums[tokens.first[:-1]]) // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(features.astype(np.int64)), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored; the same for one id in every run."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0)))).cast("long")


#: A part of a composite key: a column of longs that hold no null, and whether it goes up.
Part = tuple[Column, bool]


def kth_key(rows: DataFrame, key: list[Part], k: int, bits: int = DIGIT_BITS) -> list[int]:
    """The key of the k-th row (k from 1) of ``rows`` in the order of ``key``.

    Each pass aggregates the rows that are still in question by one digit; the driver gets one
    row for each value of the digit. No row is sorted or moved.
    """
    found: list[int] = []
    left = rows
    for value, up in key:
        low, high, n = left.agg(F.min(value), F.max(value), F.count(F.lit(1))).first()
        if n == 1:  # the row is found, and so is the rest of its key
            rest = [v.alias(f"k{i}") for i, (v, _) in enumerate(key[len(found) :])]
            return found + list(left.select(*rest).first())
        # the value as a number from 0 that goes up in the order asked for, read digit by digit from the top
        place = value - F.lit(low) if up else F.lit(high) - value
        prefix = 0
        for shift in range(((high - low).bit_length() - 1) // bits * bits, -1, -bits):
            digit = F.shiftright(place, shift)
            for row in left.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).orderBy("digit").collect():
                prefix = row["digit"]
                if k <= row["n"]:
                    break
                k -= row["n"]
            left = left.where(digit == prefix)
        found.append(low + prefix if up else high - prefix)
        left = left.where(value == found[-1])
    return found


def up_to(key: list[Part], found: list[int]) -> Column:
    """Whether a row's key is ``found`` or comes before it."""
    out = F.lit(True)
    for (value, up), last in reversed(list(zip(key, found))):
        out = ((value < last) if up else (value > last)) | ((value == last) & out)
    return out


def draw_order() -> list[Part]:
    """Score down, id up (by halves, so that the span of each fits a long) with null ids last, number of features, row."""
    number = F.coalesce(F.col("id").cast("long"), F.lit(0))
    halves = F.shiftright(number, 32), number.bitwiseAND(F.lit((1 << 32) - 1))
    return [(F.col("score"), False), (F.col("id").isNull().cast("long"), True), (halves[0], True), (halves[1], True), (F.col("n_features"), True), (F.col("row"), True)]


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", bits: int = DIGIT_BITS
) -> DataFrame:
    """One row per row of ``docs`` (whose id is an integer): id, n_features, weight, score and rank, which is null if the row is not drawn.

    Of the N rows with ``least_words`` words, floor(``percent`` * N / 100) are drawn. The target
    should be far smaller than the documents or as large; both are only counted.
    """
    counts = lambda df: {r["bucket"]: r["n"] for r in df.collect()}  # noqa: E731  BUCKETS rows at most
    gain = gains(counts(bucket_counts(docs.select(F.col(text_col).cast("string")))), counts(bucket_counts(target.select(F.col(target_text_col).cast("string")))))
    weights = weighed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), gain)
    scored = stored(
        weights.select("id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score")).withColumn("row", F.monotonically_increasing_id()),
        "scored",
    )
    columns = (F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
    undrawn = F.lit(None).cast("long").alias("rank")
    enough = F.col("n_words") >= least_words
    k = percent * scored.df.where(enough).count() // 100
    if not k:
        return scored.df.select("*", undrawn).select(*columns)
    key = draw_order()
    chosen = enough & up_to(key, kth_key(scored.df.where(enough).drop("weight"), key, k, bits))
    return scored.df.where(~chosen).select("*", undrawn).select(*columns).unionByName(_ranked(scored.df.where(chosen)).select(*columns))


def _ranked(chosen: DataFrame) -> DataFrame:
    """``chosen`` in the order of the draw, with rank from 1."""
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("row")]
    parts = int(chosen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(
        chosen.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "drawn",
    ).df
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn("rank", (F.col("before") + F.col("place") + 1).cast("long"))
