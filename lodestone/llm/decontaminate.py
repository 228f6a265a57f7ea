"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A text is its words in lower case; a shingle is five words, hashed to 64 bits; a text of fewer
words has its whole sequence as one shingle, so a short item is found where it is the whole
document. An item of n shingles is compared with windows of n shingles of documents, as
weighted sets: the weight of a shingle is how often it stands in the window. Two are a match
if the sum of the smaller weights is at least ``least`` times the sum of the larger ones. The
edges of a document cut windows off. Windows begin at every shingle for items of fewer than
128, and at multiples of n / 64 (rounded down) for longer ones.

1. A window that is similar enough shares a run of shingles with its item (``shared_run``), so
   it is enough to look up every 8th shingle of a document among all shingles of the items, or
   more of them if there are very short items. Every window of an item's size that holds such
   a shingle is kept; which item it may be is not known yet. Only hashes and places take part
   in this join, and only places are sent back to the texts, which stay where they are.
2. Windows and items get a 64-bit SimHash of their words, each as often as it stands there. Words
   change less than shingles do: at a similarity of 0.8 about one word in ten is another one at
   most. The 64 bits are cut into ``BLOCKS`` blocks, and an item is listed under all values within
   ``NEAR`` bits of each block. Two fingerprints within the radius differ by so few bits in some
   block, so an equality join on (size, block, value) finds every such pair of window and item;
   a bit count then drops what is further apart.
3. The weighted similarity of the rest is computed exactly, from the shingles of both.

The join of step 1 and that of step 2 are left to the engine, which broadcasts a side only within its
own size limit; beyond it the same rows are shuffled. Everything is DataFrame expressions.

Null texts and texts without words match nothing. Items with a null id are items like others.
All matches of a document id come out once for an item id, with the best window; a null id is one
id like others. Rows with one id and different texts are compared each by itself, and
``without_leaks`` removes rows, not ids.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.placed import Placed, placed, placed_whole, restored
from lodestone.llm.store import Steps, stored

SHINGLE = 5
#: Blocks of a fingerprint, and the bits by which the same block of two fingerprints may differ.
BLOCKS, NEAR = 5, 2
#: Fingerprints that differ by at most so many bits always differ by at most NEAR in some block.
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Every so many shingles of a document are looked up, if items are long enough.
STRIDE = 8
_LANES = (1 << 32) | 1
_PLACE = 1 << 32


def words(text: Column) -> Column:
    """Words in lower case; none for a null or blank text."""
    white = " \t\n\x0b\f\r"
    lower = F.translate(F.trim(F.coalesce(text, F.lit("")), F.lit(white)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` bound to a name, so that it is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def n_shingles(hashes: Column) -> Column:
    return F.when(F.size(hashes) >= SHINGLE, F.size(hashes) - (SHINGLE - 1)).otherwise(F.least(F.size(hashes), F.lit(1)))


def shingles(hashes: Column, first: Column, n: Column, step: int = 1) -> Column:
    """(at, shingle) of ``n`` shingles from ``first`` on, every ``step``-th of them."""
    at = lambda i: F.when(F.size(hashes) >= SHINGLE, F.xxhash64(*(F.get(hashes, i + j) for j in range(SHINGLE)))).otherwise(F.xxhash64(hashes))
    places = F.sequence(first, first + F.greatest(n - 1, F.lit(0)), F.lit(step))
    return F.when(n > 0, F.transform(places, lambda i: F.struct(i.alias("at"), at(i).alias("shingle")))).otherwise(F.array().cast("array<struct<at:int,shingle:bigint>>"))


def _some_shingles(hashes: Column, first: Column, n: Column) -> Column:
    return F.transform(shingles(hashes, first, n), lambda s: s["shingle"])


def simhash(window: Column) -> Column:
    """64 bits: bit b is set if more than half of the word hashes, each as often as it stands in the window, have it. Bits k and k + 32 are counted together."""
    counts = lambda k: F.aggregate(window, F.lit(0).cast("long"), lambda acc, h: acc + F.call_function("shiftrightunsigned", h, k).bitwiseAND(F.lit(_LANES)))
    more = lambda lane: F.when(lane * 2 > F.size(window), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    bits = lambda c: more(c.bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseOR(F.shiftleft(more(F.shiftrightunsigned(c, 32)), 32))
    each = F.transform(F.transform(F.sequence(F.lit(0), F.lit(31)), counts), lambda c, k: F.call_function("shiftleft", bits(c), k))
    return F.aggregate(each, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles."""
    count = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    single = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    common = F.array_intersect(a, b)
    low = F.when(single, F.size(common)).otherwise(F.aggregate(common, F.lit(0), lambda acc, v: acc + F.least(count(a, v), count(b, v))))
    return low / (F.size(a) + F.size(b) - low)


def blocks() -> list[tuple[int, int]]:
    """(first bit, number of bits) of the blocks of 64 bits."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _block(mark: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(mark, first).bitwiseAND(F.lit((1 << bits) - 1))


def _probe_blocks(mark: Column) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("block"), _block(mark, a, n).alias("value")) for i, (a, n) in enumerate(blocks())))


def _listed_blocks(mark: Column) -> Column:
    """All values within ``NEAR`` bits of each block."""
    flips = [[sum(1 << b for b in some) for k in range(NEAR + 1) for some in combinations(range(n), k)] for _, n in blocks()]

    def listed(i: int, first: int, bits: int) -> Column:
        value = _block(mark, first, bits)
        return F.transform(F.array(*map(F.lit, flips[i])), lambda m: F.struct(F.lit(i).alias("block"), value.bitwiseXOR(m.cast("long")).alias("value")))

    lists = [listed(i, a, n) for i, (a, n) in enumerate(blocks())]
    return F.concat(*lists)


def shared_run(n: Column, least: float) -> Column:
    """The least length of the longest run of shingles that an item of n shares with a window that matches it.

    The window lacks at most ``(1 - least) * n`` of them, and whatever parts two runs costs four at least.
    """
    lost = F.floor(n * F.lit(1 - least) + F.lit(1e-9))
    return F.floor((n - lost) / (F.floor(lost / 4) + 1))


def _grid(n: Column) -> Column:
    """Windows of n shingles begin at multiples of this."""
    return F.greatest(F.lit(1), F.floor(n / 64)).cast("int")


def _index(items: DataFrame, item_col: str, item_text: str, least: float, steps: Steps) -> DataFrame:
    """Items with at least one word: key, item, n, own (shingles), mark and how densely documents are looked up for them."""
    rows = items.select(F.monotonically_increasing_id().alias("key"), F.col(item_col).alias("item"), word_hashes(F.col(item_text)).alias("hashes")).where(F.size("hashes") > 0)
    rows = steps(rows.withColumn("n", n_shingles(F.col("hashes"))), "items")
    run = shared_run(F.col("n"), least)
    dense = F.when(run >= STRIDE, F.lit(STRIDE)).when(run >= 4, F.lit(4)).when(run >= 2, F.lit(2)).otherwise(F.lit(1))
    return steps(rows.select("key", "item", "n", dense.alias("dense"), _some_shingles(F.col("hashes"), F.lit(0), F.col("n")).alias("own"), simhash(F.col("hashes")).alias("mark")), "index")


def _windows(keyed: Placed, index: DataFrame, steps: Steps) -> DataFrame:
    """(row, n, start, mark) of every window of an item's size that holds a shingle of an item of that size."""
    step = index.agg(F.min("dense")).first()[0] or STRIDE
    anchors = index.select("n", "dense", F.explode("own").alias("shingle")).distinct()
    probes = keyed.df.select("row", F.inline(_bound(word_hashes(F.col("text")), lambda h: shingles(h, F.lit(0), n_shingles(h), step))))
    hits = steps(probes.join(anchors, "shingle").where("at % dense = 0").select("row", "n", "at"), "hits")
    texts = keyed.beside(keyed.per_row(hits, F.collect_set(F.struct("n", "at")).alias("hits")))
    code = lambda n, start: n.cast("long") * F.lit(2 * _PLACE) + start + F.lit(_PLACE)
    starts = lambda n, at: F.sequence(F.ceil((at - n + 1) / _grid(n)).cast("int") * _grid(n), F.floor(at / _grid(n)).cast("int") * _grid(n), _grid(n))
    places = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.transform(starts(x["n"], x["at"]), lambda s: code(x["n"], s)))))

    def marked(hashes: Column) -> Column:
        def one(c: Column) -> Column:
            n, start = F.floor(c / (2 * _PLACE)).cast("int"), (c % (2 * _PLACE) - _PLACE).cast("int")
            all_ = n_shingles(hashes)
            begin = F.greatest(start, F.lit(0))
            window = F.slice(hashes, begin + 1, F.greatest(F.least(start + n, all_) - begin + F.size(hashes) - all_, F.lit(0)))
            return F.struct(n.alias("n"), start.alias("start"), _bound(window, simhash).alias("mark"))

        return F.transform(places, one)

    return steps(texts.select("row", F.inline(_bound(word_hashes(F.col("text")), marked))), "windows")


def leaks_of_rows(keyed: Placed, items: DataFrame, least: float, item_col: str, item_text: str, steps: Steps) -> DataFrame:
    """(row, id, item, first word, similarity) of every matching window of ``keyed`` (id, text)."""
    index = _index(items, item_col, item_text, least, steps)
    windows = _windows(keyed, index, steps)
    listed = index.select("key", "n", "mark", F.inline(_listed_blocks(F.col("mark")))).withColumnRenamed("mark", "own_mark")
    probes = windows.select("row", "n", "start", "mark", F.inline(_probe_blocks(F.col("mark"))))
    near = probes.join(listed, ["n", "block", "value"]).where(F.bit_count(F.col("mark").bitwiseXOR(F.col("own_mark"))) <= RADIUS)
    found = steps(near.select("row", "n", "start", "key").distinct(), "near")
    texts = keyed.beside(keyed.per_row(found, F.collect_list(F.struct("key", "n", "start")).alias("found")))

    def parts(hashes: Column) -> Column:
        begin = lambda x: F.greatest(x["start"], F.lit(0))
        return F.transform("found", lambda x: F.struct(x["key"].alias("key"), begin(x).alias("begin"), _some_shingles(hashes, begin(x), F.least(x["start"] + x["n"], n_shingles(hashes)) - begin(x)).alias("part")))

    windows = steps(texts.select("row", "id", F.inline(_bound(word_hashes(F.col("text")), parts))), "parts")
    scored = windows.join(index.select("key", "item", "own"), "key").select("row", "id", "item", F.col("begin").alias("first_word"), similarity(F.col("part"), F.col("own")).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


def find_leaks(docs: DataFrame, items: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item id, first word of the best window, similarity) of every leak.

    The result is a table in the shared folder; all others are deleted when this returns.
    """
    steps = Steps()
    keyed = placed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    scored = leaks_of_rows(keyed, items, least, item_col, item_text, steps)
    best = scored.groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("back"))).alias("b"))
    out = stored(best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("b.back")).alias("first_word"), F.col("b.similarity").alias("similarity")), "leaks").df
    steps.drop()
    keyed.drop()
    return out


def without_leaks(docs: DataFrame, items: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    steps = Steps()
    whole, names = placed_whole(docs)
    leaks = steps(leaks_of_rows(whole.view(id=names[id_col], text=names[text_col]), items, least, item_col, item_text, steps).select("row").distinct(), "leaks")
    out = stored(restored(whole.beside(whole.per_row(leaks), "left_anti"), names), "without_leaks").df
    steps.drop()
    whole.drop()
    return out
