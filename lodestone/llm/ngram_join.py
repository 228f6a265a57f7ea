"""Jaccard self-join on word shingles with adaptive multi-match prefixes.

A document is the set of its distinct k-word shingles, as 64-bit hashes. Documents with one
set are one class, so copies meet in a partial aggregation and are never paired. A class is
known by its first row, so null ids and repeated ids link like others.

Shingles have one global order: by their count in a sketch of fixed size over all documents,
rare first, then by hash. Two sets of sizes x and y with a Jaccard similarity of t or more
share at least l shingles in their prefixes of length ``x - ceil(t * x) + l`` (and the same
for y), for every l. A document takes the l of least estimated cost: what the lists of its
prefix hold, divided by l, and the longer prefix itself. Two documents are compared only if
their prefixes share at least the smaller l of the two.

Only prefix shingles of two or more classes make lists, and of lists with the same classes (the
shingles of one shared passage) only the first is worked on. Inside a list, pairs are not all
made: first every class meets one hub, the class with the fewest shingles before this one;
then components are found, and only lists that still hold several components go on. Their
classes have a random order, and the first 16 or so are hubs of the others, then those up to
256, 4096 and so on, each against classes of other components. No list is numbered in one
task, and a list closes once it is one component or all its classes have been hubs. A pair is left out if it is in one component
already, or if sizes and positions prove that it can't be similar enough: at the first
shingle that two sets share, no more than the rest of the smaller remainder is common to
both. So every component is exact, with far fewer pairs than a group of near copies has.

Texts are written once. They are read for the sketch and for the prefixes, and after that
only rows of pairs whose prefixes fit give their sets, where they are stored (``placed``).

A row with a null id takes the smallest id of its component, null if there is none. Documents
without words have size 0 and are their own component. Rows that repeat an id are documents
like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import merged
from lodestone.llm.placed import Placed, placed, placed_whole, restored
from lodestone.llm.store import Steps, stored
from lodestone.llm.words import Words, mix, shingle_sets, slices

#: Counters of the sketch and of one of the rows in which it travels; its size never depends on the data.
WIDTH, BLOCK = 1 << 18, 1 << 12
#: The most shared prefix shingles that a document may ask for.
MOST_SHARED = 4
#: Hubs of the first round after the one with a single hub, and by how much later rounds have more.
HUBS = 16
_SHIFT = np.uint64(64 - 18)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for a, b in slices(batch["text"]):
            part = batch.slice(a, b - a)
            yield part, *shingle_sets(Words(part["text"], lower=True), k)


def shingle_counts(docs: DataFrame, k: int) -> np.ndarray:
    """The sketch: how often shingles of each counter occur as members of documents' sets."""

    def count(batches):
        total = np.zeros(WIDTH, np.int64)
        for _, hashes, _ in _sets(batches, k):
            total += np.bincount((hashes >> _SHIFT).astype(np.int64), minlength=WIDTH)
        rows = total.astype(np.int32).reshape(-1, BLOCK)
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[i].tobytes() for i in some], pa.binary())], ["block", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch["block"].to_pylist(), batch["counts"]):
                own = total.setdefault(i, np.zeros(BLOCK, np.int64))
                own += np.frombuffer(counts.as_py(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    out = np.zeros((WIDTH // BLOCK, BLOCK), np.int64)
    for block, counts in docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect():  # WIDTH counters in all
        out[block] = np.frombuffer(counts, np.int64)
    return out.ravel()


def shared_wanted(costs: np.ndarray, need: int) -> int:
    """How many shared shingles a document asks for; ``costs``: estimated other documents in its lists, in order."""
    n = len(costs)
    best, least = 1, None
    running = np.cumsum(costs)
    for l in range(1, min(MOST_SHARED, need) + 1):
        p = n - need + l
        cost = p + running[p - 1] / l
        if least is None or cost < least:
            best, least = l, cost
    return best


def summaries(texts: DataFrame, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """One row per row of ``texts`` (row, id, text): row, id, n, c1 and c2 (which name its set), wanted and prefix."""
    load = counts.sum() / WIDTH

    def run(batches):
        for part, hashes, first in _sets(batches, k):
            n = np.diff(first)
            seen = counts[(hashes >> _SHIFT).astype(np.int64)]
            cost = np.maximum(seen - load, 1.0) - 1.0
            mixed = (mix(hashes ^ np.uint64(0x1234567)), mix(hashes ^ np.uint64(0x89ABCDEF01)))
            names = []
            for m in mixed:
                total = np.zeros(len(m) + 1, np.uint64)
                np.cumsum(m, out=total[1:])
                names.append(mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)).view(np.int64))
            wanted, prefix, signed = np.ones(len(n), np.int32), [], hashes.view(np.int64)
            for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
                if a == b:
                    prefix.append(np.zeros(0, np.int64))
                    continue
                order = np.lexsort((hashes[a:b], seen[a:b]))
                need = -(-percent * (b - a) // 100)
                wanted[i] = shared_wanted(cost[a:b][order], int(need))
                prefix.append(signed[a:b][order[: b - a - need + wanted[i]]])
            yield pa.RecordBatch.from_arrays([part["row"], part["id"], pa.array(n), pa.array(names[0]), pa.array(names[1]), pa.array(wanted), _lists(prefix)], ["row", "id", "n", "c1", "c2", "wanted", "prefix"])

    kind = dict(texts.dtypes)["id"]
    return texts.select("row", "id", "text").mapInArrow(run, f"row long, id {kind}, n long, c1 long, c2 long, wanted int, prefix array<long>")


def shingle_rows(texts: DataFrame, k: int) -> DataFrame:
    """The whole set of each row of ``texts``: row and shingles."""

    def run(batches):
        for part, hashes, first in _sets(batches, k):
            yield pa.RecordBatch.from_arrays([part["row"], pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))], ["row", "shingles"])

    return texts.select("row", "text").mapInArrow(run, "row long, shingles array<long>")


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def _possible(percent: int, n1: Column, at1: Column, n2: Column, at2: Column) -> Column:
    """Whether sets that first meet at these places may be similar enough."""
    common = F.least(n1 - at1, n2 - at2)
    return common * 100 >= (n1 + n2 - common) * percent


def components_of_rows(keyed: Placed, k: int, percent: int, steps: Steps) -> DataFrame:
    """One line per row of ``keyed`` (id, text): row, id, n and rep, a row that names its component; null for sets of size 0."""
    counts = shingle_counts(keyed.df, k)
    every = steps(summaries(keyed.df, k, percent, counts), "summaries")
    grouped = every.where("n > 0").groupBy("c1", "c2").agg(F.min(F.struct("row", "n", "wanted", "prefix")).alias("x"))
    classes = steps(grouped.select("c1", "c2", F.col("x.row").alias("rep"), "x.n", "x.wanted", "x.prefix"), "classes")
    posts = classes.select("rep", "n", F.posexplode("prefix").alias("at", "token"))
    common = steps(posts.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "common")
    lists = steps(posts.join(common.hint("merge"), "token"), "lists")
    # what prefixes share stands in lists, so only these shingles of a prefix are needed beside a pair
    shared = lists.groupBy("rep").agg(F.collect_list("token").alias("tokens"))
    sides = steps(classes.select("rep", "n", "wanted", (F.col("n") - F.size("prefix")).alias("rest")).join(shared.hint("merge"), "rep"), "sides")
    labels = _link(keyed, lists, sides, k, percent, steps)
    found = classes.select("c1", "c2", "rep")
    if labels is not None:
        found = found.join(labels.hint("merge"), F.col("rep") == F.col("node"), "left").select("c1", "c2", F.coalesce("label", "rep").alias("rep"))
    return every.select("row", "id", "n", "c1", "c2").join(steps(found, "found"), ["c1", "c2"], "left").select("row", "id", "n", "rep")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id it reaches by links).

    The result is a table in the shared folder; all others are deleted when this returns.
    """
    steps = Steps()
    keyed = placed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    rows = steps(components_of_rows(keyed, k, percent, steps), "rows")
    least = rows.where("rep is not null").groupBy("rep").agg(F.min("id").alias("least"))
    own = F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.col("least"))
    out = stored(rows.join(least, "rep", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id")), "near_duplicates").df
    steps.drop()
    keyed.drop()
    return out


def distinct_rows(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays (null last, then the first row).

    Rows are told apart by themselves, not by their ids. Rows without words all stay.
    """
    steps = Steps()
    whole, names = placed_whole(docs)
    rows = steps(components_of_rows(whole.view(id=names[id_col], text=names[text_col]), k, percent, steps), "rows")
    rank = F.struct(F.col("id").isNull().alias("no"), "id", "row")
    best = rows.where("rep is not null").groupBy("rep").agg(F.min(rank).alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1").select("rep", F.col("b.row").alias("stays"))
    gone = rows.select("row", "rep").join(best, "rep").where("row != stays").select("row")
    out = stored(restored(whole.beside(whole.per_row(gone), "left_anti"), names), "distinct_rows").df
    steps.drop()
    whole.drop()
    return out


def _link(keyed: Placed, lists: DataFrame, sides: DataFrame, k: int, percent: int, steps: Steps) -> DataFrame | None:
    """(node, label) of all classes with links, None without any."""
    lists = steps(lists.join(_first_of_equal_lists(lists).hint("merge"), "token", "left_semi"), "own_lists")
    hubs = steps(lists.groupBy("token").agg(F.min(F.struct("at", "n", "rep")).alias("h")).select("token", "h.*"), "hubs")
    pairs = _pairs(lists.withColumn("label", F.col("rep")), hubs.withColumn("label", F.col("rep")), F.col("o.rep") != F.col("h.rep"), percent)
    labels = merged(None, _verified(keyed, pairs, sides, k, percent, steps), steps)
    lists = lists.withColumn("place", F.floor(F.pmod(F.xxhash64("rep", "token"), F.lit(1 << 31)) * F.col("size") / F.lit(float(1 << 31))))
    low, high, done = 0, HUBS, 2  # the pair of a list of two has met its hub
    while True:
        lists = lists.where(F.col("size") > done)
        left = lists.withColumn("label", F.col("rep"))
        if labels is not None:
            left = lists.join(labels.hint("merge"), F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep")).drop("node")
        several = steps(left.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("token"), "several")
        left = steps(left.join(several.hint("merge"), "token", "left_semi"), "open")
        hubs = left.where((F.col("place") >= low) & (F.col("place") < high))
        if not left.where(F.col("place") >= low).limit(1).count():
            return labels
        after = (F.col("o.place") > F.col("h.place")) | ((F.col("o.place") == F.col("h.place")) & (F.col("o.rep") > F.col("h.rep")))
        labels = merged(labels, _verified(keyed, _pairs(left, hubs, after, percent), sides, k, percent, steps), steps)
        # lists close as a whole, so places in the others stay as they were and every pair has its round
        lists, low, high, done = left.drop("label"), high, high * 16, high


def _first_of_equal_lists(lists: DataFrame) -> DataFrame:
    """One shingle of each set of lists with the same classes: the first in the global order, at which every pair of them meets first."""
    classes = [F.count(F.lit(1)), F.min("rep"), F.max("rep"), F.bit_xor(F.xxhash64("rep")), F.bit_xor(F.xxhash64("rep", F.lit(1)))]
    told = lists.groupBy("token").agg(*(c.alias(f"s{i}") for i, c in enumerate(classes)), F.min(F.struct("rep", "at")).alias("f"))
    return told.groupBy(*(f"s{i}" for i in range(len(classes)))).agg(F.min_by("token", "f.at").alias("token")).select("token")


def _pairs(lists: DataFrame, hubs: DataFrame, after: Column, percent: int) -> DataFrame:
    """Pairs of a hub and a class of its list that is in another component and may be similar enough."""
    o, h = lists.alias("o"), hubs.alias("h")
    fits = _possible(percent, F.col("o.n"), F.col("o.at"), F.col("h.n"), F.col("h.at"))
    met = o.join(h.hint("merge"), F.col("o.token") == F.col("h.token")).where(after & (F.col("o.label") != F.col("h.label")) & fits)
    return met.select(F.least("o.rep", "h.rep").alias("a"), F.greatest("o.rep", "h.rep").alias("b")).distinct()


def _verified(keyed: Placed, pairs: DataFrame, sides: DataFrame, k: int, percent: int, steps: Steps) -> DataFrame:
    """The pairs whose prefixes share what both ask for and whose sets are similar enough.

    What two prefixes share also bounds what the sets share: of the set whose prefix ends first
    only the rest can be added. Sets are made only for pairs that this leaves.
    """
    side = lambda x: sides.select(F.col("rep").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "wanted", "rest", "tokens"))).hint("merge")
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    most = shared + F.greatest("rest_a", "rest_b")
    enough = (shared >= F.least("wanted_a", "wanted_b")) & (most * 100 >= (F.col("n_a") + F.col("n_b") - most) * percent)
    close = steps(pairs.join(side("a"), "a").join(side("b"), "b").where(enough).select("a", "b", "n_a", "n_b"), "close")
    members = keyed.per_row(close.select(F.explode(F.array("a", "b")).alias("row")).distinct())
    sets = stored(shingle_rows(keyed.beside(members), k), "sets")
    one, two = (sets.df.select(F.col("row").alias(i), F.col("shingles").alias(f"s_{i}")).hint("merge") for i in "ab")
    common = F.size(F.array_intersect("s_a", "s_b"))
    linked = close.join(one, "a").join(two, "b").where(common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent)
    out = steps(linked.select("a", "b"), "links")
    sets.drop()
    return out
