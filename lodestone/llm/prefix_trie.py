"""Trie of conversation prefixes.

A node of depth d is a distinct sequence of the first d turns (role and text) of a
conversation, the root is the empty sequence, and conversations that begin with a node are its
members. The operator gives one row per node: its smallest member and its parent's, the
numbers of members, children and leaves, the characters that storing every shared prefix once
would save, and a digest of the members that end there.

1. Turns become rows of a 128-bit digest and a length; texts move no further. They are
   range-sorted by conversation and turn, so that one endless conversation is split over tasks;
   running counts, with what the partitions before hold of the first conversation, give places.
2. Conversations with the same turns become one weighted sequence: sums of hashes of (place,
   digest) are a key of the whole conversation without collecting it. The ids of one key are
   range-sorted and packed into pieces of text, and the pieces hashed one after another; this is
   the one thing that a single task does for a whole group (SHA-256 reads in order), and it
   holds one piece at a time.
3. Sequences are partitioned by the digest of their first turn. Each subtree of up to ``most``
   turns is built by ``applyInPandas`` as a trie of dictionaries, whose sums an iterative
   postorder walk makes. A larger subtree is partitioned again by its next turn; its top node
   comes from an aggregation. A subtree of a single sequence is a path, which needs no trie.
4. The sums of the top nodes of step 3 go up level by level, one aggregation for each.

Turns stand in order of ``turn``, null first; turns equal in that stand in order of their
digest. Null role or text is empty. Rows with a null conversation id belong to no conversation
and are left out; no conversations give no rows, not even a root. Repeated rows are turns like
others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.store import Steps

#: Turns of a subtree that one task builds; larger subtrees are partitioned again.
MOST_TURNS = 4096
#: Characters of ids that are hashed at once.
PIECE = 1 << 16
_NOTHING = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = [c.split()[0] for c in _NODE.split(", ")]


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ordered_turns(turns: DataFrame, steps: Steps) -> DataFrame:
    """(conv_id, place, digest, chars): place from 0 in a conversation's turns."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            ids = batch["conv_id"].to_numpy()
            if not len(ids):
                continue
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            place = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
            if last == ids[0]:
                place[: first[1] if len(first) > 1 else len(ids)] += seen
            last, seen = ids[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("part", "conv_id", "digest", "chars")), pa.array(place)], ["part", "conv_id", "digest", "chars", "place"])

    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    order = ["conv_id", F.asc_nulls_first("turn"), "digest"]
    ranged = rows.repartitionByRange(_parts(turns), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged = steps(ranged.select("part", "conv_id", "digest", "chars").mapInArrow(counted, "part int, conv_id long, digest binary, chars long, place long"), "turns")
    # what the partitions before hold of the conversation that a partition begins with: one row for each partition
    ends = sorted(ranged.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place")).alias("last")).collect(), key=lambda r: r["part"])
    carried, before = [], (None, 0)
    for r in ends:
        more = before[1] if before[0] == r["first"] else 0
        carried.append((r["part"], r["first"], more))
        before = (r["last"]["conv_id"], r["last"]["place"] + 1 + (more if r["last"]["conv_id"] == r["first"] else 0))
    carry = turns.sparkSession.createDataFrame(carried, "part int, first long, more long")
    place = F.col("place") + F.when(F.col("conv_id") == F.col("first"), F.col("more")).otherwise(0)
    return ranged.join(F.broadcast(carry), "part").select("conv_id", place.alias("place"), "digest", "chars")


def rebuilt(rows: DataFrame, block: int, kinds: int) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth from 1, digest, chars) of the rebuilt conversations, and all conversation ids.

    Of conversation c, the first h = crc32(c) % ``kinds`` turns are those of the first
    conversation of its block of ``block`` ids (as many as there are).
    """
    base = F.col("conv_id") - F.col("conv_id") % block
    h = F.crc32(F.col("conv_id").cast("string")) % kinds
    convs = rows.where("place = 0").select("conv_id")
    heads = rows.where((F.col("conv_id") % block == 0) & (F.col("place") < kinds - 1)).select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    found = heads.groupBy("base").agg((F.max("place") + 1).alias("there"))
    taken = convs.withColumn("base", base).withColumn("h", h).join(heads, "base").where("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "chars")
    own = rows.withColumn("base", base).withColumn("h", h).where("place >= h").join(found, "base", "left")
    depth = F.least("h", F.coalesce("there", F.lit(0))) + F.col("place") - F.col("h") + 1
    return taken.unionByName(own.select("conv_id", depth.alias("depth"), "digest", "chars")), convs


_KEY = ["n", "a", "b"]


def sequences(turns: DataFrame, convs: DataFrame, steps: Steps) -> DataFrame:
    """Conversations by their whole sequence of turns: n (its turns), seq (the smallest id), weight (how many), ends (digest of their ids)."""
    lane = lambda salt: F.xxhash64(F.lit(salt), "depth", "digest").cast("decimal(20,0)")
    whole = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(lane("a")).alias("a"), F.sum(lane("b")).alias("b"))
    zero = F.lit(0).cast("decimal(30,0)")
    whole = convs.join(whole, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"))
    order = [*_KEY, "conv_id"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are sorted; one piece for each key, or several for a long one
        now, ids, size, out = None, [], 0, []

        def flush():
            if ids:
                out.append((*now, int(ids[0]), len(ids), ",".join(ids)))

        for batch in batches:
            for *key, i in zip(*(batch[c].to_pylist() for c in order)):
                if key != now or size >= PIECE:
                    flush()
                    now, ids, size = key, [], 0
                ids.append(str(i))
                size += len(ids[-1]) + 1
            if len(out) > 5000 or sum(len(o[-1]) for o in out) > PIECE * 8:
                yield _batch(out)
                out = []
        flush()
        if out:
            yield _batch(out)

    kinds = [pa.int64(), pa.decimal128(30, 0), pa.decimal128(30, 0), pa.int64(), pa.int64(), pa.string()]
    names = [*_KEY, "first", "size", "ids"]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    pieces = whole.repartitionByRange(_parts(turns), *order).sortWithinPartitions(*order).mapInArrow(packed, "n long, a decimal(30,0), b decimal(30,0), first long, size long, ids string")
    pieces = steps(pieces, "pieces").repartition(_parts(turns), *_KEY).sortWithinPartitions(*_KEY, "first")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, weight, digest, out = None, 0, 0, None, []
        for batch in batches:
            for *key, first, size, ids in zip(*(batch[c].to_pylist() for c in names)):
                if key == now:
                    digest.update(b",")
                    weight += size
                else:
                    if now:
                        out.append((now[0], seq, weight, digest.hexdigest()))
                    now, seq, weight, digest = key, first, size, hashlib.sha256()
                digest.update(ids.encode())
            if len(out) > 5000:
                yield _sequences(out)
                out = []
        if now:
            out.append((now[0], seq, weight, digest.hexdigest()))
        if out:
            yield _sequences(out)

    def _sequences(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["n", "seq", "weight", "ends"])

    return steps(pieces.mapInArrow(hashed, "n long, seq long, weight long, ends string"), "sequences")


def subtrie(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of one subtree, from the turns of its sequences (seq, depth, digest, chars, n, weight, ends, parent, up); ``up`` is left on its top node only."""
    rows = rows.sort_values(["seq", "depth"], kind="stable")
    top = int(rows["depth"].iloc[0])
    children: list[dict[bytes, int]] = [{}]
    above, conv, depth, chars, members, ends = [-1], [0], [top - 1], [0], [0], [None]
    node = 0
    for seq, d, digest, size, n, weight, end in zip(*(rows[c].tolist() for c in ("seq", "depth", "digest", "chars", "n", "weight", "ends"))):
        node = 0 if d == top else node
        child = children[node].get(digest)
        if child is None:
            child = children[node][digest] = len(children)
            children.append({})
            for values, value in zip((above, conv, depth, chars, members, ends), (node, seq, d, size, 0, None)):
                values.append(value)
        node = child
        members[node] += weight
        if d == n:
            ends[node] = end
    leaves, saved = [0] * len(children), [0] * len(children)
    stack = [(k, iter(children[k].values())) for k in children[0].values()]
    while stack:  # postorder: a node is summed when its children are done
        k, rest = stack[-1]
        below = next(rest, None)
        if below is not None:
            stack.append((below, iter(children[below].values())))
            continue
        stack.pop()
        leaves[k] += not children[k]
        saved[k] += (members[k] - 1) * chars[k]
        leaves[above[k]] += leaves[k]
        saved[above[k]] += saved[k]
    parent, up = rows["parent"].iloc[0], rows["up"].iloc[0]
    out = [
        (conv[k], depth[k], conv[above[k]] if above[k] else parent, members[k], len(children[k]), leaves[k], saved[k], ends[k] or _NOTHING, None if above[k] else up)
        for k in range(1, len(children))
    ]
    return pd.DataFrame(out, columns=[*COLUMNS, "up"])


def _paths(rows: DataFrame) -> DataFrame:
    """The nodes of subtrees of a single sequence each."""
    top = F.col("depth") == F.col("top")

    def nodes(df: DataFrame, saved: Column) -> DataFrame:
        return df.select(
            F.col("seq").alias("conv_id"), "depth", F.when(top, F.col("parent")).otherwise(F.col("seq")).alias("parent_conv_id"), F.col("weight").alias("n_convs"),
            (F.col("depth") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens"),
            F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256"), F.when(top, F.col("up")).alias("up"),
        )

    below = Window.partitionBy("seq").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    copies = rows.where("weight > 1")
    return nodes(rows.where("weight = 1"), F.lit(0)).unionByName(nodes(copies.withColumn("below", F.sum("chars").over(below)), (F.col("weight") - 1) * F.col("below")))


def prefix_trie(turns: DataFrame, block: int = 100, kinds: int = 6, most: int = MOST_TURNS) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text)."""
    steps, kept = Steps(), Steps()
    spark = turns.sparkSession
    rows, convs = rebuilt(ordered_turns(turns.select("conv_id", "turn", "role", "text"), steps), block, kinds)
    rows = steps(rows, "rebuilt")
    seqs = sequences(rows, convs, steps)
    total = seqs.agg(F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max(F.when(F.col("n") == 0, F.col("ends"))).alias("ends")).first()
    if total["n_convs"] is None:
        return spark.createDataFrame([], _NODE)

    own = seqs.where("n > 0").select("seq", "n", "weight", F.col("ends").alias("last"))
    work = rows.join(own, F.col("conv_id") == F.col("seq")).select("seq", "depth", "digest", "chars", "n", "weight", F.when(F.col("depth") == F.col("n"), F.col("last")).alias("ends"))
    work = steps(work.withColumn("key", F.lit("")).withColumn("parent", F.lit(total["conv_id"]).cast("long")), "work")
    built: list[DataFrame] = []
    large: list[DataFrame] = []
    depth = 1
    while True:
        # the next turn of each sequence decides its subtree
        here = work.where(F.col("depth") == depth).select("seq", F.md5(F.concat(F.encode("key", "UTF-8"), F.col("digest"))).alias("subtree"), F.col("key").alias("up"), "parent", "weight", "n", "chars", "ends")
        tops = here.groupBy("subtree").agg(
            F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count(F.lit(1)).alias("seqs"), F.sum(F.col("n") - depth + 1).alias("turns"),
            F.min("up").alias("up"), F.min("parent").alias("parent"), F.max("chars").alias("chars"), F.max("ends").alias("ends"),
        )
        kind = F.when(F.col("seqs") == 1, F.lit("path")).when(F.col("turns") <= most, F.lit("trie")).otherwise(F.lit("large"))
        tops = steps(tops.withColumn("kind", kind), "tops")
        told = here.select("seq", "subtree").join(tops.select("subtree", "kind", F.col("conv_id").alias("top_conv")), "subtree")
        tagged = steps(work.join(told, "seq").select(*work.columns, F.col("key").alias("up"), "subtree", "kind", "top_conv"), "tagged")
        tries = tagged.where("kind = 'trie'").select("subtree", "seq", "depth", "digest", "chars", "n", "weight", "ends", "parent", "up")
        built.append(kept(tries.groupBy("subtree").applyInPandas(lambda pdf: subtrie(pdf), f"{_NODE}, up string"), "tries"))
        built.append(_paths(tagged.where("kind = 'path'").withColumn("top", F.lit(depth))))
        if not tops.where("kind = 'large'").limit(1).count():
            break
        large.append(tops.where("kind = 'large'").withColumn("depth", F.lit(depth).cast("long")))
        work = tagged.where((F.col("kind") == "large") & (F.col("depth") > depth)).select(*(c for c in work.columns if c not in ("key", "parent")), F.col("subtree").alias("key"), F.col("top_conv").alias("parent"))
        depth += 1

    done = built[0].unionByName(built[1])
    for more in built[2:]:
        done = done.unionByName(more)
    done = kept(done, "nodes")
    root = spark.createDataFrame([("root", total["conv_id"], total["n_convs"], None, None, 0, total["ends"], 0)], "subtree string, conv_id long, n_convs long, up string, parent long, chars long, ends string, depth long")
    above = done.where("up IS NOT NULL").select("up", "n_leaves", "saved_tokens")
    for level in [*reversed(large), root.withColumn("subtree", F.lit(""))]:
        sums = above.groupBy("up").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        nodes = level.select("subtree", "conv_id", "n_convs", F.col("up").alias("above"), "parent", "chars", "ends", "depth").join(sums, F.col("subtree") == F.col("up"), "left")
        nodes = nodes.select(
            "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"), F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256"), F.col("above").alias("up"),
        )
        nodes = kept(nodes, "large")
        done = done.unionByName(nodes)
        above = above.unionByName(nodes.where("up IS NOT NULL").select("up", "n_leaves", "saved_tokens"))
    steps.drop()
    return done.select(*(F.col(c).cast(t) for c, t in (x.split() for x in _NODE.split(", "))))
