"""Removal of repeated word passages by fixed-block anchors.

A window is ``window`` consecutive words of one document. Words in a window whose word
sequence also begins anywhere else are removed. Let ``block`` be ``(window + 1) // 2``: every
window holds a whole block that begins at a multiple of ``block`` in its document. So

1. these non-overlapping reference blocks are the index, and every rolling window of
   ``block`` words probes it. Blocks and probes meet by hash;
2. a hash group with a reference block and two or more members gives hits, and each hit is
   extended: all windows that hold it are hashed whole and meet in the same way. A window
   met twice is repeated; the union of the repeated windows at a place is a maximal repeat.

Blocks meet by 38 bits of their hash, which can only add work; whole windows meet by 126 bits
of two hashes that read the words' bytes independently. The words themselves are not compared again.

Both meetings use one exchange of packed rows: a map task sorts the entries of a few
megabytes of text by bucket and sends one binary row for each bucket, about 8 bytes for a
probe. Inside such a piece, members of one hash become one entry that says so, so a passage
that a third of all documents hold reaches its bucket once per piece of text and not once per
document. The number of buckets follows the bytes of the texts, so a bucket has one size at
every input. Texts are written once and stay where they are; hits come to them (``placed``).

Null text has no words. Documents with fewer words than a window keep all of them. Every
row is a document of its own, also when ids are null or repeated: repeated rows hold the
same windows and lose them all. White space between kept words becomes one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.placed import Placed, placed
from lodestone.llm.store import stored, written_bytes
from lodestone.llm.words import Words, slices

#: Rows whose answers travel together, as a power of two: neighbours in one partition.
SLICE = 9
#: Bytes of written (compressed) text for each bucket; its entries take about four times as many in a worker's memory.
BUCKET_BYTES = 4 << 20
_U = np.uint64
_ENTRY = "bucket int, base long, keys binary, rows binary, places binary, found boolean"
_NAMES = ["bucket", "base", "keys", "rows", "places", "found"]
#: Bits at the low end of a packed key: it is a reference block; its piece of text has several of it.
_ANCHOR, _SEVERAL = _U(1), _U(2)
_SIZES = (np.uint8, np.uint16, np.uint32, np.uint64)


def _small(values: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes that hold the largest."""
    top = int(values.max()) if len(values) else 0
    return values.astype(_SIZES[0] if top < 1 << 8 else _SIZES[1] if top < 1 << 16 else _SIZES[2] if top < 1 << 32 else _SIZES[3]).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(data) // n]).astype(np.int64) if n else np.zeros(0, np.int64)


def _packed(hashes: np.ndarray, others: np.ndarray | None, rows: np.ndarray, places: np.ndarray, anchors: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Entries of one piece of text by bucket; members of a hash that the piece has several times are given out as found.

    A key has 5 bytes of ``hashes`` or, if there are ``others``, 16 bytes of both; its two lowest bits are flags.
    """
    out: list[list] = [[] for _ in _NAMES]

    def put(bucket, keys, row, place, found):
        out[0].append(bucket)
        out[1].append(int(row[0]))
        out[2].append(keys)
        out[3].append(_small(np.diff(row, prepend=row[0])))
        out[4].append(_small(place))
        out[5].append(found)

    pair = (np.zeros(len(hashes), np.uint64), hashes >> _U(24) << _U(2)) if others is None else (hashes, others & ~_U(3))
    order = np.lexsort((pair[1], hashes))
    h, g = hashes[order], pair[1][order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(h)))
    several = order[np.repeat(size > 1, size)]
    several = several[np.lexsort((places[several], rows[several]))]
    if len(several):
        put(int(rows[several[0]] % buckets), bytes(len(several)), rows[several], places[several], True)
    if len(begin):
        flags = np.where(size > 1, _SEVERAL, _U(0)) | np.where(np.maximum.reduceat(anchors[order], begin), _ANCHOR, _U(0))
        one = order[begin]
        bucket = (h[begin] % _U(buckets)).astype(np.int64)
        key = np.stack([pair[0][one], g[begin] | flags], axis=1)
        by = np.lexsort((places[one], rows[one], bucket))
        one, bucket, key = one[by], bucket[by], np.ascontiguousarray(key[by]).view(np.uint8).reshape(-1, 16)
        key = key[:, 8:13] if others is None else key
        edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        for a, b in zip(edges[:-1], edges[1:]):
            put(int(bucket[a]), key[a:b].tobytes(), rows[one[a:b]], places[one[a:b]], False)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()))], _NAMES)


def _meet(width: int, anchored: bool):
    """For one bucket: the entries whose hash has another member (and, if ``anchored``, a reference block), as row and places."""

    def meet(table: pa.Table) -> pa.Table:
        keys, rows, places, known = [], [], [], []
        for base, key, row, place, found in zip(*(table[c].to_pylist() for c in _NAMES[1:])):
            n = len(key) if found else len(key) // width
            rows.append(base + np.cumsum(_wide(row, n)))
            places.append(_wide(place, n))
            full = np.zeros((n, 16), np.uint8)
            if not found:
                full[:, slice(8, 13) if width == 5 else slice(0, 16)] = np.frombuffer(key, np.uint8).reshape(n, width)
            keys.append(full.view(np.uint64))
            known.append(np.full(n, found))
        keys, rows, places, known = (np.concatenate(x) for x in (keys, rows, places, known))
        new = np.flatnonzero(~known)
        order = new[np.lexsort((keys[new, 1] >> _U(2), keys[new, 0]))]
        h, first = keys[order, 1], keys[order, 0]
        hit = np.zeros(0, np.int64)
        if len(h):
            fresh = np.ones(len(h), bool)
            fresh[1:] = ((h[1:] >> _U(2)) != (h[:-1] >> _U(2))) | (first[1:] != first[:-1])
            begin = np.flatnonzero(fresh)
            size = np.diff(np.append(begin, len(h)))
            good = size > 1
            if anchored:
                good &= np.bitwise_or.reduceat(h, begin) & _U(3) > 0
            hit = order[np.repeat(good, size) & (h & _SEVERAL == 0)]
        hit = np.concatenate([hit, np.flatnonzero(known)])
        hit = hit[np.lexsort((places[hit], rows[hit]))]
        rows, places = rows[hit], places[hit]
        first = np.flatnonzero(np.diff(rows >> SLICE, prepend=-1)) if len(hit) else np.zeros(0, np.int64)
        offsets = pa.array(np.append(first, len(hit)).astype(np.int32))
        docs = pa.array((rows & ((1 << SLICE) - 1)).astype(np.int32))
        return pa.table([pa.array(rows[first] >> SLICE), pa.ListArray.from_arrays(offsets, docs), pa.ListArray.from_arrays(offsets, pa.array(places.astype(np.int32)))], ["slice", "docs", "places"])

    return meet


def _pieces(rows: np.ndarray, texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of one slice, with a few megabytes of text at most or one row."""
    for a, b in slices(texts):
        cuts = a + 1 + np.flatnonzero(np.diff(rows[a:b] >> SLICE))
        yield from zip([a, *cuts.tolist()], [*cuts.tolist(), b])


def _places(answers: pa.Table) -> dict[int, np.ndarray]:
    """The answered places of each row of one slice."""
    if not answers.num_rows:
        return {}
    docs, places = (np.concatenate([np.asarray(x.values) for x in answers[c]]) for c in ("docs", "places"))
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    return dict(zip((docs[first].astype(np.int64) + (answers["slice"][0].as_py() << SLICE)).tolist(), np.split(places, first[1:])))


def _probes(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    block = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch["row"].to_numpy()
            for a, b in _pieces(row, batch["text"]):
                words = Words(batch["text"].slice(a, b - a))
                hashes, at = words.runs(block)
                doc = np.repeat(np.arange(b - a), words.counts)[at]
                enough = words.counts[doc] >= window
                hashes, at, doc = hashes[enough], at[enough], doc[enough]
                places = at - words.first[doc]
                if len(hashes):
                    yield _packed(hashes, None, row[a:b][doc], places, places % block == 0, buckets)

    return docs.select("row", "text").mapInArrow(run, _ENTRY)


def _lines(docs: Placed, answers: DataFrame) -> DataFrame:
    """Answers gathered to one line for each row that has any, where the row is; no text moves."""

    def split(table: pa.Table) -> pa.Table:
        found = _places(table)
        offsets = np.append(0, np.cumsum([len(p) for p in found.values()])).astype(np.int32)
        flat = np.concatenate(list(found.values())) if found else np.zeros(0, np.int32)
        return pa.table([pa.array(list(found), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))], ["row", "places"])

    return docs.per_row(answers.groupBy("slice").applyInArrow(split, "row long, places array<int>"), F.first("places").alias("places"))


def _windows(docs: Placed, hits: DataFrame, window: int, buckets: int) -> DataFrame:
    """Whole windows around the hits of each document."""
    block = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch["row"].to_numpy()
            for a, b in _pieces(row, batch["text"]):
                words = Words(batch["text"].slice(a, b - a))
                near = np.zeros(len(words.hashes) + 1, np.int64)
                for i in range(b - a):
                    found = np.asarray(batch["places"][a + i].values)
                    np.add.at(near, words.first[i] + np.maximum(found - (window - block), 0), 1)
                    np.add.at(near, words.first[i] + found + 1, -1)
                near = np.cumsum(near) > 0
                hashes, at = words.runs(window)
                others = words.runs(window, other=True)[0][near[at]]
                hashes, at = hashes[near[at]], at[near[at]]
                if len(hashes):
                    doc = np.repeat(np.arange(b - a), words.counts)[at]
                    yield _packed(hashes, others, row[a:b][doc], at - words.first[doc], np.ones(len(at), bool), buckets)

    return docs.beside(_lines(docs, hits)).select("row", "text", "places").mapInArrow(run, _ENTRY)


def _kept(docs: Placed, repeats: DataFrame, window: int) -> DataFrame:
    """Documents without the words of the repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, out = [], [], []
            for text, found in zip(batch["text"], batch["places"]):
                words = (text.as_py() or "").encode().split()
                total.append(len(words))
                if found.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    first = np.unique(np.asarray(found.values))
                    edge[first] += 1
                    np.add.at(edge, first + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                removed.append(total[-1] - len(words))
                out.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "text"])

    kind = dict(docs.df.dtypes)["id"]
    return docs.beside(_lines(docs, repeats), "left").select("id", "text", "places").mapInArrow(run, f"id {kind}, n_words long, n_removed long, text string")


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed and text, the kept words joined by one space.

    The result is a table in the shared folder; all others are deleted when this returns.
    """
    keyed = placed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    buckets = max(len(keyed.parts), -(-written_bytes(docs.sparkSession, keyed.path) // BUCKET_BYTES))
    found = "slice long, docs array<int>, places array<int>"
    hits = stored(_probes(keyed.df, window, buckets).groupBy("bucket").applyInArrow(_meet(5, True), found), "hits")
    repeats = stored(_windows(keyed, hits.df, window, buckets).groupBy("bucket").applyInArrow(_meet(16, False), found), "repeats")
    hits.drop()
    out = stored(_kept(keyed, repeats.df, window), "kept_words").df
    repeats.drop()
    keyed.drop()
    return out.withColumnRenamed("id", id_col)
