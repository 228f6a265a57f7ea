"""Packing of documents into sequences of a fixed length, by cutting-stock column generation.

A document is its token ids and an end id. It is cut into whole sequences and a tail shorter
than one. Whole sequences stand alone; the tails are the stock to pack:

1. A histogram of tail lengths (one count for each length, however many documents) goes to the
   driver. A linear program over patterns, multisets of lengths that fill one sequence exactly,
   finds how often to use each so that as many ids as possible are in whole tails without
   padding. Patterns are columns that a knapsack dynamic program prices, made as they are needed.
2. The counts of patterns are rounded down, and up again where tails are left. What
   no pattern takes is laid end to end and cut at sequence ends; the last stretch becomes
   sequences of powers of two, which are not padded. So there is no padding at all, and the
   program keeps the number of cut tails small.
3. Tails are ranked by length (running counts inside tasks, sums over tasks). A pattern's count
   gives ranges of ranks of its lengths, so each tail finds its sequence and offset by itself.

Texts are tokenised once. The ids of tails are written beside their lengths and stay where they
are (``placed``); only tails that are cut are read again.

Null text is empty; an empty text is its end id alone. Null and repeated document ids are
documents like others. One text is tokenised in stretches of about ``STRETCH`` characters that
end where the tokenizer would split anyway.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.placed import placed
from lodestone.llm.store import Steps, stored

LENGTH = 1024
#: Characters of a text that are tokenised at once.
STRETCH = 1 << 19
#: The linear program stops here: ids of tails outside patterns as a share, or prices looked up so often.
GAP, MOST_PIVOTS = 2e-3, 1500
#: Fixed value: how byte-level BPE vocabularies of this kind split text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# -- tokenizing ---------------------------------------------------------------


def encoder(path: str) -> Callable[[str], list[int]]:
    """The ids of a text by the tokenizer file ``path``, without added special tokens.

    Byte-level BPE files with the usual split are run by tiktoken, which gives the same ids
    several times faster (a test holds both to each other); others by tokenizers itself.
    """
    spec = json.load(open(path, encoding="utf-8"))
    split, vocabulary = spec.get("pre_tokenizer") or {}, spec["model"].get("vocab")
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", ())):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return lambda text: own.encode(text, add_special_tokens=False).ids
    import tiktoken
    from tiktoken.registry import ENCODINGS  # lives as long as the worker process, over many tasks

    name = f"file:{path}"
    if name not in ENCODINGS:
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in word): i for word, i in vocabulary.items() if word not in added}
        ENCODINGS[name] = tiktoken.Encoding(name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
    fast = ENCODINGS[name]

    def encode(text: str) -> list[int]:
        if any(token in text for token in added):
            return fast.encode(text, allowed_special="all")
        return fast.encode_ordinary(text)

    return encode


_CUT = re.compile(r"(?<=[!-~]) ")


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """``text`` in pieces whose ids, one after another, are those of the whole: cut before a space that follows a visible ASCII character."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _tokenised(docs: DataFrame, path: str, end_id: int, length: int) -> DataFrame:
    """Of each document: its number of ids, checksums of its whole sequences, and its tail with its checksum; ranks count from 0 within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(path), np.zeros(length + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for i, text in zip(batch["id"].to_pylist(), batch["text"]):
                ids = np.concatenate([np.array(encode(s), np.uint32) for s in stretches(text.as_py() or "")] + [np.array([end_id], np.uint32)])
                whole = len(ids) // length
                tail = ids[whole * length :]
                crcs = [zlib.crc32(ids[k * length : (k + 1) * length].tobytes()) for k in range(whole)]
                out.append((i, task, len(ids), crcs, int(seen[length]), len(tail), zlib.crc32(tail.tobytes()), int(seen[len(tail)]), tail.tobytes()))
                seen[length] += whole
                seen[len(tail)] += len(tail) > 0
                held += len(tail)
                if held > 1 << 20:
                    yield batched(out)
                    out, held = [], 0
            if out:
                yield batched(out)

    kind = dict(docs.dtypes)["id"]
    names = ["id", "task", "tokens", "whole", "whole_rank", "tail", "crc", "tail_rank", "ids"]
    types = [None, pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[kind]

    def batched(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t or id_type) for c, t in zip(zip(*rows), types)], names)

    return docs.mapInArrow(run, f"id {kind}, task int, tokens long, whole array<long>, whole_rank long, tail int, crc long, tail_rank long, ids binary")


# -- the program --------------------------------------------------------------


class Program:
    """Column generation for one histogram: ``sizes`` (lengths that occur) and ``need`` (how often).

    A pattern is a multiset of lengths that fills a sequence exactly; the program uses patterns
    so that as many ids as possible are in them, and no length more often than it occurs. The
    basis begins with the unused tails of each length. Patterns that use up one length each, found by
    a knapsack for the widest bottleneck, bring it near the best; then the cheapest pattern
    under the prices of the basis enters until none is worth it.
    """

    def __init__(self, sizes: np.ndarray, need: np.ndarray, length: int = LENGTH):
        self.sizes, self.need, self.length = sizes.astype(np.int64), need.astype(np.float64), length
        m = len(sizes)
        self.basis: list[dict[int, int] | int] = list(range(m))  # an unused length, or a pattern
        self.value = np.zeros(m)
        self.inverse = np.eye(m)
        self.x = self.need.copy()
        self.pivots = 0

    def _knapsack(self, first: float, join: Callable, pick: Callable, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each total up to the length, the best over exact fills with the items ``some``, and its last item."""
        sizes = self.sizes[some]
        worst = -first if first == np.inf else np.inf
        best, last = np.full(self.length + 1, worst), np.zeros(self.length + 1, np.int64)
        best[0] = first
        reach = np.searchsorted(sizes, np.arange(self.length + 1), side="right")
        for t in range(int(sizes[0]) if len(sizes) else self.length + 1, self.length + 1):
            value = join(best[t - sizes[: reach[t]]], reach[t])
            last[t] = k = pick(value)
            best[t] = value[k]
        return best, some[last] if len(some) else last

    def _pattern(self, last: np.ndarray, t: int, item: int) -> dict[int, int]:
        out: dict[int, int] = {}
        while t > 0:
            out[item] = out.get(item, 0) + 1
            t -= int(self.sizes[item])
            item = int(last[t])
        return out

    def _enter(self, at: np.ndarray, count: np.ndarray, column: dict[int, int] | int, value: float) -> bool:
        step = self.inverse[:, at] @ count
        good = step > 1e-9
        if not good.any():
            return False
        ratio = np.where(good, self.x / np.where(good, step, 1), np.inf)
        row = int(ratio.argmin())
        theta = ratio[row]
        self.x = np.maximum(self.x - theta * step, 0)
        self.x[row] = theta
        pivot = self.inverse[row] / step[row]
        moved = np.flatnonzero(np.abs(step) > 1e-12)
        self.inverse[moved] -= np.outer(step[moved], pivot)
        self.inverse[row] = pivot
        self.basis[row], self.value[row] = column, value
        self.pivots += 1
        if self.pivots % 500 == 0:  # rounding errors do not add up
            self.refresh()
        return True

    def _widest(self) -> bool:
        """One pattern of lengths that are still unused, with the widest bottleneck; whether there was one."""
        unused = np.zeros(len(self.sizes))
        for row, column in enumerate(self.basis):
            if isinstance(column, int):
                unused[column] = self.x[row]
        some = np.flatnonzero(unused >= 1)
        best, last = self._knapsack(np.inf, lambda before, n: np.minimum(before, unused[some[:n]]), np.argmax, some)
        if not best[self.length] > 0:
            return False
        pattern = self._pattern(last, self.length, int(last[self.length]))
        return self._enter(np.array(list(pattern)), np.array(list(pattern.values()), np.float64), pattern, self.length)

    def _cheapest(self, most: int = 32) -> bool:
        """The cheapest patterns under the prices of the basis enter; whether any did."""
        prices = self.value @ self.inverse
        entered = False
        for k in np.argsort(prices)[:4]:  # a length whose price is below nothing is better left unused
            if prices[k] < -1e-7 * self.length:
                entered |= self._enter(np.array([k]), np.ones(1), int(k), 0.0)
                prices = self.value @ self.inverse
        paid = np.maximum(prices, 0)
        everything = np.arange(len(self.sizes))
        best, last = self._knapsack(0.0, lambda before, n: before + paid[:n], np.argmin, everything)
        ends = best[self.length - self.sizes] + paid
        seen = set()
        for i in np.argsort(ends)[:most]:
            if not ends[i] < self.length * (1 - 1e-7):
                break
            pattern = self._pattern(last, self.length, int(i))
            key = tuple(sorted(pattern.items()))
            at, count = np.array(list(pattern)), np.array(list(pattern.values()), np.float64)
            if key not in seen and self.length - (self.value @ self.inverse[:, at]) @ count > 1e-7 * self.length:
                seen.add(key)
                entered |= self._enter(at, count, pattern, self.length)
        return entered

    def solve(self, gap: float = GAP, most: int = MOST_PIVOTS) -> list[tuple[dict[int, int], float]]:
        """Patterns and how often each is used."""
        every = float(self.need @ self.sizes)
        far = lambda: every - self.value @ self.x > gap * every
        while far() and self._widest():
            pass
        begun = self.pivots
        while far() and self.pivots - begun < most and self._cheapest():
            pass
        self.refresh()
        return [(c, x) for c, x in zip(self.basis, self.x) if not isinstance(c, int)]

    def refresh(self) -> None:
        matrix = np.zeros((len(self.sizes), len(self.sizes)))
        for j, column in enumerate(self.basis):
            if isinstance(column, int):
                matrix[column, j] = 1
            else:
                matrix[list(column), j] = list(column.values())
        self.inverse = np.linalg.inv(matrix)
        self.x = np.maximum(self.inverse @ self.need, 0)


@dataclass
class Layout:
    """Where tails go. By length: the ranks below ``taken`` are in patterns, whose ranges begin at ``starts``; the others lie end to end from ``base`` on."""

    length: int
    taken: np.ndarray
    base: np.ndarray
    #: For each length: first ranks of ranges, and of each range the first sequence, tails of this length in a sequence, offset of the first.
    starts: list[np.ndarray]
    ranges: list[np.ndarray]
    #: First sequence of the stretch of cut tails, its ids, and first sequence after it.
    first: int
    total: int
    after: int

    def ends(self) -> np.ndarray:
        """Ends of the sequences in the last, incomplete stretch of the cut tails."""
        rest, at = self.total % self.length, self.total - self.total % self.length
        powers = [1 << b for b in reversed(range(self.length.bit_length())) if rest >> b & 1]
        return at + np.cumsum(powers, dtype=np.int64)

    def sequence(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of places in the stretch of cut tails."""
        whole, ends = self.total // self.length * self.length, self.ends()
        late = np.searchsorted(ends, place, side="right")
        begin = np.append(whole, ends)[np.minimum(late, len(ends))]
        inside = place < whole
        sequence = np.where(inside, place // self.length, whole // self.length + late)
        return self.first + sequence, np.where(inside, place % self.length, place - begin)


def layout(counts: np.ndarray, length: int = LENGTH, gap: float = GAP) -> Layout:
    """A layout of tails from the number of tails of each length (places 1 to ``length`` - 1 of ``counts``)."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    sizes = np.flatnonzero(left)
    used: list[tuple[dict[int, int], int]] = []
    if len(sizes):
        solved = Program(sizes, left[sizes], length).solve(gap)
        exact = [({int(sizes[i]): n for i, n in pattern.items()}, x) for pattern, x in solved]
        times = [int(x + 1e-6) for _, x in exact]
        for k, (pattern, _) in enumerate(exact):
            times[k] = min([times[k], *(left[s] // n for s, n in pattern.items())])
            for s, n in pattern.items():
                left[s] -= n * times[k]
        for k in sorted(range(len(exact)), key=lambda k: times[k] - exact[k][1]):  # round up where tails are left
            more = min(left[s] // n for s, n in exact[k][0].items())
            times[k] += more
            for s, n in exact[k][0].items():
                left[s] -= n * more
        used = [(pattern, int(t)) for (pattern, _), t in zip(exact, times) if t]
    sequence = 0
    starts: list[list[int]] = [[] for _ in range(length + 1)]
    ranges: list[list[tuple[int, int, int]]] = [[] for _ in range(length + 1)]
    taken = np.zeros(length + 1, np.int64)
    for pattern, t in used:
        offset = 0
        for s, n in sorted(pattern.items(), reverse=True):
            starts[s].append(int(taken[s]))
            ranges[s].append((sequence, n, offset))
            taken[s] += n * t
            offset += s * n
        sequence += t
    ids = left * np.arange(len(left))
    base = np.append(0, np.cumsum(ids[::-1])[:-1])[::-1]  # long tails first
    total = int(ids.sum())
    out = Layout(length, taken, base, [np.array(s, np.int64) for s in starts], [np.array(r, np.int64).reshape(-1, 3) for r in ranges], sequence, total, 0)
    out.after = sequence + total // length + len(out.ends())
    return out


# -- assigning ----------------------------------------------------------------

_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _placed_tails(tails: DataFrame, plan: Layout) -> DataFrame:
    """Sequence and offset of tails; for tails that are cut, the places (in the tail) where pieces begin, each with its sequence and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch["tail"].to_numpy().astype(np.int64), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            cut = np.zeros(len(size), bool)
            for s in np.unique(size):
                own = np.flatnonzero((size == s) & (rank < plan.taken[s]))
                if len(own):
                    at = np.searchsorted(plan.starts[s], rank[own], side="right") - 1
                    first, n, begin = plan.ranges[s][at].T
                    inside = rank[own] - plan.starts[s][at]
                    sequence[own], offset[own] = first + inside // n, begin + inside % n * s
            free = np.flatnonzero(rank >= plan.taken[size])
            place = plan.base[size[free]] + (rank[free] - plan.taken[size[free]]) * size[free]
            sequence[free], offset[free] = plan.sequence(place)
            cut[free] = plan.sequence(place + size[free] - 1)[0] != sequence[free]
            pieces: list = [None] * len(size)
            for k, p in zip(free.tolist(), place.tolist()):
                if cut[k]:
                    every = np.arange(p, p + size[k])
                    of, there = plan.sequence(every)
                    begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                    pieces[k] = [{"at": int(b), "sequence": int(of[b]), "offset": int(there[b])} for b in begins]
            kind = pa.list_(pa.struct([("at", pa.int32()), ("sequence", pa.int64()), ("offset", pa.int32())]))
            rest = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(sequence), pa.array(offset), pa.array(pieces, kind)], [*rest, "sequence_id", "offset", "pieces"])

    schema = ", ".join(f"{n} {t}" for n, t in tails.dtypes if n != "rank")
    return tails.mapInArrow(run, f"{schema}, sequence_id long, offset long, pieces array<struct<at: int, sequence: long, offset: int>>")


def _cut_tails(rows: DataFrame) -> DataFrame:
    """The pieces of tails that are cut, from their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, out = [], []
            for k, (tokens, size, ids, pieces) in enumerate(zip(*(batch[c].to_pylist() for c in ("tokens", "tail", "ids", "pieces")))):
                ends = [p["at"] for p in pieces[1:]] + [size]
                for p, end in zip(pieces, ends):
                    which.append(k)
                    out.append((tokens - size + p["at"], end - p["at"], zlib.crc32(ids[4 * p["at"] : 4 * end]), tokens, p["sequence"], p["offset"]))
            columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(which, pa.int64())), *columns], ["id", *(c.split()[0] for c in _PIECE.split(", "))])

    return rows.select("id", "tokens", "tail", "ids", "pieces").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, {_PIECE}")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = LENGTH, gap: float = GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the document's id, start, length, ids_crc32, doc_tokens, sequence_id and offset. ``length`` is a power of two.

    The result is a table in the shared folder; all others are deleted when this returns.
    """
    steps = Steps()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = placed(_tokenised(rows, tokenizer, end_id, length))
    light = keyed.df.drop("ids")
    counted = light.groupBy("task", "tail").agg(F.count(F.lit(1)).alias("n")).where("tail > 0")
    counted = counted.unionByName(light.where(F.size("whole") > 0).groupBy("task").agg(F.sum(F.size("whole")).cast("long").alias("n")).withColumn("tail", F.lit(length)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tail").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = steps(counted.withColumn("before", before).withColumnsRenamed({"task": "of_task", "tail": "of_tail"}), "ranks")
    counts = np.zeros(length + 1, np.int64)
    for r in ranks.groupBy("of_tail").agg(F.sum("n").alias("n")).collect():  # one row for each length
        counts[r["of_tail"]] = r["n"]
    plan = layout(counts[:-1], length, gap)

    beside = lambda size: (F.col("task") == F.col("of_task")) & (size == F.col("of_tail"))
    tails = light.where("tail > 0").join(ranks, beside(F.col("tail"))).select("row", "id", "tokens", "tail", "crc", (F.col("tail_rank") + F.col("before")).alias("rank"))
    tails = steps(_placed_tails(tails, plan), "tails")
    names = [c.split()[0] for c in _PIECE.split(", ")]
    start = (F.col("tokens") - F.col("tail")).alias("start")
    uncut = tails.where("pieces IS NULL").select("id", start, F.col("tail").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")
    cut = _cut_tails(keyed.beside(keyed.per_row(tails.where("pieces IS NOT NULL").select("row", "pieces"), F.first("pieces").alias("pieces"))))
    whole = light.where(F.size("whole") > 0).join(ranks.where(F.col("of_tail") == length), F.col("task") == F.col("of_task"))
    whole = whole.select("id", "tokens", (F.col("whole_rank") + F.col("before") + plan.after).alias("first"), F.posexplode("whole").alias("k", "crc"))
    whole = whole.select(
        "id", (F.col("k") * F.lit(length).cast("long")).alias("start"), F.lit(length).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"),
        (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    out = stored(uncut.unionByName(cut).unionByName(whole).select("id", *names), "packed").df
    steps.drop()
    keyed.drop()
    return out.withColumnRenamed("id", id_col)
