"""Line dedup within an edit bound, by a deletion-neighbourhood join.

A line is what stands between line feeds; it is read as its words. The edit bound is one unit
(inserted, deleted or exchanged) in ``least_units``: the units of a line with that many words
or more are its words, those of any other line are its characters (words joined by one space),
and a line with fewer characters than that has a bound of 0. Lines with different units are
not within a bound of each other. A line is removed if an earlier line is within the bound;
earlier means a smaller document id (null first), then the row, then the place in the
document. Lines without words are never removed.

1. Every line becomes two 64-bit hashes of its words. Lines with equal hashes are one
   distinct line with its earliest place.
2. Of two lines one edit apart, the first or the last half of the units is equal. Distinct
   lines that share no half with another leave here, without loss.
3. The others emit their deletion neighbourhood as hashed keys: the line itself and the line
   without its i-th unit, for each i outside the half that is shared. Equal keys are joined:
   with equal length and i they are an exchange, against a whole line they are an insertion.
   Each line meets only the earliest of a key, found by aggregation, so no group is expanded
   into pairs.
4. The edit is checked on the units of both lines.

Texts are written once and stay where they are: each step sends back the few numbers that it
has found about a row (``placed``). Joins are sort-merge joins at every size.

Null text has no lines. Every row is a document of its own, repeated ids too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.placed import Placed, placed
from lodestone.llm.store import stored
from lodestone.llm.words import Words, folded, mix, powers, slices

_U = np.uint64
_SEQ = _U(0xD1342543DE82EF95)
_INVERSE = _U(pow(int(_SEQ), -1, 1 << 64))
_OTHER = _U(0x632BE59BD9B4E019)
_CHARACTER = _U(0x2545F4914F6CDD1D)
#: Flags of a line whose half is shared: which half it is, and whether a line of another length shares it.
_FIRST, _LAST, _LENGTHS = 1, 2, 4


class _Runs:
    """Hashes of any runs of units, from running sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(_INVERSE, n), out=self.sums[1:])
        self.power = powers(_SEQ, n + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The finalised sum of h[i] * SEQ ** (b - 1 - i) over a <= i < b; 0 units give the hash of nothing."""
        return mix((self.sums[b] - self.sums[a]) * self.power[np.maximum(b - 1, 0)])


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of some texts and the text each is of."""
    parts = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), "\n")
    return parts.flatten(), np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))


def _units(lines: pa.Array, words: Words, some: np.ndarray, least_units: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the units of the lines ``some``, one after another, and where each line's units begin. A line with a bound of 0 has none."""
    counts = words.counts[some]
    short = np.flatnonzero(counts < least_units)
    spelt = [np.frombuffer(b" ".join((lines[some[i]].as_py() or "").encode().split()).decode().encode("utf-32-le"), np.uint32) for i in short]
    sizes = counts.copy()
    sizes[short] = [len(x) if len(x) >= least_units else 0 for x in spelt]
    first = np.append(0, np.cumsum(sizes))
    out = np.zeros(first[-1], np.uint64)
    wordy = np.repeat(counts >= least_units, sizes)
    own = np.repeat(counts >= least_units, counts)
    at = np.concatenate([np.arange(words.first[i], words.first[i + 1]) for i in some]) if len(some) else np.zeros(0, np.int64)
    out[wordy] = words.hashes[at[own]]
    if (~wordy).any():
        out[~wordy] = mix(np.concatenate([x for x in spelt if len(x) >= least_units]).astype(np.uint64) ^ _CHARACTER)
    return out, first


def _line_rows(keyed: DataFrame, least_units: int) -> DataFrame:
    """Every line with words: its place, the number of its units, two hashes of its words, and hashes of its first and last halves in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                lines, doc = _lines(batch["text"].slice(a, b - a))
                words = Words(lines)
                some = np.flatnonzero(words.counts)
                if not len(some):
                    continue
                begin, end = words.first[:-1][some], words.first[1:][some]
                whole, other = folded(words.hashes, begin, end), folded(words.others, begin, end, 1)
                units, first = _units(lines, words, some, least_units)
                runs, begin, end = _Runs(units), first[:-1], first[1:]
                n = end - begin
                kind = np.where(words.counts[some] >= least_units, _U(0), _CHARACTER)
                halves = np.zeros((len(some), 4), np.uint64)
                for i, size in enumerate((n // 2, np.maximum(n - 1, 0) // 2)):
                    halves[:, 2 * i] = mix(runs.of(begin, begin + size) ^ mix(size.astype(np.uint64)) ^ kind)
                    halves[:, 2 * i + 1] = mix(runs.of(end - size, end) ^ mix(size.astype(np.uint64) + _OTHER) ^ kind)
                keep = np.repeat((n > 0)[:, None], 4, 1)
                keep[:, 2:] &= (n % 2 == 0)[:, None]
                offsets = np.append(0, np.cumsum(keep.sum(1))).astype(np.int32)
                place = np.arange(len(lines)) - np.searchsorted(doc, doc)
                at = pa.array(doc[some])
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(a, b - a).take(at), batch["row"].slice(a, b - a).take(at), pa.array(place[some].astype(np.int32)), pa.array(n.astype(np.int32)),
                     pa.array(whole.view(np.int64)), pa.array(other.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(halves[keep].view(np.int64)))],
                    ["id", "row", "line", "n", "h", "g", "halves"],
                )

    kind = dict(keyed.dtypes)["id"]
    return keyed.select("id", "row", "text").mapInArrow(run, f"id {kind}, row long, line int, n int, h long, g long, halves array<long>")


def _picked(batch: pa.RecordBatch, least_units: int) -> Iterator[tuple]:
    """For slices of texts with ``wanted`` (line, flags), which may name a line repeatedly: ids, rows, lines and flags of these lines, their units and where each line's begin."""
    for a, b in slices(batch["text"]):
        lines, doc = _lines(batch["text"].slice(a, b - a))
        begin = np.searchsorted(doc, np.arange(b - a))
        wanted = batch["wanted"].slice(a, b - a)
        owner = np.repeat(np.arange(b - a), pc.list_value_length(wanted).to_numpy())
        entries = wanted.flatten()
        places, told = (entries.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        pick, inverse = np.unique(begin[owner] + places, return_inverse=True)
        flags = np.zeros(len(pick), np.int32)
        np.bitwise_or.at(flags, inverse, told)
        chosen = lines.take(pa.array(pick))
        units, first = _units(chosen, Words(chosen), np.arange(len(pick)), least_units)
        of = pa.array(doc[pick])
        yield batch["id"].slice(a, b - a).take(of), batch["row"].slice(a, b - a).take(of), (pick - begin[doc[pick]]).astype(np.int32), flags, units, first


def _neighbourhood(texts: DataFrame, least_units: int) -> DataFrame:
    """For the lines ``wanted``: keys of the line and of it without each unit from ``start`` on, as far as the shared halves leave units in doubt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, rows, places, flags, units, first in _picked(batch, least_units):
                low, high = first[:-1], first[1:]
                n = high - low
                half = np.maximum(n - 1, 0) // 2
                start = np.where(flags & _LAST, 0, half)
                stop = np.where(flags & _FIRST, n, n - half)
                size = stop - start
                line = np.repeat(np.arange(len(places)), size)
                at = np.arange(len(line)) - np.repeat(np.append(0, np.cumsum(size))[:-1], size) + (low + start)[line]
                runs = _Runs(units)
                # the units before ``at`` move one place to the right end
                without = mix((runs.sums[at] - runs.sums[low[line]]) * runs.power[high[line] - 1] * _INVERSE + (runs.sums[high[line]] - runs.sums[at + 1]) * runs.power[high[line] - 1])
                keys = np.insert(without, np.append(0, np.cumsum(size))[:-1], runs.of(low, high))
                offsets = pa.array(np.append(0, np.cumsum(size + 1)).astype(np.int32))
                columns = [ids, rows, pa.array(places), pa.array(n.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(flags & _LENGTHS > 0), pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "row", "line", "n", "start", "lengths", "keys"])

    kind = dict(texts.dtypes)["id"]
    return texts.select("id", "row", "text", "wanted").mapInArrow(run, f"id {kind}, row long, line int, n int, start int, lengths boolean, keys array<long>")


def _spelt(texts: DataFrame, least_units: int) -> DataFrame:
    """The units of the lines ``wanted``, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, places, _, units, first in _picked(batch, least_units):
                yield pa.RecordBatch.from_arrays([rows, pa.array(places), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(units.view(np.int64)))], ["row", "line", "units"])

    return texts.select("id", "row", "text", "wanted").mapInArrow(run, "row long, line int, units array<long>")


def _wanted(keyed: Placed, lines: DataFrame) -> DataFrame:
    """The texts of some lines (row, line, flags)."""
    return keyed.beside(keyed.per_row(lines, F.collect_list(F.struct("line", "flags")).alias("wanted")))


def _near(keyed: Placed, distinct: DataFrame, least_units: int) -> DataFrame:
    """Places (row, line) of distinct lines that an earlier one is one edit away from."""
    halves = distinct.select("row", "line", "n", F.posexplode("halves").alias("side", "half"))
    common = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least"), F.max("n").alias("most")).where("c > 1").select("half", (F.col("least") < F.col("most")).alias("lengths"))
    flags = F.when(F.col("side") % 2 == 0, F.lit(_FIRST)).otherwise(F.lit(_LAST)) + F.when(F.col("lengths"), F.lit(_LENGTHS)).otherwise(F.lit(0))
    shared = stored(halves.join(common.hint("merge"), "half").select("row", "line", flags.alias("flags")), "shared")
    table = stored(_neighbourhood(_wanted(keyed, shared.df), least_units), "neighbourhood")
    shared.drop()

    place = F.struct("id", "row", "line")
    forms = table.df.select("n", "start", "lengths", place.alias("o"), F.posexplode("keys").alias("i", "key"))
    cut = forms.where("i > 0").withColumn("at", F.col("start") + F.col("i") - 1)
    exchanged = cut.select(F.xxhash64("key", "n", "at").alias("form"), "o", "at")
    several = exchanged.groupBy("form").count().where("count > 1").select("form")
    met = stored(exchanged.join(several.hint("merge"), "form"), "met")
    first = met.df.groupBy("form").agg(F.min("o").alias("w"))
    swapped = met.df.join(first.hint("merge"), "form").where(F.col("w") < F.col("o")).select("o", "w", "at", F.lit("swap").alias("how"))
    whole = forms.where("i = 0 and lengths").select(F.col("o").alias("w"), (F.col("n") + 1).alias("n"), "key")
    shorter = stored(cut.where("lengths").select("key", "n", "o", "at").join(whole.hint("merge"), ["key", "n"]).select("o", "w", "at"), "shorter")
    inserted = shorter.df.where(F.col("w") < F.col("o")).withColumn("how", F.lit("cut"))
    # a whole line against the earliest longer line that holds it
    grown = shorter.df.where(F.col("o") < F.col("w")).groupBy("w").agg(F.min(F.struct("o", "at")).alias("m")).select(F.col("w").alias("o"), F.col("m.o").alias("w"), F.col("m.at").alias("at"), F.lit("grow").alias("how"))
    pairs = stored(swapped.unionByName(inserted).unionByName(grown), "pairs").df
    for done in (table, met, shorter):
        done.drop()

    members = pairs.select(F.explode(F.array("o", "w")).alias("m")).select("m.row", "m.line", F.lit(0).alias("flags")).distinct()
    spelt = stored(_spelt(_wanted(keyed, members), least_units), "spelt").df
    side = lambda of, units: spelt.select(F.col("row").alias(f"{of}_row"), F.col("line").alias(f"{of}_line"), F.col("units").alias(units)).hint("merge")
    flat = pairs.select(*(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ow" for c in ("row", "line")), "at", "how")
    cutting = lambda units: F.concat(F.slice(units, F.lit(1), F.col("at")), F.slice(units, F.col("at") + 2, F.size(units)))
    x, y = F.col("x"), F.col("y")
    same = F.when(F.col("how") == "swap", cutting(x) == cutting(y)).when(F.col("how") == "cut", cutting(x) == y).otherwise(x == cutting(y))
    checked = flat.join(side("o", "x"), ["o_row", "o_line"]).join(side("w", "y"), ["w_row", "w_line"]).where(same)
    return checked.select(F.col("o_row").alias("row"), F.col("o_line").alias("line")).distinct()


def _without(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, texts = [], [], []
            for text, gone in zip(batch["text"], batch["gone"]):
                lines = (text.as_py() or "").split("\n") if text.is_valid else []
                drop = set(gone.as_py() or ())
                total.append(len(lines))
                removed.append(len(drop))
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in drop))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["id", "n_lines", "n_removed", "text"])

    kind = dict(docs.dtypes)["id"]
    return docs.select("id", "text", "gone").mapInArrow(run, f"id {kind}, n_lines long, n_removed long, text string")


def remove_lines(docs: DataFrame, least_units: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_removed and text, the kept lines.

    The result is a table in the shared folder; all others are deleted when this returns.
    """
    keyed = placed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    lines = stored(_line_rows(keyed.df, least_units), "lines")
    place = F.struct("id", "row", "line")
    grouped = lines.df.groupBy("h", "g").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(place.alias("o"), "n", "halves")).alias("x"))
    distinct = stored(grouped.select("h", "g", "c", "x.o.row", "x.o.line", "x.n", "x.halves"), "distinct")
    near = stored(_near(keyed, distinct.df, least_units), "near")
    copied = distinct.df.where("c > 1").select("h", "g", F.col("row").alias("r"), F.col("line").alias("l"))
    later = lines.df.select("h", "g", "row", "line").join(copied.hint("merge"), ["h", "g"]).where((F.col("row") != F.col("r")) | (F.col("line") != F.col("l"))).select("row", "line")
    gone = keyed.per_row(later.unionByName(near.df), F.collect_list("line").alias("gone"))
    out = stored(_without(keyed.beside(gone, "left")), "kept_lines").df
    for done in (lines, distinct, near, keyed):
        done.drop()
    return out.withColumnRenamed("id", id_col)
