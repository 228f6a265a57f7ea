"""Vectorised word hashing over Arrow string columns.

Everything here works on the raw UTF-8 buffer of an Arrow array with numpy, so no
Python string is made per word. Words are maximal runs of bytes other than
``0x20`` and ``0x09``-``0x0D``; these bytes never occur inside a multi-byte character.

Word hashes are 64-bit: a chain over the word's 8-byte blocks, each step a multiply-and-shift
mix of all that came before, so no arithmetic pattern in the letters cancels out. Two lanes
with seeds of their own read the bytes independently. Words longer than ``LONG_WORD`` bytes
take both lanes from a BLAKE2b digest. Sequence hashes are polynomials over word hashes, for
runs of a fixed few words, and chains (``folded``) for runs of any length. All are the same
on every machine and in every run.

Memory: a text takes about 12 bytes for each of its bytes while it is split, and 40 for each
of its words afterwards; batches of texts are cut to ``SLICE_BYTES``, one longer text is alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text is worked on alone.
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SEQ = _U(0xD1342543DE82EF95)
#: Seeds and odd factors of the two lanes of a word hash.
_LANES = ((_U(0x632BE59BD9B4E019), _U(0x9FB21C651E98DF25)), (_U(0xD6E8FEB86659FD93), _U(0xC2B2AE3D27D4EB4F)))
#: Bytes of a word, and values of a run, beyond which a digest of them is taken.
LONG_WORD, LONG_RUN = 512, 4096
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTES = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BYTES[_WHITE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


class Tokens:
    """The tokens of some texts: ``begin`` and ``end`` of each in ``data``, and ``first``, where each text's tokens begin.

    Tokens are maximal runs of bytes that ``solid``, a table of 256 flags, marks.
    """

    def __init__(self, texts: pa.Array, solid: np.ndarray, lower: bool = False):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset) if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if n else None
        size = int(offsets[-1] - offsets[0])
        data = np.frombuffer(raw, np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
        if lower:
            data = _LOWER[data]
        at = (offsets - offsets[0]).astype(np.int64)
        self.data, self.n = data, n
        inside = solid[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < size)]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        self.begin = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.begin, at)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


class Words(Tokens):
    """The words of some texts, with a 64-bit hash of each."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        super().__init__(texts, ~_WHITE, lower)
        self.hashes = self._lane(0)
        self._second = None

    @property
    def others(self) -> np.ndarray:
        """The second lane: hashes of the same words that share nothing with ``hashes``."""
        if self._second is None:
            self._second = self._lane(1)
        return self._second

    def _lane(self, k: int) -> np.ndarray:
        seed, factor = _LANES[k]
        size = self.end - self.begin
        out = mix(size.astype(np.uint64) ^ seed)
        if not len(out):
            return out
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        blocks = np.ndarray((len(self.data),), np.dtype("<u8"), padded, strides=(1,))  # the 8 bytes that begin at each place
        some = np.flatnonzero(size <= LONG_WORD)
        done = 0
        while len(some):
            left = np.minimum(size[some] - done, 8).astype(np.uint64)
            block = blocks[self.begin[some] + done] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * left))
            out[some] = mix(out[some] ^ (block * factor + seed))
            done += 8
            some = some[size[some] > done]
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = _digest(self.data[self.begin[i] : self.end[i]], k)
        return out

    def runs(self, k: int, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k consecutive words of one text, and the word at which each begins; ``other``: a second hash of the same runs."""
        each, total = self.others if other else self.hashes, len(self.hashes)
        if total < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if k <= 6:
            acc = each[: total - k + 1].copy()
            for j in range(1, k):
                acc *= _SEQ
                acc += each[j : total - k + 1 + j]
        else:
            # acc_i = sum of h[i + j] * SEQ ** (k - 1 - j), from running sums with inverse powers
            inverse = powers(_U(pow(int(_SEQ), -1, 1 << 64)), total)
            sums = np.zeros(total + 1, np.uint64)
            np.cumsum(each * inverse, out=sums[1:])
            acc = (sums[k:] - sums[:-k]) * powers(_SEQ, total)[k - 1 :]
        last = np.repeat(self.first[1:], self.counts)[: total - k + 1]
        whole = np.arange(total - k + 1) + k <= last
        at = np.flatnonzero(whole)
        return mix(acc[at]), at


def _digest(values: np.ndarray, lane: int) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(values.tobytes(), digest_size=16).digest(), np.uint64)[lane]


def folded(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of each run ``hashes[begin:end]``, of any length; other than a polynomial it has no patterns that cancel out."""
    seed, factor = _LANES[lane]
    size = end - begin
    out = mix(size.astype(np.uint64) + seed)
    some = np.flatnonzero((size > 0) & (size <= LONG_RUN))
    done = 0
    while len(some):
        out[some] = mix(out[some] ^ (hashes[begin[some] + done] * factor + seed))
        done += 1
        some = some[size[some] > done]
    for i in np.flatnonzero(size > LONG_RUN):
        out[i] = _digest(hashes[begin[i] : end[i]], lane)
    return out


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text each, at least one row."""
    n = len(texts)
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))
    total = np.cumsum(sizes)
    start = 0
    while start < n:
        stop = int(np.searchsorted(total, (total[start - 1] if start else 0.0) + most, side="right"))
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of every text (sorted within the text), and where each text's begin.

    A text with fewer than k words has its whole sequence as one shingle; one without words has none.
    """
    hashes, at = words.runs(k)
    text = np.repeat(np.arange(words.n), words.counts)[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        hashes = np.concatenate([hashes, folded(words.hashes, words.first[:-1][short], words.first[1:][short])])
        text = np.concatenate([text, short])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    if len(hashes):
        keep = np.ones(len(hashes), bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        hashes, text = hashes[keep], text[keep]
    return hashes, np.searchsorted(text, np.arange(words.n + 1))


def shapes(words: Words) -> np.ndarray:
    """A hash per word of its shape: runs of letters, capitals, digits and other bytes, each run of one class once."""
    if not len(words.begin):
        return np.zeros(0, np.uint64)
    kind = _SHAPE[words.data]
    fresh = np.ones(len(kind), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[words.begin] = True
    fresh &= ~_WHITE[words.data]
    rank = np.cumsum(fresh)
    base = np.repeat(rank[words.begin], np.diff(np.append(words.begin, len(kind))))
    place = rank[words.begin[0] :] - base
    value = np.where(fresh[words.begin[0] :], _BYTES[kind[words.begin[0] :]] * powers(_BASE, int(place.max()) + 1)[place], _U(0))
    return mix(np.add.reduceat(value, words.begin - words.begin[0]) ^ _U(0xA5A5A5A5A5A5A5A5))


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
