"""Language identification in two levels.

A text is a vector of relative frequencies of hashed byte trigrams (A-Z in lower case, white
space as one space). One-versus-rest linear support vector machines predict the language
family; inside a family, one-versus-one machines vote between its languages. Both are
trained on the driver, on a sample bounded by ``SAMPLE_DOCS`` documents with a language,
taken evenly by language by a hash of the id (every language has its share, one document at least). The vectors are made on the executors, from
whole texts. A trained model has a fixed size for each pair of languages and goes to the
executors with the scoring function.

Prediction: ``und`` with score 0 for null text and texts without a letter, otherwise a
language of the sample. With no languages to learn from, every text is ``und``, and a filter
by language (``identified``) keeps what has a letter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.words import SLICE_BYTES, slices

#: Bound of the sample: documents in all, and of one language.
SAMPLE_DOCS, SAMPLE_EACH = 6000, 400
DIMS = 1 << 12

#: Language codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "pa", "gu", "ne"),
    "semitic": ("ar", "he", "mt"),
    "malayic": ("id", "ms"),
    "sinitic": ("zh", "yue"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every trigram of some texts, where each text's begin, and how many each text has."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset) if n else np.zeros(1, np.int64)
    size = int(offsets[-1] - offsets[0])
    at = offsets - offsets[0]
    counts = np.maximum(np.diff(at) - 2, 0)
    if size < 3:
        return np.zeros(0, np.uint32), np.zeros(n, np.int64), counts
    b = _FOLD[np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0]))]
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    h *= np.uint32(2654435761)
    h >>= np.uint32(32 - 12)
    last = at[1:][np.diff(at) > 0]
    outside = np.concatenate([last - 1, last - 2])
    h[outside[(outside >= 0) & (outside < len(h))]] = DIMS  # trigrams that leave their text
    return h, at[:-1], counts


def sums(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    out = np.zeros(len(first), values.dtype)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, first[some])
    return out


def has_letter(texts: pa.Array) -> np.ndarray:
    quick = np.array(pc.match_substring_regex(texts.fill_null(""), "[A-Za-z]").to_numpy(zero_copy_only=False), bool)
    for i in np.flatnonzero(~quick):
        quick[i] = any(map(str.isalpha, texts[i].as_py() or ""))
    return quick


def hinge(x: np.ndarray, at: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 15) -> tuple[np.ndarray, float]:
    """A linear support vector machine over the rows ``at`` of ``x``, by dual coordinate descent; a column of ones is its bias."""
    n = len(at)
    w, b, alpha = np.zeros(x.shape[1], np.float64), 0.0, np.zeros(n)
    weight = np.where(y > 0, n / (2 * max((y > 0).sum(), 1)), n / (2 * max((y < 0).sum(), 1))) * c
    norm = np.array([np.dot(x[i], x[i]) for i in at], np.float64) + 1
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(n):
            row = x[at[i]]
            g = y[i] * (row @ w + b) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), weight[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * row
                b += step
                alpha[i] = new
    return w, b


class Model:
    """Family machines and, inside each family, one machine for each pair of its languages."""

    def __init__(self, langs: list[str], x: np.ndarray):
        self.langs = sorted(set(langs))
        family = {code: _FAMILY.get(code, code) for code in self.langs}
        self.families = sorted(set(family.values()))
        self.members = [[c for c in self.langs if family[c] == f] for f in self.families]
        y = np.array(langs)
        fam = np.array([family[c] for c in langs])
        mean = x.mean(0) if len(x) else np.zeros(DIMS, np.float32)
        z = x - mean  # the only copy of the vectors
        dev = np.sqrt(np.einsum("ij,ij->j", z, z) / max(len(z), 1)) + np.float32(1e-4)
        z /= dev * np.float32(np.sqrt(DIMS))
        rows, self.pairs = [], []

        def learn(positive: np.ndarray, used: np.ndarray) -> None:
            w, b = hinge(z, np.flatnonzero(used), np.where(positive[used], 1.0, -1.0))
            scaled = w / dev / np.sqrt(DIMS)
            rows.append((scaled, b - scaled @ mean))

        everything = np.ones(len(y), bool)
        if len(self.families) > 1:
            for f in self.families:
                learn(fam == f, everything)
        for k, codes in enumerate(self.members):
            for a, b in combinations(codes, 2):
                learn(y == a, (y == a) | (y == b))
                self.pairs.append((k, codes.index(a), codes.index(b)))
        self.weights = np.zeros((len(rows), DIMS + 1), np.float32)
        self.bias = np.array([b for _, b in rows], np.float64)
        for i, (w, _) in enumerate(rows):
            self.weights[i, :DIMS] = w

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of every text that has a letter."""
        h, first, counts = grams(texts)
        n = len(texts)
        margin = np.zeros((len(self.bias), n))
        for i, w in enumerate(self.weights):
            margin[i] = sums(w[h], first, counts) / np.maximum(counts, 1) + self.bias[i]
        f = len(self.families) if len(self.families) > 1 else 0
        best = margin[:f].argmax(0) if f else np.zeros(n, int)
        score = _sure(margin[:f].max(0)) if f else np.ones(n)
        lang = np.empty(n, object)
        for k, codes in enumerate(self.members):
            here = best == k
            votes, least = np.zeros((len(codes), n)), np.ones((len(codes), n))
            for i, (own, a, b) in enumerate(self.pairs):
                if own == k:
                    m = margin[f + i]
                    for code, side in ((a, m), (b, -m)):
                        votes[code] += (side > 0) + 1e-3 * np.tanh(side)
                        least[code] = np.minimum(least[code], _sure(side))
            win = votes.argmax(0)
            lang[here] = np.array(codes, object)[win[here]]
            score[here] *= least[win[here], np.flatnonzero(here)]
        return lang, score


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2 * np.clip(margin, -20, 20)))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch["text"]):
            texts = batch["text"].slice(a, b - a)
            h, first, counts = grams(texts)
            out = []
            for i in range(b - a):
                own = np.bincount(h[first[i] : first[i] + counts[i]], minlength=DIMS + 1)[:DIMS] if counts[i] else np.zeros(DIMS)
                out.append((own / max(counts[i], 1)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch["lang"].slice(a, b - a).cast(pa.string()), pa.array(out, pa.binary())], ["lang", "x"])


def sample(docs: DataFrame, most: int = SAMPLE_DOCS, each: int = SAMPLE_EACH, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """About ``each`` documents of each language at most, by a hash of the id: columns text and lang."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = known.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").collect()  # one row for each language
    if not sizes:
        return docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.lit(False))
    each = max(1, min(each, most // len(sizes)))
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(1 << 40))
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], int(min(1.0, each / r["count"]) * (1 << 40)))))[F.col(lang_col)]
    return known.where(place < share).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))


def train(docs: DataFrame, most: int = SAMPLE_DOCS, each: int = SAMPLE_EACH, **cols) -> Model:
    """A model from the documents of ``docs`` with a language."""
    rows = sample(docs, most, each, **cols).mapInArrow(_vectors, "lang string, x binary").limit(2 * most).toArrow()
    langs = rows["lang"].to_pylist()
    x = np.zeros((len(langs), DIMS), np.float32)
    for i, vector in enumerate(v for chunk in rows["x"].chunks for v in chunk):
        x[i] = np.frombuffer(vector.as_buffer(), np.float32)
    del rows
    if langs:
        order = np.lexsort((*(x[:, k] for k in range(8)), np.array(langs, str)))
        langs, x = [langs[i] for i in order], x[order]
    return Model(langs, x)


def _scorer(model: Model) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], SLICE_BYTES // 2):
                texts = batch["text"].slice(a, b - a)
                ok = has_letter(texts)
                lang, sure = np.full(b - a, "und", object), np.zeros(b - a)
                if model.langs and ok.any():
                    got, value = model.predict(texts)
                    lang[ok], sure[ok] = got[ok], value[ok]
                rest = [batch[c].slice(a, b - a) for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(sure)], [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score"])

    return score


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[Column, ...] = (), names: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, named ``names`` (without ``keep``: the columns of these names), with lang_pred and score, one row per row of ``docs``."""
    rows = docs.select(*(c.alias(n) for c, n in zip(keep or map(F.col, names), names)), F.col(text_col).alias("text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "text")
    return rows.mapInArrow(_scorer(model), f"{schema}, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns as they were, whose language is known with a score of ``least`` or more.

    Where there was no language to learn from, no text can be told apart, and every text with a letter stays.
    """
    score = _scorer(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch[text_col].cast(pa.string())
            for got in score(iter([pa.RecordBatch.from_arrays([texts, pa.array(range(len(texts)))], ["text", "row"])])):
                good = pc.and_(pc.not_equal(got["lang_pred"], "und"), pc.greater_equal(got["score"], least)) if model.langs else pa.array(has_letter(texts.take(got["row"])))
                rows = got["row"].filter(good)
                if len(rows):
                    yield batch.take(rows)

    return docs.mapInArrow(keep, docs.schema)
