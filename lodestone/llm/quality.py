"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

A text's features are its words, pairs of neighbouring words, word shapes and pairs of
shapes, hashed into ``DIMS`` buckets; a bucket's value is its share of them. The model is
trained on the driver, one labelled document at a time, on a sample bounded by
``SAMPLE_ROWS`` labelled rows taken by a hash of the id. Its feature vectors are sparse and
made on the executors from whole texts. A score is a sparse dot product through a logistic.

Null and empty texts have no features; their score is the model's bias alone. Without
labels every score is 0.5. Null labels are not learned from; of several labels of one
document the smallest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.words import Words, mix, shapes, slices

#: Bound of the sample of labelled rows.
SAMPLE_ROWS = 3000
BITS = 16
DIMS = 1 << BITS
_SCALE = 20.0
_U = np.uint64


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (4 for each word: word, pair, shape, pair of shapes; DIMS where a text has no next word)."""
    n = len(words.hashes)
    out = np.full((n, 4), DIMS, np.int32)
    if n:
        shape = shapes(words)
        last = np.zeros(n, bool)
        last[words.first[1:][words.counts > 0] - 1] = True
        for column, h in ((0, words.hashes), (2, shape)):
            out[:, column] = h >> _U(64 - BITS)
            pair = mix(h[:-1] * _U(0xD1342543DE82EF95) + h[1:]) >> _U(64 - BITS)
            out[:-1, column + 1] = np.where(last[:-1], DIMS, pair)
    return out, np.maximum(4 * words.counts - 2, 1)


class Model:
    """Weights of follow-the-regularised-leader with per-coordinate rates."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)  # the last is the bias

    def _weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, DIMS), np.append(x, 1.0)
        w = self._weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def freeze(self) -> tuple[np.ndarray, float]:
        w = self._weights(np.arange(DIMS + 1))
        bias = float(w[DIMS])
        w[DIMS] = 0
        return w.astype(np.float32), bias


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch["text"]):
            words = Words(batch["text"].slice(a, b - a))
            flat, total = features(words)
            out = []
            for i in range(b - a):
                own, count = np.unique(flat[words.first[i] : words.first[i + 1]], return_counts=True)
                out.append(own[own < DIMS].astype(np.uint16).tobytes() + (count[own < DIMS] / total[i] * _SCALE).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a), batch["y"].slice(a, b - a), pa.array(out, pa.binary())], ["id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, passes: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """(weights, bias) from the documents that ``labels`` marks."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    count = known.count()
    share = int(min(1.0, most / max(count, 1)) * (1 << 40))
    chosen = known.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("quality")), F.lit(1 << 40)) < share)
    chosen = chosen.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc") == F.col("id")).select(F.col("id").cast("string"), "y", "text")  # at most about ``most`` ids
    rows = rows.mapInArrow(_vectors, "id string, y int, x binary").limit(2 * most).toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    model = Model()
    data = []
    for y, x in zip(rows["y"].to_pylist(), rows["x"].to_pylist()):
        n = len(x) // 6
        data.append((np.frombuffer(x, np.uint16, n).astype(np.int64), np.frombuffer(x, np.float32, n, 2 * n).astype(np.float64), y))
    order = np.random.default_rng(11)
    for _ in range(passes):
        for i in order.permutation(len(data)):
            model.learn(*data[i])
    return model.freeze()


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", keep: tuple[Column, ...] = (), names: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, named ``names`` (without ``keep``: the columns of these names), with score and predicted, one row per row of ``docs``."""
    weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                words = Words(batch["text"].slice(a, b - a))
                flat, total = features(words)
                running = np.zeros(len(flat) + 1)
                np.cumsum(weights[flat].sum(1, dtype=np.float64), out=running[1:])
                logit = (running[words.first[1:]] - running[words.first[:-1]]) / total * _SCALE + bias
                p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                rest = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(a, b - a) for c in rest), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*rest, "score", "predicted"])

    rows = docs.select(*(c.alias(n) for c, n in zip(keep or map(F.col, names), names)), F.col(text_col).alias("text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "text")
    return rows.mapInArrow(run, f"{schema}, score double, predicted int")
