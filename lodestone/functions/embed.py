"""Text embeddings: a protocol, and a deterministic default that needs no model."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """``encode`` gives a vector of length 1 for each text; ``name`` tells models apart."""

    name: str
    dims: int

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class HashedEmbedder:
    """Words and neighbouring pairs hashed into ``dims`` buckets, damped counts, length 1.

    Its cosines are lexical. Thresholds that were tuned for a sentence model do not carry over;
    callers pass their own.
    """

    def __init__(self, dims: int = 256):
        self.name, self.dims = f"hashed-{dims}", dims

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            words = re.findall(r"\w+", (text or "").lower())
            v = [0.0] * self.dims
            for term, n in Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]).items():
                h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little")
                v[h % self.dims] += (1 if h >> 63 else -1) * (1 + math.log(n))
            length = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / length for x in v])
        return out


def embedded(rows: DataFrame, embedder: Embedder, text: str = "text", into: str = "vector") -> DataFrame:
    """``rows`` with the vector of a text column."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{into: pd.Series(embedder.encode(list(pdf[text])), index=pdf.index, dtype=object)})

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", `{into}` array<float>"
    return rows.mapInPandas(run, schema)


def stale(chunks: DataFrame, embedder: Embedder, model: str = "model", vector: str = "vector") -> DataFrame:
    """Chunks whose vector is missing or of another model."""
    return chunks.where(F.col(vector).isNull() | ~F.col(model).eqNullSafe(F.lit(embedder.name)))
