"""Vectors for texts, from a caller's model or from hashed words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.session import bound_batches

Embedder = Callable[[pd.Series], Iterable[Sequence[float]]]


def embedding(text: Column, embedder: Embedder, dim: int) -> Column:
    """``array<float>`` column from a function over batches of texts.

    Only the text crosses to Python, in Arrow batches. A null text is not sent
    to the model and has a null vector; a vector of another width is an error.
    """

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        present = texts[texts.notna()]
        found = [np.asarray(v, dtype=np.float32) for v in embedder(present)] if len(present) else []
        if len(found) != len(present):
            raise ValueError(f"{len(present)} texts gave {len(found)} vectors")
        for vector in found:
            if vector.shape != (dim,):
                raise ValueError(f"vector of shape {vector.shape} where {dim} values are expected")
        filled = iter(found)
        return pd.Series([next(filled) if known else None for known in texts.notna()], dtype=object)

    bound_batches(SparkSession.active())
    # A model is not to be called again because the optimizer moved a filter, nor
    # for rows that an earlier filter drops: non-deterministic calls stay put.
    return vectors.asNondeterministic()(text)


def embed(
    rows: DataFrame,
    embedder: Embedder,
    dim: int,
    text: str = "content",
    parallelism: int | None = None,
) -> DataFrame:
    """Add ``embedding``. ``parallelism`` bounds the model calls running at once."""
    if parallelism is not None:
        rows = rows.repartition(parallelism)
    return rows.withColumn("embedding", embedding(F.col(text), embedder, dim))


class HashedWords:
    """Unit-length bag of words: each space-separated word counts in one bucket.

    The bucket is the first 28 bits of the word's MD5, modulo the width. Row-local,
    so no word ever crosses a shuffle; each distinct word of a slice is hashed once.
    """

    _SLICE = 256

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def __call__(self, texts: pd.Series) -> Iterable[np.ndarray]:
        values = texts.tolist()
        for start in range(0, len(values), self._SLICE):
            yield from self._unit_counts(values[start : start + self._SLICE])

    def _unit_counts(self, texts: list[str]) -> np.ndarray:
        words = [[w for w in text.split(" ") if w] for text in texts]
        lengths = [len(w) for w in words]
        codes, distinct = pd.factorize(np.array(list(chain.from_iterable(words)), dtype=object))
        buckets = np.fromiter((self._bucket(w) for w in distinct), np.int64, len(distinct))
        rows = np.repeat(np.arange(len(texts)), lengths)
        cells = rows * self.dim + buckets[codes]
        counts = np.bincount(cells, minlength=len(texts) * self.dim).reshape(len(texts), self.dim)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return counts / np.where(norms == 0, 1, norms)

    def _bucket(self, word: str) -> int:
        return int(hashlib.md5(word.encode("utf-8")).hexdigest()[:7], 16) % self.dim
