"""Turning texts into vectors: an interface, a deterministic hashing embedder, and the Spark function."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Signed counts of hashed words, scaled to length one; stands in for a model where none is at hand."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
                out[i, h % self.dimension] += 1 if h >> 40 & 1 else -1
        scale = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(scale == 0, 1, scale)).astype(np.float32).tolist()


def embedded(text: Column, make: Callable[[], Embedder] = HashingEmbedder, query: bool = False) -> Column:
    """Vectors of a text column; the embedder is made once a task.  Queries get a prefix, passages none."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = make()
        for part in parts:
            some = part.notna()
            out = pd.Series([None] * len(part), dtype=object)
            for i, v in zip(np.nonzero(some.to_numpy())[0], own.embed(part[some].tolist()), strict=True):
                out.iat[i] = v
            yield out

    return run(F.concat(F.lit(QUERY_PREFIX), text) if query else text)
