"""Embedding providers: what turns texts into vectors, on the driver for a query, in workers for chunks."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import DIMENSION


class EmbeddingProvider(Protocol):
    """Anything with a width, one vector for one text, and vectors for many."""

    @property
    def dimension(self) -> int: ...

    def embed_text(self, text: str) -> list[float]: ...

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashingProvider:
    """Signed feature hashing of words: lexical likeness, not meaning. Agrees with ``vectors.hashed``."""

    _words = re.compile(r"[^\W]+")

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    def embed_text(self, text: str) -> list[float]:
        out = [0.0] * self.dimension
        for term in self._words.findall(text.lower()):
            digest = hashlib.md5(term.encode()).hexdigest()
            out[int(digest[:8], 16) % self.dimension] += 1.0 - 2 * (int(digest[8:10], 16) % 2)
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else out

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.embed_text(t) for t in texts]


def embedded(text: Column, provider: EmbeddingProvider) -> Column:
    """The provider's vector of each text, in Arrow batches; a worker sets the provider up once."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(provider.embed_batch(["" if t is None else t for t in texts]), dtype=object)

    return vectors(text)
