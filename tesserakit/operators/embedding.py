"""Texts into vectors, by a backend that each Python worker loads once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..spark_util import by_value


class Backend(Protocol):
    """What makes vectors."""

    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """A stand-in without a model: counts of words by hash bucket. It knows no meaning and isn't a match for a trained model."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word)
                row[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        return out


class TextShape:
    """A stand-in of four numbers that any engine can count: characters, words, digits and one."""

    dimensions = 4

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([[len(t), len(t.split()), sum("0" <= c <= "9" for c in t), 1.0] for t in texts], dtype=np.float32).reshape(-1, 4)


BACKENDS: dict[str, Callable[[], Backend]] = {"hashed-words": HashedWords, "text-shape": TextShape}
_LOADED: dict[str, tuple[object, Backend]] = {}


def register(name: str, factory: Callable[[], Backend]) -> None:
    """Adds a backend, or replaces one: what makes it goes to the workers with each plan, and each of them makes it once."""
    BACKENDS[name] = factory


def backend(name: str) -> Backend:
    """A backend in this process."""
    return _made(name, BACKENDS[name], BACKENDS[name])


def _made(name: str, token: object, factory: Callable[[], Backend]) -> Backend:
    if name not in _LOADED or _LOADED[name][0] != token:
        _LOADED[name] = token, factory()
    return _LOADED[name][1]


def unit(vectors: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(n == 0, 1, n)


def embed(text: str | Column, name: str = "hashed-words", prefix: str = "", batch: int = 512) -> Column:
    """Vectors of length 1 of texts (zero for texts without words), with the model's prefix in front; null and blank texts as one blank."""
    factory = by_value(BACKENDS[name])
    token = f"{name} {id(factory)}"

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _made(name, token, factory)
        for part in parts:
            texts = (prefix + part).tolist()
            vectors = [unit(model.embed(texts[a : a + batch])) for a in range(0, len(texts), batch)]
            yield pd.Series(list(np.concatenate(vectors)) if vectors else [], dtype=object)

    return run(X.for_embedding(text))
