"""Embedders: text columns to vectors in order, in Arrow batches of a bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts in one call to a model, characters of a text that it takes.
BATCH, MOST_CHARS = 250, 20_000


class FeatureHash:
    """A deterministic embedder for tests: words hashed to signed coordinates, length one; null for no words."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        import zlib

        out = []
        for text in texts:
            v = np.zeros(self.dim)
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                v[h % self.dim] += 1 if h >> 31 else -1
            size = np.linalg.norm(v)
            out.append((v / size).tolist() if size else None)
        return out


class Zeros:
    """The embedder of a service that has no model. Its vectors never score."""

    def __init__(self, dim: int = 768):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        return [[0.0] * self.dim for _ in texts]


def embed(text: Column, embedder: Callable[[list[str]], list], dim: int, batch: int = BATCH, most: int = MOST_CHARS) -> Column:
    """Vectors of texts, each cut to what the model takes; a batch that fails gives null, not zero, vectors.
    A vector of another length is an error, as it would spoil every comparison."""

    @F.arrow_udf("array<float>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            for i in range(0, len(part), batch):  # only the texts of one call are Python's
                texts = [t or "" for t in part.slice(i, batch).to_pylist()]
                try:
                    got = embedder(texts)
                except (OSError, RuntimeError):
                    got = [None] * len(texts)
                if any(v is not None and len(v) != dim for v in got):
                    raise ValueError(f"expected vectors of {dim} dimensions")
                yield pa.array(got, pa.list_(pa.float32()))

    return run(F.substring(text, 1, most))  # cut before it is sent


def embed_one(embedder: Callable[[list[str]], list], text: str) -> list[float]:
    return embedder([text[:MOST_CHARS]])[0]
