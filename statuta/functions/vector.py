"""Vector arithmetic as columns. Vectors are array<float>; everything is computed in double."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a null or zero vector, so that no NaN passes a threshold."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def unit(v: Column) -> Column:
    """The vector scaled to length one; null for zero."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float")))


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def fits(v: Column, dim: int) -> Column:
    return F.coalesce(F.size(v) == dim, F.lit(False))


def checked(v: Column, dim: int) -> Column:
    """The vector, or an error if it is not null and has another dimension."""
    return F.when(v.isNull() | fits(v, dim), v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(v).cast("string"))))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def score(v: Column, query: Sequence[float], engine: str = "arrow") -> Column:
    """Cosine similarity with a constant vector, whose norm is computed once on the driver.

    engine: ``arrow`` sends batches to numpy, a matrix by a vector each; ``jvm`` stays in higher-order functions,
    which Spark interprets. A vector of another length, a null one and a zero one score null.
    """
    query = [float(x) for x in query]
    size = math.sqrt(sum(x * x for x in query))
    if size == 0:
        return F.lit(None).cast("double")
    if engine == "arrow":
        return _arrow(query, size)(v)
    return F.when(fits(v, len(query)), dot(v, literal(query)) / F.nullif(norm(v) * size, F.lit(0.0)))


def _arrow(query: list[float], size: float):
    @F.arrow_udf("double")
    def run(v: pa.Array) -> pa.Array:
        lens = np.asarray(v.value_lengths().fill_null(-1))
        good = lens == len(query)
        out = np.full(len(v), np.nan)
        if good.any():
            m = np.asarray(v.filter(pa.array(good)).flatten(), dtype=np.float64).reshape(-1, len(query))
            with np.errstate(invalid="ignore", divide="ignore"):
                out[good] = m @ np.asarray(query) / (np.linalg.norm(m, axis=1) * size)
        return pa.array(out, mask=np.isnan(out))

    return run
