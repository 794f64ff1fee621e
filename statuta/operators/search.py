"""Filtered exact top-k search by cosine similarity, and what is built on it.

Filters come before scores by construction, so they reach the scan; a score is a projection; the page is one
TakeOrderedAndProject, that is a heap for each task. Scores are rounded before they are ordered and the id breaks
ties, so a page is the same on every run. Null and zero vectors have no score and are never hits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions import vector

#: Bounds of a page and of the looser one for tools.
MOST, MOST_TOOL, MOST_CHANGES = 50, 20, 200
CLOSE = 0.5
#: Dimension tables up to this size are broadcast; beyond it Spark chooses by its own statistics.
SMALL_ROWS = 100_000


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    return min(max(default if value is None else value, low), high)


def require_text(query: str) -> str:
    if not query or not query.strip():
        raise ValueError("the query is empty")
    return query


def require_range(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")
    return value


def all_of(**wanted) -> Column:
    """Equality on each column named; None means no condition, a list means any of its values."""
    parts = [F.col(c).isin(list(v)) if isinstance(v, list | tuple | set) else F.col(c) == v for c, v in wanted.items() if v is not None]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def between(column: str, low=None, high=None) -> Column:
    """Both bounds count; an open end is None."""
    return reduce(lambda a, b: a & b, [F.col(column) >= low] * (low is not None) + [F.col(column) <= high] * (high is not None), F.lit(True))


def small(df: DataFrame) -> DataFrame:
    """A hint to broadcast a dimension that has been counted; larger ones are joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def vector_of(chunks: DataFrame, key: str, value, column: str = "embedding") -> list[float]:
    """The vector of one row, as a query; an error if there is none."""
    row = chunks.where((F.col(key) == value) & F.col(column).isNotNull()).select(column).first()
    if row is None:
        raise LookupError(f"no vector with {key} {value}")
    return list(row[0])


def scored(chunks: DataFrame, query: Sequence[float], column: str = "embedding", engine: str = "arrow") -> DataFrame:
    """Chunks that have a score, with it and without the vector."""
    return chunks.where(F.col(column).isNotNull()).withColumn("score", F.round(vector.score(F.col(column), query, engine), 6)).drop(column).where(F.col("score").isNotNull())


def page(hits: DataFrame, key: str, limit: int | None = 10, offset: int = 0, most: int = MOST) -> DataFrame:
    return hits.orderBy(F.desc("score"), key).offset(max(offset, 0)).limit(clamp(limit, 10, 1, most))


def search(chunks: DataFrame, query: Sequence[float], key: str, where: Column | None = None, min_score: float | None = None, limit: int = 10, offset: int = 0, engine: str = "arrow") -> DataFrame:
    """The page of hits; ``min_score`` 0.0 is a threshold like any other."""
    hits = scored(chunks if where is None else chunks.where(where), query, engine=engine)
    return page(hits if min_score is None else hits.where(F.col("score") >= min_score), key, limit, offset)


def totals(chunks: DataFrame, query: Sequence[float], where: Column | None = None, close: float = CLOSE) -> DataFrame:
    """One row from one pass: total_matching, and total_close with a distance under ``close``."""
    hits = scored(chunks if where is None else chunks.where(where), query)
    return hits.agg(F.count("*").alias("total_matching"), F.count_if(1 - F.col("score") < close).alias("total_close"))


def federated(laws: DataFrame, cases: DataFrame, query: Sequence[float], key: str, min_score: float | None = None, limit: int = 10) -> DataFrame:
    """Laws and case law in one ranking. The case arm gives half of the limit, rounded down."""
    arms = [search(laws, query, key, None, min_score, limit).withColumn("kind", F.lit("law"))]
    if limit // 2:
        arms.append(search(cases, query, key, None, min_score, limit // 2).withColumn("kind", F.lit("case_law")))
    return reduce(lambda a, b: a.unionByName(b), arms).orderBy(F.desc("score"), key).limit(limit)


def related(chunks: DataFrame, parent: str, value, index: str = "chunk_index", key: str = "chunk_id", chunk_limit: int = 20, limit: int = 5) -> DataFrame:
    """Parents whose chunks are nearest to the first chunk of one parent, by their best chunk among the nearest."""
    first = chunks.where((F.col(parent) == value) & F.col("embedding").isNotNull()).agg(F.min_by("embedding", index)).first()[0]
    if first is None:
        raise LookupError(f"no chunk with {parent} {value}")
    near = page(scored(chunks.where(F.col(parent) != value), first), key, chunk_limit)
    return near.groupBy(parent).agg(F.max("score").alias("score")).orderBy(F.desc("score"), parent).limit(limit)
