"""Approximate search: an inverted file, that is a layout by nearest centroid, of which few cells are read."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import search

#: Vectors that the centroids are fitted on at most; all vectors are indexed.
FIT_ROWS = 20_000


def fit(chunks: DataFrame, key: str, cells: int, rounds: int = 10, column: str = "embedding") -> np.ndarray:
    """Spherical k-means on a bounded sample, chosen by a hash of the key; centroids of unit length. The sample's most common length counts."""
    rows = chunks.where(F.col(column).isNotNull()).orderBy(F.xxhash64(key), key).limit(FIT_ROWS).select(column).collect()
    widths = Counter(len(r[0]) for r in rows if r[0])
    width = widths.most_common(1)[0][0] if widths else 0
    x = np.array([r[0] for r in rows if len(r[0]) == width and None not in r[0]], np.float64).reshape(-1, width)
    x = x[np.isfinite(x).all(axis=1)]
    size = np.linalg.norm(x, axis=1)
    x = x[size > 0] / size[size > 0, None]
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            total = x[own == c].sum(axis=0)
            if np.linalg.norm(total):
                centres[c] = total / np.linalg.norm(total)
    return centres


def assign(chunks: DataFrame, centres: np.ndarray, column: str = "embedding") -> DataFrame:
    """Chunks with the number of their nearest centroid; written with partitionBy("cell") a search reads few folders."""
    @F.arrow_udf("int")
    def nearest(v: pa.Array) -> pa.Array:
        good = np.asarray(v.value_lengths().fill_null(-1)) == centres.shape[1]
        out = np.full(len(v), -1, np.int32)
        if good.any():
            x = np.asarray(v.filter(pa.array(good)).flatten(), dtype=np.float64).reshape(-1, centres.shape[1])
            out[good] = (x @ centres.T).argmax(axis=1)
        return pa.array(out, mask=~good)

    return chunks.withColumn("cell", nearest(column))


def write(chunks: DataFrame, key: str, path: str, cells: int = 16, column: str = "embedding") -> None:
    """The index: chunks with their cell in a folder for each cell, and beside it the centroids. Vectors that cannot be scored are left out."""
    centres = fit(chunks, key, cells, column=column)
    assign(chunks, centres, column).where("cell >= 0").repartition("cell", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/chunks")
    put_centres(chunks.sparkSession, centres, path)


def put_centres(spark: SparkSession, centres: np.ndarray, path: str) -> None:
    """Written last: an index that has them is whole."""
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def centres_of(spark: SparkSession, path: str) -> np.ndarray | None:
    """The centroids of a written index, of which there are few; None if there is no whole index."""
    try:
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return np.array([r["centre"] for r in rows])


def version_of(chunks: DataFrame) -> str:
    """A name for the state of the files that a table is read from: another when one of them has changed."""
    files = chunks.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return format(files.agg(F.coalesce(F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time")), F.lit(0))).first()[0] & (2**64 - 1), "016x")


def ensured(chunks: DataFrame, key: str, path: str, cells: int = 16) -> str:
    """The path of an index of these files, which is written only if it is not there yet."""
    at = f"{path}/{version_of(chunks)}"
    if centres_of(chunks.sparkSession, at) is None:
        write(chunks, key, at, cells)
    return at


def nearest_cells(centres: np.ndarray, query: Sequence[float]) -> list[int]:
    return np.argsort(-(centres @ np.asarray(query, np.float64)), kind="stable").tolist()


def probe(indexed: DataFrame, centres: np.ndarray, query: Sequence[float], key: str, probes: int = 4, limit: int = 10) -> DataFrame:
    """The page of hits from the cells nearest to the query; a filter on ``cell`` prunes partitions."""
    return search.page(search.scored(indexed.where(F.col("cell").isin(nearest_cells(centres, query)[:probes])), query), key, limit)


def probe_filtered(indexed: DataFrame, centres: np.ndarray, query: Sequence[float], key: str, where: Column, probes: int = 4, limit: int = 10) -> DataFrame:
    """The page of hits that pass a filter: probing goes on, with twice the cells each time, until the cells read hold
    ``limit`` rows that pass, or all cells have been read. So a rare filter gives as many rows as an exact search.

    A step counts rows of its new cells only, with the filter and the cells pushed to the scan and no vector read."""
    order, limit = nearest_cells(centres, query), search.clamp(limit, 10, 1, search.MOST)
    at, passed = 0, 0
    while at < len(order) and passed < limit:
        step = order[at : max(probes, 2 * at)]
        passed += indexed.where(F.col("cell").isin(step) & where & F.col("embedding").isNotNull()).limit(limit).count()
        at += len(step)
    return search.page(search.scored(indexed.where(F.col("cell").isin(order[:at]) & where), query), key, limit)


def recall(found: DataFrame, exact: DataFrame, key: str) -> float:
    return found.join(exact, key, "left_semi").count() / max(1, exact.count())
