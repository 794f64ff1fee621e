"""Posting lists: for each trigram or keyword the rows that have it, so that a query reads its own lists and no table.

A list is cut into parts: the table is dealt over parts of about PART rows, block by block, and a part of a list has the
rows of one of these, so one of a frequent gram is several rows of the index. A block's lists are made where its rows are
read, so what is shuffled is a row for each gram of a block and not one for each gram of a row. Lists lie in folders by a
hash of the gram and are sorted by it inside, so the lists asked for are found by partition pruning and the files'
statistics. A row of a list carries how many grams the row has, which is all that a likeness needs beside the number of
lists that it is in.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import text as tx

#: Rows of a part of a list, grams of a block's rows together, and folders of an index.
PART, BLOCK, FOLDERS = 65_536, 1 << 21, 16


def folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def block_lists(parts: int, most_rows: int, most_grams: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (key, grams) of rows the lists of each block of them (gram, part, rows); blocks are dealt over the parts in turn.

    A block ends after so many rows, or before it has more grams; a row stays whole."""

    def blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
        before, at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), 0
        while at < len(sizes):
            end = max(at + 1, min(at + most_rows, int(np.searchsorted(before, before[at] + most_grams, "right")) - 1))
            yield at, end
            at = end

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("grams")), 0).to_numpy(zero_copy_only=False).astype(np.int32)
            for start, end in blocks(sizes):
                grams = batch.column("grams").slice(start, end - start).flatten().dictionary_encode(null_encoding="encode")
                codes = grams.indices.to_numpy()
                row = np.repeat(np.arange(start, end), sizes[start:end])[np.argsort(codes, kind="stable")]
                ends = pa.array(np.append(0, np.cumsum(np.bincount(codes, minlength=len(grams.dictionary)))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, batch.column("key").take(pa.array(row))), pa.ListArray.from_arrays(ends, pa.array(sizes[row]))]
                part = pa.array(np.full(len(grams.dictionary), number % parts, np.int32))
                yield pa.RecordBatch.from_arrays([grams.dictionary, part, *lists], ["gram", "part", "keys", "sizes"])
                number += 1

    return of


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same part of a list that stand next to each other, as one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        same = [pc.equal(c.slice(1), c.slice(0, len(c) - 1)) for c in map(batch.column, ("gram", "part"))]
        first = np.flatnonzero(np.append(True, ~pc.fill_null(pc.and_(*same), False).to_numpy(zero_copy_only=False)))
        ends = batch.column("keys").offsets.to_numpy()
        ends = pa.array(np.append(ends[first], ends[-1]) - ends[0])
        lists = [pa.ListArray.from_arrays(ends, batch.column(c).flatten()) for c in ("keys", "sizes")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(first)) for c in ("gram", "part")), *lists, pc.list_value_length(lists[0]), batch.column("folder").take(pa.array(first))], ["gram", "part", "keys", "sizes", "n", "folder"])


def write(table: DataFrame, key: str, grams: Column, path: str) -> None:
    """The lists of all grams (an array of distinct ones for each row; null or empty: the row is in no list)."""
    rows = table.select(F.col(key).alias("key"), grams.alias("grams"))
    shape = f"gram string, part int, keys array<{rows.schema['key'].dataType.simpleString()}>, sizes array<int>"
    pieces = rows.mapInArrow(block_lists(max(1, math.ceil(table.count() / PART)), PART, BLOCK), shape).withColumn("folder", folder(F.col("gram")))
    dealt = pieces.repartition("folder", "gram", "part").sortWithinPartitions("folder", "gram", "part")
    dealt.mapInArrow(joined, f"{shape}, n int, folder int").write.mode("overwrite").partitionBy("folder").parquet(path)


def ensured(table: DataFrame, key: str, grams: Column, path: str, version: str) -> DataFrame:
    """The index of this version of a table; written if it is not there."""
    spark, at = table.sparkSession, f"{path}/{version}"
    found = opened(spark, at)
    if found is None:
        write(table, key, grams, at)
        found = opened(spark, at)
    return found


def opened(spark: SparkSession, path: str) -> DataFrame | None:
    """A written index; one that was not written to its end has no mark of success and is none."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # of an empty table
            return None
        raise


def lists_of(index: DataFrame, grams: list[str]) -> DataFrame:
    """The parts of some lists; folders and grams are literals, so both reach the scan."""
    spark = index.sparkSession
    folders = sorted({r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(folder(F.col("gram"))).collect()})
    return index.where(F.col("folder").isin(folders) & F.col("gram").isin(grams))


def having_any(index: DataFrame, words: list[str]) -> DataFrame:
    """Keys (one column, key) of rows that have any of some grams."""
    return lists_of(index, words).select(F.explode("keys").alias("key")).distinct()


def alike(index: DataFrame, grams: list[str], least: float = 0.3) -> DataFrame:
    """(key, likeness) of rows whose set of grams is as like a query's as asked: Jaccard, rounded to six digits.

    A row that is has at least ``need`` of the query's grams, so it is in one of any len - need + 1 lists: the shortest
    ones of these give the candidates, with the sizes that the bound leaves; the other lists only count for those."""
    n = len(grams)
    if not n:
        return lists_of(index, [""]).select(F.explode("keys").alias("key"), F.lit(0.0).alias("likeness")).limit(0)
    need = max(1, math.ceil(least * n - 1e-9))
    lengths = dict(lists_of(index, grams).groupBy("gram").agg(F.sum("n")).collect())  # as many as the query's grams
    first = sorted(grams, key=lambda g: (lengths.get(g, 0), g))[: n - need + 1]
    rows = lists_of(index, grams).select("gram", F.explode(F.arrays_zip("keys", "sizes")).alias("r")).select("gram", F.col("r.keys").alias("key"), F.col("r.sizes").alias("size"))
    fits = rows.where((F.col("size") >= math.ceil(least * n - 1e-9)) & (F.col("size") <= math.floor(n / least + 1e-9)))
    counts = fits.groupBy("key", "size").agg(F.count("*").alias("both"), F.max(F.col("gram").isin(first)).alias("candidate")).where("candidate")
    likeness = F.round(F.col("both") / (F.lit(n) + F.col("size") - F.col("both")), 6)
    return counts.withColumn("likeness", likeness).where(F.col("likeness") >= least).select("key", "likeness")


def similar_titles(table: DataFrame, key: str, title: str, index: DataFrame, query: str, least: float = 0.3) -> DataFrame:
    """The rows of a table whose title is like a query, found by the trigrams' lists, and verified by the title itself."""
    spark = table.sparkSession
    grams = spark.range(1).select(tx.trigrams(F.lit(query))).first()[0]
    found = table.join(alike(index, grams, least).withColumnRenamed("key", key), key)
    return found.where(F.round(tx.jaccard(tx.trigrams(F.col(title)), tx.trigrams(F.lit(query))), 6) == F.col("likeness"))
