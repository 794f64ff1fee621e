"""Ranked lexical search: document-sharded postings in compressed sparse rows with precomputed integer impacts.

A shard holds the postings of some documents (up to SHARD bytes of text) as arrays: its terms by hash, where each one's
postings begin, the documents and their impacts, which take the frequency and the document's length against the mean
length in whole numbers. Shards are rows of a table in the shared folder, so a lost task is done again from them.

A search broadcasts the terms of at most ITEMS queries with their weights. Each shard is scored term at a time: the
postings of a term are added to a dense row of sums for every query that has it, and argpartition finds the k-th score of
a query; all documents above it, and of those with the same score the smallest ids, are kept. A task merges the best k of
its shards and gives at most k rows a query, of which Spark keeps the best k (each task again before the shuffle).
More queries than ITEMS are blocks of queries, each of which reads the shards once.

Defined results: null and empty texts have no terms and are in no result, nor counted in N; a very long text is a shard
of its own; repeated rows are documents each, so their ids stand in as many ranks; equal scores go by ascending id, null
ids last; a null or empty item has no hits; rows of items that share an id are one query of all their terms; other columns,
whatever their names, are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.llm.common import joined, prepare, slices, text_bytes, tidy, trim, word_hashes, written

#: Bytes of text of a shard, and queries of a block.
SHARD, ITEMS = 8_000_000, 8192
#: Fixed values of the contract: impacts are per 10**9, of 1000 x frequency and 8 x length; a length counts 10 + 90 x n / mean.
UNIT, TF, LENGTH, FLAT, SLOPE = 1_000_000_000, 1000, 8, 10, 90


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of some texts (runs of letters, digits and what is not ASCII; A-Z as a-z), and how many each has."""
    return word_hashes(*joined(texts), fold=True, marks=True)


def shard(ids: pa.Array, texts: list[bytes], n_docs: int, all_terms: int) -> pa.RecordBatch:
    """One row: the postings of some documents."""
    hashes, counts = terms_of(texts)
    docs = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    order = np.lexsort((docs, hashes))
    h, d = hashes[order], docs[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.empty(0, np.int64)
    tf = np.diff(np.append(new, len(h)))
    h, d = h[new], d[new]
    begins = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    length = FLAT + (SLOPE * counts.astype(object) * n_docs // max(all_terms, 1))  # whole numbers of any size
    impact = (UNIT * tf) // (TF * tf + LENGTH * length.astype(np.int64)[d])
    narrow = np.uint16 if len(texts) <= 1 << 16 else np.uint32
    columns = {"terms": h[begins], "begins": np.append(begins, len(h)).astype(np.int32), "docs": d.astype(narrow), "impacts": impact.astype(np.int32)}
    listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.record_batch({"ids": listed, **{k: pa.array([v.tobytes()], pa.binary()) for k, v in columns.items()}})


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The table of shards over all rows, and how many documents have terms."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema["_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in slices(batches, column="_text"):
            counts = terms_of(text_bytes(batch, "_text"))[1]
            n, total = n + int((counts > 0).sum()), total + int(counts.sum())
        yield pa.record_batch({"n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64())})

    n_docs, all_terms = docs.select("_text").mapInArrow(counted, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in slices(batches, most=SHARD // 2, column="_text"):
            some = text_bytes(batch, "_text")
            more = sum(map(len, some))
            if texts and size + more > SHARD:
                yield shard(pa.concat_arrays(ids), texts, n_docs, all_terms)
                ids, texts, size = [], [], 0
            ids.append(batch.column("_id"))
            texts, size = texts + some, size + more
        if texts:
            yield shard(pa.concat_arrays(ids), texts, n_docs, all_terms)
        trim()

    shards = docs.mapInArrow(built, f"ids array<{kind}>, terms binary, begins binary, docs binary, impacts binary")
    return written(shards, "postings"), n_docs


class Shard:
    """The arrays of a row of the table of shards."""

    def __init__(self, row: dict):
        self.terms, self.begins = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["begins"], np.int32)
        self.impacts = np.frombuffer(row["impacts"], np.int32)
        self.docs = np.frombuffer(row["docs"], np.uint16 if len(row["docs"]) == 2 * len(self.impacts) else np.uint32)

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where some sorted terms stand, and whether they do."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), bool)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return at, self.terms[at] == terms


def best(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores above 0; of equal ones those with the smallest order."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        values = scores[some]
        least = values[np.argpartition(values, len(values) - k)[len(values) - k]]
        some = some[values >= least]  # all that tie with the k-th
    return some[np.lexsort((order[some], -scores[some]))][:k]


def shards_of(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[dict, pa.Array | None]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column("ids").slice(i, 1).flatten() if "ids" in batch.schema.names else None
            yield {c: batch.column(c)[i].as_buffer() for c in columns}, ids


def weights(shards: DataFrame, n_docs: int, terms: np.ndarray) -> np.ndarray:
    """The weight of each of some sorted terms, from the documents that hold it."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for t, b in zip(batch.column("terms"), batch.column("begins"), strict=True):
                own, begins = np.frombuffer(t.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.int32)
                if len(own):
                    at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                    df += np.where(own[at] == terms, begins[at + 1] - begins[at], 0)
        some = np.flatnonzero(df)
        yield pa.record_batch({"term": pa.array(some, pa.int64()), "n": pa.array(df[some], pa.int64())})

    df = np.zeros(len(terms), np.int64)
    for row in shards.select("terms", "begins").mapInArrow(found, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():  # no more than the terms of a block
        df[row["term"]] = row["n"]
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def search(shards: DataFrame, n_docs: int, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(item, rank, id, score) of the k best documents of each item."""
    spark = items.sparkSession
    kind, item_kind = shards.schema["ids"].dataType.elementType.simpleString(), items.schema[item_col].dataType.simpleString()
    rows = items.select(F.col(item_col).alias("item"), F.coalesce(text_col, F.lit("")).alias("text")).orderBy("item").toLocalIterator(prefetchPartitions=True)
    parts, held, last = [], {}, object()
    for row in rows:
        if len(held) >= ITEMS and row["item"] != last:
            parts.append(_block(spark, shards, n_docs, held, k, kind, item_kind))
            held = {}
        last = row["item"]
        held.setdefault(last, []).append(row["text"].encode())
    if held:
        parts.append(_block(spark, shards, n_docs, held, k, kind, item_kind))
    if not parts:
        return spark.createDataFrame([], f"{item_col} {item_kind}, rank int, {id_col} {kind}, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _block(spark, shards: DataFrame, n_docs: int, held: dict, k: int, kind: str, item_kind: str) -> DataFrame:
    names = pa.array(list(held), shards_type(items_kind=item_kind))
    own = [np.unique(terms_of([b" ".join(texts)])[0]) for texts in held.values()]
    terms = np.unique(np.concatenate([np.empty(0, np.uint64), *own]))
    sent = spark.sparkContext.broadcast((names, own, terms, weights(shards, n_docs, terms)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own, terms, weight = sent.value
        places = [np.searchsorted(terms, t) for t in own]
        tops: list[tuple[np.ndarray, pa.Array] | None] = [None] * len(own)
        for row, ids in shards_of(batches, ["terms", "begins", "docs", "impacts"]):
            part = Shard(row)
            at, there = part.places(terms)
            begins, ends = part.begins[at], part.begins[np.minimum(at + 1, len(part.begins) - 1)]
            order = np.empty(len(ids), np.int64)
            order[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
            for q, mine in enumerate(places):
                mine = mine[there[mine]]
                if not len(mine):
                    continue
                sums = np.zeros(len(ids), np.int64)
                for t in mine.tolist():
                    lo, hi = begins[t], ends[t]
                    sums[part.docs[lo:hi]] += weight[t] * part.impacts[lo:hi].astype(np.int64)
                chosen = best(sums, order, k)
                if len(chosen):
                    tops[q] = merged(tops[q], sums[chosen], ids.take(pa.array(chosen)), k)
        found = [(q, t) for q, t in enumerate(tops) if t]
        yield pa.record_batch({
            "item": names.take(pa.array([q for q, t in found for _ in t[0]], pa.int64())),
            "id": pa.concat_arrays([t[1] for _, t in found]) if found else pa.array([], id_type),
            "score": pa.array(np.concatenate([np.empty(0, np.int64), *(t[0] for _, t in found)])),
        })
        trim()

    id_type = shards_type(items_kind=kind)
    rows = shards.mapInArrow(scored, f"item {item_kind}, id {kind}, score long")
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merged(top: tuple[np.ndarray, pa.Array] | None, scores: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, pa.Array]:
    """The k best of two lists."""
    if top is not None:
        scores, ids = np.concatenate((top[0], scores)), pa.concat_arrays([top[1], ids])
    order = np.empty(len(ids), np.int64)
    order[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
    chosen = best(scores, order, k)
    return scores[chosen], ids.take(pa.array(chosen))


def shards_type(items_kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(items_kind))


@tidy
def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Index all documents and search them for all items."""
    shards, n_docs = index(docs, id_col, text_col)
    return search(shards, n_docs, items, k, item_col, item_text, id_col)
