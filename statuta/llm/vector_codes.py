"""Vector code compression: product quantisation by an exact integer Lloyd iteration that keeps bounds in heaps.

Vectors become integers and are cut into parts; each part position has a codebook. The vectors lie in blocks of at most
BLOCK rows, one row of a table each, together with their state: which entry each part is assigned to, and for each entry
a heap of its parts. A heap's key is the slack of a part, lower bound of the second distance minus upper bound of the
first, plus the drift that the entry had gathered when the part was put in. When entries move, only the gathered drift
grows (an entry's own way and the longest way of another); nothing is done for a part until the drift has reached its
key. Those parts alone are popped, compared with all entries exactly and put in again, so the result is that of the plain
iteration. A round is one pass over the blocks that writes their next state and what has changed in the sums of entries;
the changes are added up by Spark, and the driver sees one number for each entry and component. The tables of earlier
rounds are deleted.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; vectors of another length
than that of the smallest id have null for code and error; a length that the parts do not divide is filled up with
zeros; fewer kept vectors than entries make as many entries; repeated rows each give a row; rows that share an id are
ordered by their vectors where the first entries are chosen; a null id is a row like others and the last in that order;
null labels are one label; other columns, whatever their names, are ignored; an empty table gives no rows. Components
must be below 2**27 / 4096 in size, else sums would not fit a long: larger ones are an error that says so.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import join_hot, prepare, scratch_tables, sweep, written

#: Components are integers of this many steps to one; the largest such integer.
SCALE, LARGEST = 4096, 1 << 27
#: Vectors of a block at most: with its state a block of 64 components takes about 3 MB.
BLOCK = 8192
#: What is added to bounds for rounding: integer distances below 2**61 have roots that differ by more or are equal.
SLIP = 1e-6


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some parts (rows) the nearest entries of their codebook, of equally near ones the first, their squared
    distances, and how much further the second nearest is."""
    far = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    own = far.argmin(axis=1)
    best = far[np.arange(len(x)), own]
    if len(book) == 1:
        return own, best, np.full(len(x), np.inf)
    far[np.arange(len(x)), own] = np.iinfo(np.int64).max
    return own, best, np.sqrt(far.min(axis=1).astype(float)) - np.sqrt(best.astype(float))


def drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much the slack of parts of each entry may shrink as all entries (parts, entries, width) move: its own way and the longest of the others."""
    way = np.sqrt(((new - old) ** 2).sum(axis=2).astype(float))
    if way.shape[1] == 1:
        return way + SLIP
    order = np.sort(way, axis=1)
    others = np.where(way == order[:, -1:], np.where(order[:, -2:-1] == order[:, -1:], order[:, -1:], order[:, -2:-1]), order[:, -1:])
    return way + others + SLIP


class Block:
    """Vectors (rows, parts, width), the entry of each part, and a heap of (key, number of the part) for each entry."""

    def __init__(self, x: np.ndarray, parts: int, entries: int):
        self.x, self.own = x, np.full((len(x), parts), -1, np.int16)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(parts * entries)]
        self.entries = entries

    def due(self, gathered: np.ndarray) -> np.ndarray:
        """Pop the parts whose slack the gathered drift may have used up."""
        out = []
        for heap, limit in zip(self.heaps, gathered.ravel().tolist(), strict=True):
            while heap and heap[0][0] <= limit:
                out.append(heapq.heappop(heap)[1])
        return np.array(out, np.int64)

    def assign(self, items: np.ndarray, books: np.ndarray, gathered: np.ndarray) -> np.ndarray:
        """Compare parts with all entries and put them in again; returns the change of (parts, entries, 1 + width) counts and sums."""
        parts = self.own.shape[1]
        change = np.zeros((parts, self.entries, 1 + self.x.shape[2]), np.int64)
        for p in range(parts):
            rows = items[items % parts == p] // parts
            if not len(rows):
                continue
            x, was = self.x[rows, p].astype(np.int64), self.own[rows, p]
            own, _, slack = nearest(x, books[p])
            moved = own != was
            ones = np.concatenate((np.ones((len(rows), 1), np.int64), x), axis=1)[moved]
            np.add.at(change[p], own[moved], ones)
            left = was[moved] >= 0
            np.subtract.at(change[p], was[moved][left], ones[left])
            self.own[rows, p] = own
            for c, key, row in zip(own.tolist(), (slack + gathered[p, own] - SLIP).tolist(), rows.tolist(), strict=True):
                heapq.heappush(self.heaps[p * self.entries + c], (key, row * parts + p))
        return change

    def packed(self) -> dict[str, bytes]:
        flat = [item for heap in self.heaps for item in heap]
        return {
            "x": self.x.tobytes(),
            "own": self.own.tobytes(),
            "sizes": np.fromiter(map(len, self.heaps), np.int32, len(self.heaps)).tobytes(),
            "keys": np.fromiter((k for k, _ in flat), np.float64, len(flat)).tobytes(),
            "items": np.fromiter((i for _, i in flat), np.int32, len(flat)).tobytes(),
        }

    @staticmethod
    def unpacked(row: dict[str, bytes], parts: int, entries: int, width: int) -> Block:
        out = Block(np.frombuffer(row["x"], np.int32).reshape(-1, parts, width), parts, entries)
        out.own = np.frombuffer(row["own"], np.int16).reshape(-1, parts).copy()
        flat = list(zip(np.frombuffer(row["keys"], np.float64).tolist(), np.frombuffer(row["items"], np.int32).tolist(), strict=True))
        ends = np.cumsum(np.frombuffer(row["sizes"], np.int32)).tolist()
        out.heaps = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]  # a heap's order is kept
        return out

    def errors(self, books: np.ndarray) -> np.ndarray:
        """Squared distances to the entries, summed over the parts of each vector."""
        chosen = books[np.arange(self.own.shape[1])[None], self.own]
        return ((self.x.astype(np.int64) - chosen) ** 2).sum(axis=(1, 2))


def integers(values: np.ndarray) -> np.ndarray:
    out = np.floor(SCALE * values.astype(np.float64))
    if len(out) and np.abs(out).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST // SCALE} and more are too large for exact sums")
    return out.astype(np.int32)


_STATE = "x binary, own binary, sizes binary, keys binary, items binary"


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """A row per kept vector: its id, code, error, label_error and codebooks_sha256."""
    spark = vectors.sparkSession
    prepare(spark)
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (id_col, label_col)}
    v = F.col("v")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(v.isNotNull() & ~bad)
    head = kept.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v")).limit(1).collect()
    size = head[0][0] if head else 0
    first = [r[0] for r in kept.where(F.size("v") == size).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    width = max(1, -(-size // parts))
    pad = parts * width - size

    def matrix(values: np.ndarray) -> np.ndarray:
        out = integers(values).reshape(-1, size) if size else np.zeros((len(values), 0), np.int32)
        return np.pad(out, ((0, 0), (0, pad))).reshape(-1, parts, width)

    n = max(1, len(first))
    books = matrix(np.array(first, np.float64)).transpose(1, 0, 2).astype(np.int64) if first else np.zeros((parts, 1, width), np.int64)
    gathered = np.zeros((parts, n))

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, BLOCK - rows)
                held.append(some)
                rows, batch = rows + some.num_rows, batch.slice(some.num_rows)
                if rows == BLOCK:
                    yield block(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            yield block(pa.Table.from_batches(held))

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        new = Block(matrix(np.asarray(rows["v"].combine_chunks().flatten(), dtype=np.float64) if size else np.zeros(rows.num_rows)), parts, n)
        change = new.assign(np.arange(new.own.size), books, gathered)
        listed = {c: pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows[c].combine_chunks()) for c in ("id", "label")}
        return pa.record_batch({"ids": listed["id"], "labels": listed["label"], **{k: pa.array([b], pa.binary()) for k, b in (new.packed() | {"change": change.tobytes()}).items()}})

    def next_round(books: np.ndarray, gathered: np.ndarray):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, row in enumerate(batch.select(["x", "own", "sizes", "keys", "items"]).to_pylist()):
                    now = Block.unpacked(row, parts, n, width)
                    change = now.assign(now.due(gathered), books, gathered)
                    yield pa.record_batch({"ids": batch.column("ids").slice(i, 1), "labels": batch.column("labels").slice(i, 1), **{k: pa.array([b], pa.binary()) for k, b in (now.packed() | {"change": change.tobytes()}).items()}})

        return step

    def ended(books: np.ndarray, gathered: np.ndarray):
        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, row in enumerate(batch.select(["x", "own", "sizes", "keys", "items"]).to_pylist()):
                    now = Block.unpacked(row, parts, n, width)
                    now.assign(now.due(gathered), books, gathered)
                    text = pa.array([bytes(r).hex() for r in now.own.astype(np.uint8)], pa.string())
                    yield pa.record_batch({"id": batch.column("ids").slice(i, 1).flatten(), "label": batch.column("labels").slice(i, 1).flatten(), "code": text, "error": pa.array(now.errors(books), pa.int64())})

        return finish

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(parts * n * (1 + width), np.int64)
        for batch in batches:
            for b in batch.column("change").to_pylist():
                total += np.frombuffer(b, np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch({"cell": pa.array(at, pa.int64()), "value": pa.array(total[at], pa.int64())})

    blocks_schema = f"ids array<{kinds[id_col]}>, labels array<{kinds[label_col]}>, {_STATE}, change binary"
    other = kept.where(F.size("v") != size).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not first:
        done = other
    else:
        before = set(scratch_tables())
        state = written(kept.where(F.size("v") == size).mapInArrow(built, blocks_schema), "blocks")
        sums = np.zeros(parts * n * (1 + width), np.int64)
        for turn in range(rounds):
            for cell, value in state.select("change").mapInArrow(summed, "cell long, value long").groupBy("cell").agg(F.sum("value")).collect():
                sums[cell] += value
            table = sums.reshape(parts, n, 1 + width)
            count = table[:, :, :1]
            new = np.where(count > 0, table[:, :, 1:] // np.maximum(count, 1), books)
            gathered = gathered + drift(books, new)
            books = new
            if turn < rounds - 1:
                state = written(state.drop("change").mapInArrow(next_round(books, gathered), blocks_schema), "blocks")
                sweep(spark, [p for p in scratch_tables() if p not in before], state)
        done = written(state.drop("change").mapInArrow(ended(books, gathered), f"id {kinds[id_col]}, label {kinds[label_col]}, code string, error long"), "codes")
        sweep(spark, [p for p in scratch_tables() if p not in before], done)
        done = done.unionByName(other)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist() if first else [])).encode()).hexdigest()
    keyed = done.withColumn("_none", F.col("label").isNull()).withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    totals = keyed.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = join_hot(keyed, written(totals, "labels"), ["_none", "_label"])
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
