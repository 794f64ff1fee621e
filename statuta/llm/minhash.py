"""Near duplicates by MinHash: minima of many universal hashes, bands of them, signatures, full sets, components.

A document's set of word shingles is put through BANDS x rows hash functions x -> a x + b; the minima of `rows` functions
are a band. Sets as similar as asked agree in a band with probability t**rows, so rows is the largest number for which
they miss all bands with a probability of at most MISS (0.8: five rows, 64 bands, 1e-11), like a collision of hashes.

Sets that are equal become one row first. Rows that share a band make a bucket; buckets with the same rows are one. Rows
of a bucket are not expanded into pairs. Each row is first tried with one other, the head of most of its buckets, by
signature (SIGNED minima, a byte each: a bound seven deviations below what the threshold leads one to expect) and what
passes by full sets. Links give components (alternating large and small stars). Only buckets that still hold several
components go on: they are compared in blocks, the rows outside a bucket's largest component with all its rows; blocks
first keep the rows that may link by bitmaps and then give links that join their components. So no link is lost to a
bucket's size, and nothing is shuffled for pairs but one pair a row. Rows of a hot band are dealt into SALTS parts with a head
each; heads are tried with the first of them.

Full sets are made in one pass, only for rows that share a band: a Bloom filter of their ids (of BLOOM bits, whatever
their number) keeps most other texts out; those that it lets pass cost a row and change nothing.

Defined results: null and empty texts have an empty set and link with nothing; texts of fewer words than a shingle are
one shingle; repeated rows each give a row; rows that share an id count as linked; a row without an id is a component of
its own, without a number, and kept; a very long text is one set, taken whole; of ties the smallest id names the
component; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.llm.common import HOT, join_hot, mix, prepare, slices, text_bytes, tidy, trim, written
from statuta.llm.components import components
from statuta.llm.ngram_join import _LEVEL, _STEP, bitmap, product, products, shingle_sets

#: Bands, and the probability at most with which two sets of the least similarity share none.
BANDS, MISS = 64, 1e-11
#: Minima of a signature; shingles that are hashed at once.
SIGNED, PIECE = 128, 4096
#: One row in so many is looked at for hot bands; parts that the rows of a hot one are dealt into.
SOME, SALTS = 32, 64
#: Bits of a bitmap for each shingle of its set: pairs that fall short of 0.8 by over two hundredths show.
BITS = 8
#: Bits of the filter of ids that have a candidate, and bits of it that an id sets.
BLOOM, MARKS = 1 << 26, 4


def rows_of_band(t: float) -> int:
    return max([1, *(r for r in range(1, 17) if (1 - t**r) ** BANDS <= MISS)])


def functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of k hash functions; the same on every run."""
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[k:] >> np.uint64(32)).astype(np.uint32)


def minima(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    x, out = (grams >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(x), PIECE):
        part = (a[:, None] * x[None, at : at + PIECE] + b[:, None]).min(axis=1)
        out = part if out is None else np.minimum(out, part)
    return out


def bands(least: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each row of minima; keys of different bands differ."""
    parts = least.reshape(len(least), BANDS, rows).astype(np.uint64)
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP), parts.shape[:2])
    for j in range(rows):
        keys = mix(keys ^ (parts[:, :, j] + _LEVEL))
    return keys


def bloom(ids: DataFrame) -> np.ndarray:
    """The filter of some ids (column node) as words of 64 bits."""
    bits = ids.select(F.explode(F.array(*marks(F.col("node")))).alias("bit"))
    words = bits.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask")).toArrow()  # BLOOM / 64 rows at most
    out = np.zeros(BLOOM // 64, np.uint64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return out


def marks(col: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(col, F.lit(k)), F.lit(BLOOM)) for k in range(MARKS)]


@tidy
def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: its id, n_shingles, component_id (the smallest id that links reach from it) and kept.

    Two sets of shingles of n words link when den * intersection >= num * union."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    kind, rows = docs.schema["id"].dataType.simpleString(), rows_of_band(num / den)
    a, b = functions(BANDS * rows)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column="_text"):
            sets = shingle_sets(text_bytes(batch, "_text"), n)
            least = np.array([minima(s, a, b) if len(s) else np.zeros(len(a), np.uint32) for s in sets], np.uint32).reshape(-1, len(a))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(bands(least, rows).view(np.int64).ravel()))
            side = lambda salt: pa.array([int(mix(s ^ salt).sum()) - 2**63 for s in sets], pa.int64())
            signed = pa.array([r.tobytes() for r in least[:, :SIGNED].astype(np.uint8)], pa.binary())
            yield pa.record_batch({"id": batch.column("id"), "n": pa.array(map(len, sets), pa.int64()), "hi": side(_LEVEL), "lo": side(_STEP), "signed": signed, "bands": keys})
        trim()

    found = written(docs.mapInArrow(sketch, f"id {kind}, n long, hi long, lo long, signed binary, bands array<long>"), "minima")
    full = found.where("n > 0 and id is not null")
    nodes = full.groupBy("hi", "lo").agg(F.min(F.struct("id", "n", "signed", "bands")).alias("x"))
    nodes = written(nodes.select("hi", "lo", F.col("x.id").alias("node"), "x.n", "x.signed", "x.bands"), "classes")
    named = written(full.select("id", "n", "hi", "lo").join(nodes.select("hi", "lo", "node"), ["hi", "lo"]).select("id", "n", "node"), "named")
    state = linked(docs, nodes.select("node", "n", "signed", "bands"), same_id(named), n, num, den, kind)
    out = named.join(state, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    rest = found.where("n = 0 or id is null").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def same_id(named: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of rows that share an id."""
    several = named.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("id", "a")
    return named.join(several, "id").where("a < node").select("a", F.col("node").alias("b")).distinct()


def bucketed(nodes: DataFrame) -> DataFrame:
    """Buckets of several rows (key, node, head; salt: the part of a hot band, else -1)."""
    some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(SOME)) == 0)
    hot = some.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("n"))
    hot = hot.where(F.col("n") * HOT > some.count()).where("n > 1").select("band", F.lit(True).alias("hot"))  # HOT x BANDS at most
    entries = nodes.select("node", F.explode("bands").alias("band")).join(F.broadcast(hot), "band", "left")
    entries = entries.select("band", "node", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(-1).cast("int").alias("salt"))
    own = Window.partitionBy("band", "salt")
    rows = entries.withColumns({"rows": F.count("*").over(own), "head": F.min("node").over(own), **{f"s{k}": F.expr(f"bit_xor(xxhash64(node, {k}))").over(own) for k in range(2)}})
    key = F.when(F.col("salt") >= 0, F.col("band")).otherwise(F.xxhash64("rows", "s0", "s1"))
    return rows.where("rows > 1 or salt >= 0").select(key.alias("key"), "node", "head", "salt").distinct()


def linked(docs: DataFrame, nodes: DataFrame, given: DataFrame, n: int, num: int, den: int, kind: str) -> DataFrame:
    """Components (node, component) of nodes (node, n, signed, bands) by the links that are given and those found."""
    t = num / den
    enough = max(0, int(SIGNED * t - 7 * (SIGNED * t * (1 - t)) ** 0.5))
    buckets = written(bucketed(nodes), "buckets")
    sent = docs.sparkSession.sparkContext.broadcast(bloom(buckets.select("node").distinct()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows that are repeated in a task are one
        for batch in batches:
            bits = np.array([batch.column(f"m{k}").to_numpy() for k in range(MARKS)]).reshape(MARKS, -1)
            passed = np.flatnonzero(((sent.value[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0))
            for part in slices(iter([batch.take(pa.array(passed))]), column="_text"):
                found = shingle_sets(text_bytes(part, "_text"), n)
                new = [i for i, (k, s) in enumerate(zip(part.column("id").to_pylist(), found, strict=True)) if len(s) and (k, hash(s.tobytes())) not in seen and not seen.add((k, hash(s.tobytes())))]
                yield pa.record_batch({"node": part.column("id").take(pa.array(new, pa.int64())), "grams": pa.array([found[i].tobytes() for i in new], pa.binary())})
        trim()

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIGNED) for c in ("x", "y"))
            p, q = (batch.column(c).to_numpy() for c in ("n", "m"))
            ok = (np.minimum(p, q) * den >= np.maximum(p, q) * num) & ((x == y).sum(axis=1) >= enough)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(g.as_buffer(), np.uint64) for g in batch.column(c)] for c in ("x", "y"))
            ok = np.array([product(p, [q], num, den)[0] for p, q in zip(x, y, strict=True)], bool)
            yield batch.select(["a", "b"]).filter(pa.array(ok))
        trim()

    grams = written(docs.where("id is not null").select("id", "_text", *(m.alias(f"m{k}") for k, m in enumerate(marks(F.col("id"))))).mapInArrow(sets, f"node {kind}, grams binary"), "sets")
    sent.unpersist()

    def side(table: DataFrame, node: str, **names: str) -> DataFrame:
        return table.select(F.col("node").alias(node), *(F.col(old).alias(new) for old, new in names.items()))

    def links(pairs: DataFrame) -> DataFrame:
        """Of one pair a row (a, b) those that link."""
        near = pairs.join(side(nodes, "a", n="n", signed="x"), "a").join(side(nodes, "b", n="m", signed="y"), "b").select("a", "b", "n", "m", "x", "y").mapInArrow(screen, f"a {kind}, b {kind}")
        near = written(near, "near")
        return near.join(side(grams, "a", grams="x"), "a").join(side(grams, "b", grams="y"), "b").select("a", "b", "x", "y").mapInArrow(confirm, f"a {kind}, b {kind}").distinct()

    heads = buckets.where("salt >= 0").select("key", F.col("head").alias("node")).distinct()  # SALTS for each hot band at most
    firsts = heads.join(F.broadcast(heads.groupBy("key").agg(F.min("node").alias("head"))), "key")
    tried = buckets.select("node", "head").unionByName(firsts.select("node", "head")).where("head <> node")
    pairs = tried.groupBy("node").agg(F.mode("head", True).alias("a")).select("a", F.col("node").alias("b"))
    edges = written(given.unionByName(links(pairs)), "links")
    state = components(edges)
    labelled = buckets.select("key", "node").join(state, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = labelled.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("n")).where("p < q").select("key", "n")
    labelled = written(join_hot(labelled, written(apart, "apart"), ["key"]).select(F.col("key").alias("sig"), "node", "component"), "open")  # buckets of one component are done
    if not labelled.take(1):
        return state
    rest = written(grams.join(labelled.select("node").distinct(), "node", "left_semi"), "rest")
    new = written(products(labelled, briefs(rest, kind), lambda wanted: rest.join(wanted, "node"), num, den, kind), "links")
    return components(edges.unionByName(new)) if new.take(1) else state


def briefs(grams: DataFrame, kind: str) -> DataFrame:
    """(node, n, bits) of some sets (node, grams)."""

    def brief(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(g.as_buffer(), np.uint64) for g in batch.column("grams")]
            yield pa.record_batch({"node": batch.column("node"), "n": pa.array(map(len, sets), pa.int64()), "bits": pa.array([bitmap(s, BITS) for s in sets], pa.binary())})

    return written(grams.mapInArrow(brief, f"node {kind}, n long, bits binary"), "briefs")
