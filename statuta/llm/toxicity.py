"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words (cut at white space and ASCII punctuation, A-Z as a-z), adjacent pairs and pairs with one word between, hashed into
2**BITS coordinates. Training takes a bounded sample of labelled rows, whose coordinates (not texts) meet in one
task that runs FTRL-proximal, which is sequential, with per-coordinate rates and L1. L1 leaves few weights, all of which
are broadcast: 2**BITS + 1 at most. Scoring is one pass over all texts, without a shuffle.

Defined results: null and empty texts have no features and get the score of the bias alone; a very long text is scored
whole; with labels of one class alone every score is that class, and 0.5 without labels; repeated rows and ids are scored
each, alike, and learned from within the bound; ties (equal hashes of ids) are ordered by label, then text; rows with a
null label or id are not learned from; an empty table gives no rows; other columns, whatever their names, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import crc_mod, joined, mix, prepare, slices, text_bytes, word_hashes

BITS = 20
#: Bound of the labelled rows to learn from.
TRAIN_ROWS = 12_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 0.1, 5

_PAIR, _SKIP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def coordinates(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all features of some texts, repeated ones too, and the text of each."""
    hashes, counts = word_hashes(*joined(texts), fold=True, marks=True)
    owner = np.repeat(np.arange(len(texts)), counts)
    at, of = [hashes], [owner]
    for gap, factor in ((1, _PAIR), (2, _SKIP)):
        same = owner[gap:] == owner[:-gap]
        at.append(mix(hashes[:-gap] * factor + hashes[gap:])[same])
        of.append(owner[gap:][same])
    return (np.concatenate(at) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(of)


def ftrl(rows: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights of a model; coordinate 2**BITS is the bias, which L1 spares."""
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)
    for _ in range(EPOCHS):
        for at, label in zip(rows, labels, strict=True):
            at = np.append(at, 2**BITS)
            zs, ns = z[at], n[at]
            root = np.sqrt(ns)
            bound = np.full(len(at), L1)
            bound[-1] = 0
            w = -np.sign(zs) * np.maximum(np.abs(zs) - bound, 0) / ((BETA + root) / ALPHA + L2)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[at] = zs + g - (np.sqrt(ns + g * g) - root) / ALPHA * w
            n[at] = ns + g * g
    bound = np.full(len(z), L1)
    bound[-1] = 0
    w = -np.sign(z) * np.maximum(np.abs(z) - bound, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    at = np.flatnonzero(w)
    return at, w[at]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Learn from at most TRAIN_ROWS of the labelled rows given, chosen by a hash of the id."""
    prepare(docs.sparkSession)
    chosen = labels.where(F.col(label_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("_label")).orderBy(F.xxhash64(id_col), "_label").limit(TRAIN_ROWS)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)  # TRAIN_ROWS bounds what is broadcast
    rows = rows.orderBy(F.xxhash64(id_col), "_label", F.xxhash64(text_col)).limit(TRAIN_ROWS)  # also where ids repeat

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=text_col):
            at, of = coordinates(text_bytes(batch, text_col))
            keys = np.unique(of << BITS | at)
            cuts = np.searchsorted(keys >> BITS, np.arange(batch.num_rows + 1))
            at = (keys & (2**BITS - 1)).astype("<i4")
            yield pa.record_batch({"_order": batch.column("_order"), "_label": batch.column("_label"), "_all": pa.array([0] * batch.num_rows, pa.int32()), "at": pa.array([at[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_order", "ascending"), ("_label", "ascending")])
        at, w = ftrl([np.frombuffer(x, "<i4").astype(np.int64) for x in table["at"].to_pylist()], table["_label"].to_pylist())
        if len(set(table["_label"].to_pylist())) < 2:
            share = min(max(table["_label"][0].as_py(), 1e-6), 1 - 1e-6)
            at, w = np.array([2**BITS]), np.array([np.log(share / (1 - share))])
        return pa.table({"at": at, "w": w})

    found = rows.withColumn("_order", F.xxhash64(id_col)).select("_order", "_label", text_col).mapInArrow(features, "_order long, _label int, _all int, at binary")
    weights = found.groupBy("_all").applyInArrow(train, "at long, w double")  # TRAIN_ROWS bounds the group
    kept = weights.toArrow()
    return kept["at"].to_numpy(), kept["w"].to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the score, 0 to 1."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)
    docs = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(2**BITS + 1)
        weights[sent.value[0]] = sent.value[1]
        for batch in slices(batches, column=text_col):
            at, of = coordinates(text_bytes(batch, text_col))
            hit = np.flatnonzero(weights[at])
            keys = np.unique(of[hit] << BITS | at[hit])
            total = weights[-1] + np.bincount(keys >> BITS, weights[keys & (2**BITS - 1)], batch.num_rows)
            yield pa.record_batch({id_col: batch.column(id_col), "score": 1 / (1 + np.exp(-np.clip(total, -35, 35)))})

    return docs.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5) -> DataFrame:
    """Score all documents by a model that has not seen the labels of fold 0."""
    model = fit(docs, labels.where(crc_mod(F.col(id_col), folds) != 0), id_col, text_col, label_col)
    scored = score(docs, model, id_col, text_col)
    return scored.select(id_col, (crc_mod(F.col(id_col), folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
