"""Removal of word windows that already stand in a document with a smaller id, by repeated-phrase automata.

1. Confirm recurring phrases. Every document is cut into words, each a symbol (16 bits of its hash); of the phrases of
   SEED symbols in each window the one with the smallest hash is an anchor, so equal windows have equal anchors
   (winnowing). An anchor in two different texts is a recurring phrase. Texts with equal words count as one here.
2. Automata. Documents are dealt into blocks of about BLOCK_WORDS words; a block is sent the recurring phrases that it
   holds, without their places, so phrases are sharded by block and none goes where it cannot be. The block compiles them
   into an Aho-Corasick automaton, streams all its documents through it and so locates every occurrence. Every hit gives
   the windows around it, as 96 bits of hashes of their words (64 and 32, of two independent hashes of the words).
3. A window whose smallest document is not this one covers words that go. Documents with a copy of all their
   words in a smaller id go wholly, from one window up.

Defined results: null and empty texts have no words and keep the empty text; a document under one window is kept
whole; very long texts are judged whole, and may make a block larger; repeated rows (one id, one text) do not remove each
other, since neither id is smaller; of texts under one id neither removes words of the other; a row without an id
neither removes nor loses words; windows are judged on the input; other columns, whatever their names, pass through
``dedup``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import fresh, join_hot, joined, mix, prepare, run_hashes, scratch_tables, slices, span_hashes, sweep, text_bytes, tidy, trim, width, word_spans, written

#: Words of a phrase that anchors windows: two integers of four symbols each.
SEED, HALF = 8, 4
#: Words of a block, about; the least symbol as a character, so that none is a surrogate.
BLOCK_WORDS, FIRST = 1_000_000, 0x10000
#: Bits that tell apart the texts of one id.
TKEY = 0x7FFFFFFF


def phrases(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the phrase that starts at each symbol."""
    n = max(len(symbols) - SEED + 1, 0)
    wide = symbols.astype(np.uint64)
    half = np.zeros(n + HALF if n else 0, np.uint64)
    for k in range(HALF):
        half |= wide[k : k + len(half)] << np.uint64(16 * k)
    return half[:n], half[HALF:]


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each n neighbours, by doubling."""
    k = 1
    while 2 * k <= n:
        x = pick(x[:-k], x[k:])
        k *= 2
    return pick(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def anchors(symbols: np.ndarray, window: int) -> np.ndarray:
    """The distinct phrases (rows of two halves) that are smallest in some window."""
    if len(symbols) < window:
        return np.empty((0, 2), np.uint64)
    p, q = phrases(symbols)
    rank, n = mix(p ^ mix(q)), window - SEED + 1
    least = _slide(rank, n, np.minimum)
    pad = np.zeros(n - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate((pad, least, pad)), n, np.maximum) == rank)
    return np.unique(np.stack((p[at], q[at]), axis=1), axis=0)


def letters(symbols: np.ndarray) -> str:
    """One character for each symbol."""
    return (symbols.astype("<u4") + FIRST).tobytes().decode("utf-32-le")


def compiled(keys: np.ndarray) -> ahocorasick.Automaton:
    """An automaton of phrases (rows of two halves)."""
    shifts = np.arange(0, 64, 16, dtype=np.uint64)
    rows = ((keys[:, :, None] >> shifts) & np.uint64(0xFFFF)).reshape(len(keys), SEED)
    every = letters(rows.ravel())
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i in range(0, len(every), SEED):
        automaton.add_word(every[i : i + SEED], 1)
    automaton.make_automaton()
    return automaton


def windows_around(automaton: ahocorasick.Automaton, symbols: np.ndarray, window: int) -> np.ndarray:
    """The starts of the windows of a document that hold one of the phrases."""
    last = len(symbols) - window
    hits = np.fromiter((end for end, _ in automaton.iter(letters(symbols))), np.int64) - (SEED - 1) if last >= 0 else np.empty(0, np.int64)
    low, high = np.clip(hits - (window - SEED), 0, None), np.minimum(hits, last)
    step = np.bincount(low, minlength=max(last, 0) + 2) - np.bincount(high + 1, minlength=max(last, 0) + 2)
    return np.flatnonzero(np.cumsum(step[:-1]) > 0)


def _docs_words(texts: list[bytes], seeds: int = 1) -> list[tuple[np.ndarray, ...]]:
    """Hashes of the words of each text, by one or two independent hashes."""
    data, ends = joined(texts)
    hashes, counts, begins, stops = word_spans(data, ends, fold=False)
    every = [hashes, *(span_hashes(data, begins, stops, k) for k in range(1, seeds))]
    return list(zip(*(np.split(h, np.cumsum(counts)[:-1]) for h in every), strict=True)) if texts else []


def symbols_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.uint16)


def removals(docs: DataFrame, window: int = 50) -> DataFrame:
    """Of docs (id, text) those with removals: id, tkey (hash of the text), starts of windows to go, -1 for the whole text."""
    if window < SEED:
        raise ValueError(f"a window has {SEED} words at least")
    spark, kind = docs.sparkSession, docs.schema["id"].dataType.simpleString()
    docs = docs.where("id is not null").withColumn("tkey", F.xxhash64("text").bitwiseAND(F.lit(TKEY)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [w for (w,) in _docs_words(text_bytes(batch))]
            found = [anchors(symbols_of(w), window) for w in words]
            lens = np.cumsum([0, *map(len, found)])
            halves = np.concatenate(found).view(np.int64)
            values = pa.StructArray.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["p", "q"])
            keys = [hashlib.blake2b(w.tobytes(), digest_size=16).digest() for w in words]
            yield pa.record_batch({"id": batch.column("id"), "tkey": batch.column("tkey"), "n": pa.array(map(len, words), pa.int64()), "words": pa.array(keys, pa.binary()), "anchors": pa.ListArray.from_arrays(pa.array(lens, pa.int32()), values)}).filter(pa.array([len(w) >= window for w in words]))
        trim()

    before = set(scratch_tables())
    heads = written(docs.select("id", "tkey", "text").mapInArrow(sketch, f"id {kind}, tkey long, n long, words binary, anchors array<struct<p:long,q:long>>"), "anchors")
    total = heads.agg(F.sum("n")).first()[0] or 0
    block = F.pmod(F.xxhash64("id", "tkey"), F.lit(-(-total // BLOCK_WORDS) or 1)).cast("int").alias("block")
    firsts = heads.groupBy("words").agg(F.min(F.struct("id", "tkey", "anchors")).alias("x"), F.count("*").alias("n"))
    firsts = written(firsts.select("words", "n", "x.*").withColumn("block", block), "firsts")
    copies = join_hot(heads.select("words", "id", "tkey"), firsts.where("n > 1").select("words", "n", F.col("id").alias("first")), ["words"]).where("id > first")
    copies = written(copies.select("id", "tkey"), "copies")
    marks = firsts.select("block", F.explode("anchors").alias("y")).select("block", "y.p", "y.q")
    recurring = marks.groupBy("p", "q").agg(F.count("*").alias("n")).where("n > 1")  # a text has each of its anchors once
    sent = join_hot(marks, written(recurring, "phrases"), ["p", "q"]).select("block", "p", "q")

    def locate(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            automaton = compiled(np.unique(np.stack([right[c].to_numpy().view(np.uint64) for c in ("p", "q")], axis=1), axis=0))
            for batch in slices(left.to_batches()):
                for row, (a, b) in enumerate(_docs_words(text_bytes(batch), 2)):
                    starts = windows_around(automaton, symbols_of(a), window)
                    if len(starts):
                        x, y = run_hashes(a, window)[starts], run_hashes(b, window, 1)[starts]
                        spot = (batch.column("tkey")[row].as_py() << 32) + starts  # both in one number
                        ids = batch.column("id").take(pa.array(np.full(len(starts), row)))
                        out.append(pa.record_batch([ids, pa.array(spot), pa.array(x.view(np.int64)), pa.array((y >> np.uint64(32)).astype(np.uint32).view(np.int32))], names=["id", "spot", "a", "b"]))
            trim()
        return pa.Table.from_batches(out) if out else pa.table({"id": left["id"][:0], "spot": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int32())})

    n = width(spark)
    texts = docs.select(block, "id", "tkey", "text").where(F.octet_length("text") >= 2 * window - 1).repartition(n, "block")
    texts = texts.join(firsts.select("block", "id", "tkey").repartition(n, "block"), ["block", "id", "tkey"], "left_semi").dropDuplicates(["block", "id", "tkey"])
    found = texts.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(locate, f"id {kind}, spot long, a long, b int")
    found = written(found, "windows")
    sweep(spark, [p for p in scratch_tables() if p not in before], docs, found, copies)  # anchors and phrases have done their work
    owners = written(found.groupBy("a", "b").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "owners")
    gone = join_hot(found, owners, ["a", "b"]).where("id > first")
    gone = gone.select("id", F.shiftright("spot", 32).alias("tkey"), F.col("spot").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("start"))
    return gone.unionByName(copies.select("id", "tkey", F.lit(-1).alias("start"))).groupBy("id", "tkey").agg(F.collect_set("start").alias("starts"))


def _strip(text: bytes, starts: list[int] | None, window: int) -> tuple[list[bytes], list[bytes]]:
    """Words of a text, and those that stay; start -1 means all go."""
    words = text.split()
    if not starts:
        return words, words
    if -1 in starts:
        return words, []
    step = np.zeros(len(words) + 1, np.int64)
    at = np.array(starts)
    step[at] += 1
    np.subtract.at(step, at + window, 1)
    return words, [w for w, gone in zip(words, (np.cumsum(step[:-1]) > 0).tolist(), strict=True) if not gone]


def marked(docs: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, str]:
    """Docs with one more column, and its name: where windows to remove start, null for none."""
    own, key, starts = (fresh(docs.columns, x) for x in ("_id", "_tkey", "_starts"))
    gone = removals(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), window)
    gone = gone.select(F.col("id").alias(own), F.col("tkey").alias(key), F.col("starts").alias(starts))
    return docs.join(gone, (F.col(id_col) == F.col(own)) & (F.xxhash64(text_col).bitwiseAND(F.lit(TKEY)) == F.col(key)), "left").drop(own, key), starts


@tidy
def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per document: its id, n_words, n_removed and kept_sha256 (of the words that stay, joined by one space)."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    found, starts = marked(docs.select(id_col, text_col), id_col, text_col, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=text_col):
            rows = [_strip(t, s, window) for t, s in zip(text_bytes(batch, text_col), batch.column(starts).to_pylist(), strict=True)]
            yield pa.record_batch(
                {
                    id_col: batch.column(id_col),
                    "n_words": pa.array([len(w) for w, _ in rows], pa.int64()),
                    "n_removed": pa.array([len(w) - len(k) for w, k in rows], pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for _, k in rows]),
                }
            )
        trim()

    return found.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string")


@tidy
def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Documents without the words that go. Untouched texts stay as they are, others are their words joined by one
    space; a document that loses its last word goes."""
    prepare(docs.sparkSession)
    found, starts = marked(docs, id_col, text_col, window)
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in slices(batches, column=text_col):
            texts = [t if not s else b" ".join(_strip(t.encode(), s, window)[1]).decode() for t, s in zip(batch.column(text_col).to_pylist(), batch.column(starts).to_pylist(), strict=True)]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.filter(pa.array([not (s and not t) for t, s in zip(texts, batch.column(starts).to_pylist(), strict=True)])).drop_columns([starts])
        trim()

    return found.mapInArrow(run, docs.schema)
