"""Benchmark decontamination by latent semantic retrieval, then longest common subsequence and answer checks.

1. Words (of the lower-case text, cut at white space and ASCII punctuation) are hashed to 2**BITS features, weighted by the
   logarithm of their inverse share of all words of all documents.
2. A randomised singular value decomposition of TF-IDF passages gives RANK latent directions, scaled to equal
   variance. It is fitted on a bounded sample of documents and on all benchmark passages, whose weight together is
   that of the sample or less; products with the passage matrix are summed over the partitions, and the driver only
   orthogonalises a matrix of fixed size.
3. Every passage of every document (PASSAGE words, each half a passage) is projected and compared with every
   benchmark passage; pairs with a cosine of COSINE are candidates. Beside them, so that none is lost, so is each
   window around a passage that holds as many of the item's rarest words as every window with the needed subsequence does.
4. A candidate that shares enough words with its passage counts when the longest common subsequence of the item's words
   and the words around the passage has at least LCS_SHARE of the item, and, where ``answer_col`` gives an answer, that of
   the answer at least ANSWER_SHARE of it.

The documents are read once for all items, up to ITEMS items with ITEM_BYTES of text: that much is broadcast, as flat arrays, and
a task goes through it in blocks of QUERIES passages. A larger benchmark is dealt into groups of that size, with a pass for each.

Defined results: null and empty texts and items match nothing; items of under four words must occur whole, word by word; repeated
documents and items each match on their own; a very long text is searched whole; ties do not arise, as every item that
matches is returned; an empty table on either side gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import joined, mix, prepare, slices, text_bytes, tidy, word_hashes, written

BITS, RANK, EXTRA, POWERS = 14, 64, 8, 2
PASSAGE, COSINE, LCS_SHARE, ANSWER_SHARE = 40, 0.45, 0.6, 0.5
#: Share of an item's words (of 30, if it has more) that one passage must hold; half of them can be anywhere.
HELD = 0.35
#: Share of an item's words that must be among its rarest ones in a window, beyond those that may be missing.
SURE = 0.25
#: Bounds: documents and passages of each that the decomposition is fitted on.
FIT_DOCS, FIT_PASSAGES = 2000, 2
#: Bounds: items of a pass over the documents and bytes of their texts and answers.
ITEMS, ITEM_BYTES = 100_000, 16_000_000
#: Bounds inside a task: an item block's passages, half passages compared with them at once, rare words of items found at once.
QUERIES, HALVES, HITS = 4096, 8192, 4_000_000
#: Features of a block of the matrix that is summed over partitions.
ROWS = 4096
_ITEM = np.uint64(0xE7037ED1A0B428DB)


def features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(*joined(texts), fold=False, marks=True)


def _lower(batch: pa.RecordBatch) -> list[bytes]:
    """The texts of a batch in lower case."""
    return text_bytes(pa.record_batch({"text": pc.utf8_lower(batch.column("text"))}))


def starts(n: int) -> list[int]:
    """Where the passages of n words start: each half a passage, the last one ends with the text or before."""
    half = PASSAGE // 2
    return list(range(0, max(n - half, 1), half)) if n else []


class Items(NamedTuple):
    """Benchmark items as flat arrays: item i has the words ends[i]:ends[i + 1], and so on."""

    ids: pa.Array
    words: np.ndarray
    ends: np.ndarray
    answers: np.ndarray
    answer_ends: np.ndarray
    #: How many words the common subsequence must have, and how many a passage must hold to be compared.
    need: np.ndarray
    least: np.ndarray
    #: Latent passages, and where those of each item begin.
    queries: np.ndarray
    own: np.ndarray
    #: Hashes of all pairs of an item and its word, sorted.
    keys: np.ndarray
    #: Rare words, sorted; pairs of such a word's index and an item that has it, as index * items + item; how many of them a window must hold.
    rare: np.ndarray
    pairs: np.ndarray
    bounds: np.ndarray


def needed(n: int) -> int:
    """How long the common subsequence with an item of n words must be."""
    return n if n < 4 else math.ceil(LCS_SHARE * n)


def rarest(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, int]:
    """Some words of an item, and how many of their places a window must hold to have the needed subsequence.

    At most len - need places of the item are not in the subsequence, whichever these are."""
    need = needed(len(words))
    least = min(need, max(3, math.ceil(SURE * len(words))))
    order = np.argsort(-idf[features(words)], kind="stable")
    return np.unique(words[order[: len(words) - need + least]]), least


def items_of(rows: pa.Table, table: np.ndarray, idf: np.ndarray) -> Items | None:
    """The items (item, text, answer) that have words."""
    rows = rows.combine_chunks()
    texts, answers = ([x for part in rows.select([c]).rename_columns(["text"]).to_batches() for x in _lower(part)] for c in ("text", "answer"))
    lens = _words(texts)[1]
    some = np.flatnonzero(lens)
    if not len(some):
        return None
    words, lens = _words([texts[i] for i in some])
    answer_words, answer_lens = _words([answers[i] for i in some])
    ends, answer_ends = (np.concatenate(([0], np.cumsum(x))) for x in (lens, answer_lens))
    own, queries, rare, bounds = [0], [], [], []
    for i in range(len(some)):
        item = words[ends[i] : ends[i + 1]]
        at = features(item)
        queries += [table[at[k : k + PASSAGE]].sum(axis=0) for k in starts(len(at))]
        own.append(len(queries))
        found, least = rarest(item, idf)
        rare.append(found)
        bounds.append(least)
    of = np.repeat(np.arange(len(some)), lens)
    order = np.lexsort((words, of))
    first = np.append(True, (np.diff(of[order]) != 0) | (words[order][1:] != words[order][:-1]))
    keys = np.sort(mix(words[order][first] + of[order][first].astype(np.uint64) * _ITEM))
    known, at = np.unique(np.concatenate(rare), return_inverse=True)
    pairs = np.sort(at.astype(np.int64) * len(some) + np.repeat(np.arange(len(some)), [len(x) for x in rare]))
    need = np.array([needed(n) for n in lens.tolist()], np.int64)
    return Items(rows["item"].combine_chunks().take(pa.array(some)), words, ends, answer_words, answer_ends, need, HELD * np.minimum(lens, 30), unit(np.stack(queries)), np.array(own), keys, known, pairs, np.array(bounds, np.int64))


def windows(items: Items, reach: np.ndarray, at: np.ndarray, where: np.ndarray, n: int, lo: int, hi: int) -> np.ndarray:
    """Pairs of a half and an item of lo to hi (half * items + item) whose window holds enough of the item's rare words.

    at, where: indexes of the rare words of some texts, and in which of their n halves these stand. A window is a passage (two
    halves) and ``reach`` halves before and behind it. It holds enough just when, of an item's places in order, some run of
    ``bounds`` places lies in it: so each run gives the windows around it, those that the run before it gave left out."""
    size = len(items.ids)
    first = np.searchsorted(items.pairs, at * size + lo)
    many = np.searchsorted(items.pairs, at * size + hi) - first
    total = int(many.sum())
    if total > HITS and hi - lo > 1:
        middle = (lo + hi) // 2
        return np.concatenate([windows(items, reach, at, where, n, *x) for x in ((lo, middle), (middle, hi))])
    place = np.sort(items.pairs[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(total)] % size * n + np.repeat(where, many))
    of, half = place // n, place % n
    last = np.arange(total) + items.bounds[of] - 1
    begin = np.flatnonzero(last < total)
    last = last[begin]
    good = (of[last] == of[begin]) & (half[last] - half[begin] <= 2 * reach[of[begin]] + 1)
    begin, last = begin[good], last[good]
    of = of[begin]
    from_, to = np.maximum(half[last] - 1 - reach[of], 0), np.minimum(half[begin] + reach[of], n - 1) + 1
    same = of[1:] == of[:-1]
    from_[1:][same] = np.maximum(from_[1:][same], to[:-1][same])
    many = np.maximum(to - from_, 0)
    return (np.repeat(from_ - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))) * size + np.repeat(of, many)


def whole(a: list[int], b: list[int]) -> bool:
    return any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))


def subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of a."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        if m := places.get(y):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def statistics(docs: DataFrame) -> DataFrame:
    """One pass over all docs (id, text): rows (feature, n), and with feature -1 the features of sampled passages."""
    share = min(1.0, FIT_DOCS / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2**BITS, np.int64)
        sample = []
        for batch in slices(batches):
            hashes, counts = _words(_lower(batch))
            at = features(hashes)
            total += np.bincount(at, minlength=2**BITS)
            ends = np.cumsum(counts)
            for row in np.flatnonzero(batch.column("chosen").to_numpy(zero_copy_only=False)).tolist():
                own = at[ends[row] - counts[row] : ends[row]]
                found = starts(len(own))
                sample += [own[s : s + PASSAGE] for s in found[:: max(1, len(found) // FIT_PASSAGES)][:FIT_PASSAGES]]
        some = np.flatnonzero(total)
        yield pa.record_batch({"feature": pa.array(some, pa.int32()), "n": pa.array(total[some]), "passage": pa.nulls(len(some), pa.list_(pa.int32()))})
        if sample:
            yield pa.record_batch({"feature": pa.array([-1] * len(sample), pa.int32()), "n": pa.array([1] * len(sample), pa.int64()), "passage": pa.array(sample, pa.list_(pa.int32()))})

    chosen = (F.shiftrightunsigned(F.xxhash64("id"), 11) < F.lit(int(share * 2**53))).alias("chosen")
    return written(docs.select("text", chosen).mapInArrow(run, "feature int, n long, passage array<int>"), "statistics")


def weights(stats: DataFrame) -> np.ndarray:
    """Inverse collection frequency of every feature; 2**BITS rows reach the driver."""
    n = np.zeros(2**BITS)
    found = stats.where("feature >= 0").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    n[found["feature"].to_numpy()] = found["n"].to_numpy()
    return np.log((n.sum() + 1) / (n + 1)).astype(np.float32) ** 2 / 10


def decompose(passages: DataFrame, idf: np.ndarray) -> np.ndarray:
    """The leading right singular vectors (2**BITS x RANK) of the TF-IDF matrix of passages (columns passage and
    weight), each divided by its singular value."""
    spark, cols = passages.sparkSession, RANK + EXTRA
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((2**BITS, cols), dtype=np.float32))[0]
    for turn in range(POWERS + 1):
        sent = spark.sparkContext.broadcast((q, idf))

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, idf = sent.value  # noqa: B023
            out = np.zeros_like(q)
            for batch in batches:
                for row, weight in zip(batch.column("passage").to_pylist(), batch.column("weight").to_pylist(), strict=True):
                    at, tf = np.unique(np.array(row, np.int64), return_counts=True)
                    x = idf[at] * tf
                    x *= np.float32(weight / (np.linalg.norm(x) or 1))
                    out[at] += np.outer(x, x @ q[at])
            for k in range(0, 2**BITS, ROWS):
                yield pa.record_batch({"block": pa.array([k], pa.int32()), "body": pa.array([out[k : k + ROWS].astype(np.float32).tobytes()], pa.binary())})

        def total(table: pa.Table) -> pa.Table:
            body = sum(np.frombuffer(x, np.float32) for x in table["body"].to_pylist())
            return pa.table({"block": table["block"][:1], "body": pa.array([body.tobytes()], pa.binary())})

        parts = passages.mapInArrow(product, "block int, body binary").groupBy("block").applyInArrow(total, "block int, body binary").toArrow()
        z = np.zeros_like(q)
        for k, body in zip(parts["block"].to_pylist(), parts["body"], strict=True):
            z[k : k + ROWS] = np.frombuffer(body.as_buffer(), np.float32).reshape(-1, cols)
        sent.destroy()
        if turn < POWERS:
            q = np.linalg.qr(z)[0]
    values, inner = np.linalg.eigh((q.T @ z).astype(np.float64))
    scale = np.sqrt(np.maximum(values[::-1][:RANK], 1e-6))
    return (q @ inner[:, ::-1][:, :RANK] / scale).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@tidy
def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """One row for each document and item that it holds: id, item, item_words, lcs (the longest common subsequence), cosine."""
    spark = docs.sparkSession
    prepare(spark)
    kind, item_kind = (x.schema[c].dataType.simpleString() for x, c in ((docs, id_col), (benchmark, item_col)))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    asked = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("answer"))
    shape, names = f"id {kind}, item {item_kind}, item_words long, lcs long, cosine double", (id_col, item_col, "item_words", "lcs", "cosine")
    asked = written(asked.withColumn("turn", F.monotonically_increasing_id()), "items")
    size, n_bytes = asked.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0)))).first()
    if not size:
        return spark.createDataFrame([], shape).toDF(*names)
    stats = statistics(docs)
    idf = weights(stats)

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts = _words(_lower(batch))
            at, end, rows = features(hashes), 0, []
            for n in counts.tolist():
                rows += [at[end : end + n][s : s + PASSAGE] for s in starts(n)]
                end += n
            yield pa.record_batch({"passage": pa.array(rows, pa.list_(pa.int32()))})

    asked_passages = asked.select("text").mapInArrow(passages, "passage array<int>").withColumn("weight", F.lit(min(1.5, max(0.2, math.sqrt(1000 / size)))))
    fit = stats.where("feature = -1").select("passage", F.lit(1.0).alias("weight")).unionByName(asked_passages)
    table = decompose(fit.coalesce(8), idf) * idf[:, None]
    groups, found = max(-(-size // ITEMS), -(-(n_bytes or 0) // ITEM_BYTES)), None
    for group in range(groups):
        items = items_of(asked.where(F.pmod("turn", F.lit(groups)) == group).select("item", "text", "answer").toArrow(), table, idf)
        if items:
            now = docs.mapInArrow(search(table, items), shape)
            found = now if found is None else found.unionByName(now)
    if found is None:
        return spark.createDataFrame([], shape).toDF(*names)
    return found.toDF(*names)


def search(table: np.ndarray, items: Items):
    """The step that looks for some items in batches of documents."""
    from pyspark.sql import SparkSession

    sent = SparkSession.getActiveSession().sparkContext.broadcast((table, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, items = sent.value
        table = np.concatenate((table, np.zeros((1, table.shape[1]), np.float32)))  # the last row stands for no word
        half, size = PASSAGE // 2, len(items.ids)
        lens = np.diff(items.ends)
        reach = -(-lens // half)  # halves of a window before and behind its passage
        owner = np.repeat(np.arange(size), np.diff(items.own))
        edges = [0]  # blocks of items
        while edges[-1] < size:
            edges.append(max(edges[-1] + 1, int(np.searchsorted(items.own, items.own[edges[-1]] + QUERIES, "right")) - 1))
        maybe = np.zeros(1 << 16, bool)
        maybe[items.rare >> np.uint64(48)] = True

        @functools.lru_cache(4096)
        def words_of(i: int) -> tuple[list[int], frozenset[int], list[int]]:
            own = items.words[items.ends[i] : items.ends[i + 1]].tolist()
            return own, frozenset(own), items.answers[items.answer_ends[i] : items.answer_ends[i + 1]].tolist()

        for batch in slices(batches, 1_000_000):
            hashes, counts = _words(_lower(batch))
            if not len(hashes):
                continue
            firsts = np.cumsum(counts) - counts
            n_halves = -(-counts // half)
            row = np.repeat(np.arange(len(counts)), n_halves)
            cut = firsts[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n_halves) - n_halves, n_halves)) * half
            stop = (firsts + counts)[row]
            at = np.concatenate((features(hashes), [table.shape[0] - 1]))
            sums = np.zeros((len(row), table.shape[1]), np.float32)
            for k in range(half):
                sums += table[at[np.where(cut + k < stop, cut + k, len(hashes))]]
            both = np.flatnonzero(row[:-1] == row[1:])
            sums[both] += sums[both + 1]  # a passage: a half and the next one of the text
            sums = unit(sums)
            doc_of = np.repeat(np.arange(len(counts)), counts)
            place = (np.cumsum(n_halves) - n_halves)[doc_of] + (np.arange(len(hashes)) - firsts[doc_of]) // half
            some = np.flatnonzero(maybe[hashes >> np.uint64(48)])
            at = np.minimum(np.searchsorted(items.rare, hashes[some]), len(items.rare) - 1)
            good = items.rare[at] == hashes[some]
            at, where = at[good], place[some[good]]
            best: dict[tuple[int, int], tuple[int, float]] = {}
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                asked, pairs = items.queries[items.own[lo] : items.own[hi]].T, []
                for top in range(0, len(sums), HALVES):
                    p, k = np.nonzero(sums[top : top + HALVES] @ asked >= COSINE)
                    p, item = p + top, owner[k + items.own[lo]]
                    held = np.zeros(len(p), np.int64)
                    for i in range(PASSAGE):
                        inside = cut[p] + i < stop[p]
                        key = mix(hashes[np.where(inside, cut[p] + i, 0)] + item.astype(np.uint64) * _ITEM)
                        held += inside & (items.keys[np.minimum(np.searchsorted(items.keys, key), len(items.keys) - 1)] == key)
                    good = held >= items.least[item]
                    pairs.append(p[good] * size + item[good])
                pairs = np.unique(np.concatenate((*pairs, windows(items, reach, at, where, len(row), lo, hi))))
                for p, item in zip((pairs // size).tolist(), (pairs % size).tolist(), strict=True):
                    doc, (own, different, answer) = int(row[p]), words_of(item)
                    around = hashes[max(int(firsts[doc]), int(cut[p]) - len(own)) : min(int(stop[p]), int(cut[p]) + PASSAGE + len(own))].tolist()
                    if len(different.intersection(around)) < len(different) - (len(own) - items.need[item]):
                        continue
                    got = subsequence(own, around)
                    if got < items.need[item] or len(own) < 4 and not whole(own, around):
                        continue
                    cosine = float((items.queries[items.own[item] : items.own[item + 1]] @ sums[p]).max())
                    if subsequence(answer, around) >= ANSWER_SHARE * len(answer) and best.get((doc, item), (0, -2.0)) < (got, cosine):
                        best[doc, item] = got, cosine
            if best:
                of = np.array([i for _, i in best])
                yield pa.record_batch(
                    [batch.column("id").take(pa.array([d for d, _ in best])), items.ids.take(pa.array(of)), pa.array(lens[of], pa.int64()), pa.array([n for n, _ in best.values()], pa.int64()), pa.array([x for _, x in best.values()])],
                    ["id", "item", "item_words", "lcs", "cosine"],
                )

    return run


@tidy
def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    return docs.join(leaks(docs, benchmark, id_col, text_col).select(id_col).distinct(), id_col, "left_anti").select(*docs.columns)
