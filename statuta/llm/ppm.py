"""Prediction by partial matching over bytes, with a unigram word score beside it.

The model is a trie of byte contexts up to ORDER long, read from the last byte backwards, with all n-grams of all training
texts: it grows with the corpus, and no worker holds it whole. A node with its symbol is one number, whose digits are
the path, so sorted numbers are the trie in depth-first order. The subtrees from depth DEALT on are dealt into buckets by the
hash of their root; what is above (at most SYMBOLS**DEALT numbers of 16 bytes, 272 MB, whatever the corpus) is counted beforehand
and broadcast. In a context, escape has the weight of the number of different symbols (method C); after an escape these are
excluded and the rest of the shorter context's distribution is scaled up.

1. Blocks of documents list their distinct n-grams and words with the counts in training texts, packed by bucket.
2. Each bucket adds up what blocks sent, message by message, and computes the logarithms of its n-grams. It holds its
   own subtrees only, and one subtree has at most SYMBOLS**(ORDER-DEALT+1) numbers.
3. Each bucket answers the blocks, message by message, and blocks score their documents.

How many buckets there are follows from the size of the corpus, up to BUCKETS: a block sends at most that many messages of
each kind, so their number grows as the number of blocks does. Beyond, a bucket grows with the distinct n-grams of its subtrees.
Every text has a positive probability; it ends with a symbol of its own, so texts of all lengths share one
distribution. ``adaptive`` gives the code length that a model pays which learns from the text itself alone.

Defined results: null text is empty: one token, the end; a very long text is scored whole, and its block is the larger;
repeated rows are counted and scored each; ties do not arise; without training texts N and V are 0 and the model is
uniform; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import crc_mod, joined, mix, prepare, slices, text_bytes, tidy, trim, width, word_hashes, written

ORDER, DEALT = 5, 3
#: Symbols: the bytes, and the end of a text, which also stands before its first byte.
END, SYMBOLS = 256, 257
#: Text bytes of a block, and of the part of one that is scored at a time; n-grams that are held before they are added up.
BLOCK_BYTES, PART, HELD = 8_000_000, 500_000, 800_000
#: Text bytes of the corpus for each bucket, and the most buckets of words, and of n-grams; steps of a logarithm as it travels.
BUCKET_BYTES, BUCKETS, STEPS = 250_000_000, 8192, 2.0**40
#: Low bits of such a logarithm, which are added up by themselves.
HALF = 20


def codes(texts: list[bytes]) -> np.ndarray:
    """For each byte and end of the texts, in their order, the path of its context and then the symbol itself."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(lens + ORDER + 1) - lens - 1  # where each text's first symbol is, ORDER ends before it
    s = np.full(int((lens + ORDER + 1).sum()), END, np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    s[np.arange(len(data)) + np.repeat(first - (np.cumsum(lens) - lens), lens)] = data
    code = s[ORDER:].copy()
    for k in range(1, ORDER + 1):
        code += s[ORDER - k : len(s) - k] * SYMBOLS ** (ORDER + 1 - k)
    own = np.ones(len(s), bool)
    for k in range(1, ORDER + 1):
        own[first - k] = False  # the ends before a text are not predicted
    return code[own[ORDER:]]


def cut(code: np.ndarray, k: int, order: int = ORDER) -> np.ndarray:
    """The numbers of the same symbols after the last k symbols of their contexts, which had ``order``."""
    return code // SYMBOLS ** (order - k + 1) * SYMBOLS + code % SYMBOLS


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of some counted ones, sorted, and their sums."""
    codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def bucket_count(size: int) -> int:
    """Buckets for a corpus of so many bytes."""
    return max(64, min(BUCKETS, -(-size // BUCKET_BYTES)))


def dealt(code: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a number: by the root of its subtree."""
    return (mix((code // SYMBOLS ** (ORDER - DEALT + 1)).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted codes, and whether they are there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def logs(asked: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 probabilities of the symbols asked for; levels: the counted trie by the length of contexts, 0 first."""
    p, below = np.full(len(asked), 1 / SYMBOLS), None
    for k, (code, n) in enumerate(levels):
        if not len(code):
            break
        contexts, where, kinds = np.unique(code // SYMBOLS, return_inverse=True, return_counts=True)
        free = np.where(kinds == SYMBOLS, 0, kinds)
        total = np.bincount(where, n) + free
        mass = np.bincount(where, np.full(len(code), 1 / SYMBOLS) if below is None else below[1][np.searchsorted(below[0], cut(code, k - 1, k))])
        escape = free / total / np.maximum(1 - mass, 1e-12)
        own, want = n / total[where], cut(asked, k)
        at, known = find(contexts, want // SYMBOLS)
        p = np.where(known, p * escape[at], p)
        at, known = find(code, want)
        p = np.where(known, own[at], p)
        below = code, own
    return np.log10(np.maximum(p, 1e-300))


def adaptive(text: bytes, order: int = ORDER) -> float:
    """log10 probability of a text by a model that starts empty and learns from each symbol after coding it."""
    counts: dict[tuple, dict[int, int]] = {}
    past: tuple[int, ...] = (END,) * order
    total = 0.0
    for symbol in [*text, END]:
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            seen = {s: c for s, c in counts.get(past[order - k :], {}).items() if s not in excluded}
            if not seen:
                continue
            weight = sum(seen.values()) + len(seen)
            if symbol in seen:
                total += math.log10(seen[symbol] / weight)
                break
            total += math.log10(len(seen) / weight)
            excluded |= set(seen)
        else:
            total -= math.log10(SYMBOLS - len(excluded))
        for k in range(order + 1):
            node = counts.setdefault(past[order - k :], {})
            node[symbol] = node.get(symbol, 0) + 1
        past = (*past[1:], symbol) if order else ()
    return total


WORDS, DOCS, GRAMS, TOP = 0, 1, 2, 3


def squeeze(x: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    raw = x.astype("<i8").view(np.uint8).reshape(-1, 8)
    return zstandard.compress(np.ascontiguousarray(raw.T).tobytes(), 1)


def expand(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(body), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def parted(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket, and each bucket with where it begins and ends in it."""
    order = np.argsort(keys, kind="stable")
    cuts = np.searchsorted(keys[order], np.arange(buckets + 1)).tolist()
    return order, [(b, x, y) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]


def gather(docs: DataFrame, kind: str, buckets: int) -> DataFrame:
    """One pass over docs (id, text, train): words and n-grams for the buckets, texts of the blocks.

    Buckets of n-grams are numbered behind those of words; the top of the trie has no bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        id_type = None
        block: dict = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        top: list[tuple[np.ndarray, np.ndarray]] = []

        def rows(kind, block, bucket, body, extra, ids=None):
            n = len(body)
            return pa.record_batch(
                [pa.array([kind] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.array(bucket, pa.int32()), pa.array(body, pa.binary()), pa.array(extra, pa.binary()), pa.array([ids] * n, pa.list_(id_type))],
                ["kind", "block", "bucket", "body", "extra", "ids"],
            )

        def packed(kind, code, n, bucket, first):
            order, some = parted(bucket, buckets)
            code, n = code[order], n[order]
            return rows(kind, number, [first + b for b, _, _ in some], [squeeze(np.diff(code[x:y], prepend=0)) for _, x, y in some], [squeeze(n[x:y]) for _, x, y in some])

        def close():
            hashes, lens = np.concatenate(block["hashes"]), np.concatenate(block["lens"])
            train = np.repeat(np.concatenate(block["train"]), lens)
            known, where = np.unique(hashes, return_inverse=True)
            yield packed(WORDS, known.view(np.int64), np.bincount(where[train], minlength=len(known)), word_bucket(known, buckets), 0)
            code, n = added(held)
            held.clear()
            yield packed(GRAMS, code, n, dealt(code, buckets), buckets)
            top[:] = [added([*top, (cut(code[n > 0], DEALT - 1), n[n > 0])])]
            texts = block["texts"]
            yield rows(DOCS, number, [-1], [zstandard.compress(b"".join(texts), 3)], [squeeze(np.fromiter(map(len, texts), np.int64, len(texts)))], block["ids"])

        for batch in slices(batches, PART):
            id_type = batch.schema.field("id").type
            texts, train = text_bytes(batch), batch.column("train").to_numpy(zero_copy_only=False)
            hashes, lens = word_hashes(*joined(texts), fold=True)
            if not block:
                block |= {"hashes": [], "lens": [], "train": [], "ids": [], "texts": [], "bytes": 0}
            for name, x in (("hashes", hashes), ("lens", lens), ("train", train)):
                block[name].append(x)
            block["ids"] += batch.column("id").to_pylist()
            block["texts"] += texts
            block["bytes"] += sum(map(len, texts))
            for learn in (True, False):
                some = [t for t, yes in zip(texts, train.tolist(), strict=True) if yes == learn]
                if some:
                    code, n = np.unique(codes(some), return_counts=True)
                    held.append((code, n * learn))
            if len(held) > 1 and sum(len(c) for c, _ in held) > HELD:
                held[:] = [added(held)]
            if block["bytes"] > BLOCK_BYTES:
                yield from close()
                block.clear()
                number += 1
        if block:
            yield from close()
            block.clear()
        if top:
            yield rows(TOP, -1, [-1], [squeeze(top[0][0])], [squeeze(top[0][1])])
        top.clear()
        trim()

    return written(docs.mapInArrow(run, f"kind int, block long, bucket int, body binary, extra binary, ids array<{kind}>"), "gathered")


def word_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of words, ascending with their (unsigned) hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def trie_top(gathered: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The trie above depth DEALT, by the length of contexts."""

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, extra in zip(batch.column("body").to_pylist(), batch.column("extra").to_pylist(), strict=True):
                yield pa.record_batch({"code": expand(body), "n": expand(extra)})

    sums = gathered.where(F.col("kind") == TOP).select("body", "extra").mapInArrow(expanded, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = sums["code"].to_numpy().astype(np.int64), sums["n"].to_numpy().astype(np.int64)
    return [added([(cut(code, k, DEALT - 1), n)]) for k in range(DEALT)]


MODEL = "bucket int, block long, body binary, extra binary, tokens long, kinds long"


def model(gathered: DataFrame, buckets: int, parts: int) -> DataFrame:
    """One row for each bucket: its sorted codes, and what it answers to each: counts of words, logarithms of n-grams; totals of words."""
    sent = gathered.sparkSession.sparkContext.broadcast(trie_top(gathered))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            code, n = added(pending)
            if at < buckets:
                sums, value = (int(n.sum()), int((n > 0).sum())), n
            else:
                seen = code[n > 0], n[n > 0]
                below = [added([(cut(seen[0], k), seen[1])]) for k in range(DEALT, ORDER)]
                sums, value = (0, 0), np.round(-STEPS * logs(code, [*sent.value, *below, seen])).astype(np.int64)
            row = at, -1, code.astype("<i8").tobytes(), value.astype("<i8").tobytes(), *sums
            types = pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["bucket", "block", "body", "extra", "tokens", "kinds"])

        for batch in batches:
            for bucket, body, extra in zip(*(batch.column(c).to_pylist() for c in ("bucket", "body", "extra")), strict=True):
                if bucket != at:
                    if pending:
                        yield close()
                    at, pending, size = bucket, [], 0
                pending.append((np.cumsum(expand(body)), expand(extra)))
                size += len(pending[-1][0])
                if len(pending) > 1 and size > max(HELD, 2 * len(pending[0][0])):
                    pending[:] = [added(pending)]
                    size = len(pending[0][0])
        if pending:
            yield close()
        pending.clear()
        trim()

    sums = gathered.where(F.col("kind").isin(WORDS, GRAMS)).select("bucket", "body", "extra")
    return written(sums.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, MODEL), "model")


def answers(gathered: DataFrame, known: DataFrame, parts: int) -> DataFrame:
    """Each bucket's answer to every block (block, bucket, body), in the order of the codes sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = value = None
        for batch in batches:
            out: list[tuple] = []
            for bucket, block, body, extra in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "body", "extra")), strict=True):
                if block < 0:  # the model comes first
                    code, value = np.frombuffer(body, "<i8"), np.frombuffer(extra, "<i8")
                else:
                    out.append((block, bucket, squeeze(value[np.searchsorted(code, np.cumsum(expand(body)))])))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["block", "bucket", "body"])
        trim()

    asked = gathered.where(F.col("kind").isin(WORDS, GRAMS)).select("bucket", "block", "body", F.lit(None).cast("binary").alias("extra"))
    both = known.select("bucket", "block", "body", "extra").unionByName(asked)
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, "block long, bucket int, body binary")


def scores(texts: list[bytes], replies: np.ndarray, buckets: int) -> np.ndarray:
    """The score of each text of a block, from the buckets' answers to its n-grams."""
    parts, some, size = [], [], 0
    for i, text in enumerate(texts):
        some.append(text)
        size += len(text)
        if size > PART or i == len(texts) - 1:
            own, where = np.unique(codes(some), return_inverse=True)
            parts.append((own, where.astype(np.int32), np.cumsum([0, *(len(x) + 1 for x in some[:-1])])))
            some, size = [], 0
    known = np.unique(np.concatenate([own for own, _, _ in parts]))
    log = np.empty(len(known), np.int64)
    log[parted(dealt(known, buckets), buckets)[0]] = replies
    high, low = (  # two sums a text, as one of whole steps overflows on a very long text
        np.concatenate([np.add.reduceat(x[np.searchsorted(known, own)][where], first) for own, where, first in parts]) for x in (log >> HALF, log & (1 << HALF) - 1)
    )
    return (high * float(1 << HALF) + low) / -STEPS


@tidy
def language_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = spark.range(0).select(F.col("id").cast(kind)).toArrow().schema.field("id").type
    train = crc_mod(F.col(id_col), folds) != fold
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), train.alias("train"))
    n_train, size = docs.agg(F.count_if("train"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets, parts = bucket_count(size), max(width(spark), min(10_000, -(-size // BUCKET_BYTES)))
    gathered = gather(docs, kind, buckets)
    known = model(gathered, buckets, parts)
    tokens, kinds = known.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    tokens, kinds = tokens + n_train, kinds + (n_train > 0)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("id", "n_tokens", "n_known", "base_score", "score")}
        back = sorted(zip(right["bucket"].to_pylist(), right["body"].to_pylist(), strict=True))
        counts, replies = (np.concatenate([np.empty(0, np.int64), *(expand(x) for b, x in back if (b < buckets) == words)]) for words in (True, False))
        for row in left.to_pylist():
            data, ends = zstandard.decompress(row["body"]), np.cumsum(expand(row["extra"])).tolist()
            texts = [data[x:y] for x, y in zip([0, *ends], ends, strict=False)]
            hashes, lens = word_hashes(*joined(texts), fold=True)
            c = counts[np.unique(hashes, return_inverse=True)[1]]
            cuts = np.concatenate(([0], np.cumsum(lens)))
            sums, seen = (np.concatenate(([0], np.cumsum(x))) for x in (np.log10(c + 1.0), (c > 0).astype(np.int64)))
            n = lens + 1
            out["id"] += row["ids"]
            out["n_tokens"].append(n)
            out["n_known"].append(seen[cuts[1:]] - seen[cuts[:-1]] + (n_train > 0))
            out["base_score"].append(sums[cuts[1:]] - sums[cuts[:-1]] + math.log10(n_train + 1.0) - n * math.log10(tokens + kinds + 1.0))
            out["score"].append(scores(texts, replies, buckets))
        join = lambda c, t: np.concatenate([np.empty(0, t), *out[c]]).astype(t)
        trim()
        return pa.table({"id": pa.array(out["id"], id_type), "n_tokens": join("n_tokens", np.int64), "n_known": join("n_known", np.int64), "base_score": join("base_score", np.float64), "score": join("score", np.float64)})

    blocks = gathered.where(F.col("kind") == DOCS).select("block", "body", "extra", "ids")
    rows = blocks.groupBy("block").cogroup(answers(gathered, known, parts).groupBy("block")).applyInArrow(score, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return rows.select(F.col("id").alias(id_col), (crc_mod(F.col("id"), folds) == fold).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
