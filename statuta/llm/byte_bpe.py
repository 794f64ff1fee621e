"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

1. Each block of documents (bounded text) lists its pre-tokens by position and its distinct pre-tokens. A block
   sends each distinct pre-token, once, to the bucket of its hash: packed, one message per block and bucket.
2. A bucket encodes each distinct pre-token once, whatever number of blocks sent it, and answers the blocks, message by
   message, with the ids in their order. It holds its own distinct pre-tokens, up to KNOWN (in a bucket with more, some are
   encoded again), and one batch of messages. How many buckets there are follows from the size of the corpus, up to BUCKETS:
   a block sends at most that many messages, so their number grows as the number of blocks does.
3. Answers and position lists, which took the same way, meet by block; documents are put together by position. Decoding
   joins the ids of each distinct pre-token of a block with the token-byte table, whose size the vocabulary fixes.

A frequent word takes one entry per block, so no key is hot. Blocks carry a fingerprint of their words: should a
recomputed block list them otherwise, the job fails instead of mixing up ids; documents read from files, or from a
written table, are listed alike each time.

Defined results: null text is empty; empty text has no ids; a very long text is split whole, and its block is the
larger; repeated rows each give a row; ties do not arise; other columns, whatever their names, are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import prepare, trim, width

#: Text bytes after which a block is closed.
BLOCK_BYTES = 16_000_000
#: Text bytes of the corpus for each bucket.
BUCKET_BYTES = 250_000_000
#: The most buckets, and the most pre-tokens whose ids a bucket holds.
BUCKETS, KNOWN = 4096, 2_000_000
#: A pre-token never reaches across the start of a run of white space, so these pieces are split one by one.
PIECES = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
#: White space outside that class: such texts are split whole.
ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Separates words in a message; no UTF-8 text has this byte.
BREAK = b"\xff"
#: Entries of a block's cache of split pieces.
CACHE = 500_000


class Index(dict):
    """Numbers for things in order of appearance."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Splitter(dict):
    """Piece of text to the numbers of its pre-tokens."""

    def __init__(self, pattern: str):
        super().__init__()
        self.words, self.find = Index(), regex.compile(pattern).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > CACHE:
            self.clear()
        got = self[piece] = tuple(map(self.words.__getitem__, self.find(piece)))
        return got

    def split(self, text: str) -> np.ndarray:
        if ODD.search(text):
            return np.fromiter(map(self.words.__getitem__, self.find(text)), np.int32)
        return np.fromiter(chain.from_iterable(map(self.__getitem__, PIECES.findall(text))), np.int32)


def pack(words: list[bytes]) -> bytes:
    return zstandard.compress(BREAK.join(words), 3)


def unpack(body: bytes) -> list[bytes]:
    return zstandard.decompress(body).split(BREAK)


class Block:
    def __init__(self, pattern: str):
        self.splitter, self.ids, self.parts, self.bytes = Splitter(pattern), [], [], 0

    def add(self, doc_id, text: str | None) -> None:
        self.ids.append(doc_id)
        self.parts.append(self.splitter.split(text) if text else np.empty(0, np.int32))
        self.bytes += len(text or "")

    def close(self, buckets: int) -> tuple[bytes, np.ndarray, list[bytes], np.ndarray]:
        """Fingerprint, bucket of each word, words, all positions; words by falling frequency."""
        everything = np.concatenate(self.parts) if self.parts else np.empty(0, np.int32)
        words = [w.encode("utf-8", "surrogatepass") for w in self.splitter.words]
        order = np.argsort(-np.bincount(everything, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        words = [words[i] for i in order.tolist()]
        bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets
        mark = hashlib.blake2b(BREAK.join(words), digest_size=8).digest()
        return mark, bucket.astype(np.int32), words, rank[everything] if len(words) else everything


def planes(x: np.ndarray) -> bytes:
    """Small integers, compressed: under 240 a byte each; under 2**20 that byte says the high bits and two planes
    have the rest; larger ones take four byte planes."""
    if len(x) and int(x.max()) >= 1 << 20:
        raw = x.astype("<u4").view(np.uint8).reshape(-1, 4)
        parts = [b"", b"", np.ascontiguousarray(raw.T).tobytes()]
    else:
        rest = x[x >= 240]
        head = np.where(x < 240, x, 240 + (x >> 16)).astype(np.uint8)
        parts = [head.tobytes(), (rest & 255).astype(np.uint8).tobytes() + (rest >> 8 & 255).astype(np.uint8).tobytes(), b""]
    packed = [zstandard.compress(p, 3) for p in parts]
    return b"".join([*(len(p).to_bytes(8, "little") for p in packed), *packed])


def unplanes(body: bytes) -> np.ndarray:
    sizes, at, parts = [int.from_bytes(body[k : k + 8], "little") for k in (0, 8, 16)], 24, []
    for n in sizes:
        parts.append(np.frombuffer(zstandard.decompress(body[at : at + n]), np.uint8))
        at += n
    if len(parts[2]):
        return np.ascontiguousarray(parts[2].reshape(4, -1).T).view("<u4").ravel()
    out, (low, high) = parts[0].astype(np.uint32), parts[1].reshape(2, -1).astype(np.uint32)
    wide = np.flatnonzero(out >= 240)
    out[wide] = (out[wide] - 240 << 16) + (high << 8) + low
    return out


#: What travels: messages to buckets and their answers (bucket from 0), and the position lists of blocks, which
#: pass the buckets' tasks unchanged on their way (bucket below 0), so that each text is split only once.
ROW = "block long, mark binary, bucket int, body binary, ids array<{kind}>, lens binary, buckets binary"


def _blocks(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, pattern: str) -> Iterator[tuple[int, Block]]:
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 24
    block = Block(pattern)
    for batch in batches:
        for doc_id, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist(), strict=True):
            block.add(doc_id, text)
            if block.bytes > BLOCK_BYTES:
                yield first, block
                first, block = first + 1, Block(pattern)
    if block.ids:
        yield first, block


def bucket_count(size: int) -> int:
    """Buckets for a corpus of so many bytes."""
    return max(64, min(BUCKETS, -(-size // BUCKET_BYTES)))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_ENCODERS: dict[tuple, tuple[tiktoken.Encoding, TokenBytes]] = {}


class TokenBytes:
    """The token-byte table: the bytes of all tokens, one after the other, by id."""

    def __init__(self, ranks: dict[bytes, int]):
        of = {i: t for t, i in ranks.items()}
        tokens = [of.get(i, b"") for i in range(max(of) + 1)]
        self.lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts, self.data = np.cumsum(self.lens) - self.lens, np.frombuffer(b"".join(tokens), np.uint8)

    def join(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of sequences of ids that lie one after the other, of these lengths."""
        own = self.lens[ids]
        ends = np.cumsum(own)
        data = self.data[np.repeat(self.starts[ids] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [data[x:y] for x, y in zip(edges, edges[1:], strict=False)]


def encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, TokenBytes]:
    """The worker's own encoder and token-byte table, also for later tasks."""
    if (path, pattern) not in _ENCODERS:
        ranks = load_ranks(path)
        _ENCODERS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), TokenBytes(ranks)
    return _ENCODERS[path, pattern]


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None, digests: bool = True) -> DataFrame:
    """One row per document: its id, n_tokens, and the ids and decoded bytes.

    With ``digests`` the latter are ids_sha256 and decoded_sha256 (of little-endian 32-bit ids and of the bytes),
    else token_ids (array of int) and decoded (binary).
    """
    spark = docs.sparkSession
    prepare(spark)
    path, pattern = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    docs = docs.select(id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = pa.list_(docs.limit(0).toArrow().schema.field(id_col).type)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    buckets, parts = bucket_count(size), max(width(spark), min(10_000, -(-size // BUCKET_BYTES)))

    def rows(block: int, mark: bytes, bucket: list[int], body: list[bytes], ids=None, lens=None, bucket_of=None) -> pa.RecordBatch:
        n = len(bucket)
        same = lambda x, t: pa.array([x] * n, t)
        return pa.record_batch(
            [same(block, pa.int64()), same(mark, pa.binary()), pa.array(bucket, pa.int32()), pa.array(body, pa.binary()), same(ids, id_type), same(lens, pa.binary()), same(bucket_of, pa.binary())],
            ["block", "mark", "bucket", "body", "ids", "lens", "buckets"],
        )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches, id_col, text_col, pattern):
            mark, bucket, words, positions = block.close(buckets)
            groups: dict[int, list[bytes]] = {}
            for b, w in zip(bucket.tolist(), words, strict=True):
                groups.setdefault(b, []).append(w)
            yield rows(number, mark, list(groups), [pack(g) for g in groups.values()])
            lens = np.fromiter(map(len, block.parts), "<i8").tobytes()
            yield rows(number, mark, [-1 - zlib.crc32(number.to_bytes(8, "little")) % buckets], [planes(positions)], block.ids, lens, planes(bucket))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at = encoder(path, pattern)[0], None
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            out: list[bytes] = []
            for bucket, body in zip(batch.column("bucket").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if bucket < 0:  # a position list
                    out.append(body)
                    continue
                if bucket != at:
                    at = bucket
                    known.clear()
                words = unpack(body)
                if len(known) + len(words) > KNOWN:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = np.array(enc._encode_single_piece(w), "<u4")
                got = [known[w] for w in words]
                lens = np.fromiter(map(len, got), "<u4", len(got))
                out.append(len(got).to_bytes(8, "little") + zstandard.compress(lens.tobytes() + np.concatenate(got).tobytes(), 3))
            yield batch.set_column(3, "body", pa.array(out, pa.binary()))
        trim()

    def rebuild(table: pa.Table) -> pa.Table:
        lists = pc.less(table["bucket"], 0)
        left, right = table.filter(lists), table.filter(pc.invert(lists))
        table_of = encoder(path, pattern)[1]
        answers = {b: (m, x) for b, m, x in zip(right["bucket"].to_pylist(), right["mark"].to_pylist(), right["body"].to_pylist(), strict=True)}
        columns: dict[str, list] = {"id": [], "n": [], "a": [], "b": []}
        for row in left.to_pylist():
            bucket = unplanes(row["buckets"])
            ids, texts = [b""] * len(bucket), [b""] * len(bucket)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.unique(bucket))
            for at, b in zip(edges.tolist(), np.unique(bucket).tolist(), strict=True):
                mark, body = answers[b]
                if mark != row["mark"]:
                    raise ValueError("a block was recomputed with other words")
                n = int.from_bytes(body[:8], "little")
                raw = np.frombuffer(zstandard.decompress(body[8:]), "<u4")
                data, ends = raw[n:].tobytes(), (np.cumsum(raw[:n]) * 4).tolist()
                begin = 0
                for word, end, spelled in zip(order[at : at + n].tolist(), ends, table_of.join(raw[n:], raw[:n].astype(np.int64)), strict=True):
                    ids[word], texts[word] = data[begin:end], spelled
                    begin = end
            positions, at = unplanes(row["body"]), 0
            for doc_id, n in zip(row["ids"], np.frombuffer(row["lens"], "<i8").tolist(), strict=True):
                own = positions[at : at + n].tolist()
                at += n
                a, b = b"".join(map(ids.__getitem__, own)), b"".join(map(texts.__getitem__, own))
                columns["id"].append(doc_id)
                columns["n"].append(len(a) // 4)
                columns["a"].append(hashlib.sha256(a).hexdigest() if digests else np.frombuffer(a, "<u4").astype(np.int32))
                columns["b"].append(hashlib.sha256(b).hexdigest() if digests else b)
        kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
        return pa.table([pa.array(columns["id"], id_type.value_type), pa.array(columns["n"], pa.int64()), pa.array(columns["a"], kinds[0]), pa.array(columns["b"], kinds[1])], names)

    names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("token_ids", "decoded"))]
    shape = f"`{id_col}` {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "token_ids array<int>, decoded binary")
    row = ROW.format(kind=kind)
    answered = docs.mapInArrow(split, row).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, row)
    return answered.groupBy("block").applyInArrow(rebuild, shape)
