"""Token ids as wavelet matrices: one compressed file per shard, with access, rank, select and counting.

Documents are ranged by id, each text is encoded and ended by the end id, and every shard of bounded length is
written as one file: the documents' ids and lengths, then one bit-plane per bit of the largest id, each with its
number of zeros and cumulative counts of ones for rank and select. A shard is complete in its file, so any
reader can look up single tokens, count an id or find its occurrences without the other shards.

The file is written under a name of its own and then renamed, so a task that runs twice leaves one whole file.
Files whose task did not end up in the manifest are ignored.

Defined results: null text is empty and has the end id alone; a very long text is one document of a shard that may be
longer for it; repeated rows follow each other, ordered by id, then text (ties are equal rows); a null id sorts first;
other columns, whatever their names, are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.llm.common import joined, prepare, scratch, slices, span_hashes, text_bytes, width, word_spans, written

MAGIC = b"WVMX0001"
#: Tokens after which a shard is closed, bytes of a plane for each sampled count, words that a worker keeps.
SHARD_TOKENS, SAMPLE, CACHE = 4_000_000, 64, 4_000_000
#: Tokens of a piece: its planes are built in the processor's cache.
PIECE_TOKENS = 1 << 19
#: Texts that show whether a tokenizer works word by word.
PROBES = ["a b", "Some words, and some more. And  MORE\n\twords.", " led by space ", "Straße, naïve café; it's 3.14 (or so)", "x.,.,", "A a A.a", "the theory of the, other. other,others", "e\u0301 \u00e9"]


class WaveletMatrix:
    """A sequence of non-negative integers as bit-planes, the highest bit first."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray]):
        self.n, self.zeros, self.planes = n, zeros, planes
        self.samples = [np.concatenate(([0], np.cumsum(np.add.reduceat(np.bitwise_count(p).astype(np.int64), np.arange(0, len(p), SAMPLE))))) if len(p) else np.zeros(1, np.int64) for p in planes]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes = [], []
        for k in range(bits - 1, -1, -1):
            ones = (now & now.dtype.type(1 << k)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            left = np.compress(~ones, now)
            zeros.append(len(left))
            now = np.concatenate((left, np.compress(ones, now)))
        return cls(len(ids), zeros, planes)

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3]) >> (i & 7) & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        whole, rest = i >> 3, i & 7
        block = whole // SAMPLE
        n = int(self.samples[k][block]) + int(np.bitwise_count(self.planes[k][block * SAMPLE : whole]).sum())
        return n + (int(self.planes[k][whole]) & ((1 << rest) - 1)).bit_count() if rest else n

    def access(self, i: int) -> int:
        value = 0
        for k, z in enumerate(self.zeros):
            bit = self._bit(k, i)
            i = z + self._ones(k, i) if bit else i - self._ones(k, i)
            value = value << 1 | bit
        return value

    def _span(self, value: int, end: int) -> tuple[int, int]:
        if value >> len(self.planes):
            return 0, 0
        begin = 0
        for k, z in enumerate(self.zeros):
            if value >> (len(self.planes) - 1 - k) & 1:
                begin, end = z + self._ones(k, begin), z + self._ones(k, end)
            else:
                begin, end = begin - self._ones(k, begin), end - self._ones(k, end)
        return begin, end

    def rank(self, value: int, i: int) -> int:
        """How often value stands among the first i."""
        begin, end = self._span(value, i)
        return end - begin

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, nth: int) -> int:
        """Where value stands for the nth time, from 0; -1 if it does not."""
        begin, end = self._span(value, self.n)
        if not 0 <= nth < end - begin:
            return -1
        i = begin + nth
        for k in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - k) & 1
            i = self._find(k, bit, i - self.zeros[k] if bit else i)
        return i

    def _find(self, k: int, bit: int, nth: int) -> int:
        lo, hi = 0, self.n
        while lo < hi:  # the last place with nth such bits before it
            mid = (lo + hi) // 2
            ones = self._ones(k, mid + 1)
            if (ones if bit else mid + 1 - ones) <= nth:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def occurrences(self, value: int) -> Iterator[int]:
        return (self.select(value, k) for k in range(self.count(value)))

    def tokens(self) -> np.ndarray:
        """The whole sequence."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            now[self.zeros[k] :] |= now.dtype.type(1 << (len(self.planes) - 1 - k))
            back = np.empty_like(now)
            back[np.concatenate((np.flatnonzero(~ones), np.flatnonzero(ones)))] = now
            now = back
        return now


class Shard:
    """Wavelet matrices of successive pieces of one sequence, with the same questions."""

    def __init__(self, pieces: list[WaveletMatrix]):
        self.pieces = pieces
        self.starts = np.cumsum([0, *(p.n for p in pieces)]).tolist()
        self.n = self.starts[-1]

    @classmethod
    def build(cls, ids: np.ndarray) -> Shard:
        return cls([WaveletMatrix.build(ids[i : i + PIECE_TOKENS]) for i in range(0, len(ids), PIECE_TOKENS)])

    def access(self, i: int) -> int:
        k = bisect_right(self.starts, i) - 1
        return self.pieces[k].access(i - self.starts[k])

    def rank(self, value: int, i: int) -> int:
        return sum(p.rank(value, min(i - s, p.n)) for p, s in zip(self.pieces, self.starts, strict=False) if i > s)

    def count(self, value: int) -> int:
        return sum(p.count(value) for p in self.pieces)

    def select(self, value: int, nth: int) -> int:
        for p, s in zip(self.pieces, self.starts, strict=False):
            n = p.count(value)
            if 0 <= nth < n:
                return s + p.select(value, nth)
            nth -= n
        return -1

    def occurrences(self, value: int) -> Iterator[int]:
        return (s + i for p, s in zip(self.pieces, self.starts, strict=False) for i in p.occurrences(value))

    def tokens(self) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint32), *(p.tokens() for p in self.pieces)])


def dump(shard: Shard, header: dict) -> bytes:
    """A file: magic, length of the header, header (JSON), then each plane of each piece, all parts compressed."""
    parts = [[zstandard.compress(x.tobytes(), 1) for x in p.planes] for p in shard.pieces]
    pieces = [{"n": p.n, "zeros": p.zeros, "sizes": list(map(len, own))} for p, own in zip(shard.pieces, parts, strict=True)]
    head = zstandard.compress(json.dumps(header | {"pieces": pieces}).encode(), 3)
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *(x for own in parts for x in own)])


def load(data: bytes) -> tuple[Shard, dict]:
    if data[:8] != MAGIC:
        raise ValueError("not a shard")
    at = 16 + int.from_bytes(data[8:16], "little")
    head = json.loads(zstandard.decompress(data[16:at]))
    pieces = []
    for piece in head["pieces"]:
        planes = []
        for n in piece["sizes"]:
            planes.append(np.frombuffer(zstandard.decompress(data[at : at + n]), np.uint8))
            at += n
        pieces.append(WaveletMatrix(piece["n"], piece["zeros"], planes))
    return Shard(pieces), head


def spread(flat: np.ndarray, lens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences numbered ``at``, one after the other, of sequences that lie one after the other; their lengths."""
    starts, own = np.cumsum(lens) - lens, lens[at]
    ends = np.cumsum(own)
    return flat[np.repeat(starts[at] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)], own


class WordIds:
    """Ids of words, each encoded once while a worker keeps it; sorted arrays by the word's hash, no objects. A second,
    independent hash stands beside each; a word that agrees in the first alone is encoded on its own.

    That is only for tokenizers that part letters from the marks behind them, keep no case and never reach across white
    space, which is tried on PROBES; any other one encodes whole texts. At CACHE words it starts anew."""

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.end = Tokenizer.from_file(path), end
        special = [(i, t.content) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.border = special[-1] if special else None
        self.reset()
        whole = [x.ids for x in self.tokenizer.encode_batch(PROBES, add_special_tokens=False)]
        self.by_word = True
        self.by_word = [self.encode([x.encode()])[0][:-1].tolist() for x in PROBES] == whole
        self.reset()

    def reset(self) -> None:
        self.keys, self.checks, self.starts, self.lens = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.flat = np.array([self.end], np.uint32)

    def lookup(self, words: list[str]) -> list[np.ndarray]:
        """Ids of some words; many in one call, parted by a special token, which ends any word."""
        many = [i for i, w in enumerate(words) if self.border and "<|" not in w and self.border[1] not in w]
        lone = sorted(set(range(len(words))).difference(many)) if len(many) < len(words) else []
        got: list = [None] * len(words)
        if many:
            border, mark = self.border
            packs = [mark.join([words[i] for i in many[k : k + 500]]) for k in range(0, len(many), 500)]
            flat: list[int] = []
            for x in self.tokenizer.encode_batch_fast(packs, add_special_tokens=False):
                flat += x.ids
                flat.append(border)
            ids = np.array(flat, np.uint32)
            cuts = np.flatnonzero(ids == border).tolist()
            for i, a, b in zip(many, [-1, *cuts], cuts, strict=False):
                got[i] = ids[a + 1 : b]
        for i, x in zip(lone, self.tokenizer.encode_batch([words[i] for i in lone], add_special_tokens=False), strict=True):
            got[i] = np.array(x.ids, np.uint32)
        return got

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words, one after the other, and how many each has. Letters and the marks behind them are encoded
        apart, so that of a word before a full stop and before a comma only one is."""
        stems: dict[str, int] = {}
        pairs = []
        for word in words:
            text = word.decode("utf-8", "replace")
            stem = text.rstrip(".,")
            if stem is not text and not stem.isalpha():
                stem = text
            if stem.isascii() and stem.isalpha():
                pairs += (stems.setdefault(stem.lower(), len(stems)), stems.setdefault(text[len(stem) :], len(stems)))
            else:
                pairs += (stems.setdefault(stem, len(stems)), stems.setdefault(text[len(stem) :], len(stems)))
        got = self.lookup(list(stems))
        flat, lens = spread(np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got)), np.array(pairs))
        return flat, lens.reshape(-1, 2).sum(axis=1)

    def learn(self, keys: np.ndarray, checks: np.ndarray, words: list[bytes]) -> None:
        """Keep new words; keys are their hashes, ascending."""
        flat, lens = self.encoded(words)
        at = np.searchsorted(self.keys, keys)
        self.starts = np.insert(self.starts, at, len(self.flat) + np.cumsum(lens) - lens)
        self.lens = np.insert(self.lens, at, lens.astype(np.int32))
        self.keys, self.checks, self.flat = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks), np.concatenate((self.flat, flat))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each ended, and how many each text has."""
        if not self.by_word:
            got = [[*x.ids, self.end] for x in self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.uint32), np.array(list(map(len, got)), np.int64)
        data, ends = joined(texts)
        hashes, counts, begins, stops = word_spans(data, ends, fold=False)
        checks = span_hashes(data, begins, stops, 1)
        order = np.argsort(hashes)
        ranked = hashes[order]
        fresh = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, bool)
        keys, first = ranked[fresh], order[fresh]
        group = np.empty(len(hashes), np.int64)
        group[order] = np.cumsum(fresh) - 1
        if len(self.keys) + len(keys) > CACHE:
            self.reset()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        raw = data.tobytes()
        words = lambda some: [raw[a:b] for a, b in zip(begins[some].tolist(), stops[some].tolist(), strict=True)]
        if new.any():
            self.learn(keys[new], checks[first[new]], words(first[new]))
            at = np.searchsorted(self.keys, keys)
        starts, lens, flat = self.starts[at].take(group), self.lens[at].astype(np.int64).take(group), self.flat
        other = np.flatnonzero(self.checks[at].take(group) != checks)
        if len(other):
            own, lens[other] = self.encoded(words(other))
            starts[other] = len(flat) + np.cumsum(lens[other]) - lens[other]
            flat = np.concatenate((flat, own))
        last = np.cumsum(counts)
        starts, lens = np.insert(starts, last, 0), np.insert(lens, last, 1)
        cuts = np.cumsum(lens)
        ids = flat.take(np.repeat(starts - cuts + lens, lens) + np.arange(cuts[-1]))
        return ids, np.diff(cuts[np.cumsum(counts + 1) - 1], prepend=0)


def _put(path: str, data: bytes) -> None:
    """Write a file whole: under another name first, then renamed."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(f"file://{path[5:]}" if path.startswith("file:/") and path[5:7] != "//" else path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(aside := f"{at.rpartition('/')[0]}/.{uuid.uuid4().hex}") as out:
        out.write(data)
    store.move(aside, at)


_WORDS: dict[tuple, WordIds] = {}


def kept(path: str, end: int) -> WordIds:
    """The worker's own, also for later tasks. (What a nested function refers to by name is copied for each task.)"""
    if (path, end) not in _WORDS:
        _WORDS[path, end] = WordIds(path, end)
    return _WORDS[path, end]


def write_shards(docs: DataFrame, to: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards of all documents in ascending order of id. Returns the manifest: part, shard, n_docs, n_tokens."""
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    folder = spark._jvm.org.apache.hadoop.fs.Path(to)  # a path without a scheme is in Spark's own file system, on executors too
    to = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    ranged = docs.select(id_col, text_col).repartitionByRange(width(spark), id_col).sortWithinPartitions(id_col, text_col)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = kept(path, end), TaskContext.get().partitionId()
        shard, ids, counts, tokens, total = 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            matrix = Shard.build(np.concatenate(tokens))
            _put(f"{to}/{part:06d}-{shard:06d}.wvm", dump(matrix, {"part": part, "shard": shard, "ids": ids, "counts": counts}))
            return pa.record_batch([pa.array([x], pa.int64()) for x in (part, shard, len(ids), matrix.n)], ["part", "shard", "n_docs", "n_tokens"])

        for batch in slices(batches, 4_000_000, text_col):
            got, lens = encoder.encode(text_bytes(batch, text_col))
            ids += batch.column(id_col).to_pylist()
            counts += lens.tolist()
            tokens.append(got)
            total += len(got)
            if total > shard_tokens:
                yield close()
                shard, ids, counts, tokens, total = shard + 1, [], [], [], 0
        if ids:
            yield close()

    return written(ranged.mapInArrow(write, "part long, shard long, n_docs long, n_tokens long"), "manifest")


def read_shards(spark: SparkSession, at: str, manifest: DataFrame, id_col: str = "doc_id", id_type: str = "long") -> DataFrame:
    """One row per document of the shards in the manifest: id, start, n_tokens, ids_crc32."""
    arrow_type = spark.range(0).select(F.col("id").cast(id_type).alias("id")).toArrow().schema.field("id").type

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                matrix, head = load(data.as_py())
                ids, n = matrix.tokens().astype("<u4"), np.array(head["counts"], np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[e - k : e].data) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                same = [pa.array([head[k]] * len(n), pa.int64()) for k in ("part", "shard")]
                yield pa.record_batch([*same, pa.array(head["ids"], arrow_type), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], ["part", "shard", "id", "inside", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(at).select("content")
    rows = files.mapInArrow(read, f"part long, shard long, id {id_type}, inside long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    bases = manifest.select("part", "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, ["part", "shard"]).select(F.col("id").alias(id_col), (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write all documents as shards in the shared folder and read every file back."""
    spark = docs.sparkSession
    to = scratch(spark, "shards")
    manifest = write_shards(docs, to, id_col, text_col, shard_tokens=shard_tokens)
    kind = docs.schema[id_col].dataType.simpleString()
    if not manifest.take(1):
        return spark.createDataFrame([], f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, to, manifest, id_col, kind)
