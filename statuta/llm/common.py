"""What the operators of this subpackage share: scratch tables, Arrow streaming, word hashing.

Words are the runs of bytes outside space and 0x09-0x0D of the UTF-8 text. ``bytes.split()`` cuts at
exactly those bytes, so Python code splits encoded text, never ``str``.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that goes to Python: 512 rows of the longest texts seen stay below 64 MB.
BATCH_ROWS = 512
#: Java regular expression of a separator run, and the class of characters of a word.
GAP_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]"


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows; the byte bound of the session, if any, stays."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a new temporary one where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="statuta-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/statuta-{name}-{uuid.uuid4().hex}"


class _Made(threading.local):
    """Scratch tables of a thread that have not been deleted: other threads' queries keep theirs."""

    def __init__(self):
        self.paths: list[str] = []


_SCRATCH = _Made()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    _SCRATCH.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_tables() -> list[str]:
    return list(_SCRATCH.paths)


def sweep(spark: SparkSession, paths: list[str], *keep: DataFrame) -> list[str]:
    """Delete scratch tables, but those that some DataFrames read; returns what is left of them.

    Only for callers who know that what was built on the others has been written."""
    used, left = [f for df in keep for f in df.inputFiles()], []
    for path in paths:
        if any(path.rpartition("/")[2] in f for f in used):
            left.append(path)
        else:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
            _SCRATCH.paths.remove(path)
    return left


def tidy(operator):
    """An operator that, when it has its result (a DataFrame or several), deletes the scratch tables it made on the way, but for those that the result reads."""

    @functools.wraps(operator)
    def run(*args, **named):
        before = set(scratch_tables())
        out = operator(*args, **named)
        frames = out if isinstance(out, tuple) else (out,)
        sweep(frames[0].sparkSession, [p for p in scratch_tables() if p not in before], *frames)
        return out

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """A column name like this one that is not among some columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys that hold a larger share of all rows than one in this many are joined by broadcast; there are fewer of them than this.
HOT = 1000


def join_hot(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows joined with totals (a row a key, n: how many rows have the key) without a task that gets a hot key's rows.

    Keys with over one in HOT of all rows are HOT at most, whatever the data: they are broadcast. The others shuffle.
    Both tables are read twice, so they should be written ones."""
    bound = totals.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(totals.where(F.col("n") * HOT > bound))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(totals.where(F.col("n") * HOT <= bound), keys)
    return rows.join(hot, keys).unionByName(rest)


def join_salted(rows: DataFrame, others: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Rows joined with others (at most a row a key, of any size) without a task that gets all rows of a hot key.

    A key with over one in HOT of all rows is cut into as many parts as its share of the shuffle's partitions, by the column
    ``spread``; its row of others is sent to each part. That is at most HOT + width rows more, and only hot keys are broadcast.
    The other keys meet by a plain join, so others that lie by key already stay where they are."""
    total, salt, cuts = rows.count(), fresh(rows.columns + others.columns, "salt"), fresh(rows.columns + others.columns, "cuts")
    n = fresh(keys, "n")
    share = F.ceil(F.col(n) * width(rows.sparkSession) / F.lit(max(total, 1))).cast("int")
    hot = written(rows.groupBy(*keys).agg(F.count("*").alias(n)).where(F.col(n) * HOT > total).select(*keys, share.alias(cuts)), "hot")
    if hot.isEmpty():
        return rows.join(others, keys)
    hot = F.broadcast(hot)
    left = rows.join(hot, keys).withColumn(salt, F.pmod(F.xxhash64(spread), cuts).cast("int")).drop(cuts)
    right = others.join(hot, keys).withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(cuts) - 1))).drop(cuts)
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(others, keys)
    return rest.unionByName(left.join(right, [*keys, salt]).drop(salt))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Give a worker's freed memory back to the system at the end of a task; idle workers stay for the next one."""
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def long_ids(batch: pa.RecordBatch, column: str = "doc_id") -> pa.Array:
    return batch.column(column)


def slices(batches: Iterator[pa.RecordBatch], most: int = 4_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one take about ``most`` bytes; a longer text is a batch of its own."""
    for batch in batches:
        lens = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        at, total = 0, 0
        for i, n in enumerate(lens.tolist()):
            if total and total + n > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < batch.num_rows:
            yield batch.slice(at)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Starts of two independent hashes, bytes of a word that are hashed in columns, bytes of a piece.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_COLUMNS = 64
_PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: White space, and all of ASCII but letters and digits.
_MARKS = np.zeros(256, bool)
_MARKS[[i for i in range(128) if not chr(i).isalnum()]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: What is left of eight bytes of which the first k count, k from 0 to 8.
_FIRST = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, begins: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans of bytes: eight bytes at a time are mixed into the state, which starts with the length, so
    no sum or product of the spans' parts is kept that equal parts elsewhere could cancel. Long spans take BLAKE2."""
    lens = stops - begins
    state = mix(lens.astype(np.uint64) + np.uint64(SEEDS[seed]))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    long = np.flatnonzero(lens > _COLUMNS)
    some, k = np.arange(len(lens)) if not len(long) else np.flatnonzero(lens <= _COLUMNS), 0
    while len(some):
        left = np.minimum(lens[some] - k, 8)
        if k:
            some, left = some[left > 0], left[left > 0]
        state[some] = mix(state[some] ^ (eight[begins[some] + k] & _FIRST[left]))
        k += 8
        some = some[left == 8]
    for i in long.tolist():
        state[i] = int.from_bytes(hashlib.blake2b(data[begins[i] : stops[i]].tobytes(), digest_size=8, key=SEEDS[seed].to_bytes(8, "little")).digest(), "little")
    return state


def word_hashes(data: np.ndarray, ends: np.ndarray, fold: bool, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, and how many words each text has."""
    return word_spans(data, ends, fold, marks)[:2]


def word_spans(data: np.ndarray, ends: np.ndarray, fold: bool, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, words of each text, and where each word begins and ends.

    data: the UTF-8 bytes of the texts, joined with one space after each; ends: where each text ends (its
    space). fold: A-Z count as a-z. marks: ASCII punctuation parts words too."""
    parts = _MARKS if marks else _SPACE
    out, starts_at, stops_at = [], [], []
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + _PIECE)
        if to < n:  # end a piece behind a space
            gaps = np.flatnonzero(parts[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                step = to
                while to < n and not parts[data[to]]:  # a long run without a space, looked through piece by piece
                    step = min(n, to + _PIECE)
                    more = np.flatnonzero(parts[data[to:step]])
                    to = to + int(more[0]) if len(more) else step
                to = min(n, to + 1)
        piece = data[at:to]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], parts[piece], [True])).view(np.int8)))
        begin, end = edge[::2], edge[1::2]
        out.append(span_hashes(_FOLD[piece] if fold else piece, begin, end))
        starts_at.append(begin + at)
        stops_at.append(end + at)
        at = to
    hashes = np.concatenate(out) if out else np.empty(0, np.uint64)
    begins, stops = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts_at, stops_at))
    return hashes, np.diff(np.searchsorted(begins, np.asarray(ends)), prepend=0), begins, stops


def run_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of n words (of their hashes): runs of 2, 4, 8, ... words are mixed from halves, and n from two that overlap."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    own, k, salt = mix(hashes + np.uint64(SEEDS[seed])), 1, np.uint64(SEEDS[1 - seed] | 1)
    while k < n:
        step = min(k, n - k)
        own = mix(own[:-step] * salt + own[step:])
        k += step
    return own


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with one space after each, and where each ends."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8), ends


