"""Streams with a state for each key: token buckets, current documents, late rows.

All use ``transformWithState``, whose state stands in RocksDB beside the checkpoint, so what a batch reads and writes are
the keys that it brings. ``prepare`` sets the state store; it must be called before the stream starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts of a token; levels are whole numbers of them, so that they are the same on every machine.
PARTS = 1_000_000


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class _Bucket(StatefulProcessor):
    """Of a client the level and the time at which it was so, in a value that expires when a full bucket says the same."""

    def __init__(self, rate: int, burst: int, step: int):
        self.rate, self.burst, self.step = rate, burst, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.level = handle.getValueState("level", "left long, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        full = self.burst * PARTS
        left, at = self.level.get() if self.level.exists() else (full, None)
        batch = pd.concat(list(rows)).sort_values(["micros", "id"])
        out = []
        for stamp, request in zip(batch["micros"].tolist(), batch["id"].tolist(), strict=True):
            if at is not None:
                left = min(full, left + max(stamp - at, 0) // self.step * self.rate)
            at = stamp if at is None else max(at, stamp)
            taken = left >= PARTS
            left -= PARTS * taken
            out.append((request, bool(taken), left))
        self.level.update((left, at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max((at + ((full - left) // self.rate + 1) * self.step) // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        yield pd.DataFrame(out, columns=["id", "accepted", "left"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.level.clear()  # by now the bucket is full, as a new one is
        yield from ()

    def close(self) -> None:
        pass


def token_bucket(requests: DataFrame, client: str, time: str, key: str, rate: int, burst: int, step: int = 1, late: str = "0 seconds") -> DataFrame:
    """Requests (id) with whether their client's bucket had a token for them, and what is left of it in parts of a token.

    rate: parts of a token that each whole ``step`` of microseconds since the request before adds (1 and 1: a token a second); burst: tokens of a full bucket. Of a batch the
    requests of a client are taken by time and id; one that is older than those before it adds nothing to the bucket. A
    client whose bucket would be full again has no state."""
    prepare(requests.sparkSession)
    kind = requests.schema[key].dataType.simpleString()
    stamped = requests.select(F.col(client).alias("client"), F.col(key).alias("id"), F.col(time).cast("timestamp").alias("at")).withColumn("micros", F.unix_micros("at")).withWatermark("at", late)
    return stamped.groupBy("client").transformWithStateInPandas(_Bucket(rate, burst, step), f"id {kind}, accepted boolean, left long", "Append", "EventTime")


class _Current(StatefulProcessor):
    """Of a document the digest and the number of its last version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "digest string, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        digest, version = self.last.get() if self.last.exists() else (None, 0)
        batch = pd.concat(list(rows)).sort_values(["micros", "row"])
        out = []
        for row, new in zip(batch["row"].tolist(), batch["digest"].astype(object).where(batch["digest"].notna(), None).tolist(), strict=True):
            status = "new" if not version else "unchanged" if digest is not None and new == digest else "updated"
            if status != "unchanged":
                digest, version = new, version + 1
            out.append((key[0], row, status, version))
        self.last.update((digest, version))
        yield pd.DataFrame(out, columns=["document", "row", "status", "version"])

    def close(self) -> None:
        pass


def current(rows: DataFrame, document: str, time: str, row: str, digest: str) -> DataFrame:
    """Rows of a stream of documents with their status (new, updated, unchanged) and the version that they are or leave.

    A document's state is its last digest and version, so a batch reads those of its own documents only. Of a batch
    the rows of a document are taken by time and row; a null digest is one that equals no other."""
    prepare(rows.sparkSession)
    kinds = [rows.schema[c].dataType.simpleString() for c in (document, row)]
    named = rows.select(F.col(document).alias("document"), F.col(row).alias("row"), F.unix_micros(F.col(time).cast("timestamp")).alias("micros"), F.col(digest).alias("digest"))
    return named.groupBy("document").transformWithStateInPandas(_Current(), f"document {kinds[0]}, row {kinds[1]}, status string, version long", "Append", "None")


class _Windows(StatefulProcessor):
    """Of a key the open windows, with counts, in one value and with one timer: a batch reads and writes a key's state once.
    Rows of windows that have closed come out as late, one by one."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "starts array<long>, counts array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        had = self.open.get()
        counts = dict(zip(*had, strict=True)) if had else {}
        first = min(counts, default=None)
        for row in rows:
            if row.micros is None:  # no time, no window
                continue
            start = row.micros // self.size * self.size
            if start + self.size <= mark:
                yield Row(key=key[0], kind="late", start=start, n=1)
            else:
                counts[start] = counts.get(start, 0) + 1
        self.put(counts, first)

    def put(self, counts: dict[int, int], first: int | None) -> None:
        """Keep these windows; the timer, which is at the end of the window that was the first, goes to that of the first one."""
        if counts:
            self.open.update((list(counts), list(counts.values())))
            if (least := min(counts)) != first:
                if first is not None:
                    self.handle.deleteTimer((first + self.size) // 1000)
                self.handle.registerTimer((least + self.size) // 1000)
        elif first is not None:
            self.open.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        had = self.open.get()
        counts = dict(zip(*had, strict=True)) if had else {}
        closed = [start for start in counts if start + self.size <= mark]
        for start in closed:
            yield Row(key=key[0], kind="window", start=start, n=counts.pop(start))
        self.put(counts, None)  # a timer that expired is gone
        if closed and not counts:
            self.open.clear()

    def close(self) -> None:
        pass


def windows_and_late(events: DataFrame, key: str, time: str, seconds: int, late: str) -> DataFrame:
    """Counts of windows (start in microseconds) as they close (kind window), and a row for each event whose window had closed before it came (kind late).

    The watermark is Spark's, over all keys. The column that it stands on does not go into the operator, so Spark drops no
    row before it; a window's count comes out once, and what comes out, what is open and what is late are all rows."""
    prepare(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    stamped = events.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("at")).withWatermark("at", late).select("key", F.unix_micros("at").alias("micros"))
    return stamped.groupBy("key").transformWithState(_Windows(seconds * 1_000_000), f"key {kind}, kind string, start long, n long", "Append", "EventTime")
