"""Streams: windowed counts, sessions, rate limits with state, and incremental ingestion."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from statuta.functions import chunk as ch
from statuta.functions import text as tx
from statuta.operators import layout, state


def tumbling(events: DataFrame, time: str, size: str, late: str, *keys: str, value: str = "value") -> DataFrame:
    """Counts and sums of windows side by side; events later than the watermark are dropped."""
    w = events.withWatermark(time, late).groupBy(F.window(time, size), *keys)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """Sessions of each key: events with no gap between them."""
    s = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def rate_limit(requests: DataFrame, client: str, time: str, seconds: int, limit: int) -> DataFrame:
    """Requests with a verdict, against those of their client in the seconds before. The state of a client is the times of
    that span, each with its count, and goes when the watermark has left it."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        recent = deque(zip(*held.get, strict=True) if held.exists else ())
        span, total = seconds * 1_000_000, sum(n for _, n in recent)
        stamps = pd.concat([p["_micros"] for p in parts]).sort_values()
        out = []
        for stamp in stamps.tolist():
            while recent and recent[0][0] < stamp - span:
                total -= recent.popleft()[1]
            if recent and recent[-1][0] == stamp:
                recent[-1] = stamp, recent[-1][1] + 1
            else:
                recent.append((stamp, 1))
            total += 1
            out.append((key[0], pd.Timestamp(stamp, unit="us"), total, total > limit))
        held.update(tuple(map(list, zip(*recent, strict=True))))
        held.setTimeoutTimestamp(max((recent[-1][0] + span) // 1000, held.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["client", "at", "recent", "rejected"])

    kind = requests.schema[client].dataType.simpleString()
    stamped = requests.select(F.col(client).alias("client"), F.col(time).cast("timestamp").alias("_at")).withColumn("_micros", F.unix_micros("_at")).withWatermark("_at", "0 seconds")
    return stamped.groupBy("client").applyInPandasWithState(step, f"client {kind}, at timestamp, recent long, rejected boolean", "times array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def run_now(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all there is in batches, then stop: what a schedule starts. A restart goes on from the checkpoint."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Ingest:
    """A sink for streams of documents (doc_id, source, text): classify by digest, chunk what changed, embed, number
    versions, write. Each batch writes a folder of its own per table, so a batch that is repeated writes the same
    files again. The last version of each document stands in a table in hash parts beside the log of all versions: a batch
    reads and writes the parts of its documents, however long the log is. Rows without text or id go to ``rejected``; chunks that
    the embedder gave no vector go to ``dead``, and ``retried`` tries those again. Of rows that share an id in a batch the
    one with the least text counts."""

    def __init__(self, path: str, embed: Callable | None = None):
        self.path, self.embed = path, embed

    def table(self, spark, name: str, before: int | None = None) -> DataFrame | None:
        try:
            found = spark.read.parquet(f"{self.path}/{name}")
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return found if before is None else found.where(F.col("batch") < before)

    def current(self, spark, before: int | None = None, of: DataFrame | None = None) -> DataFrame | None:
        """The last version of each document (doc_id, content_hash, version_number); ``of``: rows whose documents' parts alone are read.

        A row knows what it replaced and in which batch, so a batch that is repeated sees what it saw before."""
        if self.table(spark, "current") is None:
            return None
        rows = layout.read(spark, f"{self.path}/current")
        if of is not None:
            parts = [r[0] for r in of.select(layout.part_of("doc_id", layout.PARTS)).distinct().collect()]  # PARTS at most
            rows = rows.where(F.col("part").isin(parts))
        if before is None:
            return rows.select("doc_id", "content_hash", "version_number")
        again = F.col("batch") >= before
        return rows.select("doc_id", F.when(again, F.col("old_hash")).otherwise(F.col("content_hash")).alias("content_hash"), F.when(again, F.col("version_number") - 1).otherwise(F.col("version_number")).alias("version_number")).where("version_number > 0")

    def chunks(self, spark) -> DataFrame:
        """Chunks of the current version of each document."""
        now = self.current(spark).select("doc_id", "version_number")
        return self.table(spark, "chunks").join(now, ["doc_id", "version_number"], "left_semi").drop("batch")

    def retried(self, spark) -> DataFrame:
        """Chunks that have no vector, with what the embedder says now; those that get one can be written over the old ones."""
        dead = self.table(spark, "dead").drop("batch")
        return dead.withColumn("embedding", self.embed(F.col("content")))

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        rows = rows.withColumn("text", tx.normalise(F.col("text"))).persist()
        bad = F.when(F.col("doc_id").isNull(), "no id").when(F.col("text") == "", "no text")
        put(rows.withColumn("error", bad).where("error is not null").select("doc_id", "error"), "rejected")
        least = rows.where("doc_id is not null and text <> ''").groupBy("doc_id").agg(F.min(F.struct("text", "source")).alias("x"))
        good = least.select("doc_id", "x.source", "x.text").withColumn("content_hash", tx.content_hash(F.col("text")))
        now = self.current(spark, batch, good)
        if now is None:
            now = spark.createDataFrame([], good.select("doc_id", "content_hash").schema).withColumn("version_number", F.lit(0).cast("long"))
        before = now.select("doc_id", "version_number", F.col("content_hash").alias("old_hash"))
        status = state.classify(good, now, ["doc_id"]).join(before, "doc_id", "left").persist()
        put(state.run_totals(status, "source"), "runs")
        changed = status.where("status <> 'unchanged'").withColumn("version_number", (F.coalesce("version_number", F.lit(0)) + 1).cast("long"))
        put(changed.select("doc_id", "version_number", "content_hash", "text"), "versions")
        parts = ch.exploded(changed, ch.word_windows(F.col("text")), "doc_id", "version_number")
        if self.embed:
            parts = parts.withColumn("embedding", self.embed(F.col("content"))).persist()
            put(parts.where("embedding is null").drop("embedding"), "dead")
        put(parts, "chunks")
        last = changed.select("doc_id", "content_hash", "version_number", "old_hash", F.lit(batch).cast("long").alias("batch"))
        if self.table(spark, "current") is None:
            layout.write(last, "doc_id", f"{self.path}/current")
        else:
            layout.replace(spark, f"{self.path}/current", "doc_id", last, last)
        parts.unpersist()
        status.unpersist()
        rows.unpersist()
