"""Where streams of queries keep their files: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="statuta-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all there is and read what it appended."""
    base = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True)
    run.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
