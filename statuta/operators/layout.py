"""Tables in hash parts by a key: a change reads and writes the parts that its keys are in, and no others.

A table is written once with ``write``, partitioned by a hash of its key. ``replace`` and ``remove`` find the parts that
some keys are in, build the next state of these parts alone and put it in their place with a dynamic partition overwrite:
files of other parts keep their names. The next state is written beside the table first, so a job that fails before the
end leaves the table as it was, and one that is repeated writes the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def write(table: DataFrame, key: str, path: str, parts: int = PARTS) -> None:
    """The table in parts; rows without a key are in the part that null hashes to."""
    table.withColumn("part", part_of(key, parts)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup(spark: SparkSession, path: str, key: str, values: list, parts: int = PARTS) -> DataFrame:
    """Rows of some keys: only their parts are read."""
    kind = read(spark, path).schema[key].dataType.simpleString()
    wanted = spark.createDataFrame([(v,) for v in values], f"{key} {kind}")
    some = [r[0] for r in wanted.select(part_of(key, parts)).distinct().collect()]
    return read(spark, path).where(F.col("part").isin(some) & F.col(key).isin(values)).drop("part")


def replace(spark: SparkSession, path: str, key: str, keys: DataFrame, new: DataFrame | None = None, parts: int = PARTS) -> list[int]:
    """In place of all rows with some keys the new ones (of the table's columns); a key may have none. Returns the parts that were written.

    The number of parts bounds what the driver is told. Rows whose keys stand in ``new`` alone are added as well."""
    table = read(spark, path)
    if new is not None:
        keys = keys.select(key).unionByName(new.select(key))
    keys = keys.select(key).distinct().withColumn("part", part_of(key, parts))
    touched = sorted(r[0] for r in keys.select("part").distinct().collect())
    if not touched:
        return []
    old = table.where(F.col("part").isin(touched))
    left = old.join(keys.select(F.col(key).alias("_k"), F.col("part").alias("_p")), (F.col("part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")), "left_anti")
    if new is not None:
        left = left.unionByName(new.withColumn("part", part_of(key, parts)))
    staged = f"{path.rstrip('/')}.next-{uuid.uuid4().hex}"
    left.repartition("part").write.partitionBy("part").parquet(staged)
    after = spark.read.schema(table.schema).parquet(staged)
    there = {r[0] for r in after.select("part").distinct().collect()}
    after.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    for gone in [f"{path}/part={p}" for p in touched if p not in there] + [staged]:
        target = spark._jvm.org.apache.hadoop.fs.Path(gone)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return touched


def remove(spark: SparkSession, path: str, key: str, keys: DataFrame, parts: int = PARTS) -> list[int]:
    return replace(spark, path, key, keys, None, parts)
