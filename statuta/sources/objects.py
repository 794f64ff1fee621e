"""Blobs: any file system that Spark reads; documents as bytes with their key and format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import text as tx


def blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under a path: path, length, content, format and decoded text (null unless it is UTF-8)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    head = F.decode(F.substring("content", 1, 64), "ISO-8859-1")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", "length", "content", tx.sniff(head).alias("format"), text.alias("text"))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are that, else Latin-1; a byte order mark goes."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^\ufeff", "")


def keyed(blobs_: DataFrame) -> DataFrame:
    """With the digest of the bytes and the key under which they are kept."""
    digest = F.sha2("content", 256)
    return blobs_.withColumns({"digest": digest, "object_key": F.concat_ws("/", "source", "external_id", F.concat(digest, F.lit("."), "format"))})


def joined_pages(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """Pages of scanned documents as one text, parted by empty lines; a document without text has an error."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    out = pages.groupBy(document).agg(F.array_join(F.filter(F.transform(listed, lambda x: x["t"]), lambda t: tx.strip(t) != ""), "\n\n").alias("text"))
    return out.withColumn("error", F.when(F.col("text") == "", "no text"))


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Write one blob, in place of one that is there."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def get(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a blob; a missing one is no error."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
