"""Queries over written indexes: graphs, filtered probing, posting lists, rewritten parts and merged sketches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from statuta.functions import text as tx
from statuta.operators import ann, feeds, graph, layout, postings, state
from statuta.plans.catalog import ORACLE_SQL, asked, classified, query, read
from statuta.streaming.store import shared

_NEAR = """SELECT q.vec_id AS query, e.vec_id AS key, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0"""


def _index(spark, sf_dir) -> str:
    """The graphs of the vectors of this folder; written by the first query that wants them."""
    return graph.ensured(read(spark, sf_dir, "embeddings"), "vec_id", f"{shared(spark)}/vector-graphs-reached")


@query("q78", f"SELECT query, count(*) AS n_hits, arg_min(key, rank) AS nearest, true AS recall_of_9_in_10 FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM ({_NEAR})) WHERE rank <= 10 GROUP BY query")
def graph_search(spark, sf_dir):
    """Every twentieth vector against the graphs of all: hits, the nearest one, and whether nine in ten of all hits are those of the exact search."""
    chunks = read(spark, sf_dir, "embeddings")
    wanted = chunks.where("vec_id % 20 = 0")
    found = graph.search(spark, _index(spark, sf_dir), wanted, "vec_id", probes=12).persist()
    exact = graph.exact(chunks, "vec_id", wanted, "vec_id")
    both = exact.join(found.select("query", "key", F.lit(1).alias("there")), ["query", "key"], "left").agg((F.count("there") / F.count("*") >= 0.9).alias("recall_of_9_in_10"))
    pages = found.groupBy("query").agg(F.count("*").alias("n_hits"), F.min_by("key", "rank").alias("nearest"))
    return pages.join(F.broadcast(both))  # one row


@query("q79", "SELECT vec_id % 100 AS part, least(10, count(*)) AS n_hits, true AS all_pass FROM embeddings WHERE vec_id % 100 < 3 GROUP BY vec_id % 100")
def rare_filter(spark, sf_dir):
    """Filters that one row in a hundred passes: a page is full whenever so many rows pass, however few cells hold them."""
    chunks = read(spark, sf_dir, "embeddings")
    at = ann.ensured(chunks, "vec_id", f"{shared(spark)}/vector-cells")
    cells, centres, wanted = spark.read.parquet(f"{at}/chunks"), ann.centres_of(spark, at), asked(spark, sf_dir)
    pages = [ann.probe_filtered(cells, centres, wanted, "vec_id", F.col("vec_id") % 100 == part, limit=10).select(F.lit(part).cast("long").alias("part"), "vec_id") for part in range(3)]
    hits = pages[0].unionByName(pages[1]).unionByName(pages[2])
    return hits.groupBy("part").agg(F.count("*").alias("n_hits"), F.every(F.col("vec_id") % 100 == F.col("part")).alias("all_pass"))


@query("q83", ORACLE_SQL["q44"])
def titles_by_lists(spark, sf_dir):
    """Titles like a query, from the lists of its trigrams."""
    parts = read(spark, sf_dir, "part")
    index = postings.ensured(parts, "p_partkey", tx.trigrams(F.col("p_name")), f"{shared(spark)}/title-trigram-lists", ann.version_of(parts))
    return postings.similar_titles(parts, "p_partkey", "p_name", index, "blue anvils").select("p_partkey", "p_name", "likeness")


@query("q84", ORACLE_SQL["q07"])
def keywords_by_lists(spark, sf_dir):
    """Documents that have any of some words, from the lists of these."""
    docs = read(spark, sf_dir, "documents")
    index = postings.ensured(docs, "doc_id", F.array_distinct(F.split(F.lower("text"), " ")), f"{shared(spark)}/keyword-lists", ann.version_of(docs))
    return postings.having_any(index, ["the", "der"]).withColumnRenamed("key", "doc_id")


@query("q85", ORACLE_SQL["q14"])
def replaced_in_parts(spark, sf_dir):
    """Chunks of changed documents replaced in a table in parts: the parts that hold these documents are rewritten."""
    docs, path = read(spark, sf_dir, "documents"), f"{shared(spark)}/parts-{uuid.uuid4().hex}"
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line")).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("line").alias("digest"))
    layout.write(lines, "doc_id", path)
    changed = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    whole = docs.join(changed, "doc_id", "left_semi").select("doc_id", F.lit(0).cast("long").alias("chunk_index"), F.md5("text").alias("digest"))
    layout.replace(spark, path, "doc_id", changed, whole)
    return layout.read(spark, path).drop("part")


@query("q86", "SELECT event_type, count(*) AS n, round(count(*) FILTER (value > 20) / count(*), 6) AS error_rate, true AS p95_in_rank FROM events GROUP BY event_type")
def latencies_of_batches(spark, sf_dir):
    """Sketches of each day, merged: the share of values up to the p95 that they give is 0.95, within a hundredth."""
    events = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    days = feeds.latency_sketches(events, "event_type", "value", F.col("value") > 20, "day")
    found = feeds.merged_latencies(days, "event_type")
    ranks = events.join(F.broadcast(found.select("event_type", "p95")), "event_type").groupBy("event_type").agg((F.abs(F.avg((F.col("value") <= F.col("p95")).cast("int")) - 0.95) <= 0.01).alias("p95_in_rank"))
    return found.join(ranks, "event_type").select("event_type", "n", "error_rate", "p95_in_rank")


@query("q87", ORACLE_SQL["q19"].replace("GROUP BY ROLLUP (source)", "").replace("coalesce(source, 'TOTAL') AS source, ", ""))
def run_counted_as_written(spark, sf_dir):
    """The counters of a crawl from the pass that writes it."""
    counts = state.written_run(classified(spark, sf_dir), f"{shared(spark)}/run-{uuid.uuid4().hex}")
    return spark.createDataFrame([counts], "discovered long, n_new long, n_updated long, n_unchanged long")
