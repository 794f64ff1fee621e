"""Change feeds, retrieval contexts, formatted results, key checks and operational figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import text as tx
from statuta.operators.search import MOST_CHANGES, clamp

#: What stands in place of a missing summary, and behind a text that was cut.
NO_SUMMARY, CUT = "(no summary available)", "... [gekürzt]"


def changes(versions: DataFrame, since: Column, time: str, key: str, limit: int | None = 20, offset: int = 0) -> DataFrame:
    """Versions after a time, newest first."""
    return versions.where(F.col(time) > since).orderBy(F.desc(time), F.desc(key)).offset(max(offset, 0)).limit(clamp(limit, 20, 1, MOST_CHANGES))


def dated_changes(laws: DataFrame, cutoff: Column, today: Column, key: str, limit: int = 50, restate: bool = True) -> DataFrame:
    """Laws published or modified since a day, as new, modified or repealed (which wins); last modified first,
    those without such a day before all. With ``restate`` a new law's change date is its publication."""
    recent = laws.where((F.col("last_modified") >= cutoff) | (F.col("publication") >= cutoff))
    new, over = F.col("publication") >= cutoff, F.col("valid_until") < today
    kind = F.when(over, "repealed").when(new, "new").otherwise("modified")
    when = F.when(new, F.col("publication")).otherwise(F.col("last_modified")) if restate else F.col("last_modified")
    return recent.withColumns({"change_type": kind, "change_date": when}).orderBy(F.desc_nulls_first("last_modified"), key).limit(limit)


def ranked(hits: DataFrame, key: str) -> DataFrame:
    """Hits of one page with their rank from 1."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long"))


def hit_lines(hits: DataFrame, title: str, language: str, source: str, content: str) -> DataFrame:
    """The text of each ranked hit."""
    line = F.format_string("%d. **%s** (%s)\n   Source: %s\n   Score: %.3f\n   Excerpt: %s", "rank", title, F.upper(language), source, "score", tx.snippet(F.col(content)))
    return hits.select("rank", line.alias("line"))


def change_lines(feed: DataFrame, title: str, time: str, summary: str) -> DataFrame:
    stamp = F.date_format(time, "yyyy-MM-dd HH:mm 'UTC'")
    return feed.withColumn("line", F.format_string("- **%s** (v%d) | Changed: %s\n  Summary: %s", title, "version_number", stamp, F.coalesce(summary, F.lit(NO_SUMMARY))))


def context_block(hits: DataFrame, title: str, content: str, most: int = 1500) -> DataFrame:
    """One row: the ranked hits of a page as numbered blocks, long texts cut."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col(title), F.lit("\n"), tx.shortened(F.col(content), most, CUT))
    listed = F.sort_array(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.agg(F.array_join(F.transform(listed, lambda x: x["block"]), "\n\n").alias("context"), F.count("*").alias("n_sources"))


def last_turns(chat: DataFrame, talk: str, turn: str, n: int = 10) -> DataFrame:
    """Of each conversation the last turns, with roles as a model takes them: user, or model for all others."""
    w = Window.partitionBy(talk).orderBy(F.desc(turn))
    recent = chat.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
    return recent.withColumn("role", F.when(F.col("role") == "user", "user").otherwise("model"))


def active_keys(keys: DataFrame, now: Column) -> DataFrame:
    return keys.where(F.col("enabled") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def allowed_origin(keys: DataFrame, origin: str) -> DataFrame:
    """Keys without a list of origins, or with this one or all (*) in it."""
    listed = F.col("allowed_origins")
    return keys.where(listed.isNull() | F.array_contains(listed, origin) | F.array_contains(listed, "*"))


def authorised(requests: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Requests whose key's digest is that of an active key."""
    return requests.join(active_keys(keys, now).select("key_hash"), "key_hash", "left_semi")


def rate_limited(requests: DataFrame, client: str, time: str, seconds: int, limit: int) -> DataFrame:
    """Each request with the requests of its client in the seconds up to it, and whether they pass the limit."""
    stamp = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(client).orderBy(stamp).rangeBetween(-seconds * 1_000_000, 0)
    return requests.withColumn("recent", F.count("*").over(w)).withColumn("rejected", F.col("recent") > limit)


def latencies(samples: DataFrame, group: str, value: str, failed: Column, accuracy: int | None = 10_000) -> DataFrame:
    """Requests, p50, p95 and share of errors for each group. Percentiles come from a sketch of bounded size, with a rank
    off by 1/accuracy at most; accuracy None takes exact ones, which keep every different value of a group."""
    at = (lambda q: F.percentile(value, q)) if accuracy is None else (lambda q: F.percentile_approx(value, q, accuracy))
    return samples.groupBy(group).agg(
        F.count("*").alias("n"), F.round(at(0.5), 6).alias("p50"), F.round(at(0.95), 6).alias("p95"), F.round(F.count_if(failed) / F.count("*"), 6).alias("error_rate")
    )


def latency_sketches(samples: DataFrame, group: str, value: str, failed: Column, *batch: str, k: int = 800) -> DataFrame:
    """Of each group and batch a row that can be kept and merged with others: counts, and a KLL sketch of the values, whose
    size does not follow their number (k 800: ranks off by about 0.004)."""
    return samples.groupBy(group, *batch).agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged_latencies(sketches: DataFrame, group: str) -> DataFrame:
    """Requests, p50, p95 and share of errors of each group from the rows of all its batches. Groups without a value have null percentiles."""
    merged = sketches.groupBy(group).agg(F.sum("n").alias("n"), F.sum("n_failed").alias("_failed"), F.kll_merge_agg_double("sketch").alias("_all"))
    at = lambda q: F.when(F.kll_sketch_get_n_double("_all") > 0, F.kll_sketch_get_quantile_double("_all", F.lit(q)))
    return merged.select(group, "n", at(0.5).alias("p50"), at(0.95).alias("p95"), F.round(F.col("_failed") / F.col("n"), 6).alias("error_rate"))


def corpus_counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    parts = [df.agg(F.count("*").alias(name)) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


def similar_titles(table: DataFrame, title: str, query: str, least: float = 0.3) -> DataFrame:
    """Rows whose title shares enough trigrams with a query."""
    likeness = F.round(tx.jaccard(tx.trigrams(F.col(title)), tx.trigrams(F.lit(query))), 6)
    return table.withColumn("likeness", likeness).where(F.col("likeness") >= least)
