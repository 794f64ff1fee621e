"""What a service answers with, as DataFrames and as text; transport, models and secrets are outside.

Tables follow ``schema.TABLES``. The query text is embedded once, on the driver; everything else is one plan.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta import schema
from statuta.functions import embed
from statuta.functions import text as tx
from statuta.operators import feeds, search, state


@dataclass
class Corpus:
    """The tables that answers come from."""

    sources: DataFrame
    documents: DataFrame
    chunks: DataFrame
    versions: DataFrame

    def joined(self) -> DataFrame:
        """Chunks with their document and source, without what no answer shows."""
        docs = self.documents.select(F.col("id").alias("document_id"), "source_id", "title", "url", "doc_type", "jurisdiction", "language")
        sources = self.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
        chunks = self.chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", F.col("content"), "embedding")
        return chunks.join(docs, "document_id").join(search.small(sources), "source_id")


@dataclass
class Answers:
    corpus: Corpus
    embedder: Callable[[list[str]], list]

    def vector(self, query: str) -> list[float]:
        return embed.embed_one(self.embedder, search.require_text(query))

    def search(self, query: str, limit: int | None = 10, offset: int = 0, min_score: float | None = None, **filters) -> DataFrame:
        """A page of hits: chunk, document, source and score. Filters are values, lists of values or None."""
        rows = self.corpus.joined().where(search.all_of(**filters))
        return search.search(rows, self.vector(query), "chunk_id", None, min_score, limit, offset)

    def totals(self, query: str, **filters) -> DataFrame:
        return search.totals(self.corpus.joined(), self.vector(query), search.all_of(**filters))

    def document(self, key: str) -> DataFrame:
        found = self.corpus.documents.where(F.col("id") == key)
        if not found.take(1):
            raise schema.NotFound(f"no document {key}")
        return found

    def versions_of(self, key: str) -> DataFrame:
        return self.corpus.versions.where(F.col("document_id") == key).orderBy(F.desc("version_number"))

    def chunks_of(self, key: str) -> DataFrame:
        return self.corpus.chunks.where(F.col("document_id") == key).drop("embedding").orderBy("chunk_index")

    def sources(self, jurisdiction: str | None = None) -> DataFrame:
        return self.corpus.sources.where(search.all_of(jurisdiction=jurisdiction)).drop("credentials_enc").orderBy("name")

    def changes(self, since: Column, jurisdiction: str | None = None, limit: int | None = 20, offset: int = 0) -> DataFrame:
        """Versions after the first one of each document, newest first."""
        docs = self.corpus.documents.select(F.col("id").alias("document_id"), "title", "url", "jurisdiction")
        log = self.corpus.versions.where("version_number > 1").drop("content_md").join(docs, "document_id").where(search.all_of(jurisdiction=jurisdiction))
        return feeds.changes(log, since, "changed_at", "id", limit, offset)

    def search_text(self, query: str, limit: int = 10, **filters) -> str:
        hits = feeds.ranked(self.search(query, search.clamp(limit, 10, 1, search.MOST_TOOL), **filters), "chunk_id")
        lines = [r["line"] for r in feeds.hit_lines(hits, "title", "language", "source_name", "content").orderBy("rank").collect()]
        return "\n".join([f'Found {len(lines)} result(s) for "{query}"\n', *lines]) if lines else f'No results for "{query}"'

    def changes_text(self, since: Column, **options) -> str:
        rows = feeds.change_lines(self.changes(since, **options), "title", "changed_at", "change_summary").select("line").collect()
        return "\n".join([f"{len(rows)} document(s) changed:\n", *(r["line"] for r in rows)])

    def prompt(self, message: str, history: DataFrame | None = None, limit: int = 5, min_score: float = 0.3) -> DataFrame:
        """One row: the numbered context of the best hits, and the last ten turns of the history given."""
        hits = feeds.ranked(self.search(message, limit, 0, min_score), "chunk_id")
        block = feeds.context_block(hits, "title", "content")
        if history is None:
            return block.withColumn("history", F.array().cast("array<struct<turn:long,role:string,text:string>>"))
        turns = feeds.last_turns(history.withColumn("_talk", F.lit(1)), "_talk", "turn").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "role", "text"))).alias("history"))
        return block.crossJoin(turns)  # one row each

    def stats(self) -> DataFrame:
        return feeds.corpus_counts(n_sources=self.corpus.sources, n_documents=self.corpus.documents, n_chunks=self.corpus.chunks)


def new_key(keys: DataFrame, name: str, now: Column, expires: Column | None = None) -> tuple[DataFrame, str]:
    """The key table with a new key, and the key itself, which is kept nowhere: only its digest and first characters."""
    key = secrets.token_hex(32)
    row = keys.sparkSession.range(1).select(F.lit(key).alias("k"))
    values = {"id": tx.content_hash(F.concat("k", F.lit("id"))), "name": F.lit(name), "key_hash": tx.content_hash(F.col("k")), "key_prefix": tx.key_prefix(F.col("k")), "created_at": now, "expires_at": expires if expires is not None else F.lit(None), "enabled": F.lit(True)}
    row = row.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in keys.schema))
    return keys.unionByName(row), key


def revoke(keys: DataFrame, key_id: str) -> DataFrame:
    if not keys.where(F.col("id") == key_id).take(1):
        raise schema.NotFound(f"no key {key_id}")
    return state.set_where(keys, F.col("id") == key_id, "enabled", F.lit(False))


def touch(keys: DataFrame, key: str, now: Column) -> DataFrame:
    """The key table with the time of a key's use."""
    return state.set_where(keys, F.col("key_hash") == F.sha2(F.lit(key), 256), "last_used_at", now)
