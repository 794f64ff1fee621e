"""Token counts by a map-side two-tier lookup; no pre-token is ever shuffled.

Tier one is a compact table of the most frequent pre-tokens and their lengths in tokens, broadcast to all
workers; tier two is a bounded cache in each worker for the rest. The table's entries come from per-partition
summaries of fixed size, so neither the table nor what it is made from grows with the vocabulary.

A pre-token is a run of spaces with the bytes up to the next space. That is where a sentencepiece BPE model may
be cut if its normaliser is the identity and no piece holds a space mark behind another character; both are
checked on the model, and where they fail each text is encoded whole.

Defined results: null and empty text have 0 bytes and 0 tokens; a very long text is counted whole;
repeated rows are counted each; ties in the choice of frequent pre-tokens only change speed; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import prepare, slices, text_bytes

RUNS = re.compile(rb" +[^ ]*")
#: Entries that a partition's summary, the broadcast table and a worker's cache may have.
SUMMARY, TABLE, CACHE = 2048, 16384, 400_000


def pre_tokens(text: bytes) -> list[bytes]:
    """The pre-tokens of a text, each without its first space. A text counts as led by one space."""
    if not text:
        return []
    if b"  " in text or text[0] == 32 or text[-1] == 32:
        return [x[1:] for x in RUNS.findall(b" " + text)]
    return text.split(b" ")


class Lengths(dict):
    """Pre-token to length in tokens: the broadcast table, then what this worker met."""

    def __init__(self, path: str, frequent: dict[bytes, int]):
        super().__init__(frequent)
        self.frequent, self.model = frequent, sentencepiece.SentencePieceProcessor(model_file=path)
        lone = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.frequent[b""] = self[b""] = lone
        marks = [p.lstrip("▁") for p in map(self.model.id_to_piece, range(self.model.get_piece_size()))]
        self.splits = not any("▁" in p for p in marks) and self.model.normalize("ﬁ  a  A ") == "▁ﬁ▁ a▁▁A▁"

    def __missing__(self, key: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
            self.update(self.frequent)
        n = self[key] = len(self.model.encode(key.decode("utf-8", "replace")))
        return n

    def count(self, text: bytes) -> int:
        if not self.splits:
            return len(self.model.encode(text.decode("utf-8", "replace")))
        return sum(map(self.__getitem__, pre_tokens(text)))


_KEPT: dict[str, Lengths] = {}


def kept(mark: str, path: str, table) -> Lengths:
    """The worker's own lengths for a broadcast table, also for later tasks; those of another table go."""
    if mark not in _KEPT:
        _KEPT.clear()
        _KEPT[mark] = Lengths(path, dict(zip(*table.value, strict=True)))
    return _KEPT[mark]


def frequent_lengths(docs: DataFrame, text_col: str, path: str) -> tuple[list[bytes], list[int]]:
    """The most frequent pre-tokens of all texts, by sums of bounded summaries, and their lengths."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches, column=text_col):
            for text in text_bytes(batch, text_col):
                seen.update(pre_tokens(text))
            if len(seen) > CACHE:
                seen = Counter(dict(seen.most_common(CACHE // 4)))
        top = [x for x in seen.most_common(SUMMARY) if len(x[0]) <= 64]
        yield pa.record_batch({"piece": pa.array([k for k, _ in top], pa.binary()), "n": pa.array([n for _, n in top], pa.int64())})

    top = docs.select(text_col).mapInArrow(summary, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    keys = [bytes(r["piece"]) for r in top.orderBy(F.desc("n"), "piece").limit(TABLE).collect()]
    counted = Lengths(path, {})
    return keys, [counted[k] for k in keys]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 4096) -> DataFrame:
    """One row per document: its id, n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer or public_tokenizers.path("piece_bpe_32k.model")
    docs = docs.select(id_col, text_col)
    table, mark = spark.sparkContext.broadcast(frequent_lengths(docs, text_col, path)), uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = kept(mark, path, table)
        for batch in slices(batches, column=text_col):
            texts = text_bytes(batch, text_col)
            tokens = [lengths.count(t) for t in texts]
            yield pa.record_batch(
                {id_col: batch.column(id_col), "n_bytes": pa.array(map(len, texts), pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "over_limit": pa.array([n > limit for n in tokens], pa.bool_())}
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
