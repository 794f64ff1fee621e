"""Chunkers: one text to an array of chunks, as columns; ``exploded`` makes rows of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import strip, token_estimate

#: What opens a section; the first form that occurs in a text is used for all of it.
SECTION_OPENINGS = (r"\n\s*§\s*\d+[a-z]?\s+", r"\n\s*Art(?:ikel)?\.\s*\d+\s+", r"\n\s*Artikel\s+\d+\s+", r"\n\s*\([0-9]+\)\s+")
#: How an article of law begins.
ARTICLES = ("Artikel", "Article", "Art.")
MARK = "\x01"


def paragraphs(text: Column, sep: str = "\n\n", longer_than: int = 50, cut: int | None = 5000, whole_line: bool = False) -> Column:
    """Array of content, reference and tokens of the paragraphs longer than a bound, in order.

    The reference is what stands before the first hyphen of the first line of a paragraph that opens an article;
    with ``whole_line`` all of that line."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), sep), strip), lambda p: F.char_length(p) > longer_than)

    def one(p: Column) -> Column:
        opens = p.startswith(ARTICLES[0]) | p.startswith(ARTICLES[1]) | p.startswith(ARTICLES[2])
        line = F.substring_index(p, "\n", 1)
        line = line if whole_line else F.substring_index(line, "-", 1)
        return F.struct((F.substring(p, 1, cut) if cut else p).alias("content"), F.when(opens, strip(line)).alias("reference"), token_estimate(p).alias("tokens"))

    return F.transform(parts, one)


def sections(text: Column) -> Column:
    """Array of sections, each from its opening to the next one. What stands before the first opening is left out,
    and so is a first section that starts the text. Without any opening: the paragraphs."""
    out = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    for form in reversed(SECTION_OPENINGS):
        marked = F.split(F.regexp_replace(text, f"({form})", f"{MARK}$1"), MARK)
        # a marker at the very start leaves an empty piece, and that first section is dropped with it
        kept = F.slice(marked, F.when(text.rlike(r"\A" + form), 3).otherwise(2), F.size(marked))
        out = F.when(text.rlike(form), F.filter(F.transform(kept, strip), lambda p: p != "")).otherwise(out)
    return F.coalesce(out, F.array().cast("array<string>"))


def windows(n: Column, size: int, overlap: int) -> Column:
    """Array of start and end of overlapping windows over n items: one if all fits, the last one ends with n."""
    step = size - overlap
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step)), lambda s: F.struct(s.cast("int").alias("start"), F.least(s + size, n).cast("int").alias("end")))
    one = F.array(F.struct(F.lit(0).alias("start"), n.cast("int").alias("end")))
    return F.when(n <= 0, F.slice(one, 1, 0)).when(n <= size, one).otherwise(many)


def word_windows(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Array of start, end and content over the words of a text."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.transform(F.array(words), lambda w: F.transform(windows(F.size(w), size, overlap), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.array_join(F.slice(w, x["start"] + 1, x["end"] - x["start"]), " ").alias("content"))))[0]


def char_windows(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Array of start and content at every (size - overlap)th character; blank ones are left out."""
    n = F.char_length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda s: F.struct(s.alias("start"), strip(F.substring(text, s + 1, F.lit(size))).alias("content"))), lambda x: x["content"] != "")


def bounded(text: str, most: int, sizer: Callable[[str], int], overlap: int = 0) -> list[str]:
    """Pieces of at most ``most`` tokens, cut at the highest level that fits: paragraphs, lines, sentences, words,
    characters; neighbouring pieces are joined while they fit. With overlap, words from the end of a piece lead the next."""
    import re

    if not text or not text.strip():
        return []
    levels = (r"\n\s*\n", r"\n", r"(?<=[.!?;])\s+", r"\s+")

    def cut(part: str, level: int) -> list[str]:
        part = part.strip()
        if not part:
            return []
        if sizer(part) <= most:
            return [part]
        if level == len(levels):
            half = len(part) // 2
            return cut(part[:half], level) + cut(part[half:], level) if half else [part]
        out: list[str] = []
        joint = ("\n\n", "\n", " ", " ")[level]
        for piece in re.split(levels[level], part):
            for small in cut(piece, level + 1):
                if out and sizer(out[-1] + joint + small) <= most:
                    out[-1] += joint + small
                else:
                    out.append(small)
        return out

    found = cut(text, 0)
    if overlap:
        for i in range(len(found) - 1, 0, -1):
            words = found[i - 1].split()
            lead: list[str] = []
            while words and sizer(" ".join([words[-1], *lead])) <= overlap and sizer(" ".join([words[-1], *lead, found[i]])) <= most:
                lead.insert(0, words.pop())
            found[i] = " ".join([*lead, found[i]])
    return found


def quarter(text: str) -> int:
    return -(-len(text) // 4)


def bpe_sizer(path: str, pattern: str) -> Callable[[str], int]:
    """Counts tokens by a rank file (base64 token and rank a line), where one is there; ``quarter`` needs none."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("sizer", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def semantic(most: int = 512, overlap: int = 0, sizer: Callable[[str], int] = quarter):
    """A function column -> array of content and tokens, cut by ``bounded`` in Arrow batches."""

    kind = pa.list_(pa.struct([("content", pa.string()), ("tokens", pa.int64())]))

    @F.arrow_udf("array<struct<content:string,tokens:long>>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            for texts in pieces(part):
                yield pa.array([[(c, sizer(c)) for c in bounded(t or "", most, sizer, overlap)] for t in texts.to_pylist()], kind)

    return run


def pieces(texts: pa.Array, most: int = 1_000_000) -> Iterator[pa.Array]:
    """Texts cut so that those of one piece take about so many bytes; a longer text is a piece of its own."""
    at, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if total and total + n > most:
            yield texts.slice(at, i - at)
            at, total = i, 0
        total += n
    yield texts.slice(at)


def exploded(docs: DataFrame, chunks: Column, *keep: str, index: str = "chunk_index") -> DataFrame:
    """A row for each chunk, numbered from 0 in each document, with the columns to keep."""
    return docs.select(*keep, F.posexplode(chunks).alias(index, "_chunk")).select(*keep, index, "_chunk.*" if _is_struct(docs, chunks) else F.col("_chunk").alias("content"))


def _is_struct(docs: DataFrame, chunks: Column) -> bool:
    return docs.select(chunks.alias("x")).schema["x"].dataType.elementType.typeName() == "struct"


def sectioned(docs: DataFrame, column: str, *keep: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """Chunks of sections that were parsed before (number, title, text): windows of each, the section's data on all."""
    parts = docs.select(*keep, F.explode(column).alias("s")).where(strip(F.coalesce("s.text", F.lit(""))) != "")
    return parts.select(*keep, F.col("s.number").alias("section_number"), F.col("s.title").alias("section_title"), F.posexplode(word_windows(F.col("s.text"), size, overlap)).alias("part", "w")).select(
        *keep, "section_number", "section_title", "part", "w.*"
    )
