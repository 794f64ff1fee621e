"""Functions of the package under names that SQL can use."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from statuta.functions import chunk, markup


def register(spark: SparkSession) -> None:
    """html_markdown_text(html), html_clean_text(html) and the table function bounded_chunks(text, most)."""

    @F.pandas_udf("string")
    def as_markdown(html: pd.Series) -> pd.Series:
        return html.map(lambda x: markup.markdown(x) if x else None)

    @F.pandas_udf("string")
    def as_text(html: pd.Series) -> pd.Series:
        return html.map(lambda x: markup.clean_text(x) if x else None)

    @F.udtf(returnType="chunk_index int, content string, tokens int")
    class Chunks:
        def eval(self, text: str, most: int) -> Iterator[tuple]:
            for i, c in enumerate(chunk.bounded(text or "", most, chunk.quarter)):
                yield i, c, chunk.quarter(c)

    spark.udf.register("html_markdown_text", as_markdown)
    spark.udf.register("html_clean_text", as_text)
    spark.udtf.register("bounded_chunks", Chunks)
