"""Documents to chunks with character offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.functions.text import chunk_spans, token_estimate


def chunk(docs: DataFrame, text_col: str, max_chars: int = 4000, overlap: int = 200, split_on: str = "paragraph") -> DataFrame:
    """The other columns of ``docs`` with chunk_index, content, char_start, char_end and token_count: a row for each chunk."""
    keep = [c for c in docs.columns if c != text_col]
    spans = docs.select(*keep, F.col(text_col).alias("_text"), F.posexplode(chunk_spans(F.col(text_col), max_chars, overlap, split_on)).alias("chunk_index", "_span"))
    content = F.expr("substring(_text, _span.start + 1, _span.end - _span.start)")
    return spans.select(*keep, "chunk_index", content.alias("content"), F.col("_span.start").alias("char_start"), F.col("_span.end").alias("char_end")).withColumn("token_count", token_estimate(F.col("content")))
