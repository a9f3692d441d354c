"""Keyword in context over a stream of documents, and keyword counts by event time.

Token arrays need no state, so the batch plan runs unchanged on ``readStream``. Counts use a watermark; rows
later than it are left out, as always in append mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cqp import parse_or_words
from ..plans.kwic import kwic, match_starts
from ..sources.text import from_documents, tokens_of


def kwic_stream(docs: DataFrame, query: str, left: int = 20, right: int = 20, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The lines of ``plans.kwic.kwic``, without line numbers, as documents arrive."""
    return kwic(from_documents(docs, text_col, id_col, sentences=False), query, left, right)


def keyword_counts(docs: DataFrame, query: str, ts_col: str = "ts", text_col: str = "text", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``(window, hits)``: matches of a query per window of event time."""
    parts = parse_or_words(query)
    toks = docs.withWatermark(ts_col, late).select(ts_col, tokens_of(F.col(text_col)).alias("toks"))
    hits = toks.select(ts_col, F.size(match_starts(parts, F.col("toks"))).cast("long").alias("n"))
    return hits.groupBy(F.window(ts_col, window)).agg(F.sum("n").alias("hits"))
