"""Text signals of chunks, made when chunks are indexed and addressed by a digest of the text.

A search reads them by digest and analyses no chunk text.  Equal texts share one row, whatever chunk,
revision or generation they belong to, so indexing again analyses only texts that were never seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import chunk_signals, snippet

KEY = "text_key"


def text_key(title: Column, body: Column) -> Column:
    """Digest of title and body; a null counts as empty."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat_ws("\0", F.length(part(title)).cast("string"), part(title), part(body)), 256)


def keyed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn(KEY, text_key(F.col("title"), F.col("body")))


def analysed(chunks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(text_key, t_...)``, and the ``snippet``, of every text of ``chunks(title, body)`` that ``known(text_key)`` lacks."""
    texts = keyed(chunks.select("title", "body"))
    if known is not None:
        texts = texts.join(known.select(KEY), KEY, "left_anti")
    texts = texts.dropDuplicates([KEY])
    return chunk_signals(texts.withColumn("snippet", snippet(F.col("body")))).drop("title")


def extended(known: DataFrame, chunks: DataFrame) -> DataFrame:
    """``known`` and the signals of the texts of ``chunks`` that it lacks."""
    return known.unionByName(analysed(chunks, known))
