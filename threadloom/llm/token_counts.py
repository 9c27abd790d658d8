"""Exact token counts from a length histogram.

Documents are aggregated by encoded length. Suffix sums over the histogram then answer, for every context
limit, how many tokens a truncation keeps, and the totals and quantiles, without another look at a text.

A null text has zero tokens, like an empty one; repeated rows count each. An empty table has an empty
histogram. Only the text is read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import encode
from .common import source

#: Lengths per block of the two-level suffix sums; no window holds more rows than this.
BLOCK = 1024


def token_length(text: Column, path: str, pattern: str) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series(encode.rank_counts(series.fillna(""), path, pattern), dtype="int64")

    return run(text)


def histogram(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``n_tokens, n_docs``: one row per encoded length."""
    lengths = docs.select(token_length(F.col(text), path, pattern).alias("n_tokens"))
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """For every length as a context limit: totals up to it, from it on, and after truncation.

    ``n_docs_from`` counts documents at least as long as the limit; ``tokens_truncated`` is what all
    documents keep when each is cut at the limit; ``quantile`` is the share of documents within it.
    """
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn(
        "tokens", F.col("n_tokens") * F.col("n_docs")
    )
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    # one row per 1024 lengths: bounded by the longest document, not by the number of documents
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(after), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("b_tokens").over(after), F.lit(0)).alias("tokens_above"),
        F.sum("b_docs").over(Window.partitionBy()).alias("all_docs"),
        F.sum("b_tokens").over(Window.partitionBy()).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    docs_from = F.sum("n_docs").over(within) + F.col("docs_above")
    tokens_from = F.sum("tokens").over(within) + F.col("tokens_above")
    return (
        hist.join(above, "block")
        .withColumn("n_docs_from", docs_from)
        .withColumn("tokens_from", tokens_from)
        .select(
            F.col("n_tokens").alias("context_limit"),
            "n_docs",
            "n_docs_from",
            "tokens_from",
            (F.col("all_tokens") - F.col("tokens_from") + F.col("n_docs_from") * F.col("n_tokens")).alias(
                "tokens_truncated"
            ),
            ((F.col("all_docs") - F.col("n_docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
            F.col("all_docs").alias("total_docs"),
            F.col("all_tokens").alias("total_tokens"),
        )
    )


def truncated_total(limits_table: DataFrame, limit: int) -> DataFrame:
    """One row ``tokens``: what all documents keep when cut at any ``limit``, also one that no length equals."""
    at = limits_table.filter(F.col("context_limit") >= limit).orderBy("context_limit").limit(1)
    tokens = F.col("total_tokens") - F.col("tokens_from") + F.col("n_docs_from") * limit
    whole = limits_table.agg(F.max("total_tokens").alias("whole"))
    return whole.join(at.select(tokens.alias("cut")), F.lit(True), "left").select(
        F.coalesce("cut", "whole", F.lit(0)).alias("tokens")
    )


def quantiles(limits_table: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the least length that this share of the documents does not exceed."""
    columns = [F.min(F.when(F.col("quantile") >= s, F.col("context_limit"))).alias(str(i)) for i, s in enumerate(shares)]
    row = limits_table.agg(*columns)
    pairs = F.array(*[F.struct(F.lit(s).alias("share"), F.col(str(i)).alias("n_tokens")) for i, s in enumerate(shares)])
    return row.select(F.inline(pairs))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Suffix sums for every context limit over all documents."""
    import public_tokenizers

    docs = source(spark, sf_dir, "documents")
    return limits(histogram(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
