"""Packing by power-of-two decomposition.

A document of n tokens (its ids and the end id) becomes n // 2048 pieces of 2048 and one piece for each bit
of the rest, longest first. Each piece is a sequence of its own whose length is a power of two, so no
sequence crosses documents and none needs padding; equal lengths share a bucket and so a batch.

A null text is an empty one: one piece with the end id. Repeated rows are packed each. Other columns are
not read. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import encode
from .common import slices, source, table


def decompose(n: int, longest: int = 2048) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: powers of two, none above ``longest``, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]


def pieces(
    docs: DataFrame, path: str, longest: int = 2048, end_id: int = 1, with_ids: bool = False, text: str = "text"
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of every piece, and its ``ids`` if asked for."""
    if longest < 1 or longest & longest - 1:
        raise ValueError("the longest piece must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    names = [part.split()[0] for part in schema.split(", ")]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        for batch in slices(batches):
            out: list[list] = [[] for _ in names]
            doc_ids = batch.column(0).to_pylist()
            texts = (t or "" for t in batch.column(1).to_pylist())
            for doc_id, ids in zip(doc_ids, encode.word_ids(texts, path)):
                ids += end
                n, start = len(ids) // 4, 0
                for length in decompose(n, longest):
                    part = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, start, length, zlib.crc32(part), n)
                    for values, value in zip(out, row):
                        values.append(value)
                    if with_ids:
                        out[-1].append(np.frombuffer(part, "<i4"))
                    start += length
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

    return docs.select("doc_id", text).mapInArrow(run, schema)


def packed(docs: DataFrame, path: str, **options) -> DataFrame:
    """Pieces with ``sequence_id``, ``offset`` in the sequence and the ``bucket`` of equal lengths.

    The pieces are written first; ids numbered over a written table stay the same when a task runs again.
    """
    written = table(pieces(docs, path, **options))
    return (
        written.withColumn("sequence_id", F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
        .withColumn("bucket", F.col("length"))
    )


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of every document."""
    import public_tokenizers

    return packed(source(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
