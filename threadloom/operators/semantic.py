"""Vector channel: query concepts and variants, embedding hook, exact cosine top-k, merging."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import fixed, text as tx
from .lexical import top_k

BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 128 * 1024 * 1024


# --------------------------------------------------------------------------- query variants


def _plain(phrase: str) -> Column:
    return tx.lit_strings(list(dict.fromkeys(phrase.split())))


def query_words(raw: Column) -> Column:
    """Distinct letter-digit runs of the lower-cased query."""
    return F.array_distinct(F.regexp_extract_all(F.lower(tx.nfkc(raw)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def _covered(needed: Column, present: Column) -> Column:
    return F.size(F.array_except(needed, present)) == 0


def concept_names(present: Column) -> Column:
    """Concepts of which at least one phrase has all its words in ``present``."""
    checks = []
    for name, phrases, _ in fixed.CONCEPTS:
        some = F.lit(False)
        for phrase in phrases:
            some = some | _covered(_plain(phrase), present)
        checks.append(F.when(some, F.lit(name)))
    return F.filter(F.array(*checks), lambda c: c.isNotNull())


def query_variants(queries: DataFrame) -> DataFrame:
    """``(query_id, variant_no, variant)``: the trimmed query, and the query with concept labels added.

    Labels already covered by the query are left out; labels are added while they fit the anchor budget.
    """
    rows = queries.select("query_id", tx.js_trim(F.col("query")).alias("_q")).filter("_q <> ''")
    rows = rows.withColumn("_w", query_words(F.col("_q"))).withColumn("_c", concept_names(F.col("_w")))
    labels = F.filter(
        F.array(
            *[
                F.when(
                    F.array_contains("_c", name) & ~_covered(_plain(label), F.col("_w")),
                    F.struct(F.lit(label).alias("label"), F.lit(len(set(label.split()))).alias("n")),
                )
                for name, _, label in fixed.CONCEPTS
            ]
        ),
        lambda label: label.isNotNull(),
    )
    rows = rows.withColumn("_l", labels)
    # keep the longest prefix of labels that fits
    used = F.aggregate("_l", F.lit(0), lambda acc, x: acc + x["n"])
    running = F.transform(
        "_l", lambda x, i: F.aggregate(F.slice("_l", 1, i + 1), F.lit(0), lambda acc, y: acc + y["n"])
    )
    kept = F.when(used <= fixed.MAX_ANCHOR_TOKENS, F.col("_l")).otherwise(
        F.slice("_l", 1, F.size(F.filter(running, lambda n: n <= fixed.MAX_ANCHOR_TOKENS)))
    )
    rows = rows.withColumn("_k", F.transform(kept, lambda x: x["label"]))
    variants = F.when(F.size("_k") == 0, F.array("_q")).otherwise(
        F.array(F.col("_q"), F.concat_ws(" ", "_q", "_k"))
    )
    return rows.select("query_id", F.posexplode(variants).alias("variant_no", "variant"))


# --------------------------------------------------------------------------- vectors


def embed(
    df: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray], output: str = "embedding", batch: int = 32
) -> DataFrame:
    """Add a vector column made by ``encode`` (a picklable function of a list of texts), batch by batch."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows: list = []
            for at in range(0, len(texts), batch):
                part = list(texts.iloc[at : at + batch])
                vectors = np.asarray(encode(part), dtype=np.float32)
                if vectors.ndim != 2 or len(vectors) != len(part):
                    raise ValueError("encoder must return one row per text")
                rows.extend(vectors)
            yield pd.Series(rows, dtype=object)

    return df.withColumn(output, run(F.col(text)))


def is_valid_vector(vector: Column, dimensions: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) == dimensions) & finite


def upsert_vectors(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` replaces rows with the same ``vector_id``."""
    fresh = incoming.dropDuplicates(["vector_id"])
    return existing.join(fresh.select("vector_id"), "vector_id", "left_anti").unionByName(fresh)


def supersede(vectors: DataFrame, indexed: DataFrame, generation_id: str) -> DataFrame:
    """Drop vectors of other generations whose revision is indexed in ``generation_id``."""
    done = indexed.select("revision_id").distinct().withColumn("_done", F.lit(True))
    return (
        vectors.join(done, "revision_id", "left")
        .filter(F.col("_done").isNull() | (F.col("generation_id") == generation_id))
        .drop("_done")
    )


RESULT = "query_id string, variant_no int, chunk_id string, score double"


def _unit(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


#: Scores that a task holds at once.
SCORES = 4_000_000


def _best(chunk_ids, owners, spaces, vectors, queries: pd.DataFrame, units: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """The best rows of one block of chunks for each query, within the query's scope and limit.

    Queries are taken some at a time, so that the scores in memory stay the same for any number of them; ``units``
    are their unit vectors, if they were made before.
    """
    matrix = _unit(vectors)
    names = np.asarray(chunk_ids).astype(str)
    units = _unit(queries["vector"]) if units is None else units
    step = max(1, SCORES // max(1, len(matrix)))
    scopes: dict = {}
    for start in range(0, len(queries), step):
        scores = matrix @ units[start : start + step].T
        np.round(scores, 9, out=scores)
        parts = []
        for column, q in enumerate(queries.iloc[start : start + step].itertuples(index=False)):
            scope = (q.user_id, None if q.namespaces is None else tuple(q.namespaces))
            if scope not in scopes:
                mask = np.ones(len(names), dtype=bool)
                if q.user_id is not None:
                    mask &= owners == q.user_id
                if q.namespaces is not None and len(q.namespaces):
                    mask &= np.isin(spaces, list(q.namespaces))
                scopes[scope] = np.flatnonzero(mask)
            at = scopes[scope]
            if len(at) > q.top:
                edge = np.partition(scores[at, column], len(at) - q.top)[len(at) - q.top]
                at = at[scores[at, column] >= edge]
                at = at[np.lexsort((names[at], -scores[at, column]))][: q.top]
            parts.append((q.query_id, q.variant_no, at, scores[at, column]))
        if parts:
            sizes = [len(at) for _, _, at, _ in parts]
            yield pd.DataFrame(
                {
                    "query_id": np.repeat(np.array([p[0] for p in parts], dtype=object), sizes),
                    "variant_no": np.repeat(np.array([p[1] for p in parts]), sizes),
                    "chunk_id": names[np.concatenate([p[2] for p in parts])].astype(object),
                    "score": np.concatenate([p[3] for p in parts]),
                }
            )


def _as_text(series: pd.Series) -> np.ndarray:
    return series.fillna("").astype(str).to_numpy(dtype=object)


def vector_top_k(vectors: DataFrame, queries: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact cosine top-k: ``(query_id, variant_no, chunk_id, score)``.

    ``vectors(chunk_id, owner, namespace, embedding)``,
    ``queries(query_id, variant_no, vector, top, namespaces, user_id)`` with any ``top``.
    Each task multiplies its block of vectors with all query vectors and keeps the best of the block, so
    only a few rows per block and query are shuffled.  Query vectors up to ``broadcast_bytes`` are sent to
    every task; more are met block by block in a grouped join.
    """
    wanted = queries.select("query_id", "variant_no", "vector", "top", "namespaces", "user_id")
    stats = wanted.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max("top")).first()
    count, dims = int(stats[0]), int(stats[1] or 0)
    # ids, scopes and Python objects come on top of eight bytes per number
    query_bytes = count * (dims * 8 + 512)
    slim = vectors.select("chunk_id", "owner", "namespace", "embedding")
    if query_bytes <= broadcast_bytes:
        local = wanted.toPandas()  # bounded by the check above

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            units = _unit(local["vector"]) if len(local) else None
            for batch in batches:
                if len(batch) and len(local):
                    yield from _best(
                        batch["chunk_id"].to_numpy(), _as_text(batch["owner"]), _as_text(batch["namespace"]),
                        batch["embedding"], local, units,
                    )

        found = slim.mapInPandas(scan, RESULT)
    else:
        rows = slim.count()
        q_blocks = math.ceil(query_bytes / broadcast_bytes)
        v_blocks = max(1, math.ceil(rows * (dims * 8 + 128) / block_bytes))
        left = slim.withColumn("_v", F.pmod(F.xxhash64("chunk_id"), F.lit(v_blocks))).withColumn(
            "_q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
        )
        right = wanted.withColumn("_q", F.pmod(F.xxhash64("query_id", "variant_no"), F.lit(q_blocks)).cast("int")).withColumn(
            "_v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(v_blocks - 1).cast("bigint")))
        )

        def meet(block: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            if not len(block) or not len(some):
                return pd.DataFrame({"query_id": [], "variant_no": [], "chunk_id": [], "score": []})
            found = _best(
                block["chunk_id"].to_numpy(), _as_text(block["owner"]), _as_text(block["namespace"]),
                block["embedding"], some,
            )
            return pd.concat(found, ignore_index=True)

        found = left.groupBy("_v", "_q").cogroup(right.groupBy("_v", "_q")).applyInPandas(meet, RESULT)
    limits = queries.select("query_id", "variant_no", "top")
    best = top_k_variant(found.join(limits, ["query_id", "variant_no"]), int(stats[2] or 1))
    return best.select("query_id", "variant_no", "chunk_id", "score")


def top_k_variant(found: DataFrame, most: int) -> DataFrame:
    keyed = found.withColumn("_id", F.col("query_id")).withColumn("query_id", F.struct("_id", "variant_no"))
    ranked = top_k(keyed, F.col("top"), most, [F.col("score").desc(), F.col("chunk_id")], "semantic_rank")
    return ranked.withColumn("query_id", F.col("_id")).drop("_id")


def merge_variants(found: DataFrame) -> DataFrame:
    """Best raw score per chunk over all variants of a query; scores of zero or less are dropped."""
    best = found.groupBy("query_id", "chunk_id").agg(F.max("score").alias("semantic_raw"))
    return best.filter("semantic_raw > 0")


def normalized_score(raw: Column) -> Column:
    span = (raw - fixed.SEMANTIC_MIN_SCORE) / fixed.SEMANTIC_SPAN
    scaled = 0.5 + 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), span))
    return F.when(raw >= fixed.SEMANTIC_MIN_SCORE, scaled).otherwise(F.lit(0.0))
