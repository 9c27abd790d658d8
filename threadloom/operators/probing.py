"""Approximate vector search: coarse lists, pruned probes and exact scores.

Centroids are learnt on a bounded sample and every vector is stored under its nearest one, in a table
partitioned by list.  A query reads the lists nearest to it only; what it finds there has exact scores.
The number of lists to read is measured against the exact search (:func:`calibrate`).  A query that finds
fewer rows than it asked for, because its scope is narrow, is answered by the exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import durable
from . import semantic
from .semantic import _as_text, _best, _unit  # by name: tasks must not get the module, which may hold bound functions

#: The sample that centroids are learnt on, in bytes of its vectors, and the most lists of an index.
SAMPLE_BYTES = 32 * 1024 * 1024
MOST_LISTS = 4096
#: Rows of one list that are written by one task.
FILE_ROWS = 200_000
STORED = ["chunk_id", "owner", "namespace", "embedding"]


@dataclass(frozen=True)
class ProbeIndex:
    """``vectors(chunk_id, owner, namespace, embedding, list)``, partitioned by ``list``; one row of
    ``centroids`` and one number of ``sizes`` per list."""

    vectors: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray


def learn(vectors: DataFrame, lists: int | None = None, sample_bytes: int = SAMPLE_BYTES, rounds: int = 12) -> np.ndarray:
    """Unit centroids of spherical k-means over the vectors with the least hashes of their ids.

    About the square root of the number of vectors, or ``lists``, but no more than a quarter of the sample.
    """
    usable = vectors.filter(F.col("embedding").isNotNull())
    stats = usable.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    count, dims = int(stats[0]), int(stats[1] or 0)
    if not count:
        return np.zeros((1, 0), np.float64)
    rows = max(4, sample_bytes // (8 * max(1, dims)))
    taken = usable.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(rows).select("embedding").toPandas()
    points = _unit(taken["embedding"])
    wanted = lists or round(math.sqrt(count))
    wanted = max(1, min(wanted, MOST_LISTS, len(points) // 4))
    centres = points[np.linspace(0, len(points) - 1, wanted).astype(int)]
    for _ in range(rounds):
        near = points @ centres.T
        home = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, points)
        # a list that nothing is nearest to starts again at a point far from its centre
        empty = np.flatnonzero(np.bincount(home, minlength=wanted) == 0)
        sums[empty] = points[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        centres = _unit(sums)
    return centres


def nearest(vector: Column, centroids: np.ndarray, count: int) -> Column:
    """The ``count`` lists nearest to a vector, the nearest first."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            order = np.argsort(-(_unit(batch) @ centroids.T), axis=1, kind="stable")[:, :count]
            yield pd.Series(list(order.astype(np.int32)), dtype=object)

    return run(vector)


def build(vectors: DataFrame, path: str, centroids: np.ndarray | None = None) -> ProbeIndex:
    """Write every vector of ``vectors`` (see ``STORED``) under its list; rows without a vector are left out.

    A large list is dealt to several tasks by a hash of the ids.
    """
    centroids = learn(vectors) if centroids is None else centroids
    rows = vectors.select(*STORED).filter(F.col("embedding").isNotNull())
    placed = rows.withColumn("list", nearest(F.col("embedding"), centroids, 1)[0])
    sizes = np.zeros(len(centroids), np.int64)
    for row in placed.groupBy("list").count().collect():  # one row per list
        sizes[row["list"]] = row["count"]
    parts = F.array(*[F.lit(math.ceil(int(n) / FILE_ROWS) or 1) for n in sizes])
    part = F.pmod(F.xxhash64("chunk_id"), F.element_at(parts, F.col("list") + 1))
    placed.repartition("list", part).write.mode("overwrite").partitionBy("list").parquet(path)
    schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())])
    return ProbeIndex(vectors.sparkSession.read.schema(schema).parquet(path), centroids, sizes)


def probed(index: ProbeIndex, queries: DataFrame, probes: int, broadcast_bytes: int = semantic.BROADCAST_BYTES) -> DataFrame:
    """``(query_id, variant_no, chunk_id, score)`` from the lists nearest to each query, before the limit is applied."""
    asked = queries.select("query_id", "variant_no", "vector", "top", "namespaces", "user_id").withColumn(
        "lists", nearest(F.col("vector"), index.centroids, probes)
    )
    stats = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    count, dims = int(stats[0]), int(stats[1] or 0)
    read = [r[0] for r in asked.select(F.explode("lists")).distinct().collect()]  # at most one row per list
    rows = index.vectors.filter(F.col("list").isin(read)) if read else index.vectors.limit(0)
    query_bytes = count * (dims * 8 + 512 + 4 * probes)
    if query_bytes <= broadcast_bytes:
        local = asked.toPandas()  # bounded by the check above
        # numbers only: the queries of a list are picked when the list is read, not kept for every list
        lists = np.array(local.pop("lists").tolist(), dtype=np.int32).reshape(len(local), -1)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at, block in batch.groupby("list"):
                    yield from _scored(block, local[(lists == at).any(axis=1)])

        return rows.mapInPandas(scan, semantic.RESULT)
    # many queries: blocks of a list meet blocks of the queries that read it
    parts = F.array(*[F.lit(math.ceil(int(n) / FILE_ROWS) or 1) for n in index.sizes])
    slots = F.element_at(parts, F.col("list") + 1)
    blocks = math.ceil(query_bytes / broadcast_bytes)
    left = rows.withColumn("_v", F.pmod(F.xxhash64("chunk_id"), slots).cast("int")).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    right = asked.withColumn("list", F.explode("lists")).drop("lists")
    right = right.withColumn("_q", F.pmod(F.xxhash64("query_id", "variant_no"), F.lit(blocks)).cast("int")).withColumn(
        "_v", F.explode(F.sequence(F.lit(0), slots - 1))
    )
    keys = ["list", "_v", "_q"]

    def meet(block: pa.Table, some: pa.Table) -> pa.Table:
        found = pd.concat([NOTHING, *_scored(block.to_pandas(), some.to_pandas())], ignore_index=True)
        kinds = {"query_id": pa.string(), "variant_no": pa.int32(), "chunk_id": pa.string(), "score": pa.float64()}
        return pa.table({name: pa.array(found[name].tolist(), kind) for name, kind in kinds.items()})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, semantic.RESULT)


NOTHING = pd.DataFrame({"query_id": [], "variant_no": [], "chunk_id": [], "score": []}, dtype=object)


def _scored(block: pd.DataFrame, asked: pd.DataFrame) -> Iterator[pd.DataFrame]:
    if len(block) and len(asked):
        yield from _best(
            block["chunk_id"].to_numpy(), _as_text(block["owner"]), _as_text(block["namespace"]), block["embedding"], asked
        )


def search(index: ProbeIndex, queries: DataFrame, probes: int, broadcast_bytes: int = semantic.BROADCAST_BYTES) -> DataFrame:
    """Top rows of each query as in :func:`semantic.vector_top_k`, from ``probes`` lists per query.

    Queries that find fewer rows than their limit there are searched for in all lists.
    """
    if not index.sizes.sum():
        return queries.sparkSession.createDataFrame([], semantic.RESULT)
    probes = min(probes, len(index.centroids))
    limits = queries.select("query_id", "variant_no", "top")
    most = int(queries.agg(F.max("top")).first()[0] or 1)
    found = probed(index, queries, probes, broadcast_bytes).join(limits, ["query_id", "variant_no"])
    best = durable(semantic.top_k_variant(found, most).select("query_id", "variant_no", "chunk_id", "score"))
    enough = best.groupBy("query_id", "variant_no").agg(F.count(F.lit(1)).alias("_n"))
    short = queries.join(enough, ["query_id", "variant_no"], "left").filter(F.coalesce("_n", F.lit(0)) < F.col("top")).drop("_n")
    short = durable(short)
    if probes == len(index.centroids) or short.isEmpty():
        return best
    rest = semantic.vector_top_k(index.vectors, short, broadcast_bytes)
    return best.join(short, ["query_id", "variant_no"], "left_anti").unionByName(rest)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact rows that were found."""
    keys = ["query_id", "variant_no", "chunk_id"]
    total = exact.count()
    return exact.join(found, keys, "left_semi").count() / total if total else 1.0


def calibrate(index: ProbeIndex, queries: DataFrame, least: float = 0.95, most_queries: int = 200) -> tuple[int, float]:
    """The fewest lists, in steps of doubling, whose recall over ``queries`` reaches ``least``; and that recall.

    At most ``most_queries`` queries, those with the least hashes of their ids, are asked.
    """
    some = durable(queries.orderBy(F.xxhash64("query_id", "variant_no")).limit(most_queries))
    exact = durable(semantic.vector_top_k(index.vectors, some))
    probes, lists = 1, len(index.centroids)
    while True:
        reached = recall(search(index, some, probes), exact)
        if reached >= least or probes == lists:
            return probes, reached
        probes = min(2 * probes, lists)
