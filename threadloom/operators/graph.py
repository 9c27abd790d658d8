"""Message graphs: heads, active branch, alternate branches and anomalies.

Input ``nodes(<key>, node_id, parent_id, is_leaf)`` (one row per node) and
``heads(<key>, current_node)`` (one row per conversation or revision).

Branches are walked by pointer doubling on node ids: about log2(depth) equi-joins, no Python and no state
per conversation, so a chain of any length and a graph of any number of leaves are handled alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .scan import follow_pointers

ACTIVE = "active"


def resolve_heads(nodes: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """``(key, current_node, head, missing)``: where the active branch starts.

    A missing current node falls back to the last leaf by id, then to the last node by id.
    """
    last = nodes.groupBy(key).agg(
        F.max(F.when(F.col("is_leaf"), F.col("node_id"))).alias("_leaf"),
        F.max("node_id").alias("_last"),
    )
    found = nodes.select(key, F.col("node_id").alias("current_node"), F.lit(True).alias("_found"))
    return (
        last.join(heads.select(key, "current_node"), key, "left")
        .join(found, [key, "current_node"], "left")
        .select(
            key,
            "current_node",
            F.when(F.col("_found"), F.col("current_node"))
            .otherwise(F.coalesce("_leaf", "_last"))
            .alias("head"),
            (F.col("_found").isNull() & (F.coalesce("current_node", F.lit("")) != "")).alias("missing"),
        )
    )


def _positions(reach: DataFrame, keys: list[str]) -> DataFrame:
    """Turn distances from the start into positions counted from the far end."""
    length = reach.groupBy(*keys, "start").agg(F.max("dist").alias("_far"))
    return reach.join(length, [*keys, "start"]).withColumn("pos", F.col("_far") - F.col("dist"))


def _walk(nodes: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    here = heads.join(nodes.select(key).distinct(), key, "left_semi")
    edges = nodes.select(key, F.col("node_id").alias("node"), F.col("parent_id").alias("parent"))
    existing = nodes.select(key, F.col("node_id").alias("parent"), F.col("node_id").alias("next"))
    edges = edges.join(existing, [key, "parent"], "left").select(key, "node", "next", "parent")
    active = _positions(
        follow_pointers(edges, here.select(key, F.col("head").alias("start")), [key]), [key]
    )
    top = (
        active.filter("pos = 0")
        .join(edges, [key, "node"])
        .filter(F.coalesce("parent", F.lit("")) != "")
        .select(
            key,
            F.lit(None).cast("string").alias("branch_key"),
            F.lit(None).cast("bigint").alias("pos"),
            F.when(F.col("next").isNull(), F.concat(F.lit("dangling_parent:"), "parent"))
            .otherwise(F.concat(F.lit("cycle:"), "next"))
            .alias("node_id"),
            F.lit(None).cast("bigint").alias("sequence"),
        )
    )
    on_active = active.select(key, "node", F.col("pos").alias("sequence"))
    outside = edges.join(on_active, [key, "node"], "left_anti")
    leaves = nodes.filter("is_leaf").select(key, F.col("node_id").alias("start"))
    leaves = leaves.join(on_active.withColumnRenamed("node", "start"), [key, "start"], "left_anti")
    side = _positions(follow_pointers(outside, leaves, [key]), [key])
    side = side.join(on_active, [key, "node"], "left")

    def rows(df: DataFrame, branch_key) -> DataFrame:
        return df.select(
            key, branch_key.alias("branch_key"), "pos", F.col("node").alias("node_id"), "sequence"
        )

    return (
        rows(active.withColumn("sequence", F.col("pos")), F.lit(ACTIVE))
        .unionByName(rows(side, F.concat(F.lit("alternate:"), "start")))
        .unionByName(top)
    )


def _prepared(nodes: DataFrame, heads: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Ids only, one row per node (of repeated ones the least parent), and the heads."""
    slim = nodes.groupBy(key, "node_id").agg(F.min("parent_id").alias("parent_id"), F.max("is_leaf").alias("is_leaf"))
    slim = durable(slim)
    return slim, resolve_heads(slim, heads, key)


def branches(nodes: DataFrame, heads: DataFrame, key: str = "revision_id") -> DataFrame:
    """``(key, branch_key, pos, node_id, sequence)``: the active path, and one path per other leaf.

    Paths run from the root; alternate ones begin one ancestor before they leave the active path.
    ``sequence`` is the place of the node on the active path (null off it).
    """
    return _walk(*_prepared(nodes, heads, key), key).filter(F.col("branch_key").isNotNull())


def anomalies(nodes: DataFrame, heads: DataFrame, key: str = "revision_id") -> DataFrame:
    """``(key, anomaly)``: missing current node, cycle or dangling parent met on the active path."""
    slim, resolved = _prepared(nodes, heads, key)
    missing = resolved.filter("missing").select(
        key, F.concat(F.lit("current_node_missing:"), "current_node").alias("anomaly")
    )
    walked = _walk(slim, resolved, key).filter(F.col("branch_key").isNull())
    return missing.unionByName(walked.select(key, F.col("node_id").alias("anomaly")))


def active_sequence(walked: DataFrame, key: str = "revision_id") -> DataFrame:
    """``(key, node_id, sequence)`` for the nodes of the active path."""
    return walked.filter(F.col("branch_key") == ACTIVE).select(
        key, "node_id", F.col("pos").alias("sequence")
    )
