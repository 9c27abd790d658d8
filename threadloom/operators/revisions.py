"""Content-addressed revisions and the current-revision view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import domain_id


#: Fields of a header and of a node, besides the ids and the text, that make a new revision when they change.
HEADER_FIELDS = ["source_type", "source_id", "title", "namespace", "current_node", "created_at", "updated_at", "metadata"]
NODE_FIELDS = ["created_at", "updated_at", "content", "metadata", "children", "model_slug", "raw"]


def node_digest(*columns: str) -> Column:
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def segment_hashes(nodes: DataFrame, key: str = "conversation_id") -> DataFrame:
    """``(key, segment_hash, node_count)`` over ``nodes(key, node_id, parent_id, role, text, ...)``.

    A hash of hashes in two levels: nodes fall into up to 4096 buckets by their own digest, so no task
    ever holds all nodes of one conversation, and the texts are reduced to digests before the shuffle.
    A node that was read twice counts once.
    """
    carried = [c for c in NODE_FIELDS if c in nodes.columns]
    digests = nodes.select(key, node_digest("node_id", "parent_id", "role", "text", *carried).alias("_h"))
    buckets = (
        digests.groupBy(key, F.substring("_h", 1, 3).alias("_bucket"))
        .agg(F.sort_array(F.collect_set("_h")).alias("_all"))
        .select(key, "_bucket", F.sha2(F.array_join("_all", ""), 256).alias("_h"), F.size("_all").alias("_n"))
    )
    return buckets.groupBy(key).agg(
        F.sha2(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_bucket", "_h"))), lambda b: b["_h"]), ""),
            256,
        ).alias("segment_hash"),
        F.sum("_n").cast("bigint").alias("node_count"),
    )


def revisions(headers: DataFrame, nodes: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Add ``segment_hash, segment_id, content_hash, revision_id, node_count`` to conversation headers.

    ``headers(conversation_id, ...)``; the whole header and all nodes decide, so equal content gives equal ids
    and a segment belongs to one conversation.  ``key`` is
    the column that ties nodes to headers, when there are several versions of a conversation.
    """
    hashed = headers.join(segment_hashes(nodes, key), key)
    fields = [F.col(c) if c in headers.columns else F.lit("") for c in HEADER_FIELDS]
    header = domain_id("header", F.col("conversation_id"), *fields)
    return (
        hashed.withColumn("segment_id", domain_id("segment", header, F.col("segment_hash")))
        .withColumn("content_hash", domain_id("revision-content", F.col("segment_id")))
        .withColumn("revision_id", domain_id("revision", F.col("conversation_id"), F.col("content_hash")))
    )


def current_view(log: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """The newest revision of each conversation that is not deleted.

    Newest by ``updated_at`` (null is oldest); of equal ones the later write (``seq``) wins.
    """
    fields = [c for c in log.columns if c != "conversation_id"]
    order = F.struct(F.coalesce(F.col("updated_at"), F.timestamp_millis(F.lit(-(1 << 50)))), F.col("seq"))
    newest = log.groupBy("conversation_id").agg(F.max_by(F.struct(*fields), order).alias("_r"))
    newest = newest.select("conversation_id", "_r.*")
    if tombstones is None:
        return newest
    return newest.join(tombstones.select("conversation_id"), "conversation_id", "left_anti")
