"""The data model laid over the given tables.

``conversations`` gives branching chats (every fifth turn forks off the turn before its predecessor)
and ``documents`` long single-message conversations.  Namespace, user, tags and time follow from the
numeric id by fixed rules, so the same model can be written in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import chunking, graph, revisions
from ..session import stored

GENERATION = "gen-1"
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id").alias("conversation_id"),
        F.col("conv_id").alias("num"),
        "turn",
        "role",
        "text",
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("conversation_id"),
        F.col("doc_id").alias("num"),
        F.lit(0).cast("bigint").alias("turn"),
        F.lit("user").alias("role"),
        "text",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conversation_id, num, turn, role, text)`` from both tables."""
    return _chats(spark, sf_dir).unionByName(_documents(spark, sf_dir))


def _with_last(spark: SparkSession, sf_dir: str, *columns: Column | str) -> DataFrame:
    """``columns`` of all messages, and the last turn of their conversation as ``_last``.

    A document has one turn, so only chats are joined and no document text is moved.
    """
    chats, docs = (part(spark, sf_dir).select("conversation_id", "turn", *columns) for part in (_chats, _documents))
    last = chats.groupBy("conversation_id").agg(F.max("turn").alias("_last"))
    docs = docs.filter(F.col("conversation_id").isNotNull()).withColumn("_last", F.lit(0).cast("bigint"))
    return chats.join(last, "conversation_id").unionByName(docs)


def title_of(text: Column) -> Column:
    """The first sentence of the first line."""
    return F.substring_index(F.substring_index(text, "\n", 1), ".", 1)


def namespace_of(num: Column) -> Column:
    return F.concat(F.lit("ns"), num % 4)


def user_of(num: Column) -> Column:
    return F.concat(F.lit("u"), num % 3)


def updated_of(num: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), (num % 1000).cast("int")).cast("timestamp")


def tags_of(num: Column) -> Column:
    return F.array(F.concat(F.lit("t"), num % 5), F.concat(F.lit("lang"), num % 2))


def node_name(turn: Column) -> Column:
    return F.concat(F.lit("t"), F.lpad(turn.cast("string"), 6, "0"))


def parent_turn(turn: Column) -> Column:
    return F.when(turn == 0, F.lit(None)).when(turn % 5 == 4, turn - 2).otherwise(turn - 1)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conversation_id, node_id, parent_id, role, text, is_leaf, turn)``.

    A turn is a leaf when the next one forks around it or when it is the last.
    """
    return _with_last(spark, sf_dir, "role", "text").select(
        "conversation_id",
        node_name(F.col("turn")).alias("node_id"),
        node_name(parent_turn(F.col("turn"))).alias("parent_id"),
        "role",
        "text",
        ((F.col("turn") == F.col("_last")) | (F.col("turn") % 5 == 3)).alias("is_leaf"),
        "turn",
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_last(spark, sf_dir, "num", title_of(F.col("text")).alias("title"))
    return rows.filter("turn = 0").select(
        "conversation_id",
        "num",
        "title",
        namespace_of(F.col("num")).alias("namespace"),
        user_of(F.col("num")).alias("user_id"),
        updated_of(F.col("num")).alias("updated_at"),
        F.lit("{}").alias("metadata"),
        node_name(F.col("_last")).alias("current_node"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One current revision per conversation, with its header."""
    return revisions.revisions(headers(spark, sf_dir), nodes(spark, sf_dir))


def revision_nodes(spark: SparkSession, sf_dir: str, heads: DataFrame) -> DataFrame:
    return nodes(spark, sf_dir).join(heads.select("conversation_id", "revision_id"), "conversation_id")


def chunks(spark: SparkSession, sf_dir: str, heads: DataFrame | None = None) -> DataFrame:
    """The chunks of ``heads``, one revision per conversation; paths and parts are found by conversation."""
    heads = stored(catalog(spark, sf_dir)) if heads is None else heads
    raw = nodes(spark, sf_dir)
    paths = graph.branches(raw, heads, "conversation_id")
    return chunking.chunk(
        raw, paths, heads.select("revision_id", "conversation_id", "title", "namespace", "updated_at"), GENERATION, key="conversation_id"
    )
