"""Flat message lists as linear canonical conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..functions.ids import domain_id
from ..operators.scan import with_position


def linear_nodes(messages: DataFrame, block_rows: int | None = None) -> DataFrame:
    """``messages(conversation_id, turn, role, text[, created_at])`` -> one canonical node per message.

    ``turn`` is a unique non-negative integer per conversation; gaps are allowed.
    """
    options = {} if block_rows is None else {"block_rows": block_rows}
    carried = [F.col("created_at")] if "created_at" in messages.columns else [F.lit(None).cast("timestamp").alias("created_at")]
    body = domain_id("mcp-message", F.col("role"), F.col("text"))
    rows = messages.select("conversation_id", "turn", "role", "text", *carried, body.alias("_body"))
    placed = with_position(
        rows,
        ["conversation_id"],
        "turn",
        "sequence",
        {"_before": ("_body", -1), "_after": ("_body", 1)},
        **options,
    )
    name = lambda at, hashed: F.concat(F.lit("mcp-"), at, F.lit("-"), F.col(hashed))
    return placed.select(
        "conversation_id",
        domain_id("message-node", F.col("conversation_id"), name(F.col("sequence"), "_body")).alias("id"),
        name(F.col("sequence"), "_body").alias("node_id"),
        name(F.col("sequence") - 1, "_before").alias("parent_id"),
        F.when(F.col("_after").isNull(), F.array().cast("array<string>"))
        .otherwise(F.array(name(F.col("sequence") + 1, "_after")))
        .alias("children"),
        "role",
        "text",
        F.to_json(
            F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts"))
        ).alias("content"),
        "created_at",
        F.lit(None).cast("timestamp").alias("updated_at"),
        F.lit(None).cast("string").alias("model_slug"),
        F.lit("{}").alias("metadata"),
        F.lit("{}").alias("raw"),
        "sequence",
        F.lit(True).alias("is_active"),
        (F.col("sequence") + 2).alias("line_number"),
        F.lit(fixed.SOURCE_MESSAGES).alias("source_type"),
    )
