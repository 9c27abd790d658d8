"""Conversation exports: JSON arrays of message graphs, read file by file and normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..session import durable
from ..functions import fixed, text as tx
from ..functions.ids import domain_id, epoch_timestamp
from ..operators import graph

FIELDS = {
    "id": "string",
    "conversation_id": "string",
    "title": "string",
    "create_time": "double",
    "update_time": "double",
    "current_node": "string",
}
NODE = (
    "parent string, children array<string>, create_time double, update_time double, "
    "message struct<author: struct<role: string>, create_time: double, update_time: double, "
    "content: string, text: string, metadata: string, model_slug: string>"
)


#: Where an item was read; no part of its content.
PLACE = ["file", "ordinal", "_part"]


def export_schema(extra: tuple[str, ...] = ()) -> T.StructType:
    """Never inferred: every node id is a key of ``mapping``.  ``extra`` fields are kept as raw JSON text."""
    parts = [f"`{n}` {t}" for n, t in FIELDS.items()] + [f"`{n}` string" for n in extra]
    return T.StructType.fromDDL(", ".join([*parts, "mapping map<string,string>", "_corrupt_record string"]))


def read_export(spark: SparkSession, path: str, extra: tuple[str, ...] = (), lines: bool = False) -> DataFrame:
    """One row per array element with its file; a truncated or malformed file gives a row with ``_corrupt_record``.

    ``lines`` reads files with one object per line, which Spark splits among tasks.
    """
    rows = spark.read.schema(export_schema(extra)).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    return with_place(rows)


def with_place(rows: DataFrame) -> DataFrame:
    """Add the file and the part of it that a row was read from."""
    return rows.withColumns({"file": F.col("_metadata.file_path"), "_part": F.col("_metadata.file_block_start")})


def with_ordinal(rows: DataFrame) -> DataFrame:
    """Replace ``_part`` by ``ordinal``, the number of the row in its file.

    Rows of a part are read by one task in order; parts are few per file, and only their counts are ordered.
    """
    rows = durable(rows.withColumn("_n", F.monotonically_increasing_id()))
    parts = rows.groupBy("file", "_part").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    return (
        rows.join(parts, ["file", "_part"])
        .withColumn("ordinal", F.col("_n") - F.col("_first") + F.col("_before"))
        .drop("_part", "_n", "_first", "_before")
    )


def _error(max_item_bytes: int | None) -> Column:
    size = F.aggregate(F.map_values("mapping"), F.lit(0).cast("bigint"), lambda acc, v: acc + F.octet_length(v))
    error = F.when(F.col("_corrupt_record").isNotNull(), "file is not a complete JSON array of conversations").when(
        F.col("mapping").isNull(), "mapping: required"
    )
    return error if max_item_bytes is None else error.when(size > max_item_bytes, "conversation exceeds the item limit")


def check_items(raw: DataFrame, max_item_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)``: rejected items carry ``error_code`` and ``error_message``."""
    rows = raw.withColumn("error", _error(max_item_bytes))
    rejected = rows.filter(F.col("error").isNotNull()).select(
        *[c for c in ("file", "ordinal", "id", "conversation_id") if c in raw.columns],
        F.lit(fixed.PARSER_ERROR).alias("error_code"),
        F.substring("error", 1, 1000).alias("error_message"),
    )
    return rows.filter(F.col("error").isNull()).drop("error", "_corrupt_record"), rejected


def identify(items: DataFrame) -> DataFrame:
    """Add ``source_id``, the stable ``conversation_key`` and ``item_id``, the digest of the item in its file.

    Several versions of a conversation may be read together, so nodes belong to items until a revision
    id is known.
    """
    source = F.coalesce(F.col("id"), F.col("conversation_id"))
    rows = items.withColumn("_whole", F.to_json(F.struct(*[c for c in items.columns if c not in PLACE])))
    key = F.coalesce(F.nullif(source, F.lit("")), F.col("_whole"))
    file = F.col("file") if "file" in items.columns else F.lit("")
    return rows.withColumns(
        {
            "source_id": source,
            "conversation_key": domain_id("conversation", F.lit(fixed.SOURCE_EXPORT), key),
            "item_id": domain_id("item", file, F.col("_whole")),
        }
    ).drop("_whole")


def message_text(content: Column, text: Column) -> Column:
    """Parts joined by line breaks (objects stay JSON text), else ``content.text``, else ``message.text``."""
    parsed = F.from_json(content, "parts array<string>, text string")
    parts = F.transform(parsed["parts"], lambda p: F.coalesce(p, F.lit("null")))
    return F.coalesce(F.array_join(parts, "\n"), parsed["text"], text, F.lit(""))


def export_nodes(identified: DataFrame) -> DataFrame:
    """One row per mapping entry, numbered by node id within its conversation."""
    entries = identified.select(
        "item_id",
        F.col("conversation_key").alias("conversation_id"),
        F.posexplode(F.array_sort(F.map_entries("mapping"))).alias("position", "_e"),
    )
    rows = entries.select(
        "item_id", "conversation_id", "position", F.col("_e.key").alias("node_id"), F.col("_e.value").alias("raw"),
        F.from_json("_e.value", NODE).alias("_n"),
    )
    message = F.col("_n.message")
    metadata = F.coalesce(message["metadata"], F.lit("{}"))
    children = F.array_sort(F.filter(F.coalesce("_n.children", F.array().cast("array<string>")), lambda c: c.isNotNull()))
    return rows.select(
        "item_id",
        "conversation_id",
        domain_id("message-node", F.col("conversation_id"), F.col("node_id")).alias("id"),
        "node_id",
        F.col("_n.parent").alias("parent_id"),
        children.alias("children"),
        (F.size(children) == 0).alias("is_leaf"),
        message["author"]["role"].alias("role"),
        message_text(message["content"], message["text"]).alias("text"),
        F.coalesce(message["content"], F.lit("null")).alias("content"),
        epoch_timestamp(F.coalesce(message["create_time"], F.col("_n.create_time"))).alias("created_at"),
        epoch_timestamp(F.coalesce(message["update_time"], F.col("_n.update_time"))).alias("updated_at"),
        F.coalesce(F.get_json_object(metadata, "$.model_slug"), message["model_slug"]).alias("model_slug"),
        metadata.alias("metadata"),
        "raw",
        (F.col("position") + 2).alias("line_number"),
    )


def export_headers(identified: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per conversation; the current node falls back to the head of the active branch."""
    known = [c for c in identified.columns if c not in ("mapping", "title", *PLACE, "source_id", "conversation_key", "item_id")]
    title = F.coalesce(F.nullif(tx.js_trim(F.col("title")), F.lit("")), F.lit(fixed.UNTITLED))
    rows = identified.select(
        "item_id",
        F.col("conversation_key").alias("conversation_id"),
        F.lit(fixed.SOURCE_EXPORT).alias("source_type"),
        "source_id",
        title.alias("title"),
        F.lit(fixed.DEFAULT_NAMESPACE).alias("namespace"),
        epoch_timestamp(F.col("create_time")).alias("created_at"),
        epoch_timestamp(F.col("update_time")).alias("updated_at"),
        F.col("current_node"),
        F.to_json(F.struct(*known)).alias("metadata"),
    )
    heads = graph.resolve_heads(nodes, rows, "item_id").select("item_id", "head").distinct()
    return rows.join(heads, "item_id", "left").withColumn("current_node", F.coalesce("current_node", "head")).drop("head")


def normalize_export(raw: DataFrame, max_item_bytes: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(headers, nodes, rejected)`` of an export."""
    good, rejected = check_items(raw, max_item_bytes)
    identified = identify(good)
    nodes = export_nodes(identified)
    return export_headers(identified, nodes), nodes, rejected
