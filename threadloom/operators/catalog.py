"""Catalog reads: listings, statistics, context windows, pages, tenant scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..functions.ids import domain_id
from .graph import ACTIVE


def _holds(tags: DataFrame, wanted: list[str], mode: str) -> DataFrame:
    """Conversations whose live tags hold any or all of ``wanted``."""
    found = tags.filter(F.col("tag").isin(*wanted)).groupBy("conversation_id").agg(
        F.count_distinct("tag").alias("_n")
    )
    return found if mode == "any" else found.filter(F.col("_n") == len(set(wanted)))


def list_conversations(
    conversations: DataFrame,
    tags: DataFrame,
    limit: int,
    cursor: str | None = None,
    user_id: str | None = None,
    namespaces: list[str] | None = None,
    wanted: list[str] | None = None,
    tag_mode: str = "all",
) -> DataFrame:
    """One keyset page of ``conversations(conversation_id, title, namespace, user_id, ...)`` by id.

    Every row carries ``next_cursor`` (null on the last page) and its ordered ``tags``.  ``wanted`` are
    normalised tags.  One row more than the page is read, through a top-k that never sorts the table.
    """
    limit = min(100, max(1, limit))
    rows = conversations
    if namespaces:
        rows = rows.filter(F.col("namespace").isin(*namespaces))
    if user_id:
        rows = rows.filter(F.col("user_id") == user_id)
    if cursor:
        rows = rows.filter(F.col("conversation_id") > cursor)
    if wanted:
        rows = rows.join(_holds(tags, wanted, tag_mode), "conversation_id", "left_semi")
    fetched = rows.orderBy("conversation_id").limit(limit + 1)
    listed = tags.join(fetched.select("conversation_id"), "conversation_id", "left_semi")
    listed = listed.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("seq", "tag"))).alias("_t"))
    numbered = Window.partitionBy(F.lit(0)).orderBy("conversation_id")  # at most limit + 1 rows
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    last = F.max(F.when(F.col("_i") == limit, F.col("conversation_id"))).over(Window.partitionBy(F.lit(0)))
    return (
        fetched.withColumn("_i", F.row_number().over(numbered))
        .withColumn("next_cursor", F.when(total > limit, last))
        .filter(F.col("_i") <= limit)
        .join(listed, "conversation_id", "left")
        .withColumn("tags", F.coalesce(F.col("_t.tag"), F.array().cast("array<string>")))
        .drop("_i", "_t")
    )


def list_namespaces(grants: DataFrame, users: DataFrame, conversations: DataFrame) -> DataFrame:
    """``(user_id, namespace, conversations, is_default)`` for every granted namespace, also empty ones."""
    counts = conversations.groupBy("user_id", "namespace").agg(F.count(F.lit(1)).alias("conversations"))
    return (
        grants.select("user_id", "namespace")
        .join(counts, ["user_id", "namespace"], "left")
        .join(users.select("user_id", F.col("namespace").alias("_default")), "user_id", "left")
        .select(
            "user_id", "namespace", F.coalesce("conversations", F.lit(0)).alias("conversations"),
            F.coalesce(F.col("namespace") == F.col("_default"), F.lit(False)).alias("is_default"),
        )
    )


def memory_stats(grants: DataFrame, conversations: DataFrame, node_counts: DataFrame) -> DataFrame:
    """Conversations and messages per granted namespace, with a total row (null namespace) per user.

    ``conversations(conversation_id, user_id, namespace, revision_id)``; ``node_counts(revision_id,
    node_count)``: all nodes of the current revision count, also empty ones and those off the active path.
    """
    counts = (
        conversations.join(node_counts, "revision_id", "left")
        .groupBy("user_id", "namespace")
        .agg(F.count(F.lit(1)).alias("conversations"), F.sum(F.coalesce("node_count", F.lit(0))).alias("messages"))
    )
    per = grants.select("user_id", "namespace").join(counts, ["user_id", "namespace"], "left")
    return per.groupBy("user_id", "namespace").agg(
        F.sum(F.coalesce("conversations", F.lit(0))).alias("conversations"),
        F.sum(F.coalesce("messages", F.lit(0))).alias("messages"),
    ).unionByName(
        per.groupBy("user_id").agg(
            F.lit(None).cast("string").alias("namespace"),
            F.sum(F.coalesce("conversations", F.lit(0))).alias("conversations"),
            F.sum(F.coalesce("messages", F.lit(0))).alias("messages"),
        )
    )


def index_health(state: DataFrame, revisions: DataFrame, conversations: DataFrame, generation_id: str, current_only: bool = False) -> DataFrame:
    """``(user_id, indexed, pending)`` for one generation.

    ``revisions(revision_id, conversation_id)`` of all versions; superseded ones still count unless
    ``current_only``.
    """
    rows = state.filter(F.col("generation_id") == generation_id).join(revisions, "revision_id")
    if current_only:
        rows = rows.join(conversations.select("revision_id"), "revision_id", "left_semi")
    rows = rows.join(conversations.select("conversation_id", "user_id"), "conversation_id")
    return rows.groupBy("user_id").agg(
        F.count_if(F.col("status") == "indexed").alias("indexed"),
        F.count_if(F.col("status") != "indexed").alias("pending"),
    )


def chunk_context(requests: DataFrame, chunks: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(chunk_id, revision_id, position, node_id, is_match)``: the messages around each requested chunk.

    ``requests(chunk_id, before, after)``, both clamped to 0..10.  Chunks of the active path get their
    neighbours on it; other chunks get their own messages with parents and children.  The window is
    expanded to at most a few dozen positions and met by an equi-join, not by a range join.
    """
    clamp = lambda c: F.least(F.lit(10), F.greatest(F.lit(0), F.col(c)))
    asked = requests.select("chunk_id", clamp("before").alias("before"), clamp("after").alias("after"))
    found = chunks.select("chunk_id", "revision_id", "sources").join(asked, "chunk_id")
    span = F.filter(F.transform("sources", lambda s: s["source_sequence"]), lambda s: s.isNotNull())
    found = found.withColumn("_span", span)
    first = F.greatest(F.lit(0), F.array_min("_span") - F.col("before"))
    on_path = found.filter(F.size("_span") > 0).select(
        "chunk_id", "revision_id", "sources",
        F.explode(F.sequence(first, F.array_max("_span") + F.col("after"))).alias("sequence"),
    )
    active = paths.filter(F.col("branch_key") == ACTIVE).select("revision_id", F.col("pos").alias("sequence"), "node_id")
    near = on_path.join(active, ["revision_id", "sequence"]).select(
        "chunk_id", "revision_id", F.col("sequence").alias("_order"), "node_id", "sources"
    )
    own = found.filter(F.size("_span") == 0).select(
        "chunk_id", "revision_id", "sources", F.posexplode(F.col("sources.source_node_id")).alias("_at", "node_id")
    )
    family = nodes.select("revision_id", "node_id", "parent_id")
    parents = own.join(family, ["revision_id", "node_id"]).filter(F.col("parent_id").isNotNull())
    children = own.join(
        family.select("revision_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child_id")),
        ["revision_id", "node_id"],
    )
    columns = ["chunk_id", "revision_id", "sources"]
    around = (
        own.select(*columns, (F.col("_at") * 3).alias("_order"), "node_id")
        .unionByName(parents.select(*columns, (F.col("_at") * 3 + 1).alias("_order"), F.col("parent_id").alias("node_id")))
        .unionByName(children.select(*columns, (F.col("_at") * 3 + 2).alias("_order"), F.col("child_id").alias("node_id")))
        .groupBy("chunk_id", "revision_id", "node_id")
        .agg(F.min("_order").cast("bigint").alias("_order"), F.first("sources").alias("sources"))
        .join(family.select("revision_id", "node_id"), ["revision_id", "node_id"], "left_semi")
    )
    numbered = Window.partitionBy("chunk_id").orderBy("_order", "node_id")  # a few dozen rows per chunk
    return near.unionByName(around).select(
        "chunk_id",
        "revision_id",
        (F.row_number().over(numbered) - 1).alias("position"),
        "node_id",
        F.array_contains(F.col("sources.source_node_id"), F.col("node_id")).alias("is_match"),
    )


def visible_chunks(requests: DataFrame, chunks: DataFrame, conversations: DataFrame) -> DataFrame:
    """Rows of ``requests(chunk_id, namespaces, user_id, ...)`` whose chunk the request may see.

    ``conversations(conversation_id, user_id)`` are those that were not deleted; null or empty ``namespaces`` and a
    null ``user_id`` do not restrict.  Pass the rows on to :func:`chunk_context` and :func:`matched_ranges`.
    """
    owned = chunks.select("chunk_id", "conversation_id", F.col("namespace").alias("_ns")).join(
        conversations.select("conversation_id", F.col("user_id").alias("_owner")), "conversation_id"
    ).drop("conversation_id")
    in_scope = (F.coalesce(F.size("namespaces"), F.lit(0)) <= 0) | F.array_contains("namespaces", F.col("_ns"))
    mine = F.col("user_id").isNull() | (F.col("user_id") == F.col("_owner"))
    return requests.join(owned, "chunk_id").filter(in_scope & mine).select(*requests.columns)


def matched_ranges(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(chunk_id, node_id, char_start, char_end)``: the parts of each message that a requested chunk covers.

    Ranges of one message that overlap or touch are one range.
    """
    asked = chunks.join(requests.select("chunk_id").distinct(), "chunk_id", "left_semi")
    ranges = asked.select("chunk_id", F.explode("sources").alias("s")).select(
        "chunk_id", F.col("s.source_node_id").alias("node_id"), "s.char_start", "s.char_end"
    )
    message = Window.partitionBy("chunk_id", "node_id").orderBy("char_start", "char_end")  # the few sources of a chunk
    before = F.max("char_end").over(message.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before >= F.col("char_start"), 0).otherwise(1)
    runs = ranges.withColumn("_new", starts).withColumn("_run", F.sum("_new").over(message.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("chunk_id", "node_id", "_run").agg(
        F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end")
    ).drop("_run")


def conversation_page(requests: DataFrame, ordered: DataFrame, totals: DataFrame) -> DataFrame:
    """``(request_id, conversation_id, position, node_id, total, next_offset)``.

    ``requests(request_id, conversation_id, offset, limit)`` (limit at most 100); ``ordered(
    conversation_id, position, node_id)`` numbers the messages of the wanted branch from 0;
    ``totals(conversation_id, total)``.
    """
    start = F.greatest(F.lit(0), F.col("offset"))
    size = F.least(F.lit(100), F.greatest(F.lit(1), F.col("limit")))
    asked = requests.select("request_id", "conversation_id", start.alias("_from"), (start + size).alias("_to"))
    asked = asked.join(totals, "conversation_id").withColumn(
        "next_offset", F.when(F.col("_to") < F.col("total"), F.col("_to"))
    )
    slots = asked.withColumn("position", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)))
    return slots.join(ordered, ["conversation_id", "position"]).select(
        "request_id", "conversation_id", "position", "node_id", "total", "next_offset"
    )


# --------------------------------------------------------------------------- tenants


def scope_requests(requests: DataFrame, users: DataFrame, grants: DataFrame) -> DataFrame:
    """``(request_id, user_id, namespaces, error)`` for ``requests(request_id, user_id, requested)``.

    A requested namespace must be granted; without one, all granted namespaces (or the default) apply.
    """
    owned = grants.groupBy("user_id").agg(F.sort_array(F.collect_set("namespace")).alias("_owned"))
    rows = requests.join(users.select("user_id", F.col("namespace").alias("_default")), "user_id", "left").join(
        owned, "user_id", "left"
    )
    all_ = F.when(F.size(F.coalesce("_owned", F.array().cast("array<string>"))) > 0, F.col("_owned")).otherwise(F.array("_default"))
    error = (
        F.when(F.col("_default").isNull(), "unknown user")
        .when(F.col("requested").isNotNull() & ~F.array_contains(all_, F.col("requested")), "namespace not accessible")
    )
    rows = rows.withColumn("error", error)
    return rows.select(
        "request_id", "user_id",
        F.when(F.col("error").isNull(), F.when(F.col("requested").isNotNull(), F.array("requested")).otherwise(all_)).alias("namespaces"),
        "error",
    )


def provision_users(emails: DataFrame, users: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """New rows for ``users`` and ``grants`` from ``emails(email)``; known and invalid addresses give none."""
    address = tx.normalize_email(F.col("email"))
    fresh = emails.select(address.alias("email")).filter(tx.is_valid_email(F.col("email"))).distinct()
    fresh = fresh.withColumn("user_id", domain_id("user", F.col("email")))
    fresh = fresh.join(users.select("user_id"), "user_id", "left_anti").select(
        "user_id", "email", F.col("user_id").alias("namespace"), at.alias("created_at")
    )
    return fresh, fresh.select("user_id", "namespace", "created_at")


def new_grants(wanted: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows of ``wanted(user_id, namespace, ...)`` that are not granted yet."""
    return wanted.dropDuplicates(["user_id", "namespace"]).join(
        grants.select("user_id", "namespace"), ["user_id", "namespace"], "left_anti"
    )


def namespace_backfill(conversations: DataFrame, grants: DataFrame) -> DataFrame:
    """Grants that existing conversations imply but that are missing."""
    return new_grants(conversations.select("user_id", "namespace"), grants)
