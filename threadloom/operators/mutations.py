"""Writes as functions from request tables to rows to append and rows to report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.ids import domain_id
from ..session import stored
from .revisions import revisions

REVISION_COLUMNS = ["revision_id", "segment_hash", "segment_id", "content_hash", "node_count"]


# --------------------------------------------------------------------------- optimistic append


def split_appends(appends: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(applied, rejected)`` for ``appends(request_id, conversation_id, base_revision_id, seq, ...)``.

    An append applies when its base is the current revision and it is the first of its batch for that
    base; ``rejected`` adds ``reason`` ("not_found" or "conflict").
    """
    live = current.select("conversation_id", F.col("revision_id").alias("_current"))
    rows = appends.join(live, "conversation_id", "left")
    fresh = rows.filter(F.col("base_revision_id") == F.col("_current"))
    first = fresh.groupBy("conversation_id").agg(F.min_by("request_id", F.struct("seq", "request_id")).alias("_first"))
    rows = rows.join(first, "conversation_id", "left").withColumn(
        "_ok", F.coalesce((F.col("base_revision_id") == F.col("_current")) & (F.col("request_id") == F.col("_first")), F.lit(False))
    )
    applied = rows.filter("_ok").select(*appends.columns)
    reason = F.when(F.col("_current").isNull(), "not_found").otherwise("conflict")
    return applied, rows.filter(~F.col("_ok")).select(*appends.columns, reason.alias("reason"))


def appended_nodes(applied: DataFrame, heads: DataFrame) -> DataFrame:
    """New nodes of applied appends, linked below the current node.

    ``applied(request_id, conversation_id, messages ARRAY<STRUCT<role, content, timestamp>>)``;
    ``heads(conversation_id, current_node, active_messages)``.  Ids follow from request and ordinal, so a
    repeated batch writes the same rows and each parent id is computed without a window.
    """
    name = lambda ordinal: F.concat(
        F.lit("append-"), domain_id("append", F.col("request_id"), F.col("conversation_id"), ordinal)
    )
    rows = applied.join(heads.select("conversation_id", "current_node", "active_messages"), "conversation_id")
    rows = rows.select("*", F.posexplode("messages").alias("ordinal", "_m"))
    return rows.select(
        "request_id",
        "conversation_id",
        domain_id("message-node", F.col("conversation_id"), name(F.col("ordinal"))).alias("id"),
        name(F.col("ordinal")).alias("node_id"),
        F.when(F.col("ordinal") == 0, F.col("current_node")).otherwise(name(F.col("ordinal") - 1)).alias("parent_id"),
        F.col("_m.role").alias("role"),
        F.col("_m.content").alias("text"),
        F.col("_m.timestamp").alias("created_at"),
        (F.col("active_messages") + F.col("ordinal")).alias("sequence"),
        (F.col("ordinal") == F.size("messages") - 1).alias("is_leaf"),
        F.to_json(F.struct(F.col("ordinal").alias("append_ordinal"))).alias("metadata"),
    )


@dataclass(frozen=True)
class Appended:
    """``outcomes(request_id, outcome)``; ``revisions`` and ``nodes`` of every append on the current base, also of those
    that lost; ``claims(base_revision_id, revision_id, request_id)``: the one that follows each base."""

    outcomes: DataFrame
    revisions: DataFrame
    nodes: DataFrame
    claims: DataFrame


def append_revisions(appends: DataFrame, heads: DataFrame, nodes: DataFrame, at: Column) -> Appended:
    """New revisions for ``appends(request_id, conversation_id, base_revision_id, seq, messages, tags)``.

    ``heads(conversation_id, revision_id, current_node, active_messages, tags, ...)`` are the current revisions with
    their headers, ``nodes(revision_id, ...)`` their nodes.  A new revision holds the nodes of its base and the
    appended ones, the tags of both without repeats, and the time of the append; its id follows from its content.
    Of several appends on one base the first by ``seq`` and request goes on as the current revision; the others are
    written as well, so their content can be read by its id, and are reported as conflicts.
    """
    applied, rejected = split_appends(appends, heads)
    outcomes = rejected.select("request_id", F.col("reason").alias("outcome")).unionByName(
        applied.select("request_id", F.lit("applied").alias("outcome"))
    )
    header = [c for c in heads.columns if c not in ("current_node", "updated_at", "tags", *REVISION_COLUMNS)]
    based = appends.withColumnRenamed("tags", "_added").join(
        heads.select(*header, F.col("revision_id").alias("base_revision_id"), F.col("current_node"), F.col("tags")), ["conversation_id", "base_revision_id"]
    )
    based = stored(based)
    asked = based.select("request_id", "conversation_id", "messages")
    fresh = appended_nodes(asked, based.select("conversation_id", "current_node", "active_messages").distinct())
    last = fresh.filter("is_leaf").select("request_id", F.col("node_id").alias("_last"))
    carried = [c for c in nodes.columns if c not in ("revision_id", "conversation_id")]
    # nodes of the base are copied once for each append on it
    kept = based.select("request_id", "conversation_id", F.col("base_revision_id").alias("revision_id")).join(
        nodes.drop("conversation_id"), "revision_id"
    )
    # the node that is appended to is no leaf any more
    ends = based.select("request_id", F.col("current_node").alias("node_id"), F.lit(True).alias("_end"))
    kept = kept.join(ends, ["request_id", "node_id"], "left")
    if "is_leaf" in carried:
        kept = kept.withColumn("is_leaf", F.col("is_leaf") & F.col("_end").isNull())
    known = {f.name: f.dataType for f in nodes.schema.fields}
    added = fresh.select(
        "request_id", "conversation_id", *[(F.col(c) if c in fresh.columns else F.lit(None)).cast(known[c]).alias(c) for c in carried]
    )
    every = stored(kept.select("request_id", "conversation_id", *carried).unionByName(added))
    headers = based.join(last, "request_id").select(
        "request_id",
        *header,
        "base_revision_id",
        F.col("_last").alias("current_node"),
        at.alias("updated_at"),
        tx.normalize_tags(F.concat("tags", F.coalesce("_added", F.array().cast("array<string>")))).alias("tags"),
        "seq",
    )
    made = stored(revisions(headers, every, "request_id"))
    claims = made.join(applied.select("request_id"), "request_id", "left_semi").select("base_revision_id", "revision_id", "request_id")
    owned = every.join(made.select("request_id", "revision_id"), "request_id").drop("request_id")
    return Appended(outcomes, made, owned, claims)


# --------------------------------------------------------------------------- tags


def live_tags(events: DataFrame) -> DataFrame:
    """``(conversation_id, tag, seq, step)`` from ``events(conversation_id, tag, op, seq, step)``.

    A tag keeps the place of its first addition after its last removal; adding a present tag changes
    nothing.
    """
    keys = ["conversation_id", "tag"]
    at = F.struct("seq", "step")
    gone = events.filter("op = 'remove'").groupBy(*keys).agg(F.max(at).alias("_gone"))
    kept = events.filter("op = 'add'").join(gone, keys, "left").filter(F.col("_gone").isNull() | (at > F.col("_gone")))
    first = kept.groupBy(*keys).agg(F.min(at).alias("_at"))
    return first.select(*keys, "_at.seq", "_at.step")


def update_tags(requests: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(events, rejected)`` for ``requests(request_id, conversation_id, base_revision_id, add, remove, seq)``.

    Removals come before additions, so a tag named in both ends up added.
    """
    live = current.select("conversation_id", F.col("revision_id").alias("_current"))
    rows = requests.join(live, "conversation_id", "left")
    good = rows.filter(F.col("base_revision_id") == F.col("_current"))
    ops = F.concat(
        F.transform(tx.normalize_tags(F.col("remove")), lambda t: F.struct(F.lit("remove").alias("op"), t.alias("tag"))),
        F.transform(tx.normalize_tags(F.col("add")), lambda t: F.struct(F.lit("add").alias("op"), t.alias("tag"))),
    )
    events = good.select("conversation_id", "seq", F.posexplode(ops).alias("step", "_o")).select(
        "conversation_id", "_o.tag", "_o.op", "seq", "step"
    )
    reason = F.when(F.col("_current").isNull(), "not_found").otherwise("conflict")
    stale = rows.filter(F.col("_current").isNull() | (F.col("base_revision_id") != F.col("_current")))
    return events, stale.select(*requests.columns, reason.alias("reason"))


# --------------------------------------------------------------------------- deletion


def delete_report(requests: DataFrame, conversations: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """``(request_id, conversation_id, outcome, stage)`` for ``requests(request_id, conversation_id, namespaces, user_id)``.

    Conversations outside the requester's scope are reported as missing.  ``failures(conversation_id,
    stage)`` names conversations that an earlier clean-up could not finish.
    """
    owned = conversations.select("conversation_id", F.col("namespace").alias("_ns"), F.col("user_id").alias("_owner"))
    rows = requests.join(owned, "conversation_id", "left")
    found = (
        F.col("_ns").isNotNull()
        & (F.col("namespaces").isNull() | (F.size("namespaces") == 0) | F.array_contains(F.col("namespaces"), F.col("_ns")))
        & (F.col("user_id").isNull() | (F.col("user_id") == F.col("_owner")))
    )
    rows = rows.withColumn("_found", F.coalesce(found, F.lit(False)))
    stage = F.lit(None).cast("string")
    if failures is not None:
        rows = rows.join(failures.select("conversation_id", F.col("stage").alias("_stage")), "conversation_id", "left")
        stage = F.col("_stage")
    outcome = F.when(~F.col("_found"), "missing").when(stage.isNotNull(), "failed").otherwise("deleted")
    return rows.select("request_id", "conversation_id", outcome.alias("outcome"), F.when(F.col("_found"), stage).alias("stage"))


def orphan_segments(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Segments that no remaining revision refers to."""
    return segments.join(links.select("segment_id").distinct(), "segment_id", "left_anti")


def delete_scope(conversations: DataFrame, user_id: str, namespaces: list[str] | None = None, limit: int | None = None):
    """``(selected, summary)``: what one call on a whole scope deletes, and the counts it reports.

    The whole scope by default; ``limit`` bounds one call.
    """
    scope = conversations.filter(F.col("user_id") == user_id)
    if namespaces:
        scope = scope.filter(F.col("namespace").isin(*namespaces))
    selected = scope.select("conversation_id")
    if limit is not None:
        selected = selected.orderBy("conversation_id").limit(limit)
    processed = F.lit(1 << 62) if limit is None else F.lit(limit)
    summary = scope.agg(F.count(F.lit(1)).alias("requested"))
    summary = summary.withColumn("deleted", F.least("requested", processed))
    summary = summary.withColumn("remaining", F.col("requested") - F.col("deleted"))
    return selected, summary.withColumn("complete", F.col("remaining") == 0)
