"""Registered queries: catalog reads, writes, imports and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ids, text as tx
from ..operators import catalog, chunking, graph, mutations, revisions, semantic, state
from ..session import durable
from ..sources import archive
from . import corpus, search_queries


def _live(spark: SparkSession, d: str) -> DataFrame:
    """Headers of conversations that are not deleted (every 17th one is)."""
    return corpus.headers(spark, d).filter("num % 17 <> 3")


def _tags(rows: DataFrame) -> DataFrame:
    return rows.select("conversation_id", F.posexplode(corpus.tags_of(F.col("num"))).alias("seq", "tag"))


def _grants(spark: SparkSession, d: str) -> DataFrame:
    """Namespaces in use and, per user, one spare namespace without conversations."""
    rows = corpus.headers(spark, d)
    used = rows.select("user_id", "namespace")
    return used.unionByName(rows.select("user_id", F.concat(F.lit("spare-"), "user_id").alias("namespace"))).distinct()


def _users(spark: SparkSession, d: str) -> DataFrame:
    return corpus.headers(spark, d).select("user_id").distinct().withColumn("namespace", F.lit("ns1"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """A revision log: one row per turn, each later turn giving a newer revision; some arrive late."""
    rows = corpus.messages(spark, d)
    late = (F.col("num") + F.col("turn")) % 4 == 0
    return rows.select(
        "conversation_id",
        ids.domain_id("revision", F.col("conversation_id"), F.col("text")).alias("revision_id"),
        F.date_add(corpus.updated_of(F.col("num")), (F.when(late, -F.col("turn")).otherwise(F.col("turn"))).cast("int")).cast("timestamp").alias("updated_at"),
        F.col("turn").alias("seq"),
        "num",
    )


def _current(spark: SparkSession, d: str) -> DataFrame:
    gone = corpus.headers(spark, d).filter("num % 17 = 3")
    return revisions.current_view(_versions(spark, d), gone)


def current_revisions(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d).select("conversation_id", "revision_id", "seq")


def list_conversations(spark: SparkSession, d: str) -> DataFrame:
    rows = _live(spark, d)
    page = catalog.list_conversations(
        rows, _tags(rows), 20, cursor="c15", user_id="u1", namespaces=["ns0", "ns1", "ns3"], wanted=["t1", "t2"], tag_mode="any"
    )
    return page.select("conversation_id", "title", "namespace", F.array_join("tags", "|").alias("tags"), "next_cursor")


def list_namespaces(spark: SparkSession, d: str) -> DataFrame:
    return catalog.list_namespaces(_grants(spark, d), _users(spark, d), _live(spark, d))


def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _live(spark, d).withColumn("revision_id", F.col("conversation_id"))
    counts = corpus.messages(spark, d).groupBy(F.col("conversation_id").alias("revision_id")).agg(F.count(F.lit(1)).alias("node_count"))
    stats = catalog.memory_stats(_grants(spark, d), rows, counts)
    return stats.withColumn("namespace", F.coalesce("namespace", F.lit("(all)")))


def index_health(spark: SparkSession, d: str) -> DataFrame:
    rows = _live(spark, d).withColumn("revision_id", F.col("conversation_id"))
    latest = state.latest_state(search_queries.index_events(spark, d))
    return catalog.index_health(latest, rows.select("revision_id", "conversation_id"), rows, corpus.GENERATION)


def _indexed(spark: SparkSession, d: str):
    heads = corpus.headers(spark, d).withColumn("revision_id", F.col("conversation_id"))
    nodes = corpus.nodes(spark, d).withColumn("revision_id", F.col("conversation_id"))
    paths = durable(graph.branches(nodes, heads, "revision_id"))
    header = heads.select("revision_id", "conversation_id", "title", "namespace", "updated_at")
    return nodes, paths, durable(chunking.chunk(nodes, paths, header, corpus.GENERATION))


def context_window(spark: SparkSession, d: str) -> DataFrame:
    nodes, paths, chunks = _indexed(spark, d)
    asked = chunks.select("chunk_id", F.lit(1).alias("before"), F.lit(2).alias("after"))
    rows = catalog.chunk_context(asked, chunks, paths, nodes)
    named = chunks.select("chunk_id", "branch_key", F.col("ordinal").alias("chunk_ordinal"))
    return rows.join(named, "chunk_id").select(
        "revision_id", "branch_key", "chunk_ordinal", F.col("position").cast("bigint").alias("position"), "node_id", "is_match"
    )


def context_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Matched ranges of every chunk, asked for in scopes that fit some of the conversations."""
    _, _, chunks = _indexed(spark, d)
    num = F.col("num")
    scopes = corpus.headers(spark, d).select(
        "conversation_id",
        F.when(num % 3 == 0, F.array(F.lit("ns0"), F.lit("ns1"))).alias("namespaces"),
        F.when(num % 5 == 0, F.lit("u1")).alias("user_id"),
    )
    asked = chunks.select("chunk_id", "conversation_id").join(scopes, "conversation_id")
    live = _live(spark, d).select("conversation_id", "user_id")
    rows = catalog.matched_ranges(catalog.visible_chunks(asked, chunks, live), chunks)
    named = chunks.select("chunk_id", "revision_id", "branch_key", F.col("ordinal").alias("chunk_ordinal"))
    return rows.join(named, "chunk_id").select(
        "revision_id", "branch_key", "chunk_ordinal", "node_id",
        F.col("char_start").cast("bigint").alias("char_start"), F.col("char_end").cast("bigint").alias("char_end"),
    )


def conversation_page(spark: SparkSession, d: str) -> DataFrame:
    paths = graph.branches(corpus.nodes(spark, d), corpus.headers(spark, d), "conversation_id")
    active = paths.filter(F.col("branch_key") == graph.ACTIVE).select("conversation_id", F.col("pos").alias("position"), "node_id")
    totals = active.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("total"))
    asked = _live(spark, d).select(
        F.col("conversation_id").alias("request_id"), "conversation_id", (F.col("num") % 3).alias("offset"), F.lit(3).cast("bigint").alias("limit")
    )
    rows = catalog.conversation_page(asked, active, totals)
    return rows.withColumn("next_offset", F.coalesce("next_offset", F.lit(-1)))


def scope_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.messages(spark, d).select(
        F.concat_ws(":", "conversation_id", "turn").alias("request_id"),
        F.when(F.col("num") % 11 == 0, "nobody").otherwise(corpus.user_of(F.col("num"))).alias("user_id"),
        F.when(F.col("num") % 5 == 0, F.lit(None)).when(F.col("num") % 5 == 1, F.lit("elsewhere")).otherwise(corpus.namespace_of(F.col("num"))).alias("requested"),
    )
    scoped = catalog.scope_requests(rows, _users(spark, d), _grants(spark, d))
    return scoped.select("request_id", F.coalesce(F.array_join("namespaces", "|"), F.lit("")).alias("namespaces"), F.coalesce("error", F.lit("")).alias("error"))


def provision_users(spark: SparkSession, d: str) -> DataFrame:
    """Accounts for addresses written in two ways and some that are no addresses."""
    num = F.col("num")
    address = F.when(num % 6 == 0, F.concat(F.lit("no at sign "), num)).otherwise(F.concat(F.lit("  User"), num % 50, F.lit("@Example.ORG ")))
    rows = corpus.headers(spark, d)
    known = rows.filter("num % 50 < 5").select(ids.domain_id("user", F.concat(F.lit("user"), num % 50, F.lit("@example.org"))).alias("user_id")).distinct()
    fresh, _ = catalog.provision_users(rows.select(address.alias("email")), known, F.lit("2024-01-31").cast("timestamp"))
    return fresh.select("user_id", "email", "namespace")


def namespace_backfill(spark: SparkSession, d: str) -> DataFrame:
    granted = _grants(spark, d).filter("namespace <> 'ns2'")
    return catalog.namespace_backfill(_live(spark, d), granted).select("user_id", "namespace")


# --------------------------------------------------------------------------- writes


def append_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """An append per message: right base, stale base, doubled base or unknown conversation."""
    now = _current(spark, d).select("conversation_id", "revision_id", "num")
    rows = corpus.messages(spark, d).select("conversation_id", "num", "turn")
    rows = rows.join(now.select("conversation_id", "revision_id"), "conversation_id", "left")
    appends = rows.select(
        F.concat_ws(":", "conversation_id", "turn").alias("request_id"),
        F.when(F.col("num") % 9 == 0, F.concat(F.lit("x"), "conversation_id")).otherwise(F.col("conversation_id")).alias("conversation_id"),
        F.when((F.col("num") + F.col("turn")) % 4 == 1, "stale").otherwise(F.coalesce("revision_id", F.lit("none"))).alias("base_revision_id"),
        (-F.col("turn")).alias("seq"),
    )
    applied, rejected = mutations.split_appends(appends, now)
    return applied.withColumn("outcome", F.lit("applied")).unionByName(rejected.withColumnRenamed("reason", "outcome")).select("request_id", "outcome")


def appended_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All turns of each conversation appended again below its current node."""
    rows = corpus.messages(spark, d)
    heads = corpus.headers(spark, d).select("conversation_id", "current_node").join(
        rows.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("active_messages")), "conversation_id"
    )
    message = F.struct("turn", "role", F.col("text").alias("content"), F.lit(None).cast("timestamp").alias("timestamp"))
    applied = rows.groupBy("conversation_id").agg(F.sort_array(F.collect_list(message)).alias("messages"))
    applied = applied.withColumn("request_id", F.concat(F.lit("r"), "conversation_id"))
    made = mutations.appended_nodes(applied, heads)
    return made.select("conversation_id", "id", "node_id", "parent_id", "role", F.sha2("text", 256).alias("text_sha"), "sequence", "is_leaf")


def tag_updates(spark: SparkSession, d: str) -> DataFrame:
    """Every message of a conversation is one tag update; the result is the live tag list."""
    now = corpus.headers(spark, d).select("conversation_id", F.col("conversation_id").alias("revision_id"))
    turn, num = F.col("turn"), F.col("num")
    requests = corpus.messages(spark, d).select(
        F.concat_ws(":", "conversation_id", "turn").alias("request_id"),
        "conversation_id",
        F.when(turn % 6 == 5, "stale").otherwise(F.col("conversation_id")).alias("base_revision_id"),
        F.array(F.concat(F.lit("A"), turn % 3), F.concat(F.lit("b"), num % 2), F.lit(" keep ")).alias("add"),
        F.array(F.concat(F.lit("a"), (turn + 1) % 3), F.concat(F.lit("B"), turn % 2)).alias("remove"),
        turn.alias("seq"),
    )
    events, _ = mutations.update_tags(requests, now)
    return mutations.live_tags(events).select("conversation_id", "tag", "seq", F.col("step").cast("bigint").alias("step"))


def delete_report(spark: SparkSession, d: str) -> DataFrame:
    num = F.col("num")
    rows = corpus.messages(spark, d).select(
        F.concat_ws(":", "conversation_id", "turn").alias("request_id"),
        F.when(num % 8 == 0, F.concat(F.lit("x"), "conversation_id")).otherwise(F.col("conversation_id")).alias("conversation_id"),
        F.when(num % 3 == 0, F.array(F.lit("ns0"), F.lit("ns1"))).alias("namespaces"),
        F.when(num % 5 == 0, F.lit("u1")).alias("user_id"),
    )
    held = corpus.headers(spark, d)
    broken = held.filter("num % 13 = 4").select("conversation_id", F.lit("vectors").alias("stage"))
    report = mutations.delete_report(rows, held, broken)
    return report.select("request_id", "conversation_id", "outcome", F.coalesce("stage", F.lit("")).alias("stage"))


def delete_scopes(spark: SparkSession, d: str) -> DataFrame:
    _, summary = mutations.delete_scope(corpus.headers(spark, d), "u1", ["ns0", "ns2"])
    return summary


def orphan_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments left over after the deletion of every 17th conversation."""
    rows = corpus.catalog(spark, d).select("conversation_id", "num", "segment_id")
    return mutations.orphan_segments(rows.select("segment_id").distinct(), rows.filter("num % 17 <> 3").select("segment_id"))


# --------------------------------------------------------------------------- index maintenance


def index_state_latest(spark: SparkSession, d: str) -> DataFrame:
    return state_rows(state.latest_state(search_queries.index_events(spark, d)))


def state_rows(rows: DataFrame) -> DataFrame:
    at = lambda c: F.coalesce(ids.iso(F.col(c)), F.lit("")).alias(c)
    return rows.select(
        "revision_id", "status", "attempts", at("queued_at"), at("started_at"), at("indexed_at"), at("failed_at"), at("updated_at")
    )


def _state(spark: SparkSession, d: str) -> DataFrame:
    return state.latest_state(search_queries.index_events(spark, d))


def reindex_worklist(spark: SparkSession, d: str) -> DataFrame:
    now = _live(spark, d).select(F.col("conversation_id").alias("revision_id"))
    return state.reindex_worklist(now, _state(spark, d), corpus.GENERATION, force=False)


def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    return state.dead_letter(_state(spark, d)).select("revision_id", "attempts")


def stale_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of two generations; those of the old one go where the new one is indexed."""
    rows = corpus.table(spark, d, "embeddings").select(
        F.concat(F.lit("c"), F.col("vec_id") % 150).alias("revision_id"),
        F.concat(F.lit("v"), "vec_id").alias("vector_id"),
        F.when(F.col("vec_id") % 2 == 0, corpus.GENERATION).otherwise("gen-0").alias("generation_id"),
    )
    done = _state(spark, d).filter("status = 'indexed'")
    return semantic.supersede(rows, done, corpus.GENERATION).select("vector_id")


def removed_derived(spark: SparkSession, d: str) -> DataFrame:
    """Derived rows that stay when only current revisions may be indexed."""
    derived = _versions(spark, d).select("conversation_id", "revision_id", F.col("seq").alias("ordinal"))
    return state.remove_derived(derived, _current(spark, d))


# --------------------------------------------------------------------------- imports and audit


def _imports(spark: SparkSession, d: str) -> DataFrame:
    """Each document as an uploaded file."""
    rows = corpus.table(spark, d, "documents")
    status = F.element_at(tx.lit_strings(["uploaded", "processing", "complete", "failed"]), (F.col("doc_id") % 4 + 1).cast("int"))
    return rows.select(
        F.concat(F.lit("i"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("import_id"),
        F.col("source").alias("source_type"),
        F.encode("text", "UTF-8").alias("content"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 97).alias("created_at"),
        status.alias("status"),
    )


def raw_checksums(spark: SparkSession, d: str) -> DataFrame:
    return archive.checksums(_imports(spark, d), "import_id").select("import_id", "sha256", "size_bytes")


def duplicate_exports(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.checksums(_imports(spark, d), "import_id", "source_type", "created_at", "status")
    return archive.duplicates(rows).select("import_id", "duplicate_of")


def import_status(spark: SparkSession, d: str) -> DataFrame:
    """Progress and the failures of imports made of messages; long or empty ones fail."""
    items = corpus.messages(spark, d).select(
        F.concat(F.lit("import-"), F.col("num") % 3).alias("import_id"),
        (F.col("num") * 16 + F.col("turn") + F.when(F.col("conversation_id").startswith("d"), 1000000).otherwise(0)).alias("ordinal"),
        F.when(F.length("text") > 1500, F.lit("text too long: ")).alias("error"),
        "text",
    )
    items = archive.import_items(items.withColumn("error", F.concat("error", "text")).drop("text"))
    totals, failures = archive.import_status(items)
    return totals.join(failures, "import_id", "left").select(
        "import_id", "processed", "failed", F.coalesce("ordinal", F.lit(-1)).alias("ordinal"),
        F.length(F.coalesce("error_message", F.lit(""))).cast("bigint").alias("message_chars"),
    )


def integrity_audit(spark: SparkSession, d: str) -> DataFrame:
    """Manifests and segments of every conversation checked against a listing with some files gone."""
    rows = corpus.catalog(spark, d)
    manifests = rows.select(
        "revision_id", F.concat(F.lit("m/"), "revision_id").alias("manifest_key"),
        F.array(F.when(F.col("num") % 23 == 1, F.lit(None)).otherwise(F.concat(F.lit("s/"), "segment_id"))).alias("segment_keys"), "num",
    )
    files = manifests.filter("num % 19 <> 2").select(F.col("manifest_key").alias("key")).unionByName(
        rows.filter("num % 29 <> 3").select(F.concat(F.lit("s/"), "segment_id").alias("key")).distinct()
    )
    return archive.integrity_audit(manifests, files).select("problem", "detail")


QUERIES = {
    f.__name__: f
    for f in (
        current_revisions, list_conversations, list_namespaces, memory_stats, index_health, context_window, context_ranges,
        conversation_page, scope_requests, provision_users, namespace_backfill, append_conflicts, appended_nodes,
        tag_updates, delete_report, delete_scopes, orphan_segments, index_state_latest, reindex_worklist, dead_letters,
        stale_vectors, removed_derived, raw_checksums, duplicate_exports, import_status, integrity_audit,
    )
}
