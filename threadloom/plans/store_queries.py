"""Registered queries over a store: tables that are written from the given ones, changed, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ids
from ..operators import erasure, mutations, revisions, state
from ..session import checkpoint_dir, durable, stored
from ..sources import canonical
from ..streaming import lifecycle
from . import catalog_queries, corpus, search_queries

BUCKETS = 16
AT = "2024-02-01 00:00:00"


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"


def _store(spark: SparkSession, d: str, with_chunks: bool) -> str:
    """A store of the model: revisions, nodes, import items, queued states and, if asked for, chunks."""
    store = _folder(spark)
    for name in ("revisions", "nodes", "import_items", "index_state", "chunks", "tombstones"):
        canonical.bucket_count(spark, f"{store}/{name}", BUCKETS)
    heads = stored(corpus.catalog(spark, d).withColumn("seq", F.lit(0).cast("bigint")))
    owned = corpus.revision_nodes(spark, d, heads)
    canonical.append_new(owned, f"{store}/nodes", ["revision_id", "node_id"], bucket_by="revision_id")
    items = heads.select(
        F.concat(F.lit("file"), F.col("num") % 7).alias("file"), F.col("conversation_id").alias("ordinal"), "conversation_id", "revision_id"
    )
    canonical.append_new(items, f"{store}/import_items", ["file", "ordinal"], bucket_by="file")
    at = F.lit(corpus.AS_OF).cast("timestamp")
    queued = state.transition(heads, corpus.GENERATION, "queued", at, F.unix_micros(at))
    canonical.append_new(queued, f"{store}/index_state", ["revision_id", "generation_id", "status"], bucket_by="revision_id")
    if with_chunks:
        made = corpus.chunks(spark, d, heads)
        canonical.replace_revisions(made, f"{store}/chunks", made.select("revision_id", "generation_id").distinct())
    canonical.append_new(heads, f"{store}/revisions", ["conversation_id", "revision_id"], bucket_by="conversation_id")
    return store


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation in a scope that fits some of them; every eighth name is unknown."""
    num = F.col("num")
    return corpus.headers(spark, d).select(
        F.concat(F.lit("r"), "conversation_id").alias("request_id"),
        F.when(num % 8 == 0, F.concat(F.lit("x"), "conversation_id")).otherwise(F.col("conversation_id")).alias("conversation_id"),
        F.when(num % 3 == 0, F.array(F.lit("ns0"), F.lit("ns1"))).alias("namespaces"),
        F.when(num % 5 == 0, F.lit("u1")).alias("user_id"),
        "num",
    )


def deleted_state(spark: SparkSession, d: str) -> DataFrame:
    """What every table of a store holds after a third of the conversations was asked to go, in two deliveries."""
    store = _store(spark, d, with_chunks=True)
    asked = stored(_requests(spark, d).filter("num % 3 <> 1").drop("num"))
    at = F.lit(AT).cast("timestamp")
    report = erasure.delete_conversations(spark, store, asked, "batch-1", at)
    erasure.delete_conversations(spark, store, asked, "batch-1", at)
    counted = report.groupBy(F.concat(F.lit("outcome "), "outcome").alias("name")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("conversation_id").alias("conversations")
    )
    for name in ("revisions", "nodes", "chunks", "import_items", "tombstones"):
        rows = canonical.read_table(spark, f"{store}/{name}")
        counted = counted.unionByName(
            rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("conversation_id").alias("conversations")).withColumn("name", F.lit(name))
        )
    states = canonical.read_table(spark, f"{store}/index_state")
    return counted.unionByName(
        states.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("revision_id").alias("conversations")).withColumn("name", F.lit("index_state"))
    )


def load_current(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of every conversation that its request may see and that was not deleted."""
    store = _store(spark, d, with_chunks=False)
    gone = corpus.headers(spark, d).filter("num % 17 = 3").select("conversation_id", F.lit(AT).cast("timestamp").alias("deleted_at"))
    canonical.append_new(gone, f"{store}/tombstones", ["conversation_id"], bucket_by="conversation_id")
    heads, nodes = canonical.load_current(spark, store, _requests(spark, d).drop("num"))
    rows = heads.select("request_id", "revision_id").join(nodes, "revision_id")
    return rows.select("request_id", "revision_id", "node_id", "role", F.sha2("text", 256).alias("text_sha"))


def append_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Every third message is appended to its conversation again, on the right or a wrong base, all at once."""
    heads = stored(corpus.catalog(spark, d))
    nodes = corpus.revision_nodes(spark, d, heads)
    sizes = corpus.messages(spark, d).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("active_messages"))
    heads = stored(heads.join(sizes, "conversation_id").withColumn("tags", corpus.tags_of(F.col("num"))))
    message = F.struct("role", F.col("text").alias("content"), F.lit(None).cast("timestamp").alias("timestamp"))
    num, turn = F.col("num"), F.col("turn")
    base = corpus.messages(spark, d).filter("turn % 3 = 0").join(heads.select("conversation_id", "revision_id"), "conversation_id")
    appends = base.select(
        F.concat_ws(":", "conversation_id", "turn").alias("request_id"),
        F.when(num % 9 == 0, F.concat(F.lit("x"), "conversation_id")).otherwise(F.col("conversation_id")).alias("conversation_id"),
        F.when((num + turn) % 4 == 1, "stale").otherwise(F.col("revision_id")).alias("base_revision_id"),
        (-turn).alias("seq"),
        F.array(message, message).alias("messages"),
        F.array(F.concat(F.lit(" New "), turn), F.lit("LANG0")).alias("tags"),
    )
    done = mutations.append_revisions(appends, heads, nodes, F.lit(AT).cast("timestamp"))
    sized = done.nodes.groupBy("revision_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("role") == "user").alias("user_nodes"))
    made = done.revisions.join(sized, "revision_id").select(
        "request_id", "base_revision_id", "nodes", "user_nodes", "current_node", F.array_join("tags", "|").alias("tags"), ids.iso(F.col("updated_at")).alias("updated_at")
    )
    return done.outcomes.join(made, "request_id", "left").select(
        "request_id",
        "outcome",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_revision_id", "current_node", "tags", "updated_at")],
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("nodes", "user_nodes")],
    )


def index_state_stream(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of every key, kept by a stream over ``events``."""
    folder = _folder(spark)
    source = f"{d}/events.parquet"
    # a stream takes a folder or a pattern, and the table may be one file
    rows = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{d}/events.parque[t]")
    lifecycle.latest_state_stream(search_queries.life_cycle(rows), f"{folder}/state", f"{folder}/progress").awaitTermination()
    return catalog_queries.state_rows(canonical.read_table(spark, f"{folder}/state"))


QUERIES = {f.__name__: f for f in (deleted_state, load_current, append_revisions, index_state_stream)}
