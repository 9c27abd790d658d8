"""Incremental import and indexing with Structured Streaming.

The source folder and the revision log are streams; each micro-batch is written with deterministic ids
and an anti-join on them, so a batch that is delivered twice or restarted after a failure adds nothing.
Progress lives in the stream checkpoints, which must be on shared storage.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking, graph, lexical, revisions, semantic, state
from ..session import durable
from ..sources import canonical, exports


#: Single revisions that may fail, before any is indexed, until the batch is given up.
PROBES = 3


def ingest_batch(raw: DataFrame, store: str, user_id: str, generation_id: str, at) -> None:
    """Normalise one batch of export items, append nodes, queue events, the item log and new revisions.

    ``raw`` as made by :func:`..sources.exports.with_place`.  Each table is compared with the whole batch on
    its own key and revisions, which readers start from, are written last; so a batch that failed after any
    write is completed by its next delivery, and a complete one adds nothing.
    """
    raw = durable(exports.with_ordinal(raw))
    good, rejected = exports.check_items(raw)
    items = durable(exports.identify(good))
    once = items.dropDuplicates(["item_id"])
    nodes = durable(exports.export_nodes(once))
    rows = revisions.revisions(exports.export_headers(once, nodes), nodes, "item_id")
    rows = durable(rows.withColumns({"user_id": F.lit(user_id), "seq": F.unix_micros(at)}))
    owned = nodes.join(rows.select("item_id", "revision_id"), "item_id").drop("item_id")
    canonical.append_new(owned, f"{store}/nodes", ["revision_id", "node_id"], bucket_by="revision_id")
    queued = state.transition(rows, generation_id, "queued", at, F.unix_micros(at))
    canonical.append_new(queued, f"{store}/index_state", ["revision_id", "generation_id", "status"], bucket_by="revision_id")
    none = F.lit(None).cast("string")
    done = items.select("file", "ordinal", "item_id").join(rows.select("item_id", "source_id", "conversation_id", "revision_id"), "item_id")
    done = done.drop("item_id").withColumns({"status": F.lit("complete"), "error_code": none, "error_message": none})
    failed = rejected.select(
        "file", "ordinal", F.coalesce("id", "conversation_id").alias("source_id"), none.alias("conversation_id"),
        none.alias("revision_id"), F.lit("failed").alias("status"), "error_code", "error_message",
    )
    canonical.append_new(done.unionByName(failed), f"{store}/import_items", ["file", "ordinal"], bucket_by="file")
    canonical.append_new(rows, f"{store}/revisions", ["conversation_id", "revision_id"], bucket_by="conversation_id")


def index_batch(
    batch: DataFrame,
    store: str,
    generation_id: str,
    at,
    tombstones: DataFrame | None = None,
    encode: Callable[[list[str]], np.ndarray] | None = None,
) -> None:
    """Chunk the current revisions among ``batch(revision_id, ...)``, build their full-text rows and vectors, mark them.

    Revisions that are no longer current, were deleted or are indexed already get nothing; those that failed in
    an earlier batch are taken again until their attempts are used up.  The derived rows of a revision are replaced
    as a whole and the ``indexed`` event is the last write, so a failed batch is made good by the next one.

    If a batch fails it is halved until a revision that cannot be indexed stands alone.  It is recorded as ``failed``
    and the rest goes on.  If one revision after the other fails, up to ``PROBES`` of them, the fault is not theirs:
    all are recorded as failed and the error is raised, so that the stream delivers the batch again.
    Without ``encode`` there are no vectors.
    """
    spark = batch.sparkSession
    log = canonical.read_table(spark, f"{store}/revisions")
    nodes = canonical.read_table(spark, f"{store}/nodes")
    if log is None or nodes is None:
        return
    current = revisions.current_view(log.drop("bucket"), tombstones)
    wanted = batch.select("revision_id")
    events = canonical.read_table(spark, f"{store}/index_state")
    if events is not None:
        known = durable(state.latest_state(events.filter(F.col("generation_id") == generation_id)))
        wanted = wanted.unionByName(known.filter("status = 'failed'").select("revision_id"))
        settled = known.filter("status = 'indexed'").unionByName(state.dead_letter(known)).select("revision_id")
        wanted = wanted.join(settled, "revision_id", "left_anti")
    todo = durable(current.join(wanted.distinct(), "revision_id", "left_semi"))

    def mark(rows: DataFrame, status: str, step: int, **details) -> None:
        moved = state.transition(rows, generation_id, status, at, F.unix_micros(at) + step, **details)
        canonical.append_new(
            moved, f"{store}/index_state", ["revision_id", "generation_id", "status", "seq"], bucket_by="revision_id"
        )

    mark(todo, "processing", 1)
    lost: list[Exception] = []
    done = 0

    def index(part: DataFrame, size: int) -> None:
        nonlocal done
        if not size:
            return
        try:
            made = _derive(part, nodes, store, generation_id, encode)
        except Exception as error:
            if size > 1 and not (done == 0 and len(lost) >= PROBES):
                for half in _halves(part):
                    index(half, half.count())
                return
            lost.append(error)
            mark(part, "failed", 2, error=str(error))
            return
        counted = part.join(made.groupBy("revision_id").agg(F.count(F.lit(1)).alias("_chunks")), "revision_id", "left")
        mark(counted, "indexed", 2, chunk_count=F.coalesce("_chunks", F.lit(0)))
        done += size

    index(todo, todo.count())
    if lost and not done:
        raise lost[0]


def _halves(part: DataFrame) -> list[DataFrame]:
    """Two parts of about equal size, by the order of a hash of the revision ids; neither is empty."""
    # 48 bits, which the percentile holds exactly
    place = F.conv(F.substring(F.sha2("revision_id", 256), 1, 12), 16, 10).cast("bigint")
    middle = part.agg(F.percentile_approx(place, 0.5)).first()[0]
    low, high = part.filter(place <= middle), part.filter(place > middle)
    return [durable(low), durable(high)]


def _derive(todo: DataFrame, nodes: DataFrame, store: str, generation_id: str, encode) -> DataFrame:
    """Write chunks, postings, token lists and vectors of the revisions; returns the chunks."""
    if "bucket" in nodes.columns:
        buckets = canonical.bucket_count(todo.sparkSession, f"{store}/nodes")
        nodes = canonical.in_buckets(nodes, todo.select(canonical.bucket_of("revision_id", buckets).alias("bucket"))).drop("bucket")
    owned = nodes.join(todo.select("revision_id"), "revision_id", "left_semi")
    paths = durable(graph.branches(owned, todo, "revision_id"))
    header = todo.select("revision_id", "conversation_id", "title", "namespace", "updated_at")
    made = durable(chunking.chunk(owned, paths, header, generation_id))
    scope = todo.select("revision_id", F.lit(generation_id).alias("generation_id"))
    place = made.select("chunk_id", "revision_id", "generation_id")
    index = lexical.build_index(made)
    tables = {"chunks": made, "postings": index.postings.join(place, "chunk_id"), "documents": index.documents.join(place, "chunk_id")}
    if encode is not None:
        keep = ["vector_id", "chunk_id", "revision_id", "conversation_id", "generation_id", "namespace", "embedding"]
        tables["vectors"] = semantic.embed(made, "body", encode).select(*keep)
    for name, rows in tables.items():
        canonical.replace_revisions(rows, f"{store}/{name}", scope)
    vectors = canonical.read_table(todo.sparkSession, f"{store}/vectors") if encode is not None else None
    if vectors is not None:
        # vectors of earlier generations go once the revision has new ones
        old = vectors.select("revision_id", "generation_id").distinct().filter(F.col("generation_id") != generation_id)
        old = durable(old.join(todo.select("revision_id"), "revision_id", "left_semi"))
        if not old.isEmpty():
            canonical.replace_revisions(tables["vectors"].limit(0), f"{store}/vectors", old)
    return made


def import_stream(
    spark: SparkSession, source: str, store: str, checkpoint: str, user_id: str, generation_id: str, files_per_batch: int = 25
) -> StreamingQuery:
    """Import every new file below ``source`` once and stop."""
    items = (
        spark.readStream.schema(exports.export_schema())
        .option("multiLine", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(source)
    )
    items = exports.with_place(items)
    return (
        items.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, _: ingest_batch(batch, store, user_id, generation_id, F.current_timestamp()))
        .start()
    )


def index_stream(
    spark: SparkSession, store: str, checkpoint: str, generation_id: str, tombstones: DataFrame | None = None, encode=None
) -> StreamingQuery:
    """Index every revision that was appended since the last run and stop."""
    schema = spark.read.parquet(f"{store}/revisions").schema
    return (
        spark.readStream.schema(schema)
        .parquet(f"{store}/revisions")
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, _: index_batch(batch, store, generation_id, F.current_timestamp(), tombstones, encode))
        .start()
    )
