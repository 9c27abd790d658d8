"""Deletion of conversations from every table of a store, resumable after a lost write.

The tombstone comes first, so readers stop seeing a conversation at once; then canonical rows, vectors and the
rows of the catalog go, and the revision log, from which everything else is found, goes last.  Only buckets that
hold a row to remove are written again, all from one list of revisions.  Each table that is done is noted under
the id of the batch; the same batch, delivered again, goes on at the table where the last delivery ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import durable
from ..sources import canonical
from . import mutations

BY_REVISION, BY_GENERATION = ["bucket"], ["generation_id", "bucket"]
#: Stage, table, key of the rows to remove, layout and bucket column of the table, in the order of removal.
STEPS = [
    ("canonical", "segments", "revision_id", BY_REVISION, "revision_id"),
    ("canonical", "nodes", "revision_id", BY_REVISION, "revision_id"),
    ("vectorize", "vectors", "revision_id", BY_GENERATION, "revision_id"),
    ("catalog", "postings", "revision_id", BY_GENERATION, "revision_id"),
    ("catalog", "documents", "revision_id", BY_GENERATION, "revision_id"),
    ("catalog", "chunks", "revision_id", BY_GENERATION, "revision_id"),
    ("catalog", "index_state", "revision_id", BY_REVISION, "revision_id"),
    ("catalog", "import_items", "revision_id", BY_REVISION, "file"),
    ("catalog", "revisions", "conversation_id", BY_REVISION, "conversation_id"),
]
#: Rows of the import log stay, without the ids of what is gone.
KEPT = {"import_items": ("conversation_id", "revision_id")}


def delete_conversations(spark: SparkSession, store: str, requests: DataFrame, batch_id: str, at: Column) -> DataFrame:
    """Delete what ``requests(request_id, conversation_id, namespaces, user_id)`` name and may delete.

    Returns the report of :func:`.mutations.delete_report`.  An error ends the work; its stage is reported for
    every conversation of the batch, which stays hidden until the batch is delivered again.
    """
    requests = durable(requests)
    log = canonical.lookup(spark, f"{store}/revisions", requests, "conversation_id")
    if log is None:
        raise ValueError(f"there is no revision log in {store}")
    log = durable(log)
    held = log.groupBy("conversation_id").agg(F.max_by(F.struct("namespace", "user_id"), "seq").alias("_h"))
    held = held.select("conversation_id", "_h.*")
    report = durable(mutations.delete_report(requests, held))
    gone = durable(report.filter("outcome = 'deleted'").select("conversation_id").distinct())
    failed_at = None
    stage = "tombstone"
    try:
        rows = gone.withColumn("deleted_at", at)
        canonical.append_new(rows, f"{store}/tombstones", ["conversation_id"], bucket_by="conversation_id")
        doomed = durable(log.join(gone, "conversation_id", "left_semi").select("conversation_id", "revision_id"))
        for stage, name, key, layout, bucket_by in STEPS:
            if name not in _marked(spark, store, batch_id):
                change = {c: F.lit(None).cast("string") for c in KEPT[name]} if name in KEPT else None
                canonical.rewrite(spark, f"{store}/{name}", doomed, key, layout, bucket_by, change)
                _mark(spark, store, batch_id, name, at)
    except Exception:  # reported per conversation; the caller delivers the batch again
        failed_at = stage
    if failed_at is None:
        return report
    failures = gone.withColumn("stage", F.lit(failed_at))
    return durable(mutations.delete_report(requests, held, failures))


def _marked(spark: SparkSession, store: str, batch_id: str) -> set[str]:
    marks = canonical.read_table(spark, f"{store}/deletions")
    if marks is None:
        return set()
    return {r["table"] for r in marks.filter(F.col("batch_id") == batch_id).select("table").distinct().collect()}


def _mark(spark: SparkSession, store: str, batch_id: str, name: str, at: Column) -> None:
    row = spark.range(1).select(F.lit(batch_id).alias("batch_id"), F.lit(name).alias("table"), at.alias("at"))
    canonical.append_new(row, f"{store}/deletions", ["batch_id", "table"])
