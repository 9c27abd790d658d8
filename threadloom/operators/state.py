"""Index life cycle as an append-only event log and the view of the latest state per revision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.ids import domain_id

KEYS = ["revision_id", "generation_id"]


def latest_state(events: DataFrame) -> DataFrame:
    """Fold ``events(revision_id, generation_id, status, at, seq)`` into one row per revision and generation.

    Queueing again resets the times of the run before; ``attempts`` counts every start.  All aggregates
    combine before the shuffle, so a key with very many events is no bottleneck.
    """
    at = lambda status: F.max(F.when(F.col("status") == status, F.col("at")))
    rows = events.groupBy(*KEYS).agg(
        F.max_by("status", F.struct("at", "seq")).alias("status"),
        F.count_if(F.col("status") == "processing").alias("attempts"),
        F.coalesce(at("queued"), F.min("at")).alias("queued_at"),
        at("processing").alias("_started"),
        at("indexed").alias("_indexed"),
        at("failed").alias("_failed"),
        F.max("at").alias("updated_at"),
        *[F.max_by(c, F.struct("at", "seq")).alias(c) for c in ("chunk_count", "error_message") if c in events.columns],
    )
    started = F.when(F.col("_started") >= F.col("queued_at"), F.col("_started"))
    since = F.coalesce("_started", "queued_at")
    return rows.select(
        *KEYS,
        "status",
        "attempts",
        "queued_at",
        started.alias("started_at"),
        F.when(F.col("_indexed") >= F.col("queued_at"), F.col("_indexed")).alias("indexed_at"),
        F.when((F.col("_failed") >= F.greatest("queued_at", since)), F.col("_failed")).alias("failed_at"),
        "updated_at",
        *[c for c in ("chunk_count", "error_message") if c in events.columns],
    )


def indexable(revisions: DataFrame, current: DataFrame) -> DataFrame:
    """Revisions that are current and not deleted; derived rows of the others have to go."""
    return revisions.join(current.select("revision_id"), "revision_id", "left_semi")


def remove_derived(derived: DataFrame, current: DataFrame) -> DataFrame:
    """Chunks, vectors or postings without the rows of revisions that may no longer be indexed."""
    return derived.join(current.select("revision_id"), "revision_id", "left_semi")


def reindex_worklist(current: DataFrame, state: DataFrame, generation_id: str, force: bool = True) -> DataFrame:
    """``(job_id, revision_id, generation_id)``: every live revision, or only those not yet indexed."""
    rows = current.select("revision_id").withColumn("generation_id", F.lit(generation_id))
    if not force:
        rows = rows.join(state.filter("status = 'indexed'").select(*KEYS), KEYS, "left_anti")
    return rows.select(domain_id("index-job", F.col("revision_id"), F.col("generation_id")).alias("job_id"), *KEYS)


def dead_letter(state: DataFrame) -> DataFrame:
    """Failed work that used up its attempts."""
    return state.filter((F.col("status") == "failed") & (F.col("attempts") >= fixed.MAX_ATTEMPTS))


def transition(
    revisions: DataFrame,
    generation_id: str,
    status: str,
    at: Column,
    seq: Column,
    chunk_count: Column | None = None,
    error: str | None = None,
) -> DataFrame:
    """Events that move ``revisions(revision_id)`` to ``status``, with what is known of the run."""
    if status not in fixed.INDEX_STATES:
        raise ValueError(f"unknown index state {status}")
    return revisions.select(
        "revision_id", F.lit(generation_id).alias("generation_id"), F.lit(status).alias("status"),
        at.alias("at"), seq.alias("seq"),
        (F.lit(None) if chunk_count is None else chunk_count).cast("bigint").alias("chunk_count"),
        F.lit(None if error is None else error[:1000]).cast("string").alias("error_message"),
    )


def ensure_generation(generations: DataFrame, generation_id: str, model: str, dimensions: int, at: Column) -> DataFrame:
    """Rows to append to ``generations`` so that ``generation_id`` is registered exactly once."""
    spark = generations.sparkSession
    row = spark.range(1).select(
        F.lit(generation_id).alias("generation_id"),
        F.lit("active").alias("status"),
        F.lit(fixed.CHUNK_STRATEGY).alias("chunk_strategy"),
        F.lit(model).alias("embedding_model"),
        F.lit(dimensions).alias("embedding_dimensions"),
        at.alias("created_at"),
    )
    return row.join(generations.select("generation_id"), "generation_id", "left_anti")
