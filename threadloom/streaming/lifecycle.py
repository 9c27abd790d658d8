"""The latest index state as a stream with state of its own.

Every event changes one small value per revision and generation.  Events may come late, in any order and more than
once: what is kept are greatest values, which do not depend on the order, and the numbers of the events that were
counted, which are forgotten some time after the newest event of their key.  The value travels with its rows, once
per key and batch; a processor that asks for its state over a socket takes a round trip for every event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import durable
from ..sources import canonical

KEYS = ["revision_id", "generation_id"]
#: An event older than the newest of its key by so many microseconds is forgotten, so it must not come again after it.
REMEMBERED = 365 * 24 * 3600 * 1_000_000
#: Greatest time of each kind of event, in microseconds.
TIMES = ["queued", "processing", "indexed", "failed"]
VALUE = "status string, at long, seq long, attempts long, first long, " + ", ".join(f"{t} long" for t in TIMES)
FIELDS = [part.split()[0] for part in VALUE.split(", ")]
OUTPUT = f"revision_id string, generation_id string, {VALUE}"


def folded(events: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """The changed values of streamed ``events(revision_id, generation_id, status, at, seq)``."""

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None,) * len(FIELDS) + ([], [])
        value, counted = dict(zip(FIELDS, held)), dict(zip(*held[-2:]))
        known = len(counted)
        for batch in batches:
            for status, at, seq in zip(batch["status"].tolist(), batch["at"].tolist(), batch["seq"].tolist()):
                if seq in counted:
                    continue
                counted[seq] = at
                if value["at"] is None or (at, seq) > (value["at"], value["seq"]):
                    value.update(status=status, at=at, seq=seq)
                value["first"] = at if value["first"] is None else min(value["first"], at)
                value["attempts"] = (value["attempts"] or 0) + (status == "processing")
                if status in TIMES:
                    value[status] = at if value[status] is None else max(value[status], at)
        if len(counted) > known:
            kept = {s: at for s, at in counted.items() if at >= value["at"] - remembered}
            state.update((*value.values(), list(kept), list(kept.values())))
            # objects, since giving every column of one row its type takes longer than the fold
            yield pd.DataFrame([[*key, *value.values()]], columns=[*KEYS, *FIELDS], dtype=object)

    slim = events.select(*KEYS, "status", F.unix_micros("at").alias("at"), F.col("seq").cast("long").alias("seq"))
    return slim.groupBy(*KEYS).applyInPandasWithState(
        fold, OUTPUT, VALUE + ", counted array<long>, counted_at array<long>", "update", GroupStateTimeout.NoTimeout
    )


def as_state(values: DataFrame) -> DataFrame:
    """Folded values as the columns of :func:`..operators.state.latest_state`."""
    queued = F.coalesce("queued", "first")
    since = F.greatest(queued, F.coalesce("processing", queued))
    return values.select(
        *KEYS,
        "status",
        "attempts",
        F.timestamp_micros(queued).alias("queued_at"),
        F.timestamp_micros(F.when(F.col("processing") >= queued, F.col("processing"))).alias("started_at"),
        F.timestamp_micros(F.when(F.col("indexed") >= queued, F.col("indexed"))).alias("indexed_at"),
        F.timestamp_micros(F.when(F.col("failed") >= since, F.col("failed"))).alias("failed_at"),
        F.timestamp_micros("at").alias("updated_at"),
    )


def latest_state_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the table at ``path`` equal to the latest state of all ``events`` that have come, and stop at their end.

    A batch replaces the rows of the keys that it changed, so one that is delivered again changes nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        rows = durable(as_state(batch))
        canonical.replace_revisions(rows, path, rows.select(*KEYS))

    return (
        folded(events)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
