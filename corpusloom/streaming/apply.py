"""Keeping an index fresh: from event streams and from polled snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.maintenance import (
    ADDING,
    dispatch_changes,
    next_snapshot,
    snapshot_diff,
)
from corpusloom.sources.index_store import IndexStore
from corpusloom.sources.watch_manifest import latest_state, write_state


def index_sink(
    store: IndexStore, chunks_of: Callable[[DataFrame], DataFrame], writer: str | None = None
) -> Callable[[DataFrame, int], None]:
    """Sink for ``debounced``: chunk the added paths and apply the events.

    ``writer`` names the stream, one name for each checkpoint: its batches are
    keyed by it and their number, so that a repeated one changes nothing and no
    other writer's rows are touched. Without a name, a restarted stream applies
    its last batch again, which leaves the same rows.
    """
    name = writer or uuid.uuid4().hex

    def sink(events: DataFrame, batch_id: int) -> None:
        events.persist()
        try:
            added = F.col("event_type").isin(*ADDING)
            paths = events.where(added).select("path").distinct()
            store.apply(events, chunks_of(paths), batch=f"{name}-{batch_id}")
        finally:
            events.unpersist()

    return sink


def poll_once(
    spark: SparkSession,
    state_root: str,
    listing: DataFrame,
    batch_id: int,
    use: Callable[[DataFrame], None],
    detect_deletes: bool = False,
    listed: DataFrame | None = None,
) -> None:
    """One tick of a polled watch.

    ``use`` gets ``(root, path, mtime, change, event_type)``, the difference
    between the listing and the last published state. The new state is
    published under ``batch_id`` only after ``use`` has returned, so that after
    a failure the next tick finds the same changes. The first tick only sets
    the baseline.
    """
    before = latest_state(spark, state_root)
    use(dispatch_changes(snapshot_diff(before, listing, detect_deletes, listed=listed), listing))
    after = next_snapshot(before, listing, detect_deletes=detect_deletes, listed=listed)
    write_state(after, state_root, batch_id)


def every(
    spark: SparkSession, seconds: int, tick: Callable[[int], None], checkpoint: str
) -> StreamingQuery:
    """Call ``tick`` at a fixed period, driven by a trigger."""
    return (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", 1)
        .load()
        .writeStream.foreachBatch(lambda _rows, batch_id: tick(batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{seconds} seconds")
        .start()
    )
