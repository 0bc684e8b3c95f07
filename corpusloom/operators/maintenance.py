"""Keeping an index in step with its files, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Event kinds, in order of precedence when several bits of a
# notification are set at once.
EVENT_BITS = (("CREATE", 1), ("WRITE", 2), ("REMOVE", 4), ("RENAME", 8))
ADDING = ("CREATE", "WRITE")
REMOVING = ("REMOVE", "RENAME")


def event_type(op: Column) -> Column:
    """Kind of a notification bit mask; null when it is none of the four."""
    kinds = [F.when(op.bitwiseAND(F.lit(bit)) == bit, F.lit(name)) for name, bit in EVENT_BITS]
    return F.coalesce(*kinds)


def latest_events(events: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """Last event per key by ``(ts, seq)``: a combinable aggregate, so a path
    with very many events still ships one row per task."""
    return events.groupBy(*by).agg(
        F.max_by("event_type", F.struct("ts", "seq")).alias("event_type"),
        F.max("ts").alias("ts"),
    )


def without_sources(index: DataFrame, paths: DataFrame, source_col: str = "source") -> DataFrame:
    """Rows whose source is not listed; rows with a null source stay."""
    gone = paths.select(F.col("path").alias("_path")).distinct()
    return index.join(gone, F.col(source_col) == F.col("_path"), "left_anti")


def delete_by_source(index: DataFrame, path: str, source_col: str = "source") -> DataFrame:
    """Rows of every source but one."""
    return index.where(~F.col(source_col).eqNullSafe(F.lit(path)))


def apply_events(
    index: DataFrame,
    events: DataFrame,
    new_chunks: DataFrame,
    append_only: bool = False,
) -> DataFrame:
    """Index after a batch of file events ``(path, event_type, ts, seq)``.

    Only the latest event of a path counts. Removal drops the rows of that
    source. Creation or change replaces them by the rows of ``new_chunks``
    with that source; ``append_only`` keeps the old ones beside the new.
    Other kinds do nothing.
    """
    last = latest_events(events)
    gone = last.where(F.col("event_type").isin(*REMOVING, *(() if append_only else ADDING)))
    fresh = last.where(F.col("event_type").isin(*ADDING)).select(F.col("path").alias("_path"))
    added = new_chunks.join(fresh, F.col("source") == F.col("_path"), "left_semi")
    return without_sources(index, gone).unionByName(added)


def snapshot_diff(
    previous: DataFrame,
    current: DataFrame,
    detect_deletes: bool = False,
    keys: tuple[str, ...] = ("root", "path"),
    listed: DataFrame | None = None,
) -> DataFrame:
    """Paths that are new or newer: ``(root, path, mtime, change)``.

    A root without any earlier state only sets its baseline: no rows.
    ``detect_deletes`` also reports paths that are gone from a listed root:
    those of ``listed``, or else those with a row in ``current``. A root whose
    last file is gone has to be named there.
    """
    root = keys[0]
    prev = previous.select(*keys, F.col("mtime").alias("_before"))
    known = previous.select(root).distinct()
    if detect_deletes:
        looked = (current if listed is None else listed).select(root).distinct()
        prev = prev.join(looked, root, "left_semi")
    joined = current.join(prev, list(keys), "full_outer" if detect_deletes else "left")
    change = (
        F.when(F.col("mtime").isNull(), F.lit("deleted"))
        .when(F.col("_before").isNull(), F.lit("new"))
        .when(F.col("_before") < F.col("mtime"), F.lit("updated"))
    )
    return (
        joined.withColumn("change", change)
        .where(F.col("change").isNotNull())
        .join(known, root, "left_semi")
        .select(*keys, "mtime", "change")
    )


def next_snapshot(
    previous: DataFrame,
    current: DataFrame,
    keys: tuple[str, ...] = ("root", "path"),
    detect_deletes: bool = False,
    listed: DataFrame | None = None,
) -> DataFrame:
    """State to keep: everything seen, with the newest time of each path.

    With ``detect_deletes`` the state of a listed root (see ``snapshot_diff``)
    keeps only what its listing holds, so that a path that is gone is reported
    once. Roots that were not listed stay as they were.
    """
    before = previous.select(*keys, "mtime")
    if detect_deletes:
        looked = (current if listed is None else listed).select(keys[0]).distinct()
        there = before.join(current.select(*keys).distinct(), list(keys), "left_semi")
        before = there.unionByName(before.join(looked, keys[0], "left_anti"))
    return (
        before.unionByName(current.select(*keys, "mtime"))
        .groupBy(*keys)
        .agg(F.max("mtime").alias("mtime"))
    )


def dispatch_changes(changed: DataFrame, listing: DataFrame) -> DataFrame:
    """WRITE for a changed path that still exists, REMOVE for one that is gone."""
    here = listing.select("path").distinct().withColumn("_here", F.lit(True))
    return changed.join(here, "path", "left").select(
        *changed.columns,
        F.when(F.col("_here"), F.lit("WRITE")).otherwise(F.lit("REMOVE")).alias("event_type"),
    )
