"""Debouncing file events: the last event per path once a root falls quiet.

One timer is shared by all paths of a root, so a session belongs to the root.
A root may hold a large share of all events; its timeline is therefore cut
into slices that are sessionised in parallel, and only one summary row per
slice is stitched together in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def debounce(
    events: DataFrame,
    gap_seconds: float = 1.0,
    slice_seconds: int = 3600,
    closed_at: str | None = None,
) -> DataFrame:
    """``(root, session_start, path, event_type, ts)`` from
    ``(root, path, event_type, ts, seq)``.

    A session ends when no event of the root follows within the gap. With
    ``closed_at`` (a timestamp text) only sessions that ended by then are kept.
    """
    stamped = events.where(F.col("event_type").isNotNull()).withColumn(
        "_us", F.unix_micros(F.col("ts").cast("timestamp"))
    )
    sliced = stamped.withColumn(
        "_slice", F.floor(F.col("_us") / F.lit(slice_seconds * 1_000_000))
    )
    gap = int(gap_seconds * 1_000_000)
    in_slice = Window.partitionBy("root", "_slice").orderBy("_us")
    opens = F.col("_us") - F.lag("_us").over(in_slice)
    local = sliced.withColumn("_opens", F.when(opens > gap, F.col("_us"))).withColumn(
        # Start of the session within the slice; null while it may still
        # belong to a session that began in an earlier slice.
        "_start",
        F.last("_opens", ignorenulls=True).over(
            in_slice.rangeBetween(Window.unboundedPreceding, 0)
        ),
    )
    # One row per (root, slice): where it begins, ends, and its last opening.
    summary = local.groupBy("root", "_slice").agg(
        F.min("_us").alias("_first"),
        F.max("_us").alias("_last"),
        F.max("_opens").alias("_last_open"),
        F.min("_opens").alias("_first_open"),
    )
    by_root = Window.partitionBy("root").orderBy("_slice")
    chained = summary.withColumn(
        "_cut",
        F.coalesce(F.col("_first") - F.lag("_last").over(by_root) > gap, F.lit(True)),
    )
    # Newest opening known at the end of each slice, and the one its head belongs to.
    newest = F.coalesce("_last_open", F.when(F.col("_cut"), F.col("_first")))
    heads = chained.withColumn(
        "_head",
        F.when(F.col("_cut"), F.col("_first")).otherwise(
            F.last(newest, ignorenulls=True).over(
                by_root.rowsBetween(Window.unboundedPreceding, -1)
            )
        ),
    )
    placed = local.join(heads.select("root", "_slice", "_head"), ["root", "_slice"]).withColumn(
        "_session", F.coalesce("_start", "_head")
    )
    last = placed.groupBy("root", "_session", "path").agg(
        F.max_by("event_type", F.struct("_us", "seq")).alias("event_type"),
        F.max("ts").alias("ts"),
        F.max("_us").alias("_us"),
    )
    if closed_at is not None:
        ends = last.groupBy("root", "_session").agg(F.max("_us").alias("_end"))
        limit = F.unix_micros(F.lit(closed_at).cast("timestamp"))
        last = last.join(
            ends.where(F.col("_end") + gap <= limit).select("root", "_session"),
            ["root", "_session"],
            "left_semi",
        )
    return last.select(
        "root",
        F.timestamp_micros("_session").alias("session_start"),
        "path",
        "event_type",
        "ts",
    )
