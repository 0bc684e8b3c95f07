"""Streams of file events: session bounds in state, events in their table.

`debounced_all` loses no event, however late: what has not been handed on yet is a
table that each micro-batch debounces together with what arrived. `debounced` keeps
less, and drops what lies behind its watermark. Its stateful part keeps one small row per open session of a root: its bounds.
The events themselves stay in the event table that feeds the stream; once a
session closes, the micro-batch reads just that stretch of the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.debounce import debounce
from corpusloom.operators.maintenance import event_type

EVENT_SCHEMA = "root string, path string, op int, ts timestamp, seq bigint"
# Fixed value: quiet time after which pending events are handed on.
GAP = "1 second"
# Rows later than this behind the newest event are dropped by the stream.
DELAY = "10 seconds"
SLICE_SECONDS = 60


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """Event stream from a parquet table; unknown kinds are left out."""
    return known_events(spark.readStream.schema(schema).parquet(path))


def known_events(raw: DataFrame) -> DataFrame:
    return raw.withColumn("event_type", event_type(F.col("op"))).where(
        F.col("event_type").isNotNull()
    )


def closed_sessions(events: DataFrame, gap: str = GAP, delay: str = DELAY) -> DataFrame:
    """``(root, start, end)`` of sessions that can no longer grow; ``end`` is
    the last event plus the gap. Append mode holds open sessions back."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap), "root")
        .agg(F.count("*").alias("events"))
        .select(
            "root",
            F.col("session_window.start").alias("start"),
            F.col("session_window.end").alias("end"),
            "events",
        )
    )


def last_events_of_sessions(
    sessions: DataFrame, events: DataFrame, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """``(root, start, path, event_type, ts, seq)``: last event per path and session.

    Sessions of a root do not overlap, so an event belongs to the last session
    that started before it, if that has not ended. Both sides are cut into
    time slices, so that a busy root spreads over many tasks and the pairing
    is one ordered pass instead of a range join.
    """
    width = slice_seconds * 1_000_000
    start, end = F.unix_micros("start"), F.unix_micros("end")
    marks = sessions.select(
        "root",
        F.struct(F.col("start").alias("start"), end.alias("end")).alias("_session"),
        start.alias("_start"),
        F.explode(F.sequence(F.floor(start / width), F.floor(end / width))).alias("_slice"),
    ).select(
        "root",
        "_slice",
        F.greatest(F.col("_start"), F.col("_slice") * width).alias("_us"),
        "_session",
        F.lit(None).cast("struct<path:string,event_type:string,ts:timestamp,seq:bigint>").alias("_e"),
    )
    us = F.unix_micros("ts")
    rows = events.select(
        "root",
        F.floor(us / width).alias("_slice"),
        us.alias("_us"),
        F.lit(None).cast("struct<start:timestamp,end:bigint>").alias("_session"),
        F.struct("path", "event_type", "ts", F.col("seq").cast("bigint").alias("seq")).alias("_e"),
    )
    order = (
        Window.partitionBy("root", "_slice")
        .orderBy("_us", F.col("_e").isNotNull())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        marks.unionByName(rows)
        .withColumn("_in", F.last("_session", ignorenulls=True).over(order))
        .where(F.col("_e").isNotNull() & (F.col("_us") < F.col("_in.end")))
        .groupBy("root", F.col("_in.start").alias("start"), F.col("_e.path").alias("path"))
        .agg(F.max_by("_e", F.struct("_e.ts", "_e.seq")).alias("_e"))
        .select("root", "start", "path", "_e.event_type", "_e.ts", "_e.seq")
    )


def debounced(
    stream: DataFrame,
    event_table: Callable[[], DataFrame],
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    gap: str = GAP,
    delay: str = DELAY,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Hand the last event per path of every closed session to ``sink``.

    ``event_table`` gives a batch reader of the same events; it is asked for
    the time stretch of the sessions that closed in this micro-batch.
    """

    def on_batch(sessions: DataFrame, batch_id: int) -> None:
        # The state is read once, however often the sink looks at its rows.
        sessions = sessions.persist()
        try:
            stretch = sessions.agg(F.min("start").alias("lo"), F.max("end").alias("hi")).first()
            if stretch["lo"] is None:
                return
            near = event_table().where(F.col("ts").between(stretch["lo"], stretch["hi"]))
            sink(last_events_of_sessions(sessions, near), batch_id)
        finally:
            sessions.unpersist()

    return (
        closed_sessions(stream, gap, delay)
        .writeStream.foreachBatch(on_batch)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


_PENDING = "root string, path string, event_type string, ts timestamp, seq bigint"
_HANDED = "root string, session_start timestamp, path string, event_type string, ts timestamp"


def debounced_all(
    stream: DataFrame,
    sink: Callable[[DataFrame, int], None],
    path: str,
    checkpoint: str,
    gap_seconds: float = 1.0,
    delay_seconds: float = 10.0,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Hand the last event per path of every closed session to ``sink``, with
    nothing dropped: ``root, session_start, path, event_type, ts``.

    A session is closed when ``delay_seconds`` have passed, by the newest event seen,
    since it fell quiet. An event that comes later still is handed on with its own
    micro-batch, unless a newer event of its path has been handed on before: the
    last event per path is the same as that of all events debounced at once.

    ``path`` is a shared folder for what is pending, handed on, and the newest time.
    A batch writes under its own number and overwrites what a failed attempt left.
    """
    gap, delay = int(gap_seconds * 1_000_000), int(delay_seconds * 1_000_000)
    spark = stream.sparkSession

    def stored(name: str, schema: str, only: Callable[[int], bool]) -> DataFrame:
        """The batches of a table that are wanted; few numbers come to the driver."""
        try:
            table = spark.read.schema(f"{schema}, batch bigint").parquet(f"{path}/{name}")
        except Exception as e:  # noqa: BLE001 - the class depends on the kind of session
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema)
        return table.where(only(F.col("batch"))).drop("batch")

    def put(df: DataFrame, name: str, batch: int) -> DataFrame:
        own = f"{path}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(own)
        return spark.read.schema(df.schema).parquet(own)

    def on_batch(arrived: DataFrame, batch: int) -> None:
        columns = [c.split()[0] for c in _PENDING.split(", ")]
        before = stored("pending", _PENDING, lambda b: b == batch - 1)
        pool = put(before.unionByName(arrived.select(*columns)), "pool", batch)
        newest = stored("newest", "ts timestamp", lambda b: b < batch).unionByName(pool.select("ts"))
        high = put(newest.agg(F.max("ts").alias("ts")), "newest", batch).first()["ts"]
        if high is None:
            return
        last = put(debounce(pool, gap_seconds), "last", batch)
        limit = F.unix_micros(F.lit(high)) - delay
        ends = last.groupBy("root", "session_start").agg(F.max("ts").alias("end"))
        open_ = F.unix_micros("end") + gap > limit
        # Sessions do not overlap: all from a root's first open one are open.
        since = ends.where(open_).groupBy("root").agg(F.min("session_start").alias("since"))
        put(pool.join(since, "root").where("ts >= since").drop("since"), "pending", batch)
        closed = last.join(ends.where(~open_).select("root", "session_start"), ["root", "session_start"], "left_semi")
        newer = (
            stored("handed", _HANDED, lambda b: b < batch)
            .groupBy("root", "path")
            .agg(F.max("ts").alias("handed"))
        )
        fresh = closed.join(newer, ["root", "path"], "left").where("handed is null or ts >= handed").drop("handed")
        sink(put(fresh, "handed", batch), batch)

    return (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
