"""Exact deduplication with disk-backed keyed streaming state.

Documents are equal when nothing but ASCII white space tells them apart. Their
digests flow through a streaming aggregation whose state lives in RocksDB and
never expires: per digest it retains the number of rows, the stable identifier
of the row that stays, and the locator of that row's content. Whatever hits a
digest that is already there is then compared by its full bytes; should two
different texts ever share a digest, their rows are grouped by the text itself.

Only DataFrame operations. Texts are shuffled once, one per digest and task.

Defined results: a null text counts as empty, and all empty texts are copies of
each other. A null `doc_id` sorts after all others. Rows that repeat an id and a
text are copies like others: of rows that agree in length and id the first as
read stays. An empty table gives an empty result. Other columns of the
input, whatever they are called, are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.columns import fresh
from corpusloom.llm.store import shared_dir, written

_STATE = "spark.sql.streaming.stateStore"
STATE_SETTINGS = {
    f"{_STATE}.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Each partition of the state would set aside megabytes before it holds a row.
    f"{_STATE}.rocksdb.allowFAllocate": "false",
    # A batch uploads what it changed, not the whole store.
    f"{_STATE}.rocksdb.changelogCheckpointing.enabled": "true",
}
# Input of one micro-batch: each commits all of the state's partitions once.
BATCH_BYTES = 4 * 1024**3


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "\x20\x09\x0a\x0b\x0c\x0d", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def rocksdb_state(spark):
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _best() -> Column:
    """Orders rows so that the smallest stays: most code points, then id."""
    return F.min(
        F.struct(
            (-F.col("n_chars")).alias("rank"),
            F.col("doc_id").isNull().alias("no_id"),
            F.col("doc_id"),
            F.col("row"),
            F.col("locator"),
        )
    ).alias("best")


def digest_state(digests: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Streams a table of `digest, doc_id, n_chars, row, locator` that lies under
    `path` through the keyed state; returns what the state retains: `digest,
    group_size, keep_id, keep_row, keep_locator`. Run again with the same
    checkpoint, only files that are new under `path` are read.
    """
    spark = digests.sparkSession
    with rocksdb_state(spark):
        stream = (
            spark.readStream.schema(digests.schema)
            .option("maxBytesPerTrigger", str(BATCH_BYTES))
            .parquet(path)
        )
        kept = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), _best())
        run = (
            kept.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
    return state.select(
        F.col("key.digest").alias("digest"),
        F.col("value.count").alias("group_size"),
        F.col("value.min.doc_id").alias("keep_id"),
        F.col("value.min.row").alias("keep_row"),
        F.col("value.min.locator").alias("keep_locator"),
    )


def _locator(docs: DataFrame) -> Column:
    """The file that holds a row; null for tables that come from several."""
    try:
        docs.select(F.input_file_name())
    except AnalysisException:
        return F.lit(None).cast("string")
    return F.input_file_name()


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: `doc_id, keep_id, group_size, kept, text_sha256,
    keep_locator, n_chars`. Exactly one row of a group is `kept`.

    `digest` maps a normalised text to its key; another than SHA-256 only serves
    to try out collisions. `text_sha256` is always SHA-256.
    """
    spark = docs.sparkSession
    root = shared_dir(spark)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    norm = normalised(F.col("text"))
    digests = written(
        texts.select(
            "doc_id",
            digest(norm).alias("digest"),
            sha256(norm).alias("text_sha256"),
            F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"),
            # Tells apart rows that agree in length and id.
            F.monotonically_increasing_id().alias("row"),
            _locator(texts).alias("locator"),
        ),
        f"{root}/digests",
    )
    state = written(
        digest_state(digests, f"{root}/digests", f"{root}/state"), f"{root}/retained"
    )

    # The full bytes behind every digest: all texts that hit it are the same if
    # the least and the greatest are. Copies meet in the tasks that read them.
    bodies = texts.select("doc_id", "text", digest(norm).alias("digest"), norm.alias("norm"))
    extremes = bodies.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    collided = written(extremes.where("least <> most").select("digest"), f"{root}/collided")

    rows = digests.join(state, "digest").drop("locator")
    if not collided.isEmpty():
        apart = written(
            bodies.join(collided, "digest", "left_semi").select(
                "doc_id",
                "norm",
                sha256(F.col("norm")).alias("text_sha256"),
                F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"),
                F.monotonically_increasing_id().alias("row"),
                F.lit(None).cast("string").alias("locator"),
            ),
            f"{root}/apart",
        )
        groups = apart.groupBy("norm").agg(F.count(F.lit(1)).alias("group_size"), _best())
        split = apart.join(groups, "norm").select(
            "doc_id",
            "text_sha256",
            "n_chars",
            "row",
            "group_size",
            F.col("best.doc_id").alias("keep_id"),
            F.col("best.row").alias("keep_row"),
            F.col("best.locator").alias("keep_locator"),
        )
        rows = (
            rows.join(collided, "digest", "left_anti")
            .select(*split.columns)
            .unionByName(split)
        )
    return rows.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        "text_sha256",
        "keep_locator",
        "n_chars",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with all their columns. Rows
    of a group that agree in id and length may stand in for each other."""
    keep, kept_sha, kept_size, own_sha, own_size = (
        fresh(docs, n) for n in ("keep", "kept_sha", "kept_size", "own_sha", "own_size")
    )
    fate = exact_dedup(docs).where("kept").toDF(
        keep, "keep_id", "group_size", "kept", kept_sha, "keep_locator", kept_size
    ).select(keep, kept_sha, kept_size)
    text = F.col("text").cast("string")
    stays = docs.withColumns(
        {own_sha: sha256(normalised(text)), own_size: F.length(F.coalesce(text, F.lit(""))).cast("bigint")}
    ).join(
        fate,
        docs["doc_id"].eqNullSafe(F.col(keep))
        & (F.col(own_sha) == F.col(kept_sha))
        & (F.col(own_size) == F.col(kept_size)),
        "left_semi",
    )
    return stays.dropDuplicates([own_sha]).drop(own_sha, own_size)
