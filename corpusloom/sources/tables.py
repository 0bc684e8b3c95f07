"""Reading parquet tables and spreading small ones over the cluster."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A scan smaller than this per core does not split finely enough by itself.
SPREAD_BYTES_PER_CORE = 32 * 1024 * 1024
# Removes the shuffle files of a write as soon as it is over.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Bits for each key that a filter holds, and bits that it has at most (16 MB).
BITS_PER_KEY, MOST_BITS = 64, 1 << 27
# Bits of one row of a filter.
BITS_PER_ROW = 1 << 15


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, in bytes."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin rows over all cores, but only when the input is so small
    that its own file splits would leave cores idle. Large inputs keep their
    splits and are never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan_bytes(df) < cores * SPREAD_BYTES_PER_CORE:
        return df.repartition(cores)
    return df


def work_dir(spark: SparkSession) -> str:
    """A new path in the folder that the whole cluster shares. Without one, a
    temporary folder will do on a single machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/corpusloom/{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind: it is read from its
    own files afterwards."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, path: str) -> DataFrame:
    """Writes a table and reads it again: later steps start from files that
    survive a lost executor, and their plan starts at a scan of known size. What
    was shuffled for it is not kept."""
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables that nothing reads any more."""
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def perhaps_among(df: DataFrame, keys: list[Column], wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose keys are those of a row of ``wanted``, and a few others:
    what a join on the keys would drop again need not be shuffled for it. ``wanted`` has
    a column for each key, of the same type.

    A bitmap of hashes goes to the tasks. Its size is bounded; with more keys than it
    has room for it lets more rows pass, and never drops one that is wanted.
    """
    n = wanted.count()
    bits = min(MOST_BITS, max(BITS_PER_ROW, 1 << (BITS_PER_KEY * max(n, 1) - 1).bit_length()))

    def place(columns: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(bits))

    def row(at: Column) -> Column:
        return F.shiftright(at, BITS_PER_ROW.bit_length() - 1)

    at = place([F.col(c) for c in wanted.columns])
    marks = wanted.select(row(at).alias("_row"), F.pmod(at, F.lit(BITS_PER_ROW)).alias("_at"))
    marks = marks.groupBy("_row").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    # As numbers of 64 bits, the first byte of each being its highest.
    word = lambda i: F.conv(F.hex(F.substring(F.col("_bits"), 8 * i + 1, F.lit(8))), 16, -10).cast("bigint")
    marks = marks.select("_row", F.transform(F.sequence(F.lit(0), F.lit(511)), word).alias("_words"))
    own = df.withColumn("_place", place(keys)).withColumn("_row", row(F.col("_place")))
    at = F.pmod(F.col("_place"), F.lit(BITS_PER_ROW)).cast("int")
    bit = 56 - F.shiftright(at, 3).bitwiseAND(7) * 8 + at.bitwiseAND(7)
    found = own.join(F.broadcast(marks), "_row").where(F.getbit(F.get("_words", F.shiftright(at, 6)), bit) == 1)
    return found.select(*df.columns)
