"""Watch manifest: which roots are watched, and the file times last seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# Field names of the manifest's JSON lines.
SCHEMA = (
    "GivenPath string, WatcherType string, Period bigint, LastUpdate map<string,timestamp>"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; malformed ones are dropped, a missing file has no rows."""
    try:
        return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], SCHEMA)


def file_times(manifest: DataFrame) -> DataFrame:
    """``(root, path, mtime)``: the map of each watcher as rows."""
    return manifest.select(
        F.col("GivenPath").alias("root"), F.explode("LastUpdate").alias("path", "mtime")
    )


STATE_SCHEMA = "root string, path string, mtime timestamp"


def write_state(times: DataFrame, root: str, batch_id: int) -> None:
    """``(root, path, mtime)`` as a new snapshot, a row for each file; the
    marker written last publishes it."""
    times.select("root", "path", "mtime").write.mode("overwrite").parquet(
        f"{root}/snapshots/{batch_id}"
    )
    times.sparkSession.createDataFrame([(batch_id,)], "batch_id bigint").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{root}/published/{batch_id}")


def latest_state(spark: SparkSession, root: str) -> DataFrame:
    """The newest published snapshot; none yet is an empty one."""
    try:
        published = spark.read.schema("batch_id bigint").json(f"{root}/published/*")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], STATE_SCHEMA)
    newest = published.agg(F.max("batch_id")).first()[0]
    return spark.read.schema(STATE_SCHEMA).parquet(f"{root}/snapshots/{newest}")
