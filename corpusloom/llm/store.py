"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpusloom.sources.tables import work_dir, written  # noqa: F401 - for the operators

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """A new path under `spark.checkpoint.dir`. Where the session names no such
    folder and runs on one machine (tests), a temporary one is set for it."""
    return work_dir(spark)
