"""Sends the package to workers that do not have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets the tasks of this session import the package, whatever folder they
    start in. Spark hands the archive from the driver to every executor. Not
    needed where the package is installed on the workers."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(), "corpusloom"),
        "zip",
        root_dir=os.path.dirname(here),
        base_dir=os.path.basename(here),
    )
    spark.sparkContext.addPyFile(archive)
    _SENT.add(app)
