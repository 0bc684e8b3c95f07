"""Source trees as tables, listed and read by the tasks.

Spark's own listing leaves out names that begin with ``_`` or ``.``, so a
package's ``__init__.py`` would vanish. Here the tasks list directories: the
upper levels one at a time, each spread over the cluster before the next, and
what lies below inside the task that got it. The driver only knows the root.
Contents are read after the paths have been spread again, in batches bounded by
bytes. Directories and files that cannot be read are rows with an error.

The root has to be mounted alike on every worker.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.files import IGNORED_DIRS, LANGUAGE_OF_EXTENSION, name_matches

SCHEMA = (
    "path string, language string, modificationTime timestamp, length bigint, "
    "content string, error string"
)
_ENTRIES = "path string, pending boolean, error string"
# Levels whose directories are dealt out one by one.
SPREAD_LEVELS = 3
_ROWS_PER_BATCH = 1024
_BYTES_PER_BATCH = 8 * 1024 * 1024

_ENTRY_ARROW = pa.schema([("path", pa.string()), ("pending", pa.bool_()), ("error", pa.string())])
_FILE_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("language", pa.string()),
        ("modificationTime", pa.timestamp("us", tz="UTC")),
        ("length", pa.int64()),
        ("content", pa.string()),
        ("error", pa.string()),
    ]
)


def _batches(
    rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]
) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if len(held) >= _ROWS_PER_BATCH or weight >= _BYTES_PER_BATCH:
            yield _table(held, schema)
            held, weight = [], 0
    if held:
        yield _table(held, schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _children(directory: str, prune: bool) -> Iterator[tuple]:
    """``(path, pending, error)`` of what a directory holds; directories are
    pending. A name that is neither file nor directory is left out."""
    try:
        with os.scandir(directory) as entries:
            for entry in entries:
                if entry.is_dir():
                    hidden = entry.name in IGNORED_DIRS or entry.name.startswith(".")
                    if not (prune and hidden) and not entry.is_symlink():
                        yield entry.path, True, None
                elif entry.is_file():
                    yield entry.path, False, None
    except OSError as problem:
        yield directory, False, str(problem)


def _open(prune: bool, deep: bool):
    """Replaces pending directories by their children; ``deep`` goes all the
    way down, so that nothing stays pending."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                known = (row["path"], row["pending"], row["error"])
                if not row["pending"]:
                    yield known
                    continue
                stack = [row["path"]]
                while stack:
                    for child in _children(stack.pop(), prune):
                        if deep and child[1]:
                            stack.append(child[0])
                        else:
                            yield child

    return lambda batches: _batches(entries(batches), _ENTRY_ARROW, lambda row: 0)


def tree_paths(spark: SparkSession, root: str, prune: bool = True) -> DataFrame:
    """``(path, error)`` of every file below a root, or of the file itself.

    ``prune`` leaves out hidden and ignored directories, but not the root.
    """

    def kind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (p, os.path.isdir(p), None if os.path.exists(p) else "no such file or directory")
                for p in batch.column("path").to_pylist()
            ]
            yield _table(rows, _ENTRY_ARROW)

    found = spark.createDataFrame([(root,)], "path string").mapInArrow(kind, _ENTRIES)
    for _ in range(SPREAD_LEVELS):
        found = found.mapInArrow(_open(prune, deep=False), _ENTRIES).repartition("path")
    return found.mapInArrow(_open(prune, deep=True), _ENTRIES).select("path", "error")


def _load(path: str, lang: str | None, stat_only: bool) -> tuple:
    try:
        stat = os.stat(path)
        data = b""
        if not stat_only:
            with open(path, "rb") as handle:
                data = handle.read()
    except OSError as problem:
        return (path, lang, None, None, None, str(problem))
    when = datetime.fromtimestamp(stat.st_mtime, tz=timezone.utc)
    text = None if stat_only else data.decode("utf-8", errors="replace")
    return (path, lang, when, stat.st_size, text, None)


def _read(stat_only: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                lang = LANGUAGE_OF_EXTENSION.get(os.path.splitext(row["path"])[1].lower())
                if row["error"] is not None:
                    yield (row["path"], lang, None, None, None, row["error"])
                else:
                    yield _load(row["path"], lang, stat_only)

    return lambda batches: _batches(rows(batches), _FILE_ARROW, lambda row: len(row[4] or ""))


def _files(paths: DataFrame, stat_only: bool = False) -> DataFrame:
    return paths.repartition("path").mapInArrow(_read(stat_only), SCHEMA)


def read_source_tree(
    spark: SparkSession, root: str, languages: list[str] | None = None
) -> DataFrame:
    """The source files below a root; the path decides what is opened."""
    paths = tree_paths(spark, root)
    ending = F.lower(F.regexp_extract("path", r"[^/.][^/]*(\.[^/.]+)$", 1))
    wanted = [
        e for e, lang in LANGUAGE_OF_EXTENSION.items() if languages is None or lang in languages
    ]
    return _files(paths.where(F.col("error").isNotNull() | ending.isin(*wanted)))


def read_text_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(source, text, error)`` of every file below a root, whatever its name."""
    return _files(tree_paths(spark, root, prune=False)).select(
        F.col("path").alias("source"), F.col("content").alias("text"), "error"
    )


def list_files(spark: SparkSession, root: str, suffix: str = ".pdf") -> DataFrame:
    """``(root, path, mtime)`` of all files below a root with that name ending."""
    paths = tree_paths(spark, root, prune=False).where(
        F.col("error").isNull() & name_matches(F.col("path"), suffix)
    )
    return (
        _files(paths, stat_only=True)
        .where(F.col("error").isNull())
        .select(F.lit(root).alias("root"), "path", F.col("modificationTime").alias("mtime"))
    )


def split_bad_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, quarantined): an unreadable file never stops the job."""
    return files.where(F.col("error").isNull()), files.where(F.col("error").isNotNull())
