"""The `source_tree` format: a tree of files as a batch or a stream.

    register(spark)
    spark.read.format("source_tree").load(root)
    spark.readStream.format("source_tree").load(root)

Rows are those of `tree.SCHEMA`; names that begin with `_` or `.` are kept, and
what cannot be read is a row with an error. Planning opens directories only
until there are enough of them to share out; every other directory is listed,
and every file read, by the tasks. No list of files is kept anywhere.

A stream's offset is a time. A micro-batch holds the files that appeared or
changed after its start and up to its end, by the later of modification and
inode change, so that a file moved into the tree counts whatever its age. A file
that changes again before it is read belongs to a later batch. The first batch
is empty unless `from_start` is set: what is there at the start is the baseline.

Options: `path`; `prune` (true) leaves out hidden and ignored directories;
`languages`, a comma list; `content` (true); `splits` (64), the directories that
planning asks for; for streams `from_start` (false) and `lag` (0), the seconds
that files may take to become visible on the workers.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

from corpusloom.sources import tree
from corpusloom.sources.files import LANGUAGE_OF_EXTENSION

MICROS = 1_000_000


@dataclass
class Directory(InputPartition):
    """A part of the tree: `path` with all below it, or its own files only."""

    path: str
    deep: bool
    after: int | None = None
    until: int | None = None


def _flag(options: dict, name: str, default: str) -> bool:
    return options.get(name, default).lower() == "true"


class _Tree:
    def __init__(self, options: dict) -> None:
        if "path" not in options:
            raise ValueError("source_tree needs a path")
        self.root = options["path"]
        self.prune = _flag(options, "prune", "true")
        self.content = _flag(options, "content", "true")
        self.splits = int(options.get("splits", "64"))
        wanted = options.get("languages")
        self.languages = {x.strip() for x in wanted.split(",")} if wanted else None

    def directories(self) -> list[tuple[str, bool]]:
        """The parts of the tree, level by level until there are enough."""
        level, own = [self.root], []
        while level and len(level) < self.splits:
            below = []
            for path in level:
                own.append((path, False))
                below += [child for child, pending, _ in tree._children(path, self.prune) if pending]
            level = below
        return own + [(path, True) for path in level]

    def _entries(self, part: Directory) -> Iterator[tuple[str, str | None]]:
        if not os.path.isdir(part.path):
            gone = None if os.path.exists(part.path) else "no such file or directory"
            # A directory below the root may have been removed since planning.
            if gone is None or part.path == self.root:
                yield part.path, gone
            return
        stack = [part.path]
        while stack:
            for path, pending, error in tree._children(stack.pop(), self.prune):
                if not pending:
                    yield path, error
                elif part.deep:
                    stack.append(path)

    def _language(self, path: str) -> str | None:
        return LANGUAGE_OF_EXTENSION.get(os.path.splitext(path)[1].lower())

    def _in_time(self, path: str, part: Directory) -> bool:
        if part.until is None:
            return True
        try:
            stat = os.stat(path)
        except OSError:
            return False  # gone again
        changed = max(stat.st_mtime_ns, stat.st_ctime_ns) // 1000
        return part.after < changed <= part.until

    def rows(self, part: Directory) -> Iterator[tuple]:
        for path, error in self._entries(part):
            lang = self._language(path)
            if error is not None:
                yield (path, lang, None, None, None, error)
            elif (self.languages is None or lang in self.languages) and self._in_time(path, part):
                yield tree._load(path, lang, stat_only=not self.content)

    def read(self, part: Directory) -> Iterator[pa.RecordBatch]:
        return tree._batches(self.rows(part), tree._FILE_ARROW, lambda row: len(row[4] or ""))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.tree = _Tree(options)

    def partitions(self) -> list[Directory]:
        return [Directory(path, deep) for path, deep in self.tree.directories()]

    def read(self, partition: Directory) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.tree = _Tree(options)
        self.lag = float(options.get("lag", "0"))
        self.from_start = _flag(options, "from_start", "false")

    def _now(self) -> int:
        return int((time.time() - self.lag) * MICROS)

    def initialOffset(self) -> dict:
        return {"until": -1 if self.from_start else self._now()}

    def latestOffset(self) -> dict:
        return {"until": self._now()}

    def partitions(self, start: dict, end: dict) -> list[Directory]:
        return [
            Directory(path, deep, start["until"], end["until"]) for path, deep in self.tree.directories()
        ]

    def read(self, partition: Directory) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return tree.SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)
