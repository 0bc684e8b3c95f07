"""The persisted chunk index: create, append, update, delete, load.

Three parquet folders under one root:

* ``chunks/batch=KEY``: the rows that a batch added;
* ``touched/batch=KEY``: the sources whose older rows it replaces or drops;
* ``commits/batch=KEY``: written last, makes the batch visible and gives its
  place in the order.

A batch's key is unique, or named by its writer: a stream names its batches, so
that one that is repeated after a failure finds itself committed and does
nothing. No batch ever writes into another's folders, an update costs what it
changes rather than the size of the index, and a source holding a large share
of all rows is never rewritten. Two writers that commit at the same place in the
order are ordered by their keys.

Rows keep all their columns: those of code chunks have columns of their own,
any other goes into the map ``extra`` as text.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpusloom.operators.maintenance import ADDING, REMOVING, latest_events
from corpusloom.sources.files import with_source

CHUNK_SCHEMA = (
    "chunk_id bigint, source string, chunk_no int, content string, embedding array<double>, "
    "language string, symbol_name string, symbol_type string, class_name string, "
    "start_line int, end_line int, extra map<string, string>"
)
TOUCH_SCHEMA = "path string"
COMMIT_SCHEMA = "kind string, place bigint"
_BATCH = ", batch string"


def chunk_id(*columns: str):
    """Stable 64-bit id of a chunk."""
    return F.xxhash64(*columns)


def live_rows(chunks: DataFrame, touched: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows of ``chunks (source, batch, …)`` whose batch is in ``commits (batch,
    place)`` and whose source no later batch of ``touched (path, batch)`` names.
    The touching batch's own rows stay."""
    order = F.struct("place", "batch")
    last = (
        touched.join(commits, "batch")
        .groupBy(F.col("path").alias("source"))
        .agg(F.max(order).alias("_touched"))
    )
    return (
        chunks.join(commits, "batch")
        .join(last, "source", "left")
        .where(F.col("_touched").isNull() | (order >= F.col("_touched")))
        .select(*[c for c in chunks.columns if c != "batch"])
    )


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, schema: str = CHUNK_SCHEMA):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = schema

    # --- reading ---------------------------------------------------------

    def _read(self, part: str, schema: str) -> DataFrame:
        """A folder with its schema; an absent one is an empty table."""
        try:
            return self.spark.read.schema(schema + _BATCH).parquet(f"{self.root}/{part}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema + _BATCH)

    def batches(self) -> DataFrame:
        """``(batch, place)`` of the committed batches."""
        commits = self._read("commits", COMMIT_SCHEMA)
        return commits.groupBy("batch").agg(F.max("place").alias("place"))

    def last_place(self) -> int:
        """Highest place in the order, -1 for a new store."""
        return self.batches().agg(F.coalesce(F.max("place"), F.lit(-1))).first()[0]

    def load(self) -> DataFrame:
        """Live rows: committed, and not touched by a later batch.

        A store that does not exist yet is an empty table with the schema.
        """
        return live_rows(
            self._read("chunks", self.schema), self._read("touched", TOUCH_SCHEMA), self.batches()
        )

    # --- writing ---------------------------------------------------------

    def _write(self, df: DataFrame, part: str, batch: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{part}/batch={batch}")

    def _commit(self, batch: str, kind: str) -> str:
        row = [(kind, self.last_place() + 1)]
        self._write(self.spark.createDataFrame(row, COMMIT_SCHEMA), "commits", batch)
        return batch

    def committed(self, batch: str) -> bool:
        return not self.batches().where(F.col("batch") == batch).isEmpty()

    def _shaped(self, chunks: DataFrame) -> DataFrame:
        wanted = self.spark.createDataFrame([], self.schema).schema
        names = [f.name for f in wanted.fields]
        others = [c for c in chunks.columns if c not in names]
        rows = with_source(chunks)
        if others and "extra" in names:
            own = [x for c in others for x in (F.lit(c), F.col(c).cast("string"))]
            given = [F.col("extra")] if "extra" in chunks.columns else []
            known = F.map_filter(F.create_map(*own), lambda _, v: v.isNotNull())
            if given:
                known = F.map_concat(
                    F.map_filter(
                        F.coalesce(given[0], F.create_map().cast("map<string,string>")),
                        lambda k, _: ~k.isin(*others),
                    ),
                    known,
                )
            rows = rows.withColumn("extra", known)
        return rows.select(
            *[
                (F.col(f.name) if f.name in rows.columns else F.lit(None))
                .cast(f.dataType)
                .alias(f.name)
                for f in wanted.fields
            ]
        )

    def append(self, chunks: DataFrame, batch: str | None = None) -> str:
        """Create the store or add rows beside the existing ones."""
        batch = batch or uuid.uuid4().hex
        if not self.committed(batch):
            self._write(self._shaped(chunks), "chunks", batch)
            self._commit(batch, "append")
        return batch

    def remove(self, paths: Sequence[str], batch: str | None = None) -> str:
        """Drop every row of the given sources."""
        batch = batch or uuid.uuid4().hex
        if not self.committed(batch):
            gone = self.spark.createDataFrame([(p,) for p in paths], TOUCH_SCHEMA)
            self._write(gone, "touched", batch)
            self._commit(batch, "remove")
        return batch

    def apply(
        self,
        events: DataFrame,
        new_chunks: DataFrame,
        batch: str | None = None,
        append_only: bool = False,
    ) -> str:
        """Apply ``(path, event_type, ts, seq)``; see ``apply_events``."""
        batch = batch or uuid.uuid4().hex
        if self.committed(batch):
            return batch
        last = latest_events(events)
        replaced = REMOVING if append_only else (*REMOVING, *ADDING)
        self._write(
            last.where(F.col("event_type").isin(*replaced)).select("path"), "touched", batch
        )
        fresh = last.where(F.col("event_type").isin(*ADDING)).select(F.col("path").alias("_p"))
        added = new_chunks.join(fresh, F.col("source") == F.col("_p"), "left_semi")
        self._write(self._shaped(added), "chunks", batch)
        return self._commit(batch, "apply")

    def compact(self, target_root: str) -> "IndexStore":
        """Write the live rows as the first batch of a new store."""
        fresh = IndexStore(self.spark, target_root, self.schema)
        fresh.append(self.load())
        return fresh
