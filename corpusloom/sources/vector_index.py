"""Stored vectors in clusters, searched exactly by the triangle inequality.

Every vector lies in the folder of its nearest centre. Of each cluster the centre, the
radius (the largest distance of a member) and the size are kept. No member can be
nearer to a query than the distance to the centre less the radius, so after the
nearest clusters have been searched, all others whose bound lies beyond the k-th
distance are left unread. The result is that of comparing every vector.

The centres are fitted on at most `SAMPLE` vectors; every vector is indexed. Cosine
similarity becomes distance on unit vectors, in which a vector without length stands
at the origin: its bound is lower than it needs to be.

Queries stay a table. They meet the vectors of a cluster in groups of bounded size,
whatever share of the vectors or queries falls to one cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators.scoring import DenseMethod, list_matrix, round_half_up

SAMPLE = 100_000
MOST_CLUSTERS = 4096
# Vectors and queries that meet in one group.
GROUP = 20_000
# Clusters of a query that are searched first.
LEAD = 2
SLACK = 1e-5


def _space(rows: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return rows
    size = np.sqrt((rows * rows).sum(axis=1))[:, None]
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Taken as differences, not from dot products: a bound must not lose digits."""
    out = np.empty((len(rows), len(centres)))
    for i, centre in enumerate(centres):
        out[:, i] = np.sqrt(((rows - centre) ** 2).sum(axis=1))
    return out


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, metric: str = "l2"):
        if metric not in ("l2", "cosine"):
            raise ValueError(f"Unsupported metric: {metric}")
        self.spark, self.path, self.metric = spark, path, metric

    def build(
        self, vectors: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding", clusters: int | None = None
    ) -> None:
        """Writes the index to a new path. Rows without a vector are left out."""
        rows = vectors.select(
            F.col(id_col).cast("bigint").alias("id"), V.as_doubles(F.col(vector_col)).alias("v")
        ).where("v is not null")
        n = rows.count()
        wanted = clusters or max(1, min(MOST_CLUSTERS, isqrt(n)))
        metric, path = self.metric, self.path
        unit = V.l2_normalise(F.col("v")) if metric == "cosine" else F.col("v")
        sample = rows.sample(fraction=min(1.0, 1.2 * SAMPLE / max(n, 1)), seed=7).limit(SAMPLE)
        centres = np.zeros((1, 0))
        if n:
            fitted = KMeans(k=max(2, wanted), seed=7, maxIter=8, initMode="random").fit(
                sample.select(array_to_vector(unit).alias("features"))
            )
            # At most MOST_CLUSTERS rows, whatever the number of vectors.
            centres = np.unique(np.array(fitted.clusterCenters()), axis=0)

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = _distances(_space(list_matrix(batch.column("v")), metric), centres)
                cluster = far.argmin(axis=1)
                yield pa.record_batch(
                    [
                        batch.column("id"),
                        batch.column("v"),
                        pa.array(far[np.arange(len(far)), cluster]),
                        pa.array(cluster, pa.int32()),
                    ],
                    ["id", "v", "far", "cluster"],
                )

        (
            rows.mapInArrow(assigned, "id bigint, v array<double>, far double, cluster int")
            .hint("rebalance", "cluster")
            .write.partitionBy("cluster")
            .parquet(f"{path}/vectors")
        )
        stored = self._vectors()
        sizes = stored.groupBy("cluster").agg(F.max("far").alias("radius"), F.count("*").alias("size"))
        known = self.spark.createDataFrame(
            [(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centre array<double>"
        )
        known.join(sizes, "cluster").coalesce(1).write.parquet(f"{path}/clusters")

    def _vectors(self) -> DataFrame:
        return self.spark.read.schema("id bigint, v array<double>, far double, cluster int").parquet(
            f"{self.path}/vectors"
        )

    def search(
        self, queries: DataFrame, k: int = 5, vector_col: str = "embedding", lead: int = LEAD
    ) -> DataFrame:
        """``query_id, rank, id, score``: the rows of ``retrieval.vector_topk``."""
        asked = queries.select("query_id", V.as_doubles(F.col(vector_col)).alias("q")).where("q is not null")
        reach = self._reach(asked)
        order = Window.partitionBy("query_id").orderBy("bound", "cluster")
        first = reach.withColumn("place", F.row_number().over(order)).where(F.col("place") <= lead)
        near = self._hits(asked, first, k)
        best = F.asc("score") if self.metric == "l2" else F.desc("score")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(best, "id"))
        bar = near.withColumn("rank", place).where(F.col("rank") == k)
        far = (
            F.sqrt(F.greatest(F.col("score"), F.lit(0.0)))
            if self.metric == "l2"
            else F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0)))
        )
        rest = (
            reach.join(first.select("query_id", "cluster"), ["query_id", "cluster"], "left_anti")
            .join(bar.select("query_id", far.alias("bar")), "query_id", "left")
            .where(F.col("bar").isNull() | (F.col("bound") <= F.col("bar") + SLACK))
        )
        hits = near.unionByName(self._hits(asked, rest, k))
        return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    def _reach(self, asked: DataFrame) -> DataFrame:
        """``query_id, cluster, size, bound``: the least distance that a member of
        a cluster can have to a query. The clusters are a bounded table."""
        known = self.spark.read.parquet(f"{self.path}/clusters").orderBy("cluster").toArrow()
        centres = list_matrix(known.column("centre"))
        radius, size = (known.column(c).to_numpy() for c in ("radius", "size"))
        names, metric = known.column("cluster").to_numpy(), self.metric

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = list_matrix(batch.column("q"))
                far = np.maximum(_distances(_space(q, metric), centres) - radius, 0.0)
                if metric == "cosine":
                    # A query without length is as near to everything.
                    far[~q.any(axis=1)] = 0.0
                rows, columns = far.shape
                yield pa.record_batch(
                    [
                        batch.column("query_id").take(pa.array(np.repeat(np.arange(rows), columns))),
                        pa.array(np.tile(names, rows), pa.int32()),
                        pa.array(np.tile(size, rows), pa.int64()),
                        pa.array(far.ravel()),
                    ],
                    ["query_id", "cluster", "size", "bound"],
                )

        kind = asked.schema["query_id"].dataType.simpleString()
        return asked.mapInArrow(bounds, f"query_id {kind}, cluster int, size bigint, bound double")

    def _hits(self, asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
        """``query_id, id, score``: the k best of each query in each group of
        vectors and queries of a cluster. Only folders of wanted clusters are read."""
        wanted = [r["cluster"] for r in pairs.select("cluster").distinct().collect()]
        parts = max(1, ceil(asked.count() / GROUP))
        splits = F.ceil(F.col("size") / GROUP).cast("int")
        queries = (
            pairs.join(asked, "query_id")
            .select("query_id", "q", "cluster", F.explode(F.sequence(F.lit(0), splits - 1)).alias("split"))
            .withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        )
        sizes = self.spark.read.parquet(f"{self.path}/clusters").select("cluster", splits.alias("splits"))
        vectors = (
            self._vectors()
            .where(F.col("cluster").isin(wanted))
            .join(F.broadcast(sizes), "cluster")
            .select(
                "id",
                "v",
                "cluster",
                F.pmod(F.xxhash64("id"), F.col("splits")).cast("int").alias("split"),
                F.explode(F.expr(f"sequence(0, {parts - 1})")).alias("part"),
            )
        )
        metric = self.metric

        def met(ours: pa.Table, theirs: pa.Table) -> pa.Table:
            q_at, v_at, score = _best_pairs(ours, theirs, metric, k)
            return pa.table(
                {
                    "query_id": ours.column("query_id").take(pa.array(q_at)),
                    "id": theirs.column("id").take(pa.array(v_at)),
                    "score": score,
                }
            )

        kind = asked.schema["query_id"].dataType.simpleString()
        keys = ("cluster", "split", "part")
        return (
            queries.groupBy(*keys)
            .cogroup(vectors.groupBy(*keys))
            .applyInArrow(met, f"query_id {kind}, id bigint, score double")
        )


def _best_pairs(ours: pa.Table, theirs: pa.Table, metric: str, k: int):
    """Rows of both sides and the score of the k best vectors of each query."""
    if not ours.num_rows or not theirs.num_rows:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    queries = list_matrix(ours.column("q"))
    ids = theirs.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    q_at, v_at, scores = [], [], []
    # Slices of the queries bound the matrix of scores.
    step = max(1, 4_000_000 // theirs.num_rows)
    batch = pa.record_batch([theirs.column("v").combine_chunks()], ["v"])
    for start in range(0, len(queries), step):
        method = DenseMethod("raw", "v", queries[start : start + step], metric)
        found = round_half_up(method.scores(batch))[order]
        # Stable, so that of equal scores the smaller id comes first.
        top = np.argsort(-found, axis=0, kind="stable")[:k]
        rows, columns = top.shape
        q_at.append(start + np.tile(np.arange(columns), rows))
        v_at.append(order[top.ravel()])
        scores.append(np.take_along_axis(found, top, 0).ravel())
    score = np.concatenate(scores)
    return np.concatenate(q_at), np.concatenate(v_at), (-score if metric == "l2" else score) + 0.0
