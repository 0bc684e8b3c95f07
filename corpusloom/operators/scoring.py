"""Exact scoring of a whole corpus against a batch of queries.

Each task streams its share of the corpus past a bounded block of queries and
keeps the best ``k`` hits per query, so nothing but ``k`` rows per query and
task is ever shuffled, however common a query's words are. A larger query set
is worked off block by block. Vectors for more queries than a block are stored
once and meet the queries in groups of bounded size (``nearest``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import vectors as V
from corpusloom.sources.tables import plan_bytes, work_dir

# Queries shipped to the tasks at once.
QUERY_BLOCK = 1_000
# Bounds the score matrix of one step: corpus rows x queries x methods.
CELLS_PER_STEP = 2_000_000
# Past this many tasks (at the usual split size) top hits merge in two levels.
MERGE_TASKS = 1_000
SPLIT_BYTES = 128 * 1024 * 1024
# Bounds the arrays of one step over token lists, however long the texts are.
TOKENS_PER_STEP = 500_000
# Queries and vectors that meet in one group, and in one step within it.
GROUP = 20_000
GROUP_QUERIES, GROUP_VECTORS = 256, 2_048
# Scores are rounded to six decimals before they are ranked.
SLACK = 1e-5


def collect_blocks(queries: DataFrame, id_col: str, block: int = QUERY_BLOCK) -> Iterator[pa.Table]:
    """The query table in Arrow blocks of about ``block`` rows.

    The usual batch fits one block and takes one job. A larger one is split by
    hash of the id and each part is fetched only when its turn comes.
    """
    first = queries.limit(block + 1).toArrow()
    if first.num_rows <= block:
        yield first
        return
    parts = -(-queries.count() // block) * 2
    for part in range(parts):
        yield queries.where(F.pmod(F.xxhash64(id_col), F.lit(parts)) == part).toArrow()


def list_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal-length list column as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    width = len(values) // len(column) if len(column) else 0
    return values.astype(np.float64).reshape(len(column), width)


def dense_scores(docs: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all pairs, one row per row of ``docs``."""
    dots = docs @ queries.T
    d2 = (docs * docs).sum(axis=1)[:, None]
    q2 = (queries * queries).sum(axis=1)[None, :]
    if metric == "l2":
        return -np.maximum(d2 + q2 - 2 * dots, 0.0)
    size = np.sqrt(d2) * np.sqrt(q2)
    return np.divide(dots, size, out=np.zeros_like(dots), where=size > 0)


@dataclass(frozen=True)
class DenseMethod:
    """Cosine similarity, or negated squared L2 distance, of vectors."""

    name: str
    column: str
    queries: np.ndarray
    metric: str = "cosine"

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        docs = list_matrix(batch.column(batch.schema.get_field_index(self.column)))
        if not len(self.queries):
            return np.zeros((len(docs), 0))
        return dense_scores(docs, self.queries, self.metric)


def term_pairs(
    lists: pa.Array, terms: pa.Array
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Known terms of token lists: (row, term number, count) per distinct pair,
    ordered by row and term, and the length of every list."""
    found = pc.index_in(pc.list_flatten(lists), value_set=terms)
    known = found.is_valid().to_numpy(zero_copy_only=False)
    row_of = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[known].astype(np.int64)
    term_of = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(len(terms), 1)
    pairs, counts = np.unique(row_of * width + term_of, return_counts=True)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return pairs // width, pairs % width, counts.astype(np.float64), lengths


def bounded(batch: pa.RecordBatch, columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose lists hold about ``TOKENS_PER_STEP`` items, and at
    least one row."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        own = pc.list_value_length(batch.column(batch.schema.get_field_index(c)))
        size = np.maximum(size, own.fill_null(0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // TOKENS_PER_STEP)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if high > low:
            yield batch.slice(low, high - low)


class Grams:
    """Words and pairs of neighbouring words among the terms of a vocabulary, found
    in lists of words by number: no pair is ever written out as text."""

    def __init__(self, terms: pa.Array):
        split = [t.split(" ") for t in terms.to_pylist()]
        known = sorted({w for t in split for w in t})
        at = {w: i for i, w in enumerate(known)}
        self.words = pa.array(known, pa.string())
        self.single = np.full(len(known) + 1, -1)
        pairs = []
        for number, term in enumerate(split):
            if len(term) == 1:
                self.single[at[term[0]]] = number
            elif len(term) == 2:
                pairs.append((at[term[0]] * len(known) + at[term[1]], number))
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.numbers = np.array([n for _, n in pairs], np.int64)
        self.n_terms = len(terms)

    def pairs(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``term_pairs`` for lists of the n-grams."""
        row, left, right, word = neighbours(lists, self.words)
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        key = left[1] * len(self.words) + right[1]
        found = np.zeros(len(key), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
        rows, terms = row, self.single[word]
        if found.any():
            rows = np.concatenate([rows, left[0][found]])
            terms = np.concatenate([terms, self.numbers[at[found]]])
        rows, terms = rows[terms >= 0], terms[terms >= 0]
        width = max(self.n_terms, 1)
        both, counts = np.unique(rows * width + terms, return_counts=True)
        return both // width, both % width, counts.astype(np.float64), lengths


def neighbours(lists: pa.Array, words: pa.Array):
    """Known words of lists as (row, number), and of neighbours that are both known
    the (row, number) on the left and on the right: ``row, left, right, number``."""
    number = pc.index_in(pc.list_flatten(lists), value_set=words).fill_null(-1).to_numpy().astype(np.int64)
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    both = np.flatnonzero((row[1:] == row[:-1]) & (number[1:] >= 0) & (number[:-1] >= 0))
    known = number >= 0
    return row[known], (row[both], number[both]), (row[both], number[both + 1]), number[known]


@dataclass(frozen=True)
class SparseMethod:
    """Weighted term overlap: documents carry token lists, queries weights.

    ``weigh`` turns (rows, terms, counts, lengths) of a batch into one weight
    per (row, term) pair. The query side is grouped by term: the queries of
    term ``t`` are ``query_no[start[t]:start[t + 1]]``.
    """

    name: str
    column: str
    terms: pa.Array
    start: np.ndarray
    query_no: np.ndarray
    query_weight: np.ndarray
    n_queries: int
    weigh: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    # Finds terms in the lists; by default the lists hold the terms themselves.
    grams: Grams | None = None

    def weighed(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) of the terms that a query has, ordered by row."""
        lists = batch.column(batch.schema.get_field_index(self.column))
        found = self.grams.pairs(lists) if self.grams else term_pairs(lists, self.terms)
        weights = self.weigh(*found)
        asked = self.start[found[1] + 1] > self.start[found[1]]
        return found[0][asked], found[1][asked], weights[asked]

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column(batch.schema.get_field_index(self.column))
        return self.spread(len(lists), *self.weighed(batch))

    def spread(self, n_rows: int, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        # Expand every pair to the queries that contain the term, then add up.
        fan = self.start[terms + 1] - self.start[terms]
        pair = np.repeat(np.arange(len(rows)), fan)
        offset = np.arange(len(pair)) - np.repeat(np.cumsum(fan) - fan, fan)
        at = self.start[terms[pair]] + offset
        flat = np.bincount(
            rows[pair] * self.n_queries + self.query_no[at],
            weights=weights[pair] * self.query_weight[at],
            minlength=n_rows * self.n_queries,
        )
        # An empty selection would otherwise come back as integers.
        return flat.astype(np.float64).reshape(n_rows, self.n_queries)


@dataclass(frozen=True)
class WeighedMethod:
    """A sparse method over rows that hold its weights (``narrowed``)."""

    method: SparseMethod

    @property
    def name(self) -> str:
        return self.method.name

    @property
    def column(self) -> str:
        return f"{self.name}_terms"

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        lists, weights = (
            batch.column(batch.schema.get_field_index(f"{self.name}_{c}")) for c in ("terms", "weights")
        )
        rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = [pc.list_flatten(x).to_numpy(zero_copy_only=False) for x in (lists, weights)]
        return self.method.spread(len(lists), rows, flat[0].astype(np.int64), flat[1])


def narrowed(corpus: DataFrame, id_col: str, methods: Sequence) -> tuple[DataFrame, list]:
    """The corpus as vectors and weights of the queries' terms, stored, and methods
    over that. Texts are tokenised once, however often their scores are needed."""
    sparse = [m for m in methods if isinstance(m, SparseMethod)]
    vectors = [m.column for m in methods if isinstance(m, DenseMethod)]
    fields = [corpus.schema[id_col], *[corpus.schema[c] for c in vectors]]
    for m in sparse:
        fields.append(T.StructField(f"{m.name}_terms", T.ArrayType(T.IntegerType())))
        fields.append(T.StructField(f"{m.name}_weights", T.ArrayType(T.DoubleType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches, methods, 1):
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in (id_col, *vectors)}
            for m in sparse:
                rows, terms, weights = m.weighed(batch)
                ends = np.cumsum(np.bincount(rows, minlength=batch.num_rows))
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                for c, x in (("terms", terms.astype(np.int32)), ("weights", weights.astype(np.float64))):
                    out[f"{m.name}_{c}"] = pa.ListArray.from_arrays(offsets, pa.array(x))
            yield pa.RecordBatch.from_pydict(out)

    path = work_dir(corpus.sparkSession)
    corpus.mapInArrow(run, T.StructType(fields)).write.parquet(path)
    stored = corpus.sparkSession.read.parquet(path)
    return stored, [WeighedMethod(m) if isinstance(m, SparseMethod) else m for m in methods]


def sparse_queries(
    lists: pa.Array | pa.ChunkedArray, terms: pa.Array, grams: Grams | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query token lists regrouped by term: (start, query_no, count)."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    query, term, count, _ = grams.pairs(lists) if grams else term_pairs(lists, terms)
    order = np.argsort(term, kind="stable")
    start = np.searchsorted(term[order], np.arange(len(terms) + 1))
    return start, query[order], count[order]


def round_half_up(x: np.ndarray) -> np.ndarray:
    # Adding zero turns a negative zero into a plain one.
    return np.sign(x) * np.floor(np.abs(x) * 1e6 + 0.5) / 1e6 + 0.0


def _steps(
    batches: Iterator[pa.RecordBatch], methods: Sequence, n_queries: int
) -> Iterator[pa.RecordBatch]:
    """Bounded slices of the batches, without rows that lack a vector.

    The check is made here because a null filter in the plan would be pushed
    below the embedding and compute it a second time.
    """
    rows = max(1, CELLS_PER_STEP // max(n_queries, 1))
    vectors = [m.column for m in methods if isinstance(m, DenseMethod)]
    lists = [m.column for m in methods if not isinstance(m, DenseMethod)]
    for batch in batches:
        for column in vectors:
            at = batch.schema.get_field_index(column)
            if batch.column(at).null_count:
                batch = batch.filter(pc.is_valid(batch.column(at)))
        for part in bounded(batch, lists):
            for at in range(0, part.num_rows, rows):
                yield part.slice(at, rows)


def method_maxima(
    corpus: DataFrame, methods: Sequence, query_ids: pa.Array
) -> dict[str, np.ndarray]:
    """Highest score per query and method over the whole corpus.

    Tasks report one row per query; the answer is one number per query and
    method, which is as bounded as the query block itself.
    """
    n = len(query_ids)
    names = [m.name for m in methods]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for step in _steps(batches, methods, n):
            now = np.stack([m.scores(step).max(axis=0) for m in methods])
            best = now if best is None else np.maximum(best, now)
        if best is not None:
            yield pa.RecordBatch.from_pydict(
                {"q": np.arange(n, dtype=np.int64), **dict(zip(names, best))}
            )

    schema = "q bigint, " + ", ".join(f"{c} double" for c in names)
    found = (
        corpus.mapInArrow(run, schema).groupBy("q").agg(*[F.max(c).alias(c) for c in names])
    ).toArrow()
    out = {}
    for c in names:
        out[c] = np.zeros(n)
        out[c][found.column("q").to_numpy()] = found.column(c).to_numpy()
    return out


def top_k(
    corpus: DataFrame,
    id_col: str,
    methods: Sequence,
    query_ids: pa.Array,
    query_field: T.StructField,
    k: int,
    combine: Callable[[list[np.ndarray]], np.ndarray] | None = None,
) -> DataFrame:
    """``(query_id, rank, id, score, one column per method)``.

    Scores are rounded to six decimals before ranking and ties go to the
    smaller id, so the result does not depend on how rows were distributed.
    """
    n = len(query_ids)
    names = [m.name for m in methods]
    fuse = combine or (lambda parts: parts[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        bar = np.full(n, -np.inf)
        bar_id = np.full(n, np.iinfo(np.int64).max)
        for step in _steps(batches, methods, n):
            ids = step.column(step.schema.get_field_index(id_col)).to_numpy(zero_copy_only=False)
            ids = ids.astype(np.int64)
            parts = [m.scores(step) for m in methods]
            fused = round_half_up(fuse(parts))
            better = (fused > bar) | ((fused == bar) & (ids[:, None] < bar_id))
            if len(ids) > k and np.isneginf(bar).any():
                # Of a step only its own k best count, and what ties with them.
                better &= fused >= np.partition(fused, -k, axis=0)[-k]
            row, query = np.nonzero(better)
            fresh = [query, ids[row], fused[row, query], *[p[row, query] for p in parts]]
            pool = fresh if kept is None else [np.concatenate(x) for x in zip(kept, fresh)]
            order = np.lexsort((pool[1], -pool[2], pool[0]))
            pool = [x[order] for x in pool]
            first = np.searchsorted(pool[0], np.arange(n))
            place = np.arange(len(order)) - first[pool[0]]
            kept = [x[place < k] for x in pool]
            last = kept[0][place[place < k] == k - 1]
            at = np.flatnonzero(place[place < k] == k - 1)
            bar[last], bar_id[last] = kept[2][at], kept[1][at]
        if kept is not None:
            yield pa.RecordBatch.from_pydict(
                {
                    "query_id": query_ids.take(pa.array(kept[0])),
                    id_col: kept[1],
                    "score": kept[2],
                    **{c: x for c, x in zip(names, kept[3:])},
                }
            )

    schema = T.StructType(
        [
            T.StructField("query_id", query_field.dataType),
            T.StructField(id_col, T.LongType()),
            T.StructField("score", T.DoubleType()),
            *[T.StructField(c, T.DoubleType()) for c in names],
        ]
    )
    hits = corpus.mapInArrow(run, schema)
    tasks = plan_bytes(corpus) // SPLIT_BYTES
    if tasks > MERGE_TASKS:
        # Merge groups of tasks first, or one query's hits of very many tasks
        # would meet in a single one.
        salted = hits.withColumn("_salt", F.spark_partition_id() % int(tasks**0.5 + 1))
        hits = _best(salted, k, id_col, "query_id", "_salt")
    return _best(hits, k, id_col, "query_id").select("query_id", "rank", id_col, "score", *names)


def _best(hits: DataFrame, k: int, id_col: str, *keys: str) -> DataFrame:
    place = F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc(id_col))
    )
    return hits.withColumn("rank", place).where(F.col("rank") <= k)


def nearest(
    queries: DataFrame, corpus: DataFrame, k: int, metric: str, id_col: str, vector_col: str
) -> DataFrame:
    """``(query_id, rank, id, score)`` for any number of queries ``(query_id, v)``.

    The ranking is that of ``top_k`` with a dense method. Vectors of both sides are
    made once and stored, and neither side passes through the driver.
    """
    spark = corpus.sparkSession
    path = work_dir(spark)
    queries.select("query_id", "v").write.parquet(f"{path}/queries")
    corpus.select(F.col(id_col).cast("bigint").alias(id_col), V.as_doubles(F.col(vector_col)).alias("v")).write.parquet(
        f"{path}/vectors"
    )
    asked = spark.read.parquet(f"{path}/queries").where("v is not null")
    stored = spark.read.parquet(f"{path}/vectors").where("v is not null")
    parts = max(1, -(-asked.count() // GROUP))
    splits = max(1, -(-stored.count() // GROUP), -(-spark.sparkContext.defaultParallelism // parts))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ("part", "split")
    ours = asked.select("*", deal("query_id", parts).alias("part"), each(splits).alias("split"))
    theirs = stored.select("*", deal(id_col, splits).alias("split"), each(parts).alias("part"))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            at, score = (np.zeros(0, np.int64),) * 2, np.zeros(0)
        else:
            ids = right.column(id_col).to_numpy()
            *at, score = best_pairs(
                list_matrix(left.column("v")), ids, list_matrix(right.column("v")), metric, k
            )
        return pa.table(
            {
                "query_id": left.column("query_id").take(pa.array(at[0])),
                id_col: right.column(id_col).take(pa.array(at[1])),
                "score": score,
            }
        )

    kind = asked.schema["query_id"].dataType.simpleString()
    hits = (
        ours.groupBy(*keys)
        .cogroup(theirs.groupBy(*keys))
        .applyInArrow(met, f"query_id {kind}, {id_col} bigint, score double")
    )
    return _best(hits, k, id_col, "query_id").select("query_id", "rank", id_col, "score")


def best_pairs(
    queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, metric: str, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both sides and the score of the ``k`` best vectors of each query.

    Both sides are taken in order of length. Two vectors are at least as far apart
    as their lengths, so steps that lie beyond a query's k-th distance are left out.
    """
    length = lambda rows: np.sqrt((rows * rows).sum(axis=1))
    q_size, v_size = length(queries), length(vectors)
    by_q, by_v = np.argsort(q_size, kind="stable"), np.argsort(v_size, kind="stable")
    starts = np.arange(0, len(vectors), GROUP_VECTORS)
    low, high = v_size[by_v[starts]], v_size[by_v[np.minimum(starts + GROUP_VECTORS, len(vectors)) - 1]]
    out = []
    for at in range(0, len(queries), GROUP_QUERIES):
        rows = by_q[at : at + GROUP_QUERIES]
        size = q_size[rows][:, None]
        gap = np.maximum(np.maximum(low - size, size - high), 0.0) ** 2
        if metric != "l2":
            gap[:] = -np.inf
        bar = np.full(len(rows), -np.inf)
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for step in np.argsort(gap.min(axis=0), kind="stable"):
            live = np.flatnonzero(-gap[:, step] >= bar - SLACK)
            if not len(live):
                continue
            there = by_v[starts[step] : starts[step] + GROUP_VECTORS]
            found = dense_scores(queries[rows[live]], vectors[there], metric)
            least = bar[live]
            if len(there) > k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(found, -k, axis=1)[:, -k])
            q, v = np.nonzero(found >= (least - SLACK)[:, None])
            fresh = [live[q], there[v], round_half_up(found[q, v])]
            pool = [np.concatenate(x) for x in zip(kept, fresh)]
            order = np.lexsort((ids[pool[1]], -pool[2], pool[0]))
            pool = [x[order] for x in pool]
            place = np.arange(len(order)) - np.searchsorted(pool[0], pool[0])
            kept = [x[place < k] for x in pool]
            last = place[place < k] == k - 1
            bar[kept[0][last]] = kept[2][last]
        out.append([rows[kept[0]], *kept[1:]])
    return tuple(np.concatenate(x) for x in zip(*out))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
