"""Top-k retrieval: dense, BM25, TF-IDF, weighted fusion, two-stage search."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import vectors as V
from corpusloom.functions.exprs import let
from corpusloom.operators import lexical as L
from corpusloom.operators.scoring import (
    QUERY_BLOCK,
    DenseMethod,
    Grams,
    SparseMethod,
    collect_blocks,
    list_matrix,
    method_maxima,
    narrowed,
    nearest,
    sparse_queries,
    top_k,
    union_all,
)

# Defaults of the retrieval settings.
DEFAULT_K = 5
FETCH_MULTIPLIER = 4
DEFAULT_WEIGHTS = {"vector": 0.4, "tfidf": 0.3, "lda": 0.2, "bm25": 0.1}


# --- dense ---------------------------------------------------------------


def vector_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = DEFAULT_K,
    metric: str = "l2",
    query_col: str = "query_id",
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Exact nearest vectors: ``(query_id, rank, id, score)``.

    ``l2`` scores are squared distances, ascending; ``cosine`` similarities
    are descending.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"Unsupported metric: {metric}")
    qs = queries.select(F.col(query_col).alias("query_id"), V.as_doubles(F.col(vector_col)).alias("v"))
    docs = corpus.select(id_col, vector_col)
    sign = F.lit(-1.0 if metric == "l2" else 1.0)
    asked = qs.where(F.col("v").isNotNull())
    block = asked.limit(QUERY_BLOCK + 1).toArrow()
    if block.num_rows > QUERY_BLOCK:
        hits = nearest(asked, docs, k, metric, id_col, vector_col)
    else:
        method = DenseMethod("raw", vector_col, list_matrix(block.column("v")), metric)
        hits = top_k(docs, id_col, [method], _ids(block), qs.schema["query_id"], k)
    # Adding zero turns a negative zero into a plain one.
    return hits.select("query_id", "rank", id_col, (sign * F.col("score") + 0.0).alias("score"))


def _ids(block: pa.Table) -> pa.Array:
    return block.column("query_id").combine_chunks()


# --- lexical -------------------------------------------------------------


def _bm25_method(block: pa.Table, numbers, queries: DataFrame) -> SparseMethod:
    """BM25 for one query block; only the query terms' numbers are fetched."""
    wanted = queries.sparkSession.createDataFrame(
        pa.table({"term": pc.unique(pc.list_flatten(block.column("tokens"))).cast(pa.string())})
    )
    terms, idf, avgdl = numbers.lookup(wanted)
    start, query_no, weight = sparse_queries(block.column("tokens"), terms)

    def weigh(row, term, count, length):
        norm = L.K1 * (1 - L.B + L.B * length[row] / avgdl)
        return idf[term] * count * (L.K1 + 1) / (count + norm)

    return SparseMethod("bm25", "tokens", terms, start, query_no, weight, block.num_rows, weigh)


def _tfidf_method(block: pa.Table, vocab: pa.Table) -> SparseMethod:
    """Cosine of TF-IDF vectors; the vocabulary is bounded by its feature limit."""
    terms = vocab.column("term").combine_chunks()
    idf = vocab.column("idf").to_numpy()
    grams = Grams(terms)
    start, query_no, count = sparse_queries(block.column("words"), terms, grams)
    weight = count * np.repeat(idf, np.diff(start))
    length = np.sqrt(np.bincount(query_no, weight * weight, minlength=block.num_rows))
    weight = weight / np.where(length > 0, length, 1.0)[query_no]

    def weigh(row, term, count, size):
        w = count * idf[term]
        norm = np.sqrt(np.bincount(row, w * w, minlength=len(size)))
        return w / norm[row]

    return SparseMethod("tfidf", "words", terms, start, query_no, weight, block.num_rows, weigh, grams)


def bm25_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = DEFAULT_K,
    id_col: str = "doc_id",
    text_col: str = "text",
    stats: DataFrame | None = None,
) -> DataFrame:
    """BM25 over every document; a repeated query word counts repeatedly.

    ``queries`` has ``query_id`` and ``query``. ``stats`` takes a stored
    ``bm25_stats`` table so that the corpus is read once, for scoring.
    """
    return hybrid_topk(
        queries, corpus, {"bm25": 1.0}, k, id_col, text_col, bm25_stats=stats, normalise=False
    ).select("query_id", "rank", id_col, "score")


def tfidf_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = DEFAULT_K,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """TF-IDF cosine; a query without any known term scores 0 everywhere."""
    return hybrid_topk(
        queries, corpus, {"tfidf": 1.0}, k, id_col, text_col, vocabulary=vocabulary, normalise=False
    ).select("query_id", "rank", id_col, "score")


# --- fusion --------------------------------------------------------------


def available_weights(weights: Mapping[str, float], missing: Sequence[str]) -> dict[str, float]:
    """Weights without the methods that cannot be used, scaled to their sum."""
    left = {m: w for m, w in weights.items() if m not in missing}
    total = sum(left.values())
    if not missing or total <= 0:
        return left
    return {m: w / total for m, w in left.items()}


def hybrid_topk(
    queries: DataFrame,
    corpus: DataFrame,
    weights: Mapping[str, float],
    k: int = DEFAULT_K,
    id_col: str = "doc_id",
    text_col: str = "text",
    dim: int = V.DEFAULT_DIM,
    embedder: Callable[[Column], Column] | None = None,
    bm25_stats: DataFrame | None = None,
    vocabulary: DataFrame | None = None,
    topics: Callable[[DataFrame, str], DataFrame] | None = None,
    normalise: bool = True,
    missing: Sequence[str] = (),
    stored: bool = False,
) -> DataFrame:
    """Weighted sum of per-method scores over every document.

    ``missing`` names methods that cannot be used: the weights of the others are
    scaled to their sum. With ``stored`` the corpus is a table of features
    (``vec, words, tokens, lda``) whose statistics are given, and no text is read.

    Each method's scores are divided by their maximum for that query when it
    is positive. Columns: query_id, rank, id, score and the raw score of each
    method used. ``topics`` adds an ``lda`` vector column to a frame holding
    the given text column; it is required when ``lda`` has a weight.
    """
    unknown = set(weights) - set(DEFAULT_WEIGHTS)
    weights = available_weights(weights, missing)
    used = [m for m in ("vector", "tfidf", "lda", "bm25") if m in weights]
    if unknown:
        raise ValueError(f"Unsupported methods: {sorted(unknown)}")
    if "lda" in used and topics is None:
        raise ValueError("the lda method needs fitted topics")
    embed = embedder or (lambda text: V.hashed_bag(text, dim))

    def features(df: DataFrame, key: str, text: str) -> DataFrame:
        made = {
            "vector": lambda: embed(F.col(text)).alias("vec"),
            "tfidf": lambda: X.word_ngrams(F.col(text), (1, 1)).alias("words"),
            "bm25": lambda: X.whitespace_tokens(F.col(text)).alias("tokens"),
        }
        carried = []
        if "lda" in used:
            df = topics(df, text)
            carried = ["lda"]
        return df.select(key, *carried, *[made[m]() for m in used if m in made])

    columns = {"vector": "vec", "tfidf": "words", "lda": "lda", "bm25": "tokens"}
    docs = corpus.select(id_col, *[columns[m] for m in used]) if stored else features(corpus, id_col, text_col)
    qs = features(queries, "query_id", "query")
    vocab = None
    if "tfidf" in used:
        if vocabulary is None:
            vocabulary = L.tfidf_vocabulary(corpus, id_col, text_col)
        vocab = vocabulary.select("term", "idf").toArrow()

    if "bm25" not in used:
        numbers = nullcontext()
    elif bm25_stats is None:
        numbers = L.Bm25Corpus(corpus, id_col, text_col)
    else:
        numbers = L.StoredBm25Stats(bm25_stats)
    share = [weights[m] for m in used]

    def hits_of(block: pa.Table) -> DataFrame:
        ids = _ids(block)
        make = {
            "vector": lambda: DenseMethod("vector", "vec", list_matrix(block.column("vec"))),
            "tfidf": lambda: _tfidf_method(block, vocab),
            "lda": lambda: DenseMethod("lda", "lda", list_matrix(block.column("lda"))),
            "bm25": lambda: _bm25_method(block, numbers, queries),
        }
        methods = [make[m]() for m in used]
        scale, rows = [1.0] * len(used), docs
        if normalise:
            # Read twice: for the maxima, and for the sums.
            rows, methods = narrowed(docs, id_col, methods)
            best = method_maxima(rows, methods, ids)
            scale = [np.where(best[m] > 0, best[m], 1.0) for m in used]

        def combine(parts):
            return sum(w * (p / s) for w, p, s in zip(share, parts, scale))

        return top_k(rows, id_col, methods, ids, qs.schema["query_id"], k, combine)

    with numbers:
        return union_all([hits_of(block) for block in collect_blocks(qs, "query_id")])


# --- rerank and two-stage search ----------------------------------------


def term_coverage(query: Column, content: Column) -> Column:
    """Share of the distinct query words that occur in the content."""
    return let(
        F.array_distinct(X.whitespace_tokens(query)),
        lambda q: F.when(F.size(q) == 0, F.lit(0.0)).otherwise(
            F.size(F.array_intersect(q, X.whitespace_tokens(content))) / F.size(q)
        ),
    )


def rerank(
    candidates: DataFrame,
    top_k: int | Column = DEFAULT_K,
    fetch_k: int | Column | None = None,
    scorer: Callable[[Column, Column], Column] = term_coverage,
    id_col: str = "chunk_id",
) -> DataFrame:
    """Second stage over ``(query_id, query, rank, id, content, ...)``.

    Candidates past ``fetch_k`` are cut first; the rest are ordered by the
    scorer, equal scores keeping their first-stage order, and cut to
    ``top_k``. No candidates give no rows.
    """
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    if fetch_k is not None:
        candidates = candidates.where(F.col("rank") <= as_col(fetch_k))
    place = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("first_rank"))
    )
    return (
        candidates.withColumnRenamed("rank", "first_rank")
        .withColumn("score", F.round(scorer(F.col("query"), F.col("content")), 6))
        .withColumn("rank", place)
        .where(F.col("rank") <= as_col(top_k))
    )


def with_content(
    hits: DataFrame,
    index: DataFrame,
    id_col: str = "chunk_id",
    columns: Sequence[str] = ("content", "source"),
    max_hits: int | None = None,
) -> DataFrame:
    """Attach the text of the hits: late, so only the final rows carry it.

    ``max_hits`` is a proven bound on the number of hits; below the limit the
    hits are broadcast and the index is scanned in place, not shuffled.
    """
    small = max_hits is not None and max_hits <= L.BROADCAST_TERMS
    found = index.select(id_col, *columns).join(F.broadcast(hits) if small else hits, id_col)
    # An append-only index may hold the same chunk twice; each place in the
    # ranking still gives one row.
    return found.dropDuplicates(["query_id", "rank"])


def search(
    queries: DataFrame,
    index: DataFrame,
    top_k: int | None = None,
    rerank_enabled: bool = False,
    rerank_top_k: int | None = None,
    store_top_k: int = DEFAULT_K,
    fetch_multiplier: int | None = FETCH_MULTIPLIER,
    scorer: Callable[[Column, Column], Column] = term_coverage,
    embedder: Callable[[Column], Column] | None = None,
    metric: str = "l2",
    id_col: str = "chunk_id",
) -> DataFrame:
    """Batch search: ``(query_id, rank, id, content, source, score, score_kind,
    metadata)``, where ``metadata`` is a struct of the index's other columns.

    ``queries`` has ``query_id``, ``query`` and optionally a per-query
    ``top_k``; 0 or null there means the default. ``index`` has the id,
    ``content``, ``source`` and ``embedding``. Without reranking the score is
    a distance (ascending) or similarity, with it a relevance (descending).
    """
    default_k = top_k or (rerank_top_k if rerank_enabled else None) or store_top_k
    wish = F.col("top_k") if "top_k" in queries.columns else F.lit(None).cast("int")
    embed = embedder or V.hashed_bag
    qs = queries.select(
        "query_id",
        "query",
        F.coalesce(F.nullif(wish, F.lit(0)), F.lit(default_k)).cast("int").alias("final_k"),
        embed(F.col("query")).alias("v"),
    )
    times = (fetch_multiplier or 1) if rerank_enabled else 1
    vectors = index.select(id_col, "embedding")
    plain = (id_col, "content", "source", "embedding")
    others = [c for c in index.columns if c not in plain]
    # An index without further columns has empty metadata.
    metadata = F.struct(*others) if others else F.struct(F.lit(None).cast("string").alias("none"))
    described = index.select(id_col, "content", "source", metadata.alias("metadata"))
    block = qs.limit(QUERY_BLOCK + 1).toArrow()
    if block.num_rows > QUERY_BLOCK:
        asked = qs.drop("v")
        n_queries, longest = qs.agg(F.count("*"), F.max("final_k")).first()
        most = longest * times
        hits = nearest(qs, vectors, most, metric, id_col, "embedding")
    else:
        asked = F.broadcast(
            queries.sparkSession.createDataFrame(block.select(["query_id", "query", "final_k"]))
        )
        n_queries = block.num_rows
        most = (pc.max(block.column("final_k")).as_py() or default_k) * times
        method = DenseMethod("raw", "embedding", list_matrix(block.column("v")), metric)
        hits = _top(vectors, id_col, method, block, qs, most)
    sign = F.lit(-1.0 if metric == "l2" else 1.0)
    hits = (
        hits.select("query_id", "rank", id_col, (sign * F.col("score") + 0.0).alias("score"))
        .join(asked, "query_id")
        .where(F.col("rank") <= F.col("final_k") * times)
    )
    found = with_content(
        hits, described, id_col, ("content", "source", "metadata"), max_hits=n_queries * most
    )
    if rerank_enabled:
        found = rerank(found, F.col("final_k"), F.col("final_k") * times, scorer, id_col)
    kind = "relevance" if rerank_enabled else ("distance" if metric == "l2" else "similarity")
    return found.select(
        "query_id", "rank", id_col, "content", "source", "score", F.lit(kind).alias("score_kind"), "metadata"
    )


def _top(vectors, id_col, method, block, qs, k) -> DataFrame:
    return top_k(vectors, id_col, [method], _ids(block), qs.schema["query_id"], k)
