"""What hybrid search needs of a corpus, computed once and stored.

``features`` holds for each document the vector, the words (of which n-grams are made), the tokens and, where
topics are fitted, the topic vector; ``vocabulary`` and ``terms`` the numbers that
TF-IDF and BM25 take from all documents. A search reads these tables and not the
text: documents are tokenised and embedded when they are stored, not per search, and
the statistics are aggregated from the stored lists.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import vectors as V
from corpusloom.operators import lexical as L
from corpusloom.operators import retrieval as R


class FeatureTable:
    def __init__(self, spark: SparkSession, path: str, dim: int = V.DEFAULT_DIM):
        self.spark, self.path, self.dim = spark, path, dim

    def build(
        self,
        corpus: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        embedder: Callable[[Column], Column] | None = None,
        topics: Callable[[DataFrame, str], DataFrame] | None = None,
    ) -> None:
        """Writes the tables to a new path. ``topics`` adds an ``lda`` column."""
        embed = embedder or (lambda text: V.hashed_bag(text, self.dim))
        text = F.col(text_col)
        rows = topics(corpus, text_col) if topics else corpus
        rows.select(
            F.col(id_col).alias("id"),
            *(["lda"] if topics else []),
            embed(text).alias("vec"),
            X.word_ngrams(text, (1, 1)).alias("words"),
            X.whitespace_tokens(text).alias("tokens"),
        ).write.parquet(f"{self.path}/features")
        stored = self.features()
        L.tfidf_vocabulary(stored, "id", words=F.col("words")).write.parquet(f"{self.path}/vocabulary")
        L.bm25_stats(stored, "id", tokens=F.col("tokens")).write.parquet(f"{self.path}/terms")

    def features(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/features")

    def search(
        self,
        queries: DataFrame,
        weights: Mapping[str, float],
        k: int = R.DEFAULT_K,
        embedder: Callable[[Column], Column] | None = None,
        topics: Callable[[DataFrame, str], DataFrame] | None = None,
        missing: Sequence[str] = (),
    ) -> DataFrame:
        """``query_id, rank, id, score`` and the raw score of each method, as
        ``retrieval.hybrid_topk`` gives them for the corpus."""
        return R.hybrid_topk(
            queries,
            self.features(),
            weights,
            k,
            id_col="id",
            dim=self.dim,
            embedder=embedder,
            bm25_stats=self.spark.read.parquet(f"{self.path}/terms"),
            vocabulary=self.spark.read.parquet(f"{self.path}/vocabulary"),
            topics=topics,
            missing=missing,
            stored=True,
        )

    def reranked(
        self,
        queries: DataFrame,
        weights: Mapping[str, float],
        texts: DataFrame,
        k: int = R.DEFAULT_K,
        fetch_multiplier: int = R.FETCH_MULTIPLIER,
        scorer: Callable[[Column, Column], Column] = R.term_coverage,
        **options,
    ) -> DataFrame:
        """Hybrid candidates, ``fetch_multiplier`` times as many as wanted, ordered
        again by the scorer. ``texts`` (``id, content``) is read for the candidates
        only: they are broadcast below a fixed number, and joined beyond it."""
        fetch = k * fetch_multiplier
        hits = self.search(queries, weights, fetch, **options).select("query_id", "rank", "id")
        asked = hits.join(queries.select("query_id", "query"), "query_id")
        found = R.with_content(asked, texts, "id", ("content",), max_hits=queries.count() * fetch)
        return R.rerank(found, k, fetch, scorer, "id").select("query_id", "rank", "id", "score", "first_rank")
