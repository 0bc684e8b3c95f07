"""Corpus statistics for BM25 and TF-IDF, as DataFrames.

Term frequencies are counted inside each row, so the only shuffle is on the
term, after map-side combining: its volume follows the vocabulary, not the
text, and a term present in every document costs one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X
from corpusloom.functions.exprs import explode_rows, index_range, let
from corpusloom.operators.scoring import Grams, bounded, neighbours, term_pairs

# Defaults of the Okapi BM25 variant.
K1, B, EPSILON = 1.5, 0.75, 0.25
# Defaults of the TF-IDF vectorizer.
MAX_FEATURES, MIN_DF, MAX_DF, NGRAM_RANGE = 10_000, 2, 0.8, (1, 2)
# A vocabulary limited to this many terms may be broadcast.
BROADCAST_TERMS = 200_000


def postings(corpus: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """``(id, term, tf)`` rows; counting happens within the row."""
    rows = explode_rows(corpus, X.term_counts(tokens), "p", keep=[id_col])
    return rows.select(id_col, F.col("p.term").alias("term"), F.col("p.tf").alias("tf"))


def term_table(corpus: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """``(term, df, cf)``: documents and occurrences per term.

    Terms are counted by number within steps of many documents, so that one row per
    distinct term of a step is shuffled, and no row per document and term is made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, ["tokens"]):
                lists = part.column(0)
                words = pc.list_flatten(lists).dictionary_encode()
                row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                df, cf = _frequencies(row, words.indices.to_numpy(), len(words.dictionary))
                yield pa.RecordBatch.from_pydict({"term": words.dictionary, "df": df, "cf": cf})

    found = corpus.select(tokens.alias("tokens")).mapInArrow(run, "term string, df bigint, cf bigint")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _frequencies(row: np.ndarray, number: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a number, and its occurrences, for each number."""
    pairs = np.unique(row * max(width, 1) + number)
    return np.bincount(pairs % max(width, 1), minlength=width), np.bincount(number, minlength=width)


def _frequent_pairs(corpus: DataFrame, words: Column, frequent: pa.Array) -> DataFrame:
    """``(term, df, cf)`` of neighbouring words that are both among the given ones."""
    width = len(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, ["words"]):
                _, left, right, _ = neighbours(part.column(0), frequent)
                key, number = np.unique(left[1] * width + right[1], return_inverse=True)
                df, cf = _frequencies(left[0], number, len(key))
                yield pa.RecordBatch.from_pydict({"pair": key, "df": df, "cf": cf})

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = batch.column(0).to_numpy()
            names = [frequent.take(pa.array(x)) for x in (pair // width, pair % width)]
            yield pa.RecordBatch.from_pydict(
                {"term": pc.binary_join_element_wise(*names, " "), "df": batch.column(1), "cf": batch.column(2)}
            )

    found = corpus.select(words.alias("words")).mapInArrow(run, "pair bigint, df bigint, cf bigint")
    summed = found.groupBy("pair").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return summed.mapInArrow(named, "term string, df bigint, cf bigint")


def bm25_stats(
    corpus: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    epsilon: float = EPSILON,
    tokens: Column | None = None,
) -> DataFrame:
    """``(term, df, cf, idf, avgdl)`` of a corpus, from its text or from stored
    ``tokens``.

    Terms in more than half the documents have a negative idf; they get
    ``epsilon`` times the mean idf instead. The corpus-wide numbers come from
    scalar subqueries that reuse the exchange of the term table.
    """
    if tokens is None:
        tokens = X.whitespace_tokens(F.col(text_col))
    terms = term_table(corpus, id_col, tokens)
    n_docs = corpus.agg(F.count("*").cast("double")).scalar()
    raw = terms.withColumn(
        "raw", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    )
    whole = raw.agg(
        F.struct(F.avg("raw").alias("mean_idf"), F.sum("cf").alias("tokens"))
    ).scalar()
    return raw.select(
        "term",
        "df",
        "cf",
        F.when(F.col("raw") < 0, epsilon * whole["mean_idf"])
        .otherwise(F.col("raw"))
        .alias("idf"),
        (whole["tokens"] / n_docs).alias("avgdl"),
    )


class Bm25Corpus:
    """BM25 numbers of a corpus for looking up the terms of query blocks.

    The term table is computed once and kept on executor disks while it is
    looked up: a lookup pushed below its aggregation would read the corpus
    again for every block. Use as a context manager.
    """

    def __init__(self, corpus: DataFrame, id_col: str, text_col: str, epsilon: float = EPSILON):
        self.terms = term_table(
            corpus, id_col, X.whitespace_tokens(F.col(text_col))
        ).persist(StorageLevel.DISK_ONLY)
        n_docs = corpus.count()
        self.raw = self.terms.withColumn(
            "idf", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        )
        whole = self.raw.agg(F.avg("idf"), F.sum("cf")).first()
        self.floor = epsilon * (whole[0] or 0.0)
        self.avgdl = (whole[1] or 0) / max(n_docs, 1) or 1.0

    def __enter__(self) -> "Bm25Corpus":
        return self

    def __exit__(self, *_problem) -> None:
        self.terms.unpersist()

    def lookup(self, wanted: DataFrame) -> tuple[pa.Array, np.ndarray, float]:
        """(terms, idf, average length) for the terms of one query block."""
        rows = self.raw.join(wanted, "term", "left_semi").select("term", "idf").toArrow()
        idf = rows.column("idf").to_numpy()
        return rows.column("term").combine_chunks(), np.where(idf < 0, self.floor, idf), self.avgdl


class StoredBm25Stats:
    """The same lookups on a stored ``bm25_stats`` table."""

    def __init__(self, stats: DataFrame):
        self.stats = stats

    def __enter__(self) -> "StoredBm25Stats":
        return self

    def __exit__(self, *_problem) -> None:
        pass

    def lookup(self, wanted: DataFrame) -> tuple[pa.Array, np.ndarray, float]:
        rows = self.stats.join(wanted, "term", "left_semi").select("term", "idf", "avgdl").toArrow()
        avgdl = rows.column("avgdl")[0].as_py() if rows.num_rows else 1.0
        return rows.column("term").combine_chunks(), rows.column("idf").to_numpy(), avgdl


def tfidf_vocabulary(
    corpus: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_features: int | None = MAX_FEATURES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    ngram_range: tuple[int, int] = NGRAM_RANGE,
    stop_words: Sequence[str] | None = tuple(X.ENGLISH_STOP_WORDS),
    words: Column | None = None,
) -> DataFrame:
    """``(term, df, cf, idf)``: the most frequent terms within the df bounds, of
    the text or of stored ``words``.

    A pair of words is not more frequent than either of them. Where the vocabulary
    has a limit, only pairs of words that are as frequent as the last word within it
    can get in, and others are not counted.
    """
    n_docs = corpus.agg(F.count("*").cast("double")).scalar()
    bounds = (F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs)
    if ngram_range == (1, 2) and max_features is not None and 0 < max_features <= BROADCAST_TERMS:
        words = X.word_ngrams(F.col(text_col), (1, 1), stop_words) if words is None else words
        single = term_table(corpus, id_col, words).persist(StorageLevel.DISK_ONLY)
        try:
            best = single.where(bounds).orderBy(F.desc("cf"), "term").limit(max_features).toArrow()
            full = best.num_rows == max_features
            least = pc.min(best.column("cf")).as_py() if full else 1
            # Words beyond the df bounds can be part of a pair within them.
            able = single.where(F.col("cf") >= least).select("term")
            few = able.limit(2 * BROADCAST_TERMS + 1).toArrow() if full else None
        finally:
            single.unpersist()
        if full and few.num_rows <= 2 * BROADCAST_TERMS:
            pairs = _frequent_pairs(corpus, words, few.column("term").combine_chunks())
            singles = corpus.sparkSession.createDataFrame(best.select(["term", "df", "cf"]))
            vocab = singles.unionByName(pairs.where(bounds))
        else:
            vocab = term_table(corpus, id_col, _with_pairs(words)).where(bounds)
    else:
        grams = X.word_ngrams(F.col(text_col), ngram_range, stop_words) if words is None else _with_pairs(words)
        vocab = term_table(corpus, id_col, grams).where(bounds)
    if max_features is not None:
        vocab = vocab.orderBy(F.desc("cf"), "term").limit(max_features)
    return vocab.withColumn("idf", F.log((1 + n_docs) / (1 + F.col("df"))) + 1)


def _with_pairs(words: Column) -> Column:
    def both(w: Column) -> Column:
        pair = lambda i: F.concat_ws(" ", w[i], w[i + 1])
        return F.concat(w, F.transform(index_range(F.size(w) - 1), pair))

    return let(words, both)


def tfidf_weights(
    corpus: DataFrame,
    vocabulary: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_features: int | None = MAX_FEATURES,
    ngram_range: tuple[int, int] = NGRAM_RANGE,
    stop_words: Sequence[str] | None = tuple(X.ENGLISH_STOP_WORDS),
) -> DataFrame:
    """``(id, term, weight)``: tf * idf, scaled to unit length per document."""
    if max_features is not None and max_features <= BROADCAST_TERMS:
        by_number = ngram_range == (1, 2)
        grams = X.word_ngrams(F.col(text_col), (1, 1) if by_number else ngram_range, stop_words)
        return _weights_in_place(corpus.select(id_col, grams.alias("grams")), id_col, vocabulary, by_number)
    grams = X.word_ngrams(F.col(text_col), ngram_range, stop_words)
    raw = (
        postings(corpus, id_col, grams)
        .join(vocabulary.select("term", "idf"), "term")
        .withColumn("w", F.col("tf") * F.col("idf"))
    )
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", (F.col("w") / length).alias("weight"))


def _weights_in_place(
    docs: DataFrame, id_col: str, vocabulary: DataFrame, by_number: bool = False
) -> DataFrame:
    """Weights of ``(id, grams)`` rows without any shuffle. ``by_number``: the rows
    hold words, whose pairs are terms as well.

    The vocabulary is bounded by its feature limit, so it travels to the
    tasks, and a document's weights and length come from its own row. An
    unbounded vocabulary is joined on the term instead.
    """
    vocab = vocabulary.select("term", "idf").toArrow()
    terms = vocab.column("term").combine_chunks()
    idf = vocab.column("idf").to_numpy()
    numbers = Grams(terms) if by_number else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bounded(whole, ["grams"])):
            lists = batch.column(batch.schema.get_field_index("grams"))
            row, term, count, lengths = numbers.pairs(lists) if numbers else term_pairs(lists, terms)
            w = count * idf[term]
            norm = np.sqrt(np.bincount(row, w * w, minlength=len(lengths)))
            ids = batch.column(batch.schema.get_field_index(id_col))
            yield pa.RecordBatch.from_pydict(
                {
                    id_col: ids.take(pa.array(row)),
                    "term": terms.take(pa.array(term)),
                    "weight": pa.array(w / norm[row], pa.float64()),
                }
            )

    schema = T.StructType(
        [
            docs.schema[id_col],
            T.StructField("term", T.StringType()),
            T.StructField("weight", T.DoubleType()),
        ]
    )
    return docs.mapInArrow(run, schema)
