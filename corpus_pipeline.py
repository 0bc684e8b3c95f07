"""A training-data pipeline over `documents`: five stages, each written as
Parquet and read again by the next.

Every stage works on all rows that the one before it kept. All but the last
return the columns of `documents`; the last adds the number of copies that the
mix takes of each document. Null texts count as empty and pass; how each stage
treats null ids, ties and repeated rows is stated by its operator. An empty
table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, exact_dedup, jaccard_join, mixing, quality
from corpusloom.llm.store import shared_dir, written
from corpusloom.sources.tables import table

# The stages fit models and search neighbours, which SQL does not express; the
# tests compare each with a brute-force version.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose perplexity under trusted text is too high."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the longest of equal documents, then the one with the least id."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard index of 0.8 or more
    over five-word shingles."""
    return jaccard_join.one_of_each(docs, k=5, least=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates and copies of every document that is left."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = shared_dir(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{path}/{name}")
    return docs
