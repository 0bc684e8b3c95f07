"""Rows that every operator must take: nulls, empty and long texts, ties,
repeated rows, and columns whose names are also used inside."""

from __future__ import annotations

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} the of and" for i in range(20_000))
CLASH = (
    "digest best locator norm keep_id group_size size k lam target words at seed item_id start "
    "model key n p logp judge score kept h1 h2 node cluster block chunk tokens weight label shard "
    "content_sha256 n_tokens payload page_id body copies rate cuts bucket _bad _keep _sha _gone"
).split()

ROWS = [
    (1, "The cat sat on the mat. And so on it went that day", "en", "a", 50),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \t\n", None, "a", 3),
    (5, LONG, "en", "a", len(LONG)),
    (6, "The cat sat on the mat.  And so on it went that day", None, None, 51),
    (6, "The cat sat on the mat.  And so on it went that day", None, None, 51),
    (None, "The cat sat on the mat. And so on it went that day", "en", "b", 50),
    (None, None, None, None, None),
    (7, "1234 5678 !!", "xx", "c", 12),
    (8, "\U0001f600 été  naïve", "fr", "c", 13),
]


def odd_docs(spark):
    return clashing(spark.createDataFrame(ROWS, SCHEMA))


def no_docs(spark):
    return clashing(spark.createDataFrame([], SCHEMA))


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
