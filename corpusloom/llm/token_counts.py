"""Token counts of whole texts through a digest cache.

The cache is a table `content_sha256, tokenizer_sha256, n_tokens` in a folder
that the cluster shares. Counting joins the digests of the texts to it, encodes
one text of each digest that is missing, and appends the results. A later call
over the same folder encodes only what is new; another tokenizer file has
another digest, so its counts never mix.

Normalisation is that of the tokenizer's own input: the exact UTF-8 bytes, null
read as empty. Anything more (case, white space) could change a count.

The text moves once, and only for the misses: their representative rows are
few in a warm cache, where Spark broadcasts them by their measured size, and a
join on the row's id, without hot keys, in a cold one.

Defined results: an empty or null text has 0 tokens. Copies and repeated rows
each get their row. Null ids are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.store import written

CACHE_SCHEMA = "content_sha256 string, tokenizer_sha256 string, n_tokens bigint"


def _counter(name: str, model: bytes):
    """The number of tokens that the library gives, without special ones."""
    if name.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda text: len(pieces.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(model)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def tokenizer_digest(name: str, model: bytes) -> str:
    """Names the file's bytes and the library that reads them."""
    kind = "sentencepiece" if name.endswith(".model") else "tokenizers"
    version = __import__(kind).__version__
    return hashlib.sha256(f"{kind} {version}\n".encode() + model).hexdigest()


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table; an empty one is laid down where there is none."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(
    docs: DataFrame, tokenizer_path: str, cache_path: str, work_path: str, limit: int = 4096
) -> DataFrame:
    """One row per document: `doc_id, n_bytes, n_tokens, over_limit`.

    `work_path` is a new folder in shared storage. Files that an interrupted
    append leaves behind are not read, and a digest appended twice by two runs
    at the same time counts once.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        model = f.read()
    version = tokenizer_digest(tokenizer_path, model)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = written(
        docs.select(
            "doc_id",
            F.sha2(text, 256).alias("content_sha256"),
            F.octet_length(text).cast("bigint").alias("n_bytes"),
        ),
        f"{work_path}/keyed",
    )

    def known() -> DataFrame:
        cache = open_cache(spark, cache_path)
        return (
            cache.where(F.col("tokenizer_sha256") == version)
            .groupBy("content_sha256")
            .agg(F.max("n_tokens").alias("n_tokens"))
        )

    # One row of each digest that the cache lacks; ids tell rows apart.
    misses = written(
        keyed.groupBy("content_sha256")
        .agg(F.min("doc_id").alias("rep_id"))
        .join(known(), "content_sha256", "left_anti"),
        f"{work_path}/misses",
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer_path, model)
        for batch in batches:
            counts = [count(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch(
                [
                    batch.column("content_sha256"),
                    pa.array([version] * len(counts), pa.string()),
                    pa.array(counts, pa.int64()),
                ],
                names=["content_sha256", "tokenizer_sha256", "n_tokens"],
            )

    bodies = docs.select("doc_id", F.sha2(text, 256).alias("_sha"), text.alias("text"))
    distinct = bodies.join(
        misses,
        F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("_sha") == F.col("content_sha256")),
    ).select("content_sha256", "text")
    # Rows that repeat an id and a text would bring it more than once.
    if not keyed.groupBy("doc_id", "content_sha256").count().where("count > 1").isEmpty():
        distinct = distinct.dropDuplicates(["content_sha256"])
    distinct.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    # As a table of its own, so that a digest with very many copies can be split.
    counts = written(known(), f"{work_path}/counts")
    return keyed.join(counts, "content_sha256").select(
        "doc_id",
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
        "content_sha256",
    )
