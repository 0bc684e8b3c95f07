"""Language identification with a conditional random field over words.

The model is fitted on a bounded sample of labelled documents, at most
`PER_LANGUAGE` whole texts of each language in the order of a hash of their id.
The words of a document carry its language as their label. `SHARDS` groups of
documents are trained side by side and their weights averaged, for `ROUNDS`
rounds; the number of groups is fixed, so that the weights do not depend on the
cluster. The lexicon holds the words that the sample uses most.

Every whole text is then labelled word by word, sentence by sentence, by
forward-backward. A document's language is that with the largest sum of its
words' probabilities, and its score their mean.

Defined results: `und` with score 0 for a null text, one without letters, and
any text where nothing could be learned. Ties go to the first language in code
point order. A null id is never learned from and not held out. Repeated rows get
a row each. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrow import slices, sums
from corpusloom.llm.crf import Model, Words, label_probabilities, train, words_of
from corpusloom.llm.store import shared_dir, written

PER_LANGUAGE = 400
SALTS = 64
LEXICON = 2_000
LEXICON_FROM = 5
SHARDS = 8
ROUNDS = 3
BATCH_TEXTS = 16
SLICE_BYTES = 1 << 20
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """`doc_id, lang, text` of at most `per_language` learnable documents each.
    Only ids are ranked; the chosen ones, a bounded number, meet their texts."""
    learn = docs.where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
    ).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = learn.select("doc_id", "lang", F.pmod(order[0], F.lit(SALTS)).alias("salt"))
    # First within parts of a language, so that a large one is not ranked in one
    # task; a fixed number of rows a language is left for the second ranking.
    for keys in (("lang", "salt"), ("lang",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        chosen = chosen.withColumn("place", place).where(F.col("place") <= per_language)
    chosen = chosen.select("doc_id", "lang").distinct()
    return learn.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")


def _lexicon(sample: DataFrame, labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most used words, and the languages that use each."""
    n = len(labels)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", SLICE_BYTES):
            words = words_of([t or "" for t in piece.column("text").to_pylist()])
            label = piece.column("label").to_numpy(False)[words.text]
            key, hits = np.unique(
                np.stack([words.name.view(np.int64), label]), axis=1, return_counts=True
            )
            yield pa.record_batch(
                [pa.array(key[0]), pa.array(key[1]), pa.array(hits)], names=["name", "label", "hits"]
            )

    top = Window.partitionBy("label").orderBy(F.col("hits").desc(), "name")
    best = (
        sample.select("label", "text")
        .mapInArrow(count, "name bigint, label bigint, hits bigint")
        .groupBy("name", "label")
        .agg(F.sum("hits").alias("hits"))
        .where(F.col("hits") >= LEXICON_FROM)
        .withColumn("place", F.row_number().over(top))
        .where(F.col("place") <= LEXICON)
        .toPandas()
    )
    names, at = np.unique(best["name"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
    known = np.zeros((len(names), n), np.float32)
    known[at, best["label"].to_numpy(np.int64)] = 1
    return names, known


def _learner(sent):
    """Trains a copy of the broadcast model on one group of documents."""

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        own = Model.blank(sent.value.labels, sent.value.names, sent.value.known)
        own.take(sent.value.flat())
        part = part.sort_values(["place", "text"], kind="stable", ignore_index=True)
        batches = []
        for a in range(0, len(part), BATCH_TEXTS):
            rows = part.iloc[a : a + BATCH_TEXTS]
            words = words_of(list(rows["text"]))
            batches.append((words, rows["label"].to_numpy(np.int64)[words.text]))
        train(own, batches)
        return pd.DataFrame({"weights": [own.flat().astype(np.float32).tobytes()]})

    return learn


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """The model of the sample; None where there is nothing to learn from."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    sample = training_sample(docs, per_language).where(F.length("text") > 0)
    sample = written(sample.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS))), f"{path}/sample")
    labels = [r["lang"] for r in sample.select("lang").distinct().orderBy("lang").collect()]
    if not labels:
        return None
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("lang")) - 1
    sample = sample.withColumn("label", number.cast("bigint"))
    names, known = _lexicon(sample, labels)
    model = Model.blank(labels, names, known)
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)
        # Documents of all languages mix in an order that a hash gives.
        rows = sample.select("shard", F.hash("doc_id").alias("place"), "label", "text")
        found = rows.groupBy("shard").applyInPandas(_learner(sent), "weights binary").toArrow()
        model.take(
            np.mean([np.frombuffer(w, np.float32) for w in found.column(0).to_pylist()], axis=0)
        )
        sent.unpersist()
    return model


def _document(words: Words, prob: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of words, and each label's mean probability, per text."""
    n = np.bincount(words.text, minlength=n_texts)
    total = np.stack([sums(prob[:, c], n) for c in range(prob.shape[1])], 1)
    return n, total / np.maximum(n, 1)[:, None]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: `doc_id, lang_pred, score`."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*sent.value.labels, UNKNOWN], object)
        for piece in slices(batches, "text", SLICE_BYTES):
            texts = [t or "" for t in piece.column("text").to_pylist()]
            words = words_of(texts)
            n, mean = _document(words, label_probabilities(sent.value, words), len(texts))
            best = mean.argmax(1)
            score = np.where(n > 0, mean[np.arange(len(texts)), best], 0.0)
            yield pa.record_batch(
                [
                    piece.column("doc_id"),
                    pa.array(names[np.where(n > 0, best, len(names) - 1)], pa.string()),
                    pa.array(np.clip(score, 0, 1)),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        label, f"doc_id {id_type}, lang_pred string, score double"
    )


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id, words`: every word of each text, lower-cased, with its most
    likely language and that language's probability."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    item = pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", SLICE_BYTES):
            texts = [t or "" for t in piece.column("text").to_pylist()]
            words = words_of(texts)
            prob = label_probabilities(sent.value, words)
            letters = words.chars.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
            rows = [[] for _ in texts]
            for i, t in enumerate(words.text.tolist()):
                a = int(words.start[i])
                best = int(prob[i].argmax())
                rows[t].append(
                    {
                        "word": letters[a : a + int(words.size[i])],
                        "lang": sent.value.labels[best],
                        "p": float(prob[i, best]),
                    }
                )
            yield pa.record_batch(
                [piece.column("doc_id"), pa.array(rows, pa.list_(item))], names=["doc_id", "words"]
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        label, f"doc_id {id_type}, words array<struct<word: string, lang: string, p: double>>"
    )
