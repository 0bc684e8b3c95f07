"""Quality by perplexity under a modified Kneser-Ney model of trusted text.

The model is an interpolated 5-gram model over characters (digits alike, control
characters as blanks, those beyond Latin in two or three symbols), one per
language and one of all languages together for documents without a model of
their own. Its
counts are tables keyed by language and n-gram: continuation counts, discounts
from counts of counts, context sums and lower orders meet in joins on those
keys, spread over the cluster like any other join.

All n-grams of the corpus, each once, are joined to these tables order by order,
which gives every one its probability with all backing off done. This table of
corpus n-grams is cut into shards of at most `SHARD_ROWS` rows by a hash. Each
shard goes to all tasks in turn and adds its share to every document's
log-likelihood; memory is bounded by the shard, whatever the corpus holds.

A document's perplexity is drawn by `PRIOR` symbols towards the mean of its
language's trusted text, so that a few characters do not decide. The threshold of a language is a far
fence over the quartiles of trusted documents that the model was not fitted on.

A language has a model and a threshold of its own from `MIN_FIT` trusted documents to
fit and `MIN_HELD` held out. Below that the common model is used, with the fence of
all held-out documents as that model scores them, raised by as much as the
language's own held-out documents lie above the rest: the common model gives a
language that it hardly knows high perplexities throughout. Of a language with
fewer than `MIN_HELD` trusted documents, or none held out, all are held out.
Below both numbers over all languages there is no threshold.

Defined results: a null or empty text has no perplexity and is kept; so is
everything where too little trusted text exists. A null language, or one with too
little trusted text, uses the common model and its threshold. Repeated rows get a row each. A
document whose labels disagree is not trusted. Extra columns are passed on by
`accepted` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrow import code_points, slices, sums
from corpusloom.llm.columns import digest, without_rows
from corpusloom.llm.store import shared_dir, written

ORDER = 5
BITS = 10
SYMBOLS = 1024
START, END, SPACE, NEWLINE, DIGIT = 0, 1, 32, 10, 48
GRAM_BITS = ORDER * BITS
GRAM_MASK = (1 << GRAM_BITS) - 1
# Rows of a shard: twelve bytes each in a task's tables.
SHARD_ROWS = 2_000_000
SLICE_BYTES = 2 << 20
PRIOR = 200
# The part of trusted documents that sets the thresholds instead of the counts.
HELD_OUT_OF = 4
FENCE = 3.0
# Trusted documents with text that a model and its fence need at least.
MIN_FIT = 24
MIN_HELD = 8

# Code points below WIDE are a symbol each, with all digits alike and control
# characters as blanks, which leaves 0 and 1 free for the ends of a text. Others
# are written in two or three symbols of seven bits, so that none share any.
WIDE, LEAD, REST = 768, 768, 896
_TABLE = np.full(WIDE, SPACE, np.int64)
_TABLE[128:] = np.arange(128, WIDE)
_TABLE[33:127] = np.arange(33, 127)
_TABLE[48:58] = DIGIT
_TABLE[10] = NEWLINE


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, and the number of each."""
    points, lengths = code_points(texts)
    out = _TABLE[np.minimum(points, WIDE - 1)]
    wide = np.flatnonzero(points >= WIDE)
    if not len(wide):
        return out, lengths
    point = points[wide].astype(np.int64)
    three = point >= 1 << 14
    out[wide] = LEAD + np.where(three, point >> 14, point >> 7)
    more = 1 + three
    ends = np.cumsum(more)
    rest = np.empty(int(ends[-1]), np.int64)
    rest[ends - 1] = REST + (point & 127)
    rest[(ends - 2)[three]] = REST + (point[three] >> 7 & 127)
    text = np.searchsorted(np.cumsum(lengths), wide, "right")
    added = np.bincount(text, more, len(lengths)).astype(np.int64)
    return np.insert(out, np.repeat(wide + 1, more), rest), lengths + added


def grams(texts: list[str], language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's n-grams with its language in the bits above, and their number
    per text: one for each symbol and one for the end."""
    symbols, lengths = symbols_of(texts)
    pad = ORDER - 1
    begin = np.cumsum(lengths + pad + 1) - lengths - 1
    line = np.full(int(lengths.sum()) + len(texts) * (pad + 1), START, np.int64)
    own = np.arange(len(symbols)) + np.repeat(begin - np.cumsum(lengths) + lengths, lengths)
    line[own] = symbols
    line[begin + lengths] = END
    gram = line.copy()
    for back in range(1, ORDER):
        gram[back:] |= line[:-back] << (BITS * back)
    at = np.arange(len(symbols) + len(texts)) + np.repeat(
        begin - np.cumsum(lengths + 1) + lengths + 1, lengths + 1
    )
    return (gram[at] & GRAM_MASK) | np.repeat(language << GRAM_BITS, lengths + 1), lengths + 1


def _texts(piece: pa.RecordBatch) -> list[str]:
    return [t or "" for t in piece.column("text").to_pylist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "text", SLICE_BYTES):
        keys, n = np.unique(
            grams(_texts(piece), piece.column("model").to_numpy(False))[0], return_counts=True
        )
        yield pa.record_batch([pa.array(keys), pa.array(n)], names=["key", "n"])


def _split(key: Column) -> list[Column]:
    return [
        F.shiftright(key, GRAM_BITS).alias("model"),
        key.bitwiseAND(F.lit(GRAM_MASK)).alias("gram"),
    ]


def _suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (BITS * order)) - 1))


def count_tables(texts: DataFrame, path: str) -> dict[int, DataFrame]:
    """`model, gram, n` per order from `model, text`: counts at the top,
    numbers of different symbols to the left below. Model 0 pools all."""
    raw = texts.mapInArrow(_count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    own = written(raw.select(*_split(F.col("key")), "n"), f"{path}/counts_own")
    pooled = own.groupBy("gram").agg(F.sum("n").alias("n")).select(
        F.lit(0).cast("bigint").alias("model"), "gram", "n"
    )
    tables = {ORDER: written(own.where("model <> 0").unionByName(pooled), f"{path}/counts{ORDER}")}
    for order in range(ORDER - 1, 0, -1):
        above = tables[order + 1]
        tables[order] = written(
            above.groupBy("model", _suffix(F.col("gram"), order).alias("gram")).agg(
                F.count(F.lit(1)).alias("n")
            ),
            f"{path}/counts{order}",
        )
    return tables


def _discounts(counts: DataFrame) -> DataFrame:
    """`model, d1, d2, d3` from the counts of counts."""
    c = counts.groupBy("model").agg(
        *[F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)]
    )
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    # Where a count of counts is 0, a plain absolute discount stands in.
    best = [
        F.when(
            (F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0),
            i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"),
        ).otherwise(F.lit(0.5))
        for i in range(1, 4)
    ]
    return c.select(
        "model",
        *[F.greatest(F.lit(0.05), F.least(d, F.lit(i - 0.05))).alias(f"d{i}") for i, d in enumerate(best, 1)],
    )


def model_tables(
    counts: dict[int, DataFrame], path: str
) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """Probabilities `model, gram, p` and context weights `model, context,
    total, weight` of every order."""
    # A row for each model and order, as a table of known size: it is broadcast,
    # and the n-grams of a large language stay where they are.
    each = [_discounts(t).withColumn("order", F.lit(order)) for order, t in counts.items()]
    discounts = written(reduce(DataFrame.unionByName, each), f"{path}/discounts")
    probs, contexts = {}, {}
    for order in range(1, ORDER + 1):
        cut = (
            F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        )
        cuts = discounts.where(F.col("order") == order).drop("order")
        known = counts[order].join(cuts, "model").select(
            "model", "gram", F.shiftright("gram", BITS).alias("context"), "n", cut.alias("cut")
        )
        contexts[order] = written(
            known.groupBy("model", "context").agg(
                F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("weight")
            ),
            f"{path}/contexts{order}",
        )
        top = known.join(contexts[order], ["model", "context"]).withColumn(
            "lower", _suffix(F.col("gram"), order - 1)
        )
        if order == 1:
            below = top.withColumn("q", F.lit(1.0 / SYMBOLS))
        else:
            low = probs[order - 1].select("model", F.col("gram").alias("lower"), F.col("p").alias("q"))
            below = top.join(low, ["model", "lower"])
        p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("weight") * F.col("q")
        probs[order] = written(below.select("model", "gram", p.alias("p")), f"{path}/p{order}")
    return probs, contexts


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "text", SLICE_BYTES):
        keys = np.unique(grams(_texts(piece), piece.column("model").to_numpy(False))[0])
        yield pa.record_batch([pa.array(keys)], names=["key"])


def corpus_grams(texts: DataFrame, probs, contexts, path: str) -> DataFrame:
    """`key, logp` for every n-gram of the corpus: each order's own
    probability, or its context's weight times the order below."""
    seen = written(texts.mapInArrow(_distinct, "key bigint").distinct(), f"{path}/seen")
    wanted = {ORDER: seen.select(*_split(F.col("key")))}
    for order in range(ORDER - 1, 0, -1):
        wanted[order] = (
            wanted[order + 1].select("model", _suffix(F.col("gram"), order).alias("gram")).distinct()
        )
    lower = None
    for order in range(1, ORDER + 1):
        asked = (
            wanted[order]
            .withColumn("context", F.shiftright("gram", BITS))
            .join(probs[order], ["model", "gram"], "left")
            .join(contexts[order].drop("total"), ["model", "context"], "left")
        )
        if lower is None:
            asked = asked.withColumn("q", F.lit(1.0 / SYMBOLS))
        else:
            asked = asked.withColumn("lower", _suffix(F.col("gram"), order - 1)).join(
                lower.select("model", F.col("gram").alias("lower"), F.col("p").alias("q")),
                ["model", "lower"],
            )
        p = F.coalesce("p", F.coalesce("weight", F.lit(1.0)) * F.col("q"))
        lower = written(asked.select("model", "gram", p.alias("p")), f"{path}/asked{order}")
    key = F.shiftleft("model", GRAM_BITS).bitwiseOR(F.col("gram"))
    return lower.select(key.alias("key"), F.ln("p").cast("float").alias("logp"))


class _Lookup:
    """An open-addressing table of 64-bit keys, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.float32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            self.keys[slot[left[free]]] = keys[left[free]]
            placed = self.keys[slot[left]] == keys[left]
            self.values[slot[left[placed]]] = values[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values, 0 for keys that are not there."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.float32(0))
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


def log_likelihoods(texts: DataFrame, table: DataFrame, path: str) -> DataFrame:
    """`n, logp` per row of `doc_id, lang, model, text`, over all shards of the
    table, with all columns but the text."""
    spark = texts.sparkSession
    shards = max(1, -(-table.count() // SHARD_ROWS))
    rows = texts.withColumn("body", F.xxhash64("text"))
    same = [*(c for c in rows.columns if c != "text"), "n"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in same[:-1])
    out = f"{kinds}, n bigint, logp double"

    def part(shard: int) -> DataFrame:
        """Scores under one shard of the table, which is let go when they are
        written: the driver and the executors hold one shard at a time."""
        mine = table.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == shard).toArrow()
        sent = spark.sparkContext.broadcast(
            (mine.column("key").to_numpy(), mine.column("logp").to_numpy())
        )
        del mine

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look = _Lookup(*sent.value)
            for piece in slices(batches, "text", SLICE_BYTES):
                found, n = grams(_texts(piece), piece.column("model").to_numpy(False))
                columns = [piece.column(c) for c in same[:-1]]
                yield pa.record_batch(
                    [*columns, pa.array(n), pa.array(sums(look(found), n))], names=[*same, "logp"]
                )

        scored = written(rows.mapInArrow(score, out), f"{path}/shard{shard}")
        sent.destroy()
        pa.default_memory_pool().release_unused()
        return scored

    parts = [part(i) for i in range(shards)]
    if shards == 1:
        return parts[0].drop("body")
    # Rows that agree in id and text have equal sums in every shard.
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy(*same)
        .agg(
            (F.sum("logp") * shards / F.count(F.lit(1))).alias("logp"),
            (F.count(F.lit(1)) / shards).cast("int").alias("copies"),
        )
        .select(*same, "logp", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
        .drop("copy", "body")
    )


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: `doc_id, lang, n_symbols, perplexity, threshold,
    kept`."""
    return _perplexities(docs, labels).drop("digest")


def _perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """As `perplexities`, with the digest of the text."""
    path = shared_dir(docs.sparkSession)
    trusted = written(
        labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id"),
        f"{path}/trusted",
    )
    base = docs.select(
        "doc_id",
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
        digest().alias("digest"),
    )
    good = base.join(trusted, "doc_id", "left_semi")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT_OF)) == 0
    number = lambda part: F.count_distinct(F.when(part, F.col("doc_id")))
    evidence = written(
        good.where("length(text) > 0").groupBy("lang").agg(number(~held).alias("fit"), number(held).alias("held")),
        f"{path}/evidence",
    )
    enough = (F.col("fit") >= MIN_FIT) & (F.col("held") >= MIN_HELD)
    tiny = (F.col("fit") + F.col("held") < MIN_HELD) | (F.col("held") == 0)
    models = written(
        evidence.where("lang is not null").select(
            "lang",
            F.when(enough, F.dense_rank().over(Window.orderBy(~enough, "lang"))).cast("bigint").alias("model"),
            tiny.alias("tiny"),
        ),
        f"{path}/models",
    )
    whole = tiny & F.col("lang").isNotNull()
    common = evidence.agg(
        F.sum(F.when(~whole, F.col("fit")).otherwise(0)).alias("fit"),
        F.sum(F.when(whole, F.col("fit") + F.col("held")).otherwise(F.col("held"))).alias("held"),
    ).where(enough)

    def texts(rows: DataFrame) -> DataFrame:
        model = F.coalesce("model", F.lit(0)).cast("bigint").alias("model")
        tiny = F.coalesce("tiny", F.lit(False)).alias("tiny")
        return rows.join(models, "lang", "left").select("doc_id", "lang", model, tiny, "digest", "text")

    counts = count_tables(texts(good.where(~held)).where("not tiny").select("model", "text"), path)
    probs, contexts = model_tables(counts, path)
    # The judges are scored by the common model too, for its own mean and fence.
    judges = texts(good.where(held)).where("model <> 0").withColumn("model", F.lit(0).cast("bigint"))
    judges = written(judges, f"{path}/judges").withColumn("again", F.lit(True))
    every = texts(base).withColumn("again", F.lit(False)).unionByName(judges)
    table = written(corpus_grams(every.select("model", "text"), probs, contexts, path), f"{path}/grams")
    scored = written(log_likelihoods(every, table, path), f"{path}/scored")
    judged = trusted.select("doc_id", held.alias("held"))
    judge = F.coalesce(F.col("held") | (F.col("tiny") & F.col("held").isNotNull()), F.lit(False))
    return _decided(scored.join(judged, "doc_id", "left").withColumn("judge", judge), common, path)


def _decided(scored: DataFrame, common: DataFrame, path: str) -> DataFrame:
    """`common` has a row if the common model may set a threshold."""
    rate = (F.sum("logp") / F.sum("n")).alias
    means = written(scored.where("judge and n > 1").groupBy("model").agg(rate("mean")), f"{path}/means")
    score = -(F.col("logp") + PRIOR * F.col("mean")) / (F.col("n") + PRIOR)
    drawn = scored.join(means, "model", "left").withColumn("score", F.when(F.col("n") > 1, score))
    quartiles = F.percentile_approx("score", F.array(F.lit(0.25), F.lit(0.75)), F.lit(10_000))
    fence = quartiles[1] + FENCE * (quartiles[1] - quartiles[0])
    middle = F.percentile_approx("score", F.lit(0.5), F.lit(10_000))
    judges = drawn.where("judge and score is not null")
    fences = judges.groupBy("model").agg(fence.alias("limit"), middle.alias("middle"))
    allowed = common.select(F.lit(0).cast("bigint").alias("none"))
    limits = written(
        fences.join(allowed, fences["model"] == F.col("none"), "left")
        .where("model <> 0 or none is not null")
        .select("model", "limit", "middle"),
        f"{path}/fences",
    )
    above = written(
        judges.where("model = 0 and not again and lang is not null").groupBy("lang").agg(middle.alias("own")),
        f"{path}/above",
    ).withColumn("model", F.lit(0).cast("bigint"))
    limit = F.col("limit") + F.coalesce(F.greatest(F.lit(0.0), F.col("own") - F.col("middle")), F.lit(0.0))
    return (
        drawn.where("not again")
        .join(limits, "model", "left")
        .join(above, ["lang", "model"], "left")
        .withColumn("limit", limit)
        .select(
            "doc_id",
            "lang",
            "digest",
            (F.col("n") - 1).alias("n_symbols"),
            F.exp("score").alias("perplexity"),
            F.exp("limit").alias("threshold"),
            F.coalesce(F.col("score") <= F.col("limit"), F.lit(True)).alias("kept"),
        )
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    rejected = _perplexities(docs, labels).where(~F.col("kept")).select("doc_id", "lang", "digest")
    return without_rows(docs, rejected, [docs["doc_id"], docs["lang"].cast("string"), digest()])
