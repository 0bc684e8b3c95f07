"""Benchmark decontamination with spaced seeds.

Texts are words, lower-cased, with nothing but letters and digits kept. A seed
is the hash of the words at a mask's positions; the words at positions that the
mask leaves out may be anything. The seeds of all benchmark items are joined to
those of every document position. Around each hit the document is laid along
the item on that diagonal, and the overlap holds if some window of `window`
words (or the whole item, if it is shorter) agrees in at least `share` of them.

The masks find every window of 16 words with up to three substitutions: a test
tries all of them. For items of fewer than `SHORT` words, the placements of
substitutions that the masks miss get a mask each, of all the other words.

Documents stay where they are read: seeds are hashed, looked up and tried on the
words around them there. The benchmark's seeds come in blocks of at most
`BLOCK_SEEDS`, each with the hashes of some fifty words, broadcast in turn, so
the size of what is broadcast is fixed. What is aggregated are small rows; only
the documents that overlap are laid along their items as a whole.

Only DataFrame operations. Defined results: a null or empty text, or item,
overlaps with nothing. Null ids are compared as values. Repeated rows give one
row for an id and item. An empty benchmark or table gives an empty result.
Further columns are not read; `clean` passes all of them on.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.exprs import index_range, let
from corpusloom.llm.columns import digest, without_rows

MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5))
SPAN = 1 + max(m[-1] for m in MASKS)
SHORT = 12
BLOCK_SEEDS = 100_000


def finds(mask: tuple[int, ...], n: int, bad: tuple[int, ...]) -> bool:
    """Whether a mask, laid somewhere on `n` words, avoids the positions `bad`."""
    return any(not any(p + o in bad for o in mask) for p in range(n - mask[-1]))


def short_masks(n: int, allowed: int) -> list[tuple[int, ...]]:
    """Masks for whole items of `n` words that, with `MASKS`, find every
    placement of up to `allowed` substitutions."""
    missed = [
        bad
        for bad in combinations(range(n), allowed)
        if not any(finds(m, n, bad) for m in MASKS)
    ]
    return [tuple(i for i in range(n) if i not in bad) for bad in missed if len(bad) < n]


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits; an empty array for null."""
    plain = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}\s]+", "")
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


def marks_of(words: Column) -> Column:
    """A hash for each word: what is looked up and tried beside seeds."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(kind: int, offsets: tuple[int, ...], words: Column, at: Column, n: Column) -> Column:
    """The hash of a mask laid at a position; null where it does not fit."""
    picked = [F.get(words, at + o) for o in offsets]
    return F.when(at + (offsets[-1] + 1) <= n, F.xxhash64(F.lit(kind), *picked))


def _seeds(
    texts: DataFrame, masks: list[tuple[int, tuple[int, ...]]], whole: dict[int, int] | None = None
) -> DataFrame:
    """Explodes `marks` into positions, and each into its masks' `seed`, with
    the seed `before` it under the same mask. Those in `whole` are laid only at the start of texts with that number of words."""
    n = F.size("marks")
    at = texts.select(
        "*",
        F.explode_outer(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("at"),
    )
    seeds = [_seed(k, m, F.col("marks"), F.col("at"), F.size("marks")) for k, m in masks]
    seeds = [
        F.when((F.col("at") == 0) & (F.size("marks") == whole[k]), s) if k in (whole or {}) else s
        for (k, _), s in zip(masks, seeds, strict=True)
    ]
    before = [
        F.lit(None).cast("bigint")
        if k in (whole or {})
        else F.when(F.col("at") > 0, _seed(k, m, F.col("marks"), F.col("at") - 1, F.size("marks")))
        for k, m in masks
    ]
    pairs = [F.struct(s.alias("seed"), b.alias("before")) for s, b in zip(seeds, before, strict=True)]
    return at.select("*", F.explode(F.array(*pairs)).alias("s")).select("*", "s.*").drop("s")


def _blocks(items: DataFrame) -> list[tuple[list[int], int]]:
    """Item numbers of each block, and in how many pieces its seeds come: the
    seeds of a very long item are dealt out by their position. Only sizes come
    to the driver."""
    sizes = (
        items.groupBy((F.col("item") % F.lit(1 << 20)).alias("part"))
        .agg(F.sum(F.size("words")).alias("n"))
        .orderBy("part")
        .toLocalIterator()
    )
    blocks, room = [], 0
    for row in sizes:
        need = row["n"] * len(MASKS)
        if not blocks or need > room:
            blocks.append(([], max(1, ceil(need / BLOCK_SEEDS))))
            room = BLOCK_SEEDS
        blocks[-1][0].append(row["part"])
        room -= need
    return blocks


def overlaps(
    docs: DataFrame, benchmark: DataFrame, window: int = 16, share: float = 0.8
) -> DataFrame:
    """One row per document and benchmark item that overlap: `doc_id, item_id,
    start, best, matched, item_words`. `start` is the word of the document at
    which the item's first word falls, `best` the agreement of the best window,
    `matched` that of the whole diagonal."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = _overlaps(rows.withColumn("body", F.xxhash64("text")), benchmark, window, share)
    best = F.max(F.struct("best", (-F.col("start")).alias("back"), "matched", "item_words"))
    return (
        found.groupBy("doc_id", "item_id")
        .agg(best.alias("b"))
        .select(
            "doc_id",
            "item_id",
            (-F.col("b.back")).cast("bigint").alias("start"),
            *[F.col(f"b.{c}").cast("bigint").alias(c) for c in ("best", "matched", "item_words")],
        )
    )


def _overlaps(texts: DataFrame, benchmark: DataFrame, window: int, share: float) -> DataFrame:
    """`text`'s best diagonal for each item, for each value of the two key
    columns, an id and a digest of the text."""
    keys = [c for c in texts.columns if c != "text"]
    items = benchmark.select(
        "item_id",
        words_of(F.col("text")).alias("words"),
    ).where(F.size("words") > 0)
    items = items.withColumn("item", F.xxhash64("item_id", "words"))
    marks = marks_of(F.col("words"))
    bodies = texts.select(*keys, marks_of(words_of(F.col("text"))).alias("marks"))
    marked = items.select("item_id", "item", F.size("words").alias("n"), marks.alias("marks"))

    parts = []
    for block, pieces in _blocks(items):
        mine = marked.where((F.col("item") % F.lit(1 << 20)).isin(block))
        parts += [_block_hits(bodies, mine, window, share, pieces, i) for i in range(pieces)]
    if not parts:
        parts = [_block_hits(bodies, marked.where("false"), window, share)]
    best = F.max(F.struct("best", (-F.col("start")).alias("back")))
    winners = (
        reduce(DataFrame.unionByName, parts)
        .groupBy(*keys, "item_id", "item", "n")
        .agg(best.alias("b"))
        .where(F.col("b.best") >= F.ceil(F.least(F.lit(window), "n") * F.lit(share)))
        .select(
            *[F.col(k).alias(f"_{k}") for k in keys],
            "item_id",
            "item",
            F.col("n").alias("item_words"),
            (-F.col("b.back")).alias("start"),
            F.col("b.best").alias("best"),
        )
    )
    # Only documents that overlap meet their item as a whole.
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    theirs = items.select("item", F.col("words").alias("theirs")).distinct()
    laid = texts.join(winners, same).join(theirs, "item")
    cut = F.greatest(F.lit(0), -F.col("start"))
    matched = let(
        F.slice(words_of(F.col("text")), F.greatest(F.lit(0), F.col("start")) + 1, F.col("item_words") - cut),
        lambda ours: _count(_agreement(ours, F.slice("theirs", cut + 1, F.size(ours)))),
    )
    return laid.select(*keys, "item_id", "start", "best", matched.alias("matched"), "item_words")


def _agreement(ours: Column, theirs: Column) -> Column:
    return F.zip_with(ours, theirs, lambda x, y: F.when(x == y, 1).otherwise(0))


def _count(agree: Column) -> Column:
    return F.aggregate(agree, F.lit(0), lambda s, x: s + x)


def _block_hits(
    bodies: DataFrame, items: DataFrame, window: int, share: float, pieces: int = 1, piece: int = 0
) -> DataFrame:
    """`start, best` for the hits of a block's seeds: the best window near each.

    Of the hits of a mask that follow each other on a diagonal only the first is
    looked at. All words from there to the last of them agree, so that either a
    window that begins there agrees throughout, or every window around a later
    hit of the run begins or ends within two windows of the first.

    Rows that carry the marks of a whole text must not leave compiled code, which
    would copy them for every word: next to the explode and the join are only
    expressions that compile, and which hits hold is asked further on.
    """
    keys = [c for c in bodies.columns if c != "marks"]
    short = [
        r["n"]
        for r in items.where(F.col("n") < SHORT).select("n").distinct().collect()
    ]
    masks, whole = [*enumerate(MASKS)], {}
    for n in sorted(short):
        for mask in short_masks(n, n - ceil(min(window, n) * share)):
            whole[len(masks)] = n
            masks.append((len(masks), mask))
    # Beside a seed stand the marks around it, not the item.
    ahead = F.least(F.col("at"), F.lit(window - 1))
    around = F.slice("marks", F.col("at") - ahead + 1, ahead + (2 * window + SPAN))
    seeds = (
        _seeds(items, masks, whole)
        .where("seed is not null")
        .where(F.pmod("at", F.lit(pieces)) == piece)
        .select(
            "item_id",
            "item",
            "n",
            F.col("at").alias("item_at"),
            ahead.alias("ahead"),
            around.alias("near"),
            "seed",
            F.col("before").alias("item_before"),
        )
        .distinct()
    )
    mine = _seeds(bodies, masks).withColumnRenamed("before", "own_before")
    hits = mine.join(F.broadcast(seeds), "seed").where(
        ~F.coalesce(F.col("own_before") == F.col("item_before"), F.lit(False))
    )
    first = F.col("at") - F.col("ahead")
    cut = F.greatest(F.lit(0), -first)
    beside = hits.select(
        *keys,
        "item_id",
        "item",
        "n",
        (F.col("at") - F.col("item_at")).alias("start"),
        cut.alias("cut"),
        "near",
        F.slice("marks", F.greatest(first, F.lit(0)) + 1, F.size("near") - cut).alias("ours"),
    )
    size = F.least(F.lit(window), F.col("n"))
    agree = _agreement(F.col("ours"), F.slice("near", F.col("cut") + 1, F.size("ours")))
    best = let(
        agree,
        lambda x: F.array_max(
            F.transform(
                index_range(F.greatest(F.size(x) - size + 1, F.lit(0))),
                lambda i: _count(F.slice(x, i + 1, size)),
            )
        ),
    )
    return beside.select(*keys, "item_id", "item", "n", "start", best.alias("best"))


def clean(
    docs: DataFrame, benchmark: DataFrame, window: int = 16, share: float = 0.8
) -> DataFrame:
    """The documents that overlap with no item, with all their columns."""
    texts = docs.select("doc_id", digest().alias("digest"), F.col("text").cast("string").alias("text"))
    leaks = _overlaps(texts, benchmark, window, share).select("doc_id", "digest")
    return without_rows(docs, leaks, [docs["doc_id"], digest()])
