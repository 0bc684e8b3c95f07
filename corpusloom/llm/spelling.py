"""Spelling variants: words one edit apart, by dense prefix-suffix tiles.

Two words are near if one inserted, deleted or replaced code point turns one into
the other: the lengths of their common prefix and common suffix then reach the
longer length less one. A block of words is a padded matrix of code points, and a
tile compares two blocks at once.

Which words meet in a tile follows from where the edit is. Of a word of m code
points and one of m or m + 1, cut after s = m // 2: an edit at or behind the cut
leaves the first s code points alike, one before it the last m - s. So every word
is dealt to a bucket by each half, once as the shorter and once as the longer
word of a pair. A bucket with too many words is cut again in the part that is
not alike yet, until that is one code point. Nothing is dropped, and of the
buckets that hold a pair exactly one counts it, the one its common prefix
leads to.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import code_points, slices
from corpusloom.llm.store import shared_dir, written

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
TYPO = 31

# Words of a bucket before it is cut again; rows of a block; cells of a tile.
MOST = 512
BLOCK = 256
CELLS = 1 << 23

_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LENGTH)
_SLICE = 1 << 22
_HELD = 200_000


def _counts_of(doc_id: str | None, text: str) -> Iterator[tuple[bytes, int]]:
    """Words in Latin-1 and their counts, after the typos of the contract."""
    start = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
    # Code points above U+00FF become "?"; bytes.lower() changes A-Z only.
    runs = _RUN.findall(text.encode("latin-1", "replace").lower())
    for run, n in Counter(runs).items():
        if start is not None:
            spelled = run if run.isascii() else run.decode("latin-1").encode()
            h = zlib.crc32(spelled, start)
            if h % TYPO == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < LEAST_LENGTH:
                    continue
        yield run, n


def word_counts(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """`word, n` over whole texts: runs of letters, A-Z lower-cased, with the
    contract's deletions (in documents without id, none)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told():
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.record_batch([words, pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in slices(batches, "text", _SLICE):
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
            for doc_id, text in rows:
                for word, n in _counts_of(doc_id, text or ""):
                    held[word] += n
                if len(held) > _HELD:
                    yield told()
                    held.clear()
        yield told()

    found = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _dealt(rows: DataFrame, parts: Column) -> DataFrame:
    """Rows for an array of `m, a, b` each: the shorter length of a pair, and
    how long the prefix and the suffix are that the words of a bucket share."""
    keep = [c for c in ("word", "n") if c in rows.columns]
    part = rows.select(*keep, F.explode(parts).alias("p")).select(*keep, "p.*")
    alike = F.struct(
        "m", "a", "b",
        F.substring("word", F.lit(1), F.col("a")),
        F.expr("right(word, b)"),
    )
    return part.withColumn("bucket", F.xxhash64(alike))


def _part(m: Column, a: Column, b: Column) -> Column:
    return F.struct(
        m.cast("int").alias("m"), a.cast("int").alias("a"), b.cast("int").alias("b")
    )


def _halves(m: Column, a: Column, b: Column) -> list[Column]:
    cut = a + F.floor((m - a - b) / 2)
    return [_part(m, cut, b), _part(m, a, m - cut)]


def buckets(words: DataFrame, path: str, most: int = MOST) -> DataFrame:
    """`word, n, m, a, b, bucket`: every word in the buckets where it can meet
    its near words. The sizes of buckets are counted, and those above `most` cut
    again; which they are is a table."""
    size, none = F.length("word"), F.lit(0)
    at_first = F.array(*_halves(size, none, none), *_halves(size - 1, none, none))
    rows, done = _dealt(words, at_first), None
    step = 0
    while True:
        step += 1
        large = written(
            rows.where("m - a - b > 1").groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most),
            f"{path}/large{step}",
        ).select("bucket")
        stay = rows.join(large, "bucket", "left_anti")
        done = stay if done is None else done.unionByName(stay)
        if large.isEmpty():
            return done
        cut = rows.where("m - a - b > 1").join(large, "bucket", "left_semi")
        # A collision of bucket hashes may hold rows that cannot be cut again.
        done = done.unionByName(rows.where("m - a - b <= 1").join(large, "bucket", "left_semi"))
        halves = F.array(*_halves(F.col("m"), F.col("a"), F.col("b")))
        rows = written(_dealt_again(cut, halves), f"{path}/rows{step}")


def _dealt_again(rows: DataFrame, parts: Column) -> DataFrame:
    held = rows.select("word", "n", parts.alias("parts"))
    return _dealt(held, F.col("parts"))


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points from the left and from the right, padded with zeros by at
    least one, and the lengths."""
    points, lengths = code_points(words)
    small = not len(points) or points.max() < 256
    width = int(lengths.max(initial=0)) + 1
    left = np.zeros((len(words), width), np.uint8 if small else np.uint32)
    right = left.copy()
    row = np.repeat(np.arange(len(words)), lengths)
    column = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left[row, column] = points
    right[row, np.repeat(lengths, lengths) - 1 - column] = points
    return left, right, lengths


def compare(left: np.ndarray, right: np.ndarray, lengths: np.ndarray, i: np.ndarray, j: np.ndarray):
    """For the pairs (i, j) of rows: whether they are one edit apart, and their
    common prefix."""
    differ = left[i] != left[j]
    prefix = differ.argmax(1)
    suffix = (right[i] != right[j]).argmax(1)
    longer = np.maximum(lengths[i], lengths[j])
    near = (prefix + suffix >= longer - 1) & (np.abs(lengths[i] - lengths[j]) <= 1)
    return near & differ[np.arange(len(i)), prefix], prefix


def _tiles(starts: np.ndarray, shorts: np.ndarray, ends: np.ndarray, block: int) -> Iterator[tuple]:
    """Block pairs of each bucket: the rows from its start hold shorter words up
    to `shorts`, longer ones up to `ends`. Two longer words are no pair."""
    for start, short, end in zip(starts.tolist(), shorts.tolist(), ends.tolist(), strict=True):
        for a in range(start, short, block):
            for b in range(a, end, block):
                yield a, min(a + block, short), b, min(b + block, end)


def _pairs(tiles: Iterator[tuple], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i < j of the tiles, many small tiles or one large one at a time."""
    held, size = [], 0

    def laid(held):
        a, a2, b, b2 = np.array(held, np.int64).T
        wide, cells = b2 - b, (a2 - a) * (b2 - b)
        tile = np.repeat(np.arange(len(cells)), cells)
        at = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        i, j = a[tile] + at // wide[tile], b[tile] + at % wide[tile]
        return i[i < j], j[i < j]

    for tile in tiles:
        cells = (tile[1] - tile[0]) * (tile[3] - tile[2])
        if held and size + cells > most:
            yield laid(held)
            held, size = [], 0
        held.append(tile)
        size += cells
    if held:
        yield laid(held)


def _near_of(rows: pa.Table, block: int) -> Iterator[pa.RecordBatch]:
    """For each word of some whole buckets that has a near word there: how many,
    and the one of largest n, the least in code-point order among equals."""
    words = rows.column("word").to_pylist()
    n, bucket, m, a, b = (
        rows.column(c).to_numpy() for c in ("n", "bucket", "m", "a", "b")
    )
    left, right, lengths = matrices(words)
    # Rows come sorted by (bucket, word); the shorter words go first.
    order = np.lexsort((lengths > m, bucket))
    left, right, lengths, rank = left[order], right[order], lengths[order], order
    n, bucket, m, a, b = (x[order] for x in (n, bucket, m, a, b))
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[starts[1:], len(bucket)]
    shorts = starts + np.add.reduceat((lengths <= m).astype(np.int64), starts)
    found = []
    step = min(block, max(1, int((CELLS // left.shape[1]) ** 0.5)))
    for i, j in _pairs(_tiles(starts, shorts, ends, step), max(1, CELLS // left.shape[1])):
        near, prefix = compare(left, right, lengths, i, j)
        near &= (prefix >= a[i]) & ((b[i] == 0) | (prefix < m[i] - b[i]))
        near &= (m[i] == m[j]) & (a[i] == a[j]) & (b[i] == b[j])
        found.append((i[near], j[near]))
    if not found:
        return
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    this, other = np.r_[i, j], np.r_[j, i]
    best = np.lexsort((rank[other], -n[other], this))
    this, other = this[best], other[best]
    first = np.flatnonzero(np.r_[True, this[1:] != this[:-1]][: len(this)])
    counts = np.diff(np.r_[first, len(this)])
    yield pa.record_batch(
        [
            pa.array([words[k] for k in rank[this[first]]], pa.string()),
            pa.array(counts, pa.int64()),
            pa.array([words[k] for k in rank[other[first]]], pa.string()),
            pa.array(n[other[first]], pa.int64()),
        ],
        ["word", "n_near", "form", "form_n"],
    )


def near_words(dealt: DataFrame, block: int = BLOCK) -> DataFrame:
    """`word, n_near, form, form_n` for every word with a near word: how many
    there are, and the one of largest n."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            change = np.flatnonzero(bucket[1:] != bucket[:-1])
            if held and len(bucket) and held[-1].column("bucket")[-1].as_py() != bucket[0]:
                yield from _near_of(pa.Table.from_batches(held), block)
                held = []
            if len(change):
                whole = int(change[-1]) + 1
                yield from _near_of(pa.Table.from_batches([*held, batch.slice(0, whole)]), block)
                held, batch = [], batch.slice(whole)
            if batch.num_rows:
                held.append(batch)
        if held:
            yield from _near_of(pa.Table.from_batches(held), block)

    told = (
        dealt.repartition("bucket")
        .sortWithinPartitions("bucket", "word")
        .mapInArrow(compared, "word string, n_near bigint, form string, form_n bigint")
    )
    best = F.struct((-F.col("form_n")).alias("less"), "form")
    return (
        told.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), F.min(best).alias("best"))
        .select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    )


def roots(forms: DataFrame, path: str) -> DataFrame:
    """`word, root`: every form followed to its end, twice as far a time. A
    form is more frequent than its word, so that there are no circles."""
    ways = forms.select("word", F.col("form").alias("root"))
    step = 0
    while True:
        step += 1
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("then"))
        ways = written(
            ways.select("word", "root")
            .join(ahead, "root", "left")
            .select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")),
            f"{path}/roots{step}",
        )
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")


def variants(words: DataFrame, path: str, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """`word, form, root, n, n_near, form_n` for each row of `word, n`."""
    words = written(words, f"{path}/words")
    near = near_words(buckets(words, f"{path}/buckets", most))
    known = F.col("form_n") >= ratio * F.col("n")
    found = written(
        words.join(near, "word", "left").select(
            "word",
            F.when(known, F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(known, F.col("form_n")).alias("form_n"),
        ),
        f"{path}/found",
    )
    ends = roots(found.where("form is not null"), path)
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of whole `documents` texts with their near words.

    Null and empty texts have no words; repeated rows count each; columns other
    than `doc_id` and `text` are not read. An empty table gives no rows.
    """
    return variants(word_counts(docs), shared_dir(docs.sparkSession))
