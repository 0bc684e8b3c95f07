"""Splitting documents into chunks, entirely within each row.

A document is one row, so its sentences, distances and chunk borders are built
with array functions on that row: no text is shuffled, and a huge document
costs one task no more than reading that row already did.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X
from corpusloom.functions import vectors as V
from corpusloom.functions.exprs import explode_rows, index_range, let

# Slack for comparing a distance with an interpolated percentile: distances
# are rounded to nine decimals first, so a real excess is far larger.
BREAK_SLACK = 1e-9
# Words whose buckets a task remembers, and documents it unpacks at once.
KNOWN_WORDS, ROWS_PER_STEP = 200_000, 256


def drop_blank(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Leave out documents that hold nothing but white space."""
    return docs.where(~X.is_blank(F.col(text_col)))


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sentence with its position."""
    return explode_rows(
        docs, X.sentences(F.col(text_col)), "pos", "sentence", keep=[id_col]
    )


def _bag_breaks(rows: DataFrame, dim: int, buffer: int, percent: float) -> DataFrame:
    """Adds ``_b``, the sentences that open a chunk, to rows with sentences ``_s``, by
    the cosine distance between the hashed bags of neighbouring sentence groups.

    A bag is kept as its buckets and counts: a document's bags take no more memory than
    its words.
    """
    out = T.StructType([*rows.schema.fields, T.StructField("_b", T.ArrayType(T.IntegerType()))])
    names = rows.columns
    lowered = rows.withColumn("_low", F.transform("_s", F.lower))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of: dict[str, int] = {}
        for batch in (b.slice(i, ROWS_PER_STEP) for b in batches for i in range(0, b.num_rows, ROWS_PER_STEP)):
            low = batch.column(batch.schema.get_field_index("_low"))
            starts = [_chunk_starts(t, dim, buffer, percent, bucket_of) for t in low.to_pylist()]
            yield batch.select(names).append_column("_b", pa.array(starts, pa.list_(pa.int32())))

    return lowered.mapInArrow(run, out)


def _chunk_starts(
    lowered: list[str] | None, dim: int, buffer: int, percent: float, bucket_of: dict[str, int]
) -> list[int] | None:
    """The sentences of one document that open a chunk."""
    if lowered is None:
        return None
    sentences = [_buckets(s.split(), dim, bucket_of) for s in lowered]
    n = len(sentences)
    if n < 2:
        return [0]
    # (sentence, bucket, count), then the same for groups, by adding up neighbours.
    place = np.repeat(np.arange(n), [len(s) for s in sentences])
    cells = place * dim + np.array([b for s in sentences for b in s], np.int64)
    shifts = [(cells + d * dim)[(place + d >= 0) & (place + d < n)] for d in range(-buffer, buffer + 1)]
    cell, count = np.unique(np.concatenate(shifts), return_counts=True)
    squared = np.bincount(cell // dim, count * count, minlength=n)
    # A bucket of the next group stands one row further.
    at = np.searchsorted(cell, cell + dim)
    both = np.flatnonzero(cell[np.minimum(at, len(cell) - 1)] == cell + dim)
    dots = np.bincount(cell[both] // dim, (count[both] * count[at[both]]).astype(np.float64), minlength=n)[: n - 1]
    size = np.sqrt(squared[:-1]) * np.sqrt(squared[1:])
    near = np.divide(dots, size, out=np.zeros(n - 1), where=size > 0)
    gaps = _rounded(1 - near)
    ordered = np.sort(gaps)
    where = (n - 2) * (percent / 100.0)
    lo = int(np.floor(where))
    hi = min(lo + 1, n - 2)
    limit = ordered[lo] + (ordered[hi] - ordered[lo]) * (where - lo)
    return [0, *(np.flatnonzero(gaps > limit + BREAK_SLACK) + 1).tolist()]


def _rounded(x: np.ndarray) -> np.ndarray:
    """Nine decimals of the shortest decimal form, half away from zero."""
    nano = Decimal("1e-9")
    exact = np.round(x, 9)
    # Where the tenth digit is close to a half, the decimal form decides.
    close = np.flatnonzero(np.abs(np.abs(x * 1e9 % 1) - 0.5) < 1e-3)
    for i in close.tolist():
        exact[i] = float(Decimal(repr(float(x[i]))).quantize(nano, ROUND_HALF_UP))
    return exact


def _buckets(tokens: list[str], dim: int, bucket_of: dict[str, int]) -> list[int]:
    """``token_bucket`` of each token; words that were seen before are looked up."""
    out = []
    for token in tokens:
        bucket = bucket_of.get(token)
        if bucket is None:
            if len(bucket_of) >= KNOWN_WORDS:
                bucket_of.clear()
            bucket = int(hashlib.md5(token.encode()).hexdigest()[:6], 16) % dim
            bucket_of[token] = bucket
        out.append(bucket)
    return out


def _distances(group_vecs: Column) -> Column:
    """Cosine distance between each group and the next one."""
    with_norm = F.transform(
        group_vecs, lambda v: F.struct(v.alias("v"), V.norm(v).alias("n"))
    )

    def between(g: Column) -> Column:
        def step(i: Column) -> Column:
            a, b = g[i], g[i + 1]
            n = a["n"] * b["n"]
            sim = F.when(n == 0, F.lit(0.0)).otherwise(V.dot(a["v"], b["v"]) / n)
            return F.round(1 - sim, 9)

        return F.transform(index_range(F.size(g) - 1), step)

    return let(with_norm, between)


def _percentile(sorted_values: Column, percent: float) -> Column:
    """Linear interpolation between the two closest ranks."""

    def interpolate(v: Column) -> Column:
        last = F.size(v) - 1
        place = last * F.lit(percent / 100.0)
        lo = F.floor(place).cast("int")
        hi = F.least(lo + 1, last)
        return v[lo] + (v[hi] - v[lo]) * (place - lo)

    return let(sorted_values, interpolate)


def _starts_after_breaks(distances: Column, percent: float) -> Column:
    """Positions of the sentences that open a chunk."""
    first = F.array(F.lit(0))

    def opened(d: Column) -> Column:
        return F.when(F.size(d) == 0, first).otherwise(
            let(
                _percentile(F.sort_array(d), percent),
                lambda limit: F.concat(
                    first,
                    F.transform(
                        F.filter(index_range(F.size(d)), lambda i: d[i] > limit + BREAK_SLACK),
                        lambda i: i + 1,
                    ),
                ),
            )
        )

    return let(distances, opened)


def semantic_chunks(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = ("source",),
    dim: int = V.DEFAULT_DIM,
    percentile: float = 95.0,
    buffer: int = 1,
    group_embedder: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Cut a document where neighbouring sentence groups differ the most.

    A border falls where the cosine distance to the next group exceeds the
    given percentile of the distances within that same document.
    ``group_embedder`` maps ``array<string>`` (the group texts of a document)
    to ``array<array<double>>``; without it the hashed default is used.
    """
    base = docs.select(
        id_col, *[c for c in keep if c in docs.columns], X.sentences(F.col(text_col)).alias("_s")
    )
    if group_embedder is None:
        starts = _bag_breaks(base, dim, buffer, percentile)
    else:
        base = base.withColumn(
            "_g",
            group_embedder(
                F.transform(
                    F.col("_s"),
                    lambda s, i: F.array_join(
                        F.slice(
                            F.col("_s"),
                            F.greatest(i - buffer, F.lit(0)) + 1,
                            F.least(i, F.lit(buffer)) + 1 + buffer,
                        ),
                        " ",
                    ),
                )
            ),
        )
        starts = base.withColumn("_b", _starts_after_breaks(_distances(F.col("_g")), percentile))
    parts, b = F.col("_s"), F.col("_b")
    chunk = F.transform(
        b,
        lambda s, j: F.array_join(
            F.slice(
                parts,
                s + 1,
                F.when(j + 1 < F.size(b), b[F.least(j + 1, F.size(b) - 1)]).otherwise(
                    F.size(parts)
                )
                - s,
            ),
            " ",
        ),
    )
    return explode_rows(
        starts,
        chunk,
        "chunk_no",
        "content",
        keep=[id_col, *[c for c in keep if c in docs.columns]],
    )


# Separators of the recursive splitter, coarse to fine; the last
# resort after them is single characters.
SEPARATORS = ("\n\n", "\n", " ")


def _pieces(text: Column, size: int, separators: Sequence[str]) -> Column:
    """``array<struct<len, fresh>>``: the indivisible pieces of a text in order.

    A piece keeps the separator in front of it, so pieces add up to the text.
    A piece too long for a chunk is cut at the next finer separator. ``fresh``
    marks a piece that may not be packed with the one before it, because one
    of the two came out of such a cut.
    """
    if not separators:
        return F.transform(
            index_range(F.length(text)),
            lambda i: F.struct(F.lit(1).alias("len"), (i == 0).alias("fresh")),
        )
    sep = separators[0]
    raw = F.split(text, sep)
    kept = F.filter(
        F.transform(raw, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(sep), p))),
        lambda p: F.length(p) > 0,
    )

    def refine(items: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            after_long = (i == 0) | (
                F.length(items[F.greatest(i - 1, F.lit(0))]) >= size
            )
            short = F.array(F.struct(F.length(p).alias("len"), after_long.alias("fresh")))
            return F.when(F.length(p) < size, short).otherwise(
                _pieces(p, size, separators[1:])
            )

        return F.flatten(F.transform(items, one))

    return let(kept, refine)


def _pack(pieces: Column, size: int, overlap: int) -> Column:
    """``array<struct<s, e>>``: greedy packing of pieces into chunk spans.

    The window of the open chunk is kept as the offsets of its pieces. When
    the next piece does not fit, the span is closed and the window moves on
    to the first piece that leaves at most ``overlap`` characters and room
    for the new piece.
    """
    span = "array<struct<s:int,e:int>>"
    ints = "array<int>"
    start = F.struct(
        F.array().cast(span).alias("done"),
        F.array().cast(ints).alias("open"),
        F.lit(0).alias("end"),
    )

    def emit(acc: Column) -> Column:
        return F.when(F.size(acc["open"]) == 0, acc["done"]).otherwise(
            F.concat(
                acc["done"],
                F.array(F.struct(acc["open"][0].alias("s"), acc["end"].alias("e"))),
            )
        )

    def step(acc: Column, p: Column) -> Column:
        opened, end = acc["open"], acc["end"]
        grown = end + p["len"]
        full = (F.size(opened) > 0) & (
            p["fresh"] | (grown - F.try_element_at(opened, F.lit(1)) > size)
        )
        carried = F.when(p["fresh"], F.array().cast(ints)).otherwise(
            F.filter(opened, lambda s: (end - s <= overlap) & (grown - s <= size))
        )
        return F.struct(
            F.when(full, emit(acc)).otherwise(acc["done"]).alias("done"),
            F.concat(F.when(full, carried).otherwise(opened), F.array(end)).alias("open"),
            grown.alias("end"),
        )

    return F.aggregate(pieces, start, step, emit)


def recursive_chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of chunks of at most ``size`` characters, stripped of white space."""
    if size < 1 or overlap < 0 or overlap > size:
        raise ValueError("need size >= 1 and 0 <= overlap <= size")
    spans = _pack(_pieces(text, size, SEPARATORS), size, overlap)
    return F.filter(
        F.transform(spans, lambda x: X.strip(F.substring(text, x["s"] + 1, x["e"] - x["s"]))),
        lambda c: F.length(c) > 0,
    )


def fallback_array(content: Column, size: int, overlap: int) -> Column:
    """``array<struct<symbol_type, start_line, end_line, chunk>>`` of a file
    without definitions.

    A file that fits becomes one ``module`` chunk with its line range; a larger
    one becomes ``block`` chunks without line numbers; a blank one none.
    """
    no_line = F.lit(None).cast("int")

    def entry(kind: str, start: Column, end: Column, chunk: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("symbol_type"),
            start.alias("start_line"),
            end.alias("end_line"),
            chunk.alias("chunk"),
        )

    return F.when(
        ~X.is_blank(content),
        F.when(
            F.length(content) <= size,
            F.array(entry("module", F.lit(1), X.line_count(content), content)),
        ).otherwise(
            F.transform(
                recursive_chunks(content, size, overlap),
                lambda c: entry("block", no_line, no_line, c),
            )
        ),
    )


def fallback_chunks(
    files: DataFrame,
    id_col: str = "path",
    text_col: str = "content",
    keep: Sequence[str] = ("language",),
    size: int = 1500,
    overlap: int = 100,
) -> DataFrame:
    """Whole-file or block chunks of every file, as rows."""
    rows = explode_rows(
        files,
        fallback_array(F.col(text_col), size, overlap),
        "chunk_no",
        "_c",
        keep=[id_col, *[c for c in keep if c in files.columns]],
    )
    return rows.select("*", "_c.*").drop("_c")
