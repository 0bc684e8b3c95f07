"""Small helpers for Arrow batches of texts inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(
    batches: Iterator[pa.RecordBatch], column: str, most: int
) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a piece holds about `most` bytes of a text column,
    or one text: memory follows the longest text, not the batch."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        piece = np.cumsum(size) // most
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and the length of each."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), lengths


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of each run of `lengths` values; empty runs give 0."""
    out = np.zeros(len(lengths))
    some = lengths > 0
    if some.any():
        # A run's sum must not depend on what stands before it.
        out[some] = np.add.reduceat(values.astype(np.float64), (np.cumsum(lengths) - lengths)[some])
    return out
