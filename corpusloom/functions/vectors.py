"""Vector arithmetic on ``array`` columns, and the default text embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.exprs import let, run_starts
from corpusloom.functions.text import whitespace_tokens

DEFAULT_DIM = 384


def as_doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector has no length."""
    return let(
        norm(a) * norm(b),
        lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n),
    )


def l2_normalise(vec: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    return let(
        norm(vec),
        lambda n: F.transform(vec, lambda x: F.when(n == 0, x).otherwise(x / n)),
    )


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x
    )


def token_bucket(token: Column, dim: int) -> Column:
    """Stable bucket of a token: the first 24 bits of its MD5, modulo ``dim``."""
    return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 6), 16, 10).cast("int") % dim).cast(
        "int"
    )


def bucket_counts(buckets: Column, dim: int) -> Column:
    """Dense count vector of a bucket array.

    Every bucket number is added once before sorting, so the run lengths of
    the sorted array, less one, are the vector already in bucket order.
    """
    padded = F.sort_array(F.concat(buckets, F.sequence(F.lit(0), F.lit(dim - 1))))

    def lengths(ordered: Column) -> Column:
        return let(
            run_starts(ordered),
            lambda starts: F.transform(
                starts,
                lambda s, j: (
                    F.when(j < dim - 1, starts[F.least(j + 1, F.lit(dim - 1))])
                    .otherwise(F.size(ordered))
                    - s
                    - 1
                ).cast("double"),
            ),
        )

    return let(padded, lengths)


def hashed_bag(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Default embedding: hashed bag of white space tokens, as counts."""
    buckets = F.transform(whitespace_tokens(text), lambda t: token_bucket(t, dim))
    return bucket_counts(buckets, dim)
