"""Small Column-building helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    Catalyst may inline a projected column into every place that uses it;
    inside a higher-order function that means once per array element. Binding
    it to a lambda variable keeps it evaluated once.
    """
    return F.transform(F.array(value), body)[0]


def round6(value: Column) -> Column:
    """Six decimals: scores are rounded before ranking so ties are stable."""
    return F.round(value, 6)


def index_range(size: Column) -> Column:
    """``[0 .. size-1]``, empty for size 0."""
    return F.when(size > 0, F.sequence(F.lit(0), size.cast("int") - 1)).otherwise(
        F.array().cast("array<int>")
    )


def run_starts(sorted_items: Column) -> Column:
    """Positions at which a new value begins in a sorted array."""
    return F.filter(
        index_range(F.size(sorted_items)),
        lambda i: (i == 0) | (sorted_items[i] != sorted_items[F.greatest(i - 1, F.lit(0))]),
    )


def explode_rows(df: DataFrame, array: Column, *names: str, keep: list[str]) -> DataFrame:
    """Explode a computed array, dropping rows where it is empty or null.

    Plain ``explode`` makes the optimizer infer ``size(array) > 0`` and push
    it below the projection, which computes the whole array expression a
    second time. The outer form is exempt, so empties are dropped afterwards.
    With two names the position comes first.
    """
    gen = F.posexplode_outer(array) if len(names) == 2 else F.explode_outer(array)
    return df.select(*keep, gen.alias(*names)).where(F.col(names[-1]).isNotNull())
