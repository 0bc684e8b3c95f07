"""Joins that leave a caller's columns alone, whatever they are called."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def digest(text: str = "text") -> Column:
    """What tells apart rows that share an id or have none; null for null."""
    return F.sha2(F.col(text).cast("string"), 256)


def without_rows(docs: DataFrame, gone: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows whose `keys` are not a row of `gone`, which has a column for
    each key; null is a value."""
    names = [fresh(docs, f"gone{i}") for i in range(len(keys))]
    gone = gone.toDF(*names).distinct()
    same = reduce(Column.__and__, [k.eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    return docs.join(gone, same, "left_anti")
