"""Running totals over sorted groups of any size, without a task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.columns import fresh
from corpusloom.llm.store import written

SUM, XOR = "sum", "xor"


def _total(kind: str, value: Column) -> Column:
    return F.sum(value) if kind == SUM else F.bit_xor(value)


def running(
    df: DataFrame,
    groups: list[str],
    order: list[str],
    totals: dict[str, tuple[str, Column]],
    path: str,
) -> DataFrame:
    """`df` and, for each name in `totals`, the sum or exclusive or of a value
    over the rows of its group up to this one. `order` is ascending, nulls first.

    Rows are dealt out by ranges of (group, order), so that a group with a large
    share of all rows spans many tasks. Each adds up its own part; what the
    earlier parts of a group come to is one row per part and group. Equal keys
    stay together: the last of `order` should tell rows apart. Group columns
    must not be null.
    """
    part = fresh(df, "part")
    values = {name: fresh(df, f"value_{name}") for name in totals}
    dealt = written(
        df.select("*", *[v.alias(values[n]) for n, (_, v) in totals.items()])
        .repartitionByRange(*groups, *order)
        .withColumn(part, F.spark_partition_id()),
        path,
    )
    keys = [part, *groups]
    own = dealt.groupBy(*keys).agg(
        *[_total(kind, F.col(values[n])).alias(values[n]) for n, (kind, _) in totals.items()]
    )
    # One row per task and group; without groups, one row per task.
    earlier = (
        Window.partitionBy(*(groups or [F.lit(0)]))
        .orderBy(part)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = {n: fresh(df, f"before_{n}") for n in totals}
    offsets = own.select(
        *keys,
        *[
            F.coalesce(_total(kind, F.col(values[n])).over(earlier), F.lit(0)).alias(before[n])
            for n, (kind, _) in totals.items()
        ],
    )
    so_far = (
        Window.partitionBy(*keys)
        .orderBy(*[F.col(c).asc_nulls_first() for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    within = dealt.select(
        *df.columns,
        part,
        *[
            _total(kind, F.col(values[n])).over(so_far).alias(values[n])
            for n, (kind, _) in totals.items()
        ],
    )

    def joined(name: str, kind: str) -> Column:
        a, b = F.col(values[name]), F.col(before[name])
        return (a + b if kind == SUM else a.bitwiseXOR(b)).alias(name)

    return within.join(offsets, keys).select(
        *df.columns, *[joined(n, kind) for n, (kind, _) in totals.items()]
    )
