"""Positions in a linked list that is given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.store import written

NONE = -1
# Below this many elements one task follows the links.
FEW = 100_000


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions of a whole list of bounded length."""
    links = {}
    at = NONE
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("at", "prev", "next", "gap")]
        for this, prev, following, gap in zip(*columns, strict=True):
            links[this] = (following, gap)
            if prev == NONE:
                at = this
    order, places, place = [], [], 0
    while at != NONE:
        following, gap = links[at]
        place += gap
        order.append(at)
        places.append(place)
        at = following
    yield pa.record_batch([pa.array(order, pa.int64()), pa.array(places, pa.int64())], ["at", "pos"])


def list_rank(links: DataFrame, path: str, few: int = FEW) -> DataFrame:
    """`at, pos`: the place of each element, from 0. `links` holds `at, prev,
    next` (bigint), the neighbours of each element of one list, -1 for none.

    A round takes out the elements whose hash is less than those of both
    neighbours, about a third, and ties the neighbours together; `gap` is the
    way from the one before. No two of them are neighbours, so a round is one
    aggregation by element in which no key has more than three rows. When `few`
    elements are left, one task follows them. The rounds are then undone: an
    element lies its gap behind the one that was before it. The rounds shrink
    geometrically, so all of them together cost a few passes over the list.
    """
    left = written(
        links.select("at", "prev", "next", F.when(F.col("prev") == NONE, 0).otherwise(1).cast("bigint").alias("gap")),
        f"{path}/links0",
    )
    out = []
    while left.count() > few:
        step = len(out) + 1

        def drawn(c):
            return F.xxhash64(F.col(c), F.lit(step))

        marked = left.withColumn(
            "out",
            (F.col("prev") != NONE)
            & (drawn("at") < drawn("prev"))
            & ((F.col("next") == NONE) | (drawn("at") < drawn("next"))),
        )
        gone, none = marked.where("out"), F.lit(None).cast("bigint")
        told = (
            marked.where("not out")
            .select("at", "prev", "next", "gap", none.alias("to_prev"), none.alias("to_next"), F.lit(0).cast("bigint").alias("more"))
            .unionByName(
                gone.select(
                    F.col("prev").alias("at"), none.alias("prev"), none.alias("next"), none.alias("gap"),
                    none.alias("to_prev"), F.col("next").alias("to_next"), F.lit(0).cast("bigint").alias("more"),
                )
            )
            .unionByName(
                gone.where(F.col("next") != NONE).select(
                    F.col("next").alias("at"), none.alias("prev"), none.alias("next"), none.alias("gap"),
                    F.col("prev").alias("to_prev"), none.alias("to_next"), F.col("gap").alias("more"),
                )
            )
        )
        out.append(written(gone.select("at", "prev", "gap"), f"{path}/out{step}"))
        left = written(
            told.groupBy("at").agg(
                F.coalesce(F.max("to_prev"), F.max("prev")).alias("prev"),
                F.coalesce(F.max("to_next"), F.max("next")).alias("next"),
                (F.max("gap") + F.sum("more")).alias("gap"),
            ),
            f"{path}/links{step}",
        )
    places = written(left.coalesce(1).mapInArrow(_followed, "at bigint, pos bigint"), f"{path}/few")
    for step, gone in reversed(list(enumerate(out, 1))):
        ahead = places.select(F.col("at").alias("prev"), "pos")
        placed = gone.join(ahead, "prev").select("at", (F.col("pos") + F.col("gap")).alias("pos"))
        places = places.unionByName(written(placed, f"{path}/placed{step}"))
    return places
