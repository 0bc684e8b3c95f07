"""A trie of conversations by their turns, with totals of every subtree from an
Euler tour.

Turns are ordered by turn number (null first), then by a digest of role and text
where numbers are equal. Null role or text is empty. Rows without a conversation
id belong to none and are left out. Two prefixes are one node if their 240-bit
digests agree: the exclusive or, over the turns, of a digest of (place, role,
text), which adds up in parallel however long a conversation is. An empty table
has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.list_rank import FEW, NONE, list_rank
from corpusloom.llm.running import SUM, XOR, running
from corpusloom.llm.store import shared_dir, written

LANES = ["x0", "x1", "x2", "x3"]
BLOCK = 1 << 16


def _lanes(text: Column) -> list[Column]:
    """Four numbers of 60 bits from a digest."""
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("bigint") for i in range(4)]


def turns(conversations: DataFrame, path: str) -> DataFrame:
    """`conv_id, depth, turn_digest, n_bytes`: each turn's place in its
    conversation, from 1. Texts stay behind."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("turn_digest"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = running(
        slim, ["conv_id"], ["turn", "turn_digest", "row"], {"depth": (SUM, F.lit(1).cast("bigint"))}, path
    )
    return placed.select("conv_id", "depth", "turn_digest", "n_bytes")


def grafted(placed: DataFrame, convs: DataFrame, base: Column, share: Column, most: int) -> DataFrame:
    """The turns of rebuilt conversations: the first `share` turns of
    conversation `base` (all if it has fewer, none if it is absent), then the
    own turns after the first `share`. `convs` holds `conv_id, n` for every
    conversation; `share` is at most `most`."""
    plan = convs.select("conv_id", base.alias("base"), share.cast("bigint").alias("share"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = plan.join(sizes, "base", "left").select(
        "*", F.least("share", F.coalesce("base_n", F.lit(0))).alias("taken")
    )
    rest = ["turn_digest", "n_bytes"]
    heads = placed.where(F.col("depth") <= most).withColumnRenamed("conv_id", "base")
    first = heads.join(plan.select("conv_id", "base", "taken"), "base").where("depth <= taken")
    own = placed.join(plan.select("conv_id", "share", "taken"), "conv_id").where("depth > share")
    return first.select("conv_id", "depth", *rest).unionByName(
        own.select("conv_id", (F.col("depth") - F.col("share") + F.col("taken")).alias("depth"), *rest)
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins sorted ids of a node to texts of at most `BLOCK` ids."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ["depth", *LANES, "conv_id"]), strict=True)
        out = []
        for key, same in groupby(rows, key=lambda r: r[:-1]):
            ids = [r[-1] for r in same]
            for i in range(0, len(ids), BLOCK):
                part = ids[i : i + BLOCK]
                out.append((*key, part[0], ",".join(map(str, part))))
        yield pa.RecordBatch.from_pylist(
            [dict(zip(["depth", *LANES, "first", "ids"], r, strict=True)) for r in out],
            pa.schema([(c, pa.int64()) for c in ["depth", *LANES, "first"]] + [("ids", pa.string())]),
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's blocks, which come sorted; one state is held."""
    schema = pa.schema([(c, pa.int64()) for c in ["depth", *LANES]] + [("ends_sha256", pa.string())])
    key, state = None, None
    for batch in batches:
        done = []
        rows = zip(*(batch.column(c).to_pylist() for c in ["depth", *LANES]), strict=True)
        for now, ids in zip(rows, batch.column("ids").to_pylist(), strict=True):
            if now == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in done], schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, state.hexdigest()), strict=True))], schema)


def _ends(last: DataFrame) -> DataFrame:
    """`depth, x0..x3, ends_sha256`: the conversations that end in each node.
    The ids are sorted and joined by ranges over all tasks; what meets in one
    task per node are blocks, which are hashed as they come."""
    keys = ["depth", *LANES]
    longs = ", ".join(f"{c} bigint" for c in keys)
    blocks = (
        last.select(*keys, "conv_id")
        .repartitionByRange(*keys, "conv_id")
        .sortWithinPartitions(*keys, "conv_id")
        .mapInArrow(_blocks, f"{longs}, first bigint, ids string")
    )
    return (
        blocks.repartition(*keys)
        .sortWithinPartitions(*keys, "first")
        .mapInArrow(_hashed, f"{longs}, ends_sha256 string")
    )


def _tour(nodes: DataFrame, count: int) -> DataFrame:
    """The arcs `at, prev, next` of the Euler tour: node `id` is entered by arc
    `2 id` and left by `2 id + 1`. The children of a node are taken in groups by
    hash, about the root of all nodes many, so that neither the children of a
    group nor the groups of a node are more than a task can sort."""
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    salts = isqrt(max(count - 1, 0)) + 1
    child = nodes.where("parent is not null").select(
        "id", "parent", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")
    )
    beside = Window.partitionBy("parent", "salt").orderBy("id")
    to_sibling = child.select("id", F.lead("id").over(beside).alias("then")).where("then is not null")
    group = child.groupBy("parent", "salt").agg(F.min("id").alias("head"), F.max("id").alias("tail"))
    groups = Window.partitionBy("parent").orderBy("salt")
    to_group = group.select("parent", "tail", F.lead("head").over(groups).alias("then"))
    first = group.groupBy("parent").agg(F.min_by("head", "salt").alias("then"))
    ahead = (
        to_sibling.select(leave.alias("at"), (F.col("then") * 2).alias("next"))
        .unionByName(
            to_group.select(
                (F.col("tail") * 2 + 1).alias("at"),
                F.coalesce(F.col("then") * 2, F.col("parent") * 2 + 1).alias("next"),
            )
        )
        .unionByName(first.select((F.col("parent") * 2).alias("at"), (F.col("then") * 2).alias("next")))
        .unionByName(nodes.where("n_children = 0").select(enter.alias("at"), leave.alias("next")))
    )
    none = F.lit(NONE).cast("bigint")
    ends = nodes.where("parent is null").select(leave.alias("at"), none.alias("next"))
    starts = nodes.where("parent is null").select(enter.alias("at"), none.alias("prev"))
    back = ahead.select(F.col("next").alias("at"), F.col("at").alias("prev")).unionByName(starts)
    return ahead.unionByName(ends).join(back, "at").select("at", "prev", "next")


def trie(rebuilt: DataFrame, convs: DataFrame, path: str, few: int = FEW) -> DataFrame:
    """One row for each node of the trie of `rebuilt` (`conv_id, depth,
    turn_digest, n_bytes`; depths of a conversation from 1 without gaps). `convs`
    names every conversation, with turns or without.

    Columns: `conv_id` (the smallest member, which with `depth` names the node),
    `depth`, `parent_conv_id`, `n_convs`, `n_children`, `n_leaves`,
    `saved_tokens`, `ends_sha256`.
    """
    turn = F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("turn_digest"))
    lanes = _lanes(turn)
    hashed = rebuilt.select("conv_id", "depth", "n_bytes", *[c.alias(f"own_{n}") for c, n in zip(lanes, LANES, strict=True)])
    steps = written(
        running(
            hashed, ["conv_id"], ["depth"], {n: (XOR, F.col(f"own_{n}")) for n in LANES}, f"{path}/steps"
        ),
        f"{path}/prefixes",
    )
    zero = [F.lit(0).cast("bigint").alias(n) for n in LANES]
    named = (
        steps.groupBy("depth", *LANES)
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.min("n_bytes").alias("n_bytes"),
            *[F.min(f"own_{n}").alias(f"own_{n}") for n in LANES],
        )
        .select(
            "depth", *LANES, "conv_id", "n_convs", "n_bytes",
            *[F.col(n).bitwiseXOR(F.col(f"own_{n}")).alias(f"up_{n}") for n in LANES],
        )
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where(
        "n_convs > 0"
    ).select(
        F.lit(0).cast("bigint").alias("depth"), *zero, "conv_id", "n_convs", F.lit(0).cast("bigint").alias("n_bytes"),
        *[F.lit(None).cast("bigint").alias(f"up_{n}") for n in LANES],
    )
    numbered = written(
        running(
            named.unionByName(root), [], ["depth", "conv_id"], {"id": (SUM, F.lit(1).cast("bigint"))}, f"{path}/named"
        ),
        f"{path}/numbered",
    )
    above = numbered.select(
        (F.col("depth") + 1).alias("depth"),
        *[F.col(n).alias(f"up_{n}") for n in LANES],
        F.col("id").alias("parent"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    linked = numbered.join(above, ["depth", *[f"up_{n}" for n in LANES]], "left").drop(*[f"up_{n}" for n in LANES])
    linked = written(linked, f"{path}/linked")
    counts = linked.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(
        linked.join(counts, "id", "left").fillna(0, ["n_children"]), f"{path}/nodes"
    )

    places = list_rank(_tour(nodes, nodes.count()), f"{path}/tour", few)
    worth = nodes.select(
        (F.col("id") * 2).alias("at"),
        (F.col("n_children") == 0).cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
    )
    arcs = places.join(worth, "at", "left").fillna(0, ["leaf", "saved"])
    totals = running(
        arcs, [], ["pos"], {"leaves": (SUM, F.col("leaf")), "saving": (SUM, F.col("saved"))}, f"{path}/arcs"
    )
    # What was added between entering and leaving a node, its own part included.
    sign = F.when(F.col("at") % 2 == 1, 1).otherwise(-1)
    below = totals.groupBy(F.floor(F.col("at") / 2).cast("bigint").alias("id")).agg(
        F.sum(sign * F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        F.sum(sign * F.col("saving") + F.col("saved")).alias("saved_tokens"),
    )

    length = steps.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    last = steps.join(length, ["conv_id", "depth"]).select("depth", *LANES, "conv_id")
    turnless = convs.join(length, "conv_id", "left_anti").select(
        F.lit(0).cast("bigint").alias("depth"), *zero, "conv_id"
    )
    ends = _ends(last.unionByName(turnless))
    return (
        nodes.join(below, "id")
        .join(ends, ["depth", *LANES], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )


def prefix_trie(conversations: DataFrame, few: int = FEW) -> DataFrame:
    """The trie of the conversations as rebuilt by the contract of the query:
    conversation c begins with the first h turns of conversation c - c % 5,
    where h is the crc32 of its number modulo 9."""
    path = shared_dir(conversations.sparkSession)
    placed = written(turns(conversations, f"{path}/turns"), f"{path}/placed")
    convs = written(placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), f"{path}/convs")
    c = F.col("conv_id")
    rebuilt = grafted(placed, convs, c - c % 5, F.crc32(c.cast("string")) % 9, 8)
    return trie(written(rebuilt, f"{path}/rebuilt"), convs, f"{path}/trie", few)


def shared_prefixes(conversations: DataFrame, few: int = FEW) -> DataFrame:
    """The trie of the conversations as they are."""
    path = shared_dir(conversations.sparkSession)
    placed = written(turns(conversations, f"{path}/turns"), f"{path}/placed")
    convs = written(placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), f"{path}/convs")
    return trie(placed, convs, f"{path}/trie", few)
