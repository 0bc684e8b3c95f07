"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies in the mix. Of all
rates that bring each source to its token target, entropy balancing takes those
nearest to one copy of each: minimise the sum of `w log w - w` over the
documents, subject to `sum(w * tokens) = target` for each source and `w <= cap`.
The dual is convex, with one multiplier per source, and gives exponentially
tilted rates, `w = min(cap, exp(lambda * tokens / mean tokens))`. With
`unit="token"` the entropy is summed over tokens instead of documents, and all
documents of a source get one rate.

The multipliers come from Newton steps, each one aggregation of gradient and
curvature over a table of `(source, size)` cells; it is joined to the table of
multipliers, and only the number of sources that have not converged comes back
to the driver. Steps are kept inside a bracket, so that the cap's kinks and far
targets cannot throw them off.

Rates become whole copies by their integer part, and one more where a hash of
id, text and occurrence falls below the fraction. The cut of that comparison is then moved,
per source, so that the words taken come as near to the target as whole
documents allow: once over all documents, then over ever shorter ones for the
rest. Cuts are read off at most 1,024 sums a source.

Only DataFrame operations. What is broadcast is the table of sources, by its
measured size. The one task that ranks sources reads a row for each source.

Defined results: a null source is a source of its own, last in order. A null or
empty text has size 0 and takes 0 words. Rows that repeat an id, or have none, are
rounded each by its own draw. A source whose documents are all empty has
target 0. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.store import shared_dir, written

WORD = r"[^\x20\x09-\x0D]+"
MAX_STEPS = 60
TOLERANCE = 1e-6
BUCKETS = 1024
PASSES = 3
# Rows that agree in everything are dealt out again in blocks of so many.
REPEATS = 10_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")


def source_targets(
    sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """`k, source, source_size, target`: `share` of all sizes dealt by weight,
    where no target is above `cap` times its source's size and what is above is
    dealt again. The level that fills the sources is found by their order of
    room per weight: sources before it are full, the others share the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    sources = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("k", F.row_number().over(by_name).cast("bigint"))
        .withColumn("weight", pattern[((F.col("k") - 1) % len(weights)).cast("int")])
        .withColumn("room", F.col("source_size") * F.lit(float(cap)))
    )
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("room") / F.col("weight"), "k")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(
        F.sum("room").over(before), F.lit(0.0)
    )) / F.sum("weight").over(rest)
    fits = F.when(F.col("level") <= F.col("room") / F.col("weight"), F.col("level"))
    return (
        sources.withColumn("level", level)
        .withColumn("level", F.min_by(fits, F.when(fits.isNotNull(), F.col("room") / F.col("weight"))).over(every))
        .withColumn(
            "target",
            F.coalesce(F.least("room", F.col("level") * F.col("weight")), F.col("room")),
        )
        .select("k", "source", "source_size", "n_docs", "target")
    )


def _tilt(unit: str) -> Column:
    """What the multiplier is multiplied with."""
    if unit == "token":
        return F.lit(1.0)
    mean = F.col("source_size") / F.col("n_docs")
    return F.when(mean > 0, F.col("size") / mean).otherwise(0.0)


def _rate(unit: str, cap: float) -> Column:
    tilted = F.least(F.exp(F.least(F.col("lam") * _tilt(unit), F.lit(50.0))), F.lit(cap))
    return (
        F.when(F.col("target") <= 0, 0.0)
        .when(F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), F.lit(cap))
        .otherwise(tilted)
    )


def balance(cells: DataFrame, sources: DataFrame, path: str, unit: str, cap: float) -> DataFrame:
    """Adds `lam` to the sources: Newton steps on the dual over
    `k, size, n` cells, each from the table that the last one wrote."""
    settled = (F.col("target") <= 0) | (
        F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    )
    state = written(
        sources.select(
            "*",
            F.lit(0.0).alias("lam"),
            F.lit(None).cast("double").alias("low"),
            F.lit(None).cast("double").alias("high"),
            settled.alias("done"),
        ).coalesce(1),
        f"{path}/step0",
    )
    rate, tilt = _rate(unit, cap), _tilt(unit)
    tokens = F.col("n") * F.col("size") * rate
    for step in range(1, MAX_STEPS + 1):
        if state.where(~F.col("done")).isEmpty():
            break
        sums = (
            cells.join(state.where(~F.col("done")), "k")
            .groupBy("k")
            .agg(
                F.sum(tokens).alias("got"),
                F.sum(F.when(rate < cap, tokens * tilt).otherwise(0.0)).alias("slope"),
            )
        )
        short = F.col("got") < F.col("target")
        off = F.abs(F.col("got") - F.col("target"))
        low = F.when(short, F.col("lam")).otherwise(F.col("low"))
        high = F.when(short, F.col("high")).otherwise(F.col("lam"))
        # The step of log(got) against log(target), which is nearly straight.
        newton = F.col("lam") + F.ln(F.col("target") / F.col("got")) * F.col("got") / F.col("slope")
        inside = (
            newton.isNotNull()
            & ~F.isnan(newton)
            & (F.col("low2").isNull() | (newton > F.col("low2")))
            & (F.col("high2").isNull() | (newton < F.col("high2")))
        )
        wide = F.when(F.col("low2").isNull(), F.col("lam") - 1 - F.abs("lam")).otherwise(
            F.col("lam") + 1 + F.abs("lam")
        )
        bisect = F.coalesce((F.col("low2") + F.col("high2")) / 2, wide)
        moved = (
            state.join(sums, "k", "left")
            .withColumn("low2", low)
            .withColumn("high2", high)
            .withColumn(
                "done2",
                F.col("done") | F.coalesce(off <= TOLERANCE * F.col("target"), F.lit(True)),
            )
        )
        state = written(
            moved.select(
                *sources.columns,
                F.when(F.col("done2"), F.col("lam"))
                .when(inside, newton)
                .otherwise(bisect)
                .alias("lam"),
                F.col("low2").alias("low"),
                F.col("high2").alias("high"),
                F.col("done2").alias("done"),
            ).coalesce(1),
            f"{path}/step{step}",
        )
    return state.drop("low", "high", "done")


def _cuts(rated: DataFrame, sources: DataFrame, path: str) -> DataFrame:
    """Adds `cuts` to the sources: which documents get one more copy.

    Each pass sums the candidates' words by bucket of `position - fraction` and
    takes the buckets up to the cut that stays within what is still short. The
    first pass looks at all documents, each later one at those no longer than
    the rest. The last takes the one size and bucket that brings the sum nearest
    to the target, from either side.
    """
    none = F.expr("array(struct(1L as shortest, 0L as longest, 0 as first, 0 as cut))")
    state = sources.withColumn("cuts", none)
    have = rated.groupBy("k").agg(F.sum(F.col("size") * F.col("whole")).alias("whole_tokens"))
    state = written(
        state.join(have, "k", "left").withColumn(
            "rest", F.col("target") - F.coalesce("whole_tokens", F.lit(0))
        ).coalesce(1),
        f"{path}/cut1",
    )
    for n in range(PASSES + 1):
        nearest = n == PASSES
        longest = F.floor(F.greatest("rest", F.lit(0.0))).cast("bigint")
        candidates = rated.join(state.select("k", "cuts", "rest"), "k").where(
            F.col("open") & ~extra(F.col("cuts")) & (F.col("size") <= longest * (2 if nearest else 1))
        )
        if nearest:
            off = F.abs(F.col("rest") - F.col("tokens"))
            best = (
                candidates.groupBy("k", "size", "bucket")
                .agg(F.sum("size").alias("tokens"), F.first("rest").alias("rest"))
                .where(off < F.col("rest"))
                .groupBy("k")
                .agg(F.min(F.struct(off.alias("off"), "size", "bucket", "tokens")).alias("b"))
                .select(
                    "k",
                    F.struct(
                        F.col("b.size").alias("shortest"),
                        F.col("b.size").alias("longest"),
                        F.col("b.bucket").alias("first"),
                        (F.col("b.bucket") + 1).alias("cut"),
                    ).alias("more"),
                    F.col("b.tokens").alias("gained"),
                )
            )
        else:
            sums = candidates.groupBy("k", "bucket").agg(
                F.sum("size").alias("tokens"), F.first("rest").alias("rest")
            )
            running = F.sum("tokens").over(Window.partitionBy("k").orderBy("bucket"))
            best = (
                sums.withColumn("running", running)
                .where(F.col("running") <= F.col("rest"))
                .groupBy("k")
                .agg(
                    F.max("bucket").alias("last"),
                    F.max("running").alias("gained"),
                    F.first("rest").alias("was"),
                )
                .select(
                    "k",
                    F.struct(
                        F.lit(0).cast("bigint").alias("shortest"),
                        F.floor("was").cast("bigint").alias("longest"),
                        F.lit(0).alias("first"),
                        (F.col("last") + 1).alias("cut"),
                    ).alias("more"),
                    "gained",
                )
            )
        state = written(
            state.join(best, "k", "left")
            .select(
                *[c for c in state.columns if c not in ("cuts", "rest")],
                F.when(F.col("more").isNotNull(), F.array_append("cuts", F.col("more")))
                .otherwise(F.col("cuts"))
                .alias("cuts"),
                (F.col("rest") - F.coalesce("gained", F.lit(0))).alias("rest"),
            )
            .coalesce(1),
            f"{path}/cut{n + 2}",
        )
    return state


def extra(cuts: Column) -> Column:
    return F.exists(
        cuts,
        lambda c: F.col("size").between(c["shortest"], c["longest"])
        & (F.col("bucket") >= c["first"])
        & (F.col("bucket") < c["cut"]),
    )


def _numbered(docs: DataFrame) -> DataFrame:
    """`doc_id, source, size, draw`: the draw is a hash of id and size. For rows
    without an id, and from the second of rows that agree in everything, it
    takes in the text and a number, so that the rounding of copies is spread
    over them too. Such rows cannot be told apart; they are counted, and dealt
    out again in blocks."""
    same = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64(F.col("text").cast("string")).alias("body"),
    ).groupBy("doc_id", "source", "size", "body").agg(F.count(F.lit(1)).alias("n"))
    blocks = same.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / REPEATS))).alias("block"))
    first = F.col("block") * REPEATS + 1
    each = blocks.select(
        "*", F.explode(F.sequence(first, F.least(F.col("n"), first + (REPEATS - 1)))).alias("nth")
    )
    named = F.col("doc_id").isNotNull() & (F.col("nth") == 1)
    draw = F.when(named, F.xxhash64("doc_id", "size")).otherwise(F.xxhash64("doc_id", "size", "body", "nth"))
    return each.select("doc_id", "source", "size", draw.alias("draw"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    unit: str = "document",
) -> DataFrame:
    """One row per document: `doc_id, size, source_size, target, taken, copies,
    rate`, where `taken = copies * size`."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    sized = written(_numbered(docs), f"{path}/sized")
    sources = written(
        source_targets(sized, weights, share, float(cap)).coalesce(1), f"{path}/sources"
    )
    same = F.col("s.source").eqNullSafe(F.col("d.source"))
    keyed = sized.alias("d").join(sources.select("k", "source").alias("s"), same).select(
        "doc_id", "k", "size", "draw"
    )
    cells = written(
        keyed.groupBy("k", "size").agg(F.count(F.lit(1)).alias("n")), f"{path}/cells"
    )
    solved = balance(cells, sources.drop("source"), path, unit, float(cap))
    position = F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53))
    rated = (
        keyed.join(solved, "k")
        .withColumn("rate", _rate(unit, float(cap)))
        .withColumn("whole", F.floor("rate"))
        .withColumn("part", F.col("rate") - F.col("whole"))
        .withColumn("bucket", F.floor((position - F.col("part") + 1) * (BUCKETS / 2)).cast("int"))
        .withColumn("open", F.col("part") > 0)
        .select("doc_id", "k", "size", "rate", "whole", "bucket", "open")
    )
    cuts = _cuts(rated, solved, path)
    copies = F.col("whole") + F.when(F.col("open") & extra(F.col("cuts")), 1).otherwise(0)
    return rated.join(cuts.select("k", "source_size", "target", "cuts"), "k").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (copies * F.col("size")).cast("bigint").alias("taken"),
        copies.cast("bigint").alias("copies"),
        "rate",
    )
