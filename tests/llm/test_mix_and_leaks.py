from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, mixing
from tests.llm.cases import ROWS, no_docs, odd_docs, rows

SF = "/root/testdata/sf0.01"


def water_fill(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by dealing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= cap * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("unit", ["document", "token"])
def test_mix_meets_its_targets(spark, unit):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs, unit=unit).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    sizes = got.groupby("source")["size"].sum().to_dict()
    target = water_fill(sizes)
    assert (got["taken"] <= 2 * got["size"]).all() and len(got) == docs.count()
    for source, part in got.groupby("source"):
        assert part["target"].iloc[0] == pytest.approx(target[source])
        assert part["source_size"].iloc[0] == sizes[source]
        assert part["taken"].sum() == pytest.approx(target[source], rel=0.02)
        # The rates alone meet the target, before any rounding.
        assert (part["rate"] * part["size"]).sum() == pytest.approx(target[source], rel=1e-4)


def test_rates_are_an_exponential_tilt(spark):
    import numpy as np

    data = [(i, "w " * (1 + i % 37), "a" if i % 3 else "b") for i in range(600)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    got = mixing.mix(docs, weights=(1, 9), share=0.8).toPandas()
    part = got[(got["rate"] < 2) & (got["target"] < got["source_size"])]
    slope = np.log(part["rate"]) / part["size"]
    assert slope.max() == pytest.approx(slope.min()) and slope.max() < 0


def test_mix_is_the_same_again_and_in_other_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = rows(mixing.mix(docs), "doc_id", "taken")
    assert a == rows(mixing.mix(docs.repartition(7)), "doc_id", "taken")


def test_mix_odd_rows(spark):
    got = mixing.mix(odd_docs(spark)).toPandas()
    assert len(got) == len(ROWS) and (got["taken"] <= 2 * got["size"]).all()
    import re

    sizes = {}
    for _, text, _, source, _ in ROWS:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert sorted(set(got["target"].round(6))) == sorted({round(t, 6) for t in water_fill(sizes).values()})
    assert mixing.mix(no_docs(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert rows(mixing.mix(blank), "size", "target", "taken") == [(0, 0.0, 0)] * 2


def test_rows_without_ids_are_rounded_each(spark):
    import pandas as pd

    data = [(None, f"a b c d e f g h i {i}", "s") for i in range(1000)]
    data += [(None, "one two three four five", "t")] * 1000 + [(7, "x " * 300, "u")] * 90
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    got = pd.DataFrame(rows(mixing.mix(docs), "source_size", "target", "taken", "size"), columns=["s", "t", "n", "z"])
    assert len(got) == len(data)
    for _, part in got.groupby("s"):
        assert abs(part["n"].sum() - part["t"].iloc[0]) <= part["z"].max()
    again = rows(mixing.mix(docs.repartition(11)), "source_size", "target", "taken", "size")
    assert again == sorted(map(tuple, got.itertuples(index=False)), key=repr)


def test_masks_find_every_window_with_three_substitutions():
    def found(n, bad):
        return any(
            not any(p + o in bad for o in m) for m in decontaminate.MASKS for p in range(n - m[-1])
        )

    assert all(found(16, set(c)) for c in combinations(range(16), 3))
    # Shorter items allow for fewer substitutions, and those are found as well.
    for n in range(decontaminate.SPAN, 16):
        k = n - -(-8 * n // 10)
        share = sum(found(n, set(c)) for c in combinations(range(n), k)) / sum(
            1 for _ in combinations(range(n), k)
        )
        assert share >= 0.5, (n, k, share)


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"


def leak(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return rows(decontaminate.overlaps(docs, bench), "doc_id", "item_id", "best", "matched")


def test_overlaps_tolerate_substitutions(spark):
    words = ITEM.split()
    three = " ".join("x" if i in (2, 7, 12) else w for i, w in enumerate(words))
    six = " ".join("x" if i in (1, 4, 7, 10, 13, 15) else w for i, w in enumerate(words))
    texts = [f"before {ITEM.upper()}! after", f"a b {three}", six, " ".join(words[::-1]), None, "", ITEM[:30]]
    assert leak(spark, texts, [ITEM, None, ""]) == [(0, 0, 16, 17), (1, 0, 13, 14)]
    assert leak(spark, ["say hello to all of them", "hello to"], ["Hello to all"]) == [(0, 0, 3, 3)]


def test_long_items_and_repeated_words(spark):
    """Seeds of a long item come in pieces; a run of one word, on both sides,
    gives a row per diagonal and not one per pair of words."""
    draw = __import__("random").Random(5)
    words = [f"w{draw.randrange(9000)}" for _ in range(50_000)]
    words[700:708] = ["same"] * 8
    item = " ".join(words)
    texts = ["same " * 20_000, " ".join(words[10_000:11_000]), item, "other words " * 5000]
    got = leak(spark, texts, [item])
    assert got == [(1, 0, 16, 1000), (2, 0, 16, 50_000)]


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = rows(decontaminate.overlaps(docs, bench), "doc_id", "item_id", "best")
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", 1500)
    assert rows(decontaminate.overlaps(docs, bench), "doc_id", "item_id", "best") == whole


def test_clean_keeps_columns_and_odd_rows(spark):
    docs = odd_docs(spark)
    bench = spark.createDataFrame([(1, "cat sat on the mat and so on it went that day")], "item_id bigint, text string")
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    # Of the rows without an id, the one that overlaps goes.
    assert rows(kept, "doc_id", "text")[-1] == (None, None)
    assert rows(kept, "doc_id") == [(2,), (3,), (4,), (5,), (7,), (8,), (None,)]
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(ROWS)
    assert decontaminate.clean(no_docs(spark), bench).collect() == []
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(f"x {ITEM} y").alias("text"))
    found = decontaminate.overlaps(hot, spark.createDataFrame([(1, ITEM)], "item_id bigint, text string"))
    assert found.count() == 3000


def test_one_leak_takes_no_other_row_with_it(spark):
    data = [(None, f"x {ITEM} y"), (None, "clean words"), (None, None), (4, ITEM), (4, "clean too"), (5, "clean")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    kept = decontaminate.clean(docs, spark.createDataFrame([(1, ITEM)], "item_id bigint, text string"))
    assert {tuple(r) for r in kept.collect()} == {data[i] for i in (1, 2, 4, 5)}


def test_short_items_with_every_allowed_substitution(spark):
    for n in range(1, 12):
        k = n - -(-8 * n // 10)
        masks = decontaminate.short_masks(n, k)
        for bad in combinations(range(n), k):
            assert any(not set(m) & set(bad) for m in masks) or any(
                decontaminate.finds(m, n, bad) for m in decontaminate.MASKS
            )
    texts, items, want = [], [], []
    for n in (4, 5, 6, 7, 10, 11):
        words = [f"w{n}x{i}" for i in range(n)]
        k = n - -(-8 * n // 10)
        items.append(" ".join(words))
        for bad in combinations(range(n), k):
            want.append((len(texts), len(items) - 1, n - k, n - k))
            texts.append("a b " + " ".join("z" if i in bad else w for i, w in enumerate(words)) + " c")
        texts.append(" ".join("z" if i <= k else w for i, w in enumerate(words)))
    assert leak(spark, texts, items) == sorted(want, key=repr)
