"""Semantic chunks: bags and distances are not built by array functions per row."""

from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import chunking as C


def test_breaks_equal_dense_vectors(spark):
    words = "red blue green cold warm salt rain".split()
    texts = [
        " ".join(f"{words[(i * j) % 7]} {words[(i + j * j) % 7]}\nX{j % 3}{'.?!'[j % 3]}" for j in range(i))
        for i in range(40)
    ] + [None, "", "   ", ". . .", "One. \x1c Two\x85three! four"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for buffer, percent in ((1, 95.0), (0, 50.0), (2, 80.0)):
        got = C.semantic_chunks(docs, dim=16, percentile=percent, buffer=buffer)
        dense = lambda groups: F.transform(groups, lambda g: V.hashed_bag(g, 16))
        want = C.semantic_chunks(docs, dim=16, percentile=percent, buffer=buffer, group_embedder=dense)
        assert sorted(got.collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "MapInArrow" in plan
