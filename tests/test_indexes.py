"""Stored indexes: the same hits as reading everything, and less that is read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lexical as L
from corpusloom.operators import retrieval as R
from corpusloom.sources.tables import work_dir
from corpusloom.sources.term_index import TermIndex
from corpusloom.sources.vector_index import VectorIndex


def texts(n, seed=1):
    draw = random.Random(seed)
    common = [f"c{i}" for i in range(20)]
    rare = [f"r{i}" for i in range(400)]
    out = []
    for _ in range(n):
        words = draw.choices(common, k=draw.randint(0, 30)) + draw.choices(rare, k=draw.randint(0, 4))
        draw.shuffle(words)
        out.append(" ".join(words))
    return out


def hits(df, id_col="id"):
    return sorted(tuple(r) for r in df.select("query_id", "rank", id_col, F.round("score", 5)).collect())


QUERIES = ["c1 c2 r5", "r7 r7 r8", "c3", "r399 unknown", "unknown", "", None, "C1 r5 r6 r7 r8 r9"]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")


def test_term_index_equals_reading_everything(spark, asked):
    docs = spark.createDataFrame(list(enumerate(texts(600))), "doc_id long, text string")
    index = TermIndex(spark, work_dir(spark), parts=16, range_docs=32)
    index.append(docs.where("doc_id < 200"))
    index.remove(docs.where("doc_id < 50"))
    index.append(docs.where("doc_id >= 200"))
    index.append(docs.where("doc_id < 20"))
    live = docs.where("doc_id < 20 or doc_id >= 50")
    for k in (1, 7):
        want = hits(R.bm25_topk(asked.where("query is not null"), live, k), "doc_id")
        for lead in (1, 50):
            found = hits(index.search(asked, k, lead))
            assert [x for x in found if x[0] != 6] == want
            # A null query has no words: the least ids, as for an empty one.
            assert [x[1:] for x in found if x[0] == 6] == [x[1:] for x in found if x[0] == 5]
    columns = ["term", "df", "cf", F.round("idf", 9), F.round("avgdl", 9)]
    stats = sorted(map(tuple, L.bm25_stats(live).select(*columns).collect()))
    assert sorted(map(tuple, index.stats().select(*columns).collect())) == stats


def test_term_index_reads_matching_folders_and_ranges(spark):
    data = [(i, "common words here " + ("needle " * 3 if i in (5, 900) else f"w{i % 50}")) for i in range(2000)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    index = TermIndex(spark, work_dir(spark), parts=32, range_docs=64)
    index.append(docs)
    asked = spark.createDataFrame([(0, "needle common")], "query_id long, query string")
    assert [r["id"] for r in index.search(asked, 2).collect()] == [5, 900]
    parts = {r[0] for r in asked.select(F.explode(F.split("query", " ")).alias("term")).select(index._part()).collect()}
    of = lambda df: df.select(F.input_file_name()).distinct().count()
    assert 0 < of(index._postings(sorted(parts))) <= 2 < of(spark.read.parquet(f"{index.path}/postings"))
    plan = index._postings(sorted(parts))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part#" in plan.split("PartitionFilters")[1]
    # Beyond the two ranges with the needle nothing reaches the second score.
    scored = []
    inner = index._scored
    index._scored = lambda ranges, *rest: scored.append(ranges.count()) or inner(ranges, *rest)
    index.search(asked, 2, lead=2).collect()
    assert scored == [2, 0]


def test_term_index_without_documents(spark, asked):
    index = TermIndex(spark, work_dir(spark))
    index.append(spark.createDataFrame([], "doc_id long, text string"))
    assert index.search(asked).collect() == [] and index.stats().collect() == []
    # What an unfinished batch leaves behind is not read.
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "d e f")], "doc_id long, text string")
    index._commit, done = lambda *_: None, index._commit
    index.append(docs)
    assert index.stats().collect() == []
    index._commit = done
    index.append(docs)
    assert {r["term"] for r in index.stats().collect()} == set("abdef")


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_vector_index_equals_reading_everything(spark, metric):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 16)) * 8
    rows = [(i, (centres[i % 12] + draw.normal(size=16)).tolist()) for i in range(900)]
    rows += [(900 + i, rows[i][1]) for i in range(30)] + [(2000, [0.0] * 16), (2001, None)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(6)
    asked = spark.createDataFrame(
        [(q, (centres[q % 12] + draw.normal(size=16)).tolist()) for q in range(15)] + [(50, [0.0] * 16), (51, None)],
        "query_id long, embedding array<double>",
    )
    index = VectorIndex(spark, work_dir(spark), metric)
    index.build(vectors, clusters=24)
    want = hits(R.vector_topk(asked, vectors, 6, metric), "chunk_id")
    for lead in (1, 3):
        assert hits(index.search(asked, 6, lead=lead)) == want
    # A query near a centre leaves most folders unread.
    reads = []
    inner = index._hits
    index._hits = lambda a, pairs, k: reads.append(pairs.select("cluster").distinct().count()) or inner(a, pairs, k)
    index.search(asked.where("query_id = 3"), 6, lead=1).collect()
    assert sum(reads) <= 12


def test_vector_index_in_small_groups(spark, monkeypatch):
    from corpusloom.sources import vector_index

    monkeypatch.setattr(vector_index, "GROUP", 7)
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(100)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    asked = vectors.where("chunk_id < 20").withColumnRenamed("chunk_id", "query_id")
    index = VectorIndex(spark, work_dir(spark))
    index.build(vectors, clusters=3)
    assert hits(index.search(asked, 5)) == hits(R.vector_topk(asked, vectors, 5), "chunk_id")


def test_vector_index_without_vectors(spark):
    empty = spark.createDataFrame([], "chunk_id long, embedding array<double>")
    index = VectorIndex(spark, work_dir(spark))
    index.build(empty)
    assert index.search(spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")).collect() == []
    with pytest.raises(ValueError):
        VectorIndex(spark, "x", "dot")


def test_features_replace_the_text(spark):
    from corpusloom.sources.feature_table import FeatureTable

    docs = spark.createDataFrame(list(enumerate(texts(200, 5))), "doc_id long, text string")
    asked = spark.createDataFrame([(0, "c1 c2 r5 r6"), (1, "r7"), (2, "")], "query_id long, query string")
    weights = {"vector": 0.5, "tfidf": 0.2, "bm25": 0.3}
    table = FeatureTable(spark, work_dir(spark), 32)
    table.build(docs)
    found = table.search(asked, weights, 6)
    assert hits(found) == hits(R.hybrid_topk(asked, docs, weights, 6, dim=32), "doc_id")
    assert "text" not in table.features().columns
    less = table.search(asked, weights, 6, missing=("bm25",))
    scaled = {"vector": 0.5 / 0.7, "tfidf": 0.2 / 0.7}
    assert hits(less) == hits(R.hybrid_topk(asked, docs, scaled, 6, dim=32), "doc_id")
    content = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    best = table.reranked(asked, weights, content, 3)
    assert best.groupBy("query_id").count().where("count <> 3").count() == 0
    order = [tuple(r) for r in best.orderBy("query_id", "rank").select("query_id", "score", "first_rank").collect()]
    assert order == sorted(order, key=lambda r: (r[0], -r[1], r[2]))


def test_search_returns_metadata(spark):
    index = spark.createDataFrame(
        [(1, "cats", "a.txt", [1.0, 0.0], "en", 7), (2, "dogs", "b.txt", [0.0, 1.0], "fr", 9)],
        "chunk_id long, content string, source string, embedding array<double>, language string, start_line int",
    )
    asked = spark.createDataFrame([(0, "cats")], "query_id long, query string")
    fixed = lambda text: F.array(F.lit(1.0), F.lit(0.0))
    for rerank in (False, True):
        got = R.search(asked, index, top_k=2, rerank_enabled=rerank, embedder=fixed).orderBy("rank").collect()
        assert [(r.content, r.metadata.language, r.metadata.start_line) for r in got] == [("cats", "en", 7), ("dogs", "fr", 9)]
    plain = index.select("chunk_id", "content", "source", "embedding")
    assert R.search(asked, plain, embedder=fixed).count() == 2
