import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answers as A
from corpusloom.operators import chunking as C
from corpusloom.operators import embedding as E
from corpusloom.operators import lexical as L
from corpusloom.operators import retrieval as R
from corpusloom.operators import scoring
from corpusloom.operators import topics as T
from corpusloom.sources.index_store import IndexStore

DOCS = [
    (1, "cats purr and cats nap in the sun", "a"),
    (2, "rockets burn fuel in space", "b"),
    (3, "the sun is a star in space", "a"),
    (4, "dogs bark at cats", "c"),
    (5, "", "d"),
    (6, "fuel fuel fuel", None),
]
QUERIES = [(10, "cats in the sun"), (11, "fuel fuel space"), (12, "zebra"), (13, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string, source string").cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id bigint, query string")


def bm25_plainly(query, texts, k1=1.5, b=0.75, eps=0.25):
    """Okapi BM25 from its formula."""
    bags = [Counter(t.lower().split()) for t in texts]
    n, sizes = len(texts), [sum(bag.values()) for bag in bags]
    mean = sum(sizes) / n
    df = Counter(w for bag in bags for w in bag)
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = eps * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    return [
        sum(
            idf.get(w, 0) * bag[w] * (k1 + 1) / (bag[w] + k1 * (1 - b + b * size / mean))
            for w in query.lower().split()
        )
        for bag, size in zip(bags, sizes)
    ]


def test_bm25_equals_formula(queries, docs):
    rows = R.bm25_topk(queries, docs, k=6).collect()
    for qid, q in QUERIES:
        want = bm25_plainly(q, [d[1] for d in DOCS])
        got = {r.doc_id: r.score for r in rows if r.query_id == qid}
        assert len(got) == 6
        for (doc_id, *_), score in zip(DOCS, want):
            assert abs(got[doc_id] - score) < 1e-6
        ranks = sorted((r for r in rows if r.query_id == qid), key=lambda r: r["rank"])
        assert [(-r.score, r.doc_id) for r in ranks] == sorted((-r.score, r.doc_id) for r in ranks)


def test_blocks_give_the_same_hits(spark, queries, docs, monkeypatch):
    whole = {tuple(r) for r in R.bm25_topk(queries, docs, k=3).collect()}
    split = scoring.collect_blocks
    monkeypatch.setattr(R, "collect_blocks", lambda df, key: split(df, key, block=1))
    assert {tuple(r) for r in R.bm25_topk(queries, docs, k=3).collect()} == whole


def test_two_level_merge_gives_the_same_hits(queries, docs, monkeypatch):
    spread = docs.repartition(6)
    whole = {tuple(r) for r in R.bm25_topk(queries, spread, k=2).collect()}
    monkeypatch.setattr(scoring, "MERGE_TASKS", -1)
    assert {tuple(r) for r in R.bm25_topk(queries, spread, k=2).collect()} == whole


def test_small_steps_give_the_same_hits(queries, docs):
    # Two rows per step: the running best has to survive many merges.
    whole = {tuple(r) for r in R.tfidf_topk(queries, docs, k=2).collect()}
    old = scoring.CELLS_PER_STEP
    try:
        scoring.CELLS_PER_STEP = 8
        assert {tuple(r) for r in R.tfidf_topk(queries, docs, k=2).collect()} == whole
    finally:
        scoring.CELLS_PER_STEP = old


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_vector_topk_equals_numpy(spark, metric):
    rng = np.random.default_rng(5)
    corpus, asked = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    c = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(corpus)] + [(999, None)], "chunk_id bigint, embedding array<double>"
    ).repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, embedding array<double>")
    rows = R.vector_topk(q, c, 4, metric).collect()
    for i, v in enumerate(asked):
        if metric == "l2":
            score = ((corpus - v) ** 2).sum(1)
            best = np.argsort(score)[:4]
        else:
            score = corpus @ v / np.linalg.norm(corpus, axis=1) / np.linalg.norm(v)
            best = np.argsort(-score)[:4]
        mine = sorted((r for r in rows if r.query_id == i), key=lambda r: r["rank"])
        assert [r.chunk_id for r in mine] == best.tolist()
        assert np.allclose([r.score for r in mine], score[best], atol=1e-6)
    with pytest.raises(ValueError):
        R.vector_topk(q, c, 4, "hamming")


def test_hybrid_scores_every_document(queries, docs):
    rows = R.hybrid_topk(queries, docs, {"vector": 0.5, "tfidf": 0.2, "bm25": 0.3}, 6, dim=32).collect()
    assert Counter(r.query_id for r in rows) == {q: 6 for q, _ in QUERIES}
    best = [r for r in rows if r.query_id == 10 and r["rank"] == 1]
    assert best[0].doc_id == 1
    # Nothing matches the empty query, so its raw scores are all zero.
    assert {(r.score, r.vector) for r in rows if r.query_id == 13} == {(0.0, 0.0)}
    with pytest.raises(ValueError):
        R.hybrid_topk(queries, docs, {"magic": 1.0})
    with pytest.raises(ValueError):
        R.hybrid_topk(queries, docs, {"lda": 1.0})


def test_weights_are_rescaled_without_a_method():
    left = R.available_weights({"vector": 0.4, "tfidf": 0.3, "lda": 0.2, "bm25": 0.1}, ["bm25"])
    assert left == pytest.approx({"vector": 4 / 9, "tfidf": 3 / 9, "lda": 2 / 9})


def test_rerank_orders_cuts_and_keeps_ties(spark):
    rows = [
        (1, "red fox", 1, 11, "a blue fox"),
        (1, "red fox", 2, 12, "nothing"),
        (1, "red fox", 3, 13, "the red fox"),
        (1, "red fox", 4, 14, "red red"),
        (1, "red fox", 5, 15, "red fox again"),
    ]
    cand = spark.createDataFrame(rows, "query_id int, query string, rank int, chunk_id bigint, content string")
    got = R.rerank(cand, 3, fetch_k=4).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [(13, 1.0), (11, 0.5), (14, 0.5)]
    assert R.rerank(cand.limit(0), 3).count() == 0


@pytest.fixture(scope="module")
def index(docs):
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source")
    return E.embed(chunks, "content", "embedding", E.hashed_embedder(64))


def test_search_shapes_and_k(spark, index):
    q = spark.createDataFrame([(1, "cats nap", 1), (2, "space fuel", 0), (3, "sun", None)], "query_id int, query string, top_k int")
    emb = E.hashed_embedder(64)
    plain = R.search(q, index, embedder=emb, store_top_k=2)
    assert plain.columns == ["query_id", "rank", "chunk_id", "content", "source", "score", "score_kind", "metadata"]
    assert Counter(r.query_id for r in plain.collect()) == {1: 1, 2: 2, 3: 2}
    again = R.search(q, index, rerank_enabled=True, embedder=emb, store_top_k=2, rerank_top_k=3).collect()
    assert Counter(r.query_id for r in again) == {1: 1, 2: 3, 3: 3}
    assert {r.score_kind for r in again} == {"relevance"}
    top = [r for r in again if r.query_id == 1][0]
    assert top.chunk_id == 1 and top.score == 1.0


def test_duplicate_chunks_do_not_multiply(spark, index):
    q = spark.createDataFrame([(1, "cats nap")], "query_id int, query string")
    rows = R.search(q, index.unionByName(index), top_k=4, embedder=E.hashed_embedder(64)).collect()
    assert sorted(r["rank"] for r in rows) == [1, 2, 3, 4]
    assert len({r.chunk_id for r in rows}) == 2


def test_documents_to_answers(spark, tmp_path):
    """Chunk, embed, store, load and search, with the defaults throughout."""
    docs = spark.createDataFrame(
        [(1, "Cats purr. Cats nap in the sun.", "cats.txt"), (2, "Rockets burn fuel. Rockets fly.", "rockets.txt")],
        "doc_id bigint, text string, source string",
    )
    chunks = C.semantic_chunks(docs).selectExpr("xxhash64(doc_id, chunk_no) AS chunk_id", "*")
    store = IndexStore(spark, str(tmp_path / "index"))
    store.append(E.embed(chunks))
    q = spark.createDataFrame([(7, "Rockets fly. Why?")], "query_id int, query string")
    hits = R.search(q, store.load(), top_k=1, rerank_enabled=True)
    row = hits.first()
    assert row.source == "rockets.txt" and row.score_kind == "relevance"
    prompt = A.prompts(q, hits).first().prompt
    assert "source:rockets.txt" in prompt and prompt.endswith("Question: Rockets fly. Why?\n\nHelpful Answer:")


def test_model_embedder_and_providers(spark, docs):
    made = E.create_embedder("model", load=lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    rows = E.embed(docs, "text", "v", made).collect()
    assert {r.doc_id: r.v for r in rows}[6] == [14.0, 1.0]
    with pytest.raises(ValueError):
        E.create_embedder("nowhere")


def test_tfidf_vocabulary_bounds(spark, docs):
    rows = {r.term: r for r in L.tfidf_vocabulary(docs).collect()}
    assert set(rows) == {"cats", "fuel", "space", "sun"}
    assert rows["fuel"].cf == 4 and rows["fuel"].df == 2
    assert rows["fuel"].idf == pytest.approx(math.log(7 / 3) + 1)
    assert {r.term for r in L.tfidf_vocabulary(docs, max_features=2).collect()} == {"fuel", "cats"}


# --- answers --------------------------------------------------------------


def test_prompt(spark):
    q = spark.createDataFrame([(1, "Why?"), (2, "How?")], "query_id int, query string")
    hits = spark.createDataFrame([(1, 2, "two", "b"), (1, 1, "one", "a")], "query_id int, rank int, content string, source string")
    got = {r.query_id: r.prompt for r in A.prompts(q, hits).collect()}
    assert "Context: Context:\ncontent:one\nsource:a\n\nContext:\ncontent:two\nsource:b\n\nQuestion: Why?" in got[1]
    assert "Context: \n\nQuestion: How?" in got[2]


def test_grounding(spark):
    made = E.model_embedder(lambda: lambda ts: [{"x": [1.0, 0.0], "y": [0.0, 1.0]}.get(t, [1.0, 1.0]) for t in ts])
    answers = spark.createDataFrame([(1, "x"), (2, "x"), (3, ""), (4, "x"), (5, None)], "query_id int, answer string")
    sources = spark.createDataFrame([(1, "y"), (1, "x"), (2, "y"), (3, "x")], "query_id int, content string")
    got = {r.query_id: (r.is_hallucination, r.score) for r in A.grounding_check(answers, sources, embedder=made).collect()}
    assert got == {1: (False, 1.0), 2: (True, 0.0), 3: (None, None), 4: (None, None), 5: (None, None)}
    exact = A.grounding_check(answers, sources, threshold=1.0, embedder=made).collect()
    assert {r.query_id: r.is_hallucination for r in exact}[1] is False
    with pytest.raises(NotImplementedError):
        A.grounding_check(answers, sources, method="judge")


def test_fallback_keeps_sources(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id int, query string")
    ans = spark.createDataFrame([(1, "yes", None), (2, None, "quota")], "query_id int, answer string, error string")
    src = spark.createDataFrame([(2, 1, "text", "s")], "query_id int, rank int, content string, source string")
    checks = spark.createDataFrame([(1, None, None, "m")], "query_id int, is_hallucination boolean, score double, method string")
    got = {r.query_id: r for r in A.answers_with_fallback(q, ans, src, checks).collect()}
    assert (got[1].result, got[1].error) == ("yes", None)
    assert (got[2].result, got[2].error) == ("I don't know", "quota") and len(got[2].source_documents) == 1
    assert (got[3].result, got[3].error) == ("I don't know", "no answer")


# --- topics ---------------------------------------------------------------


def test_topics(spark, tmp_path):
    words = ["rocket fuel engine launch orbit".split(), "cats purring whisker kitten paws".split()]
    rows = [(i, " ".join(words[i % 2][j] for j in (i % 5, (i + 1) % 5, (i + 2) % 5))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = T.cached_topics(df, str(tmp_path), num_topics=2)
    vecs = [r.lda for r in T.with_topics(model, df).collect()]
    assert all(len(v) == 2 and abs(sum(v) - 1) < 1e-9 for v in vecs)
    again = T.cached_topics(df, str(tmp_path), num_topics=2)
    assert [r.lda for r in T.with_topics(again, df).orderBy("doc_id").collect()] == [
        r.lda for r in T.with_topics(model, df).orderBy("doc_id").collect()
    ]
    assert len(list((tmp_path / "topics").iterdir())) == 1
    T.cached_topics(df.limit(19), str(tmp_path), num_topics=2)
    assert len(list((tmp_path / "topics").iterdir())) == 2
    with pytest.raises(ValueError):
        T.fit_topics(df.limit(4))
    table = T.cached_table(df, str(tmp_path), "vocabulary", T.topic_vocabulary)
    assert table.count() > 0


def test_topics_see_the_corpus_and_not_its_partitions(spark):
    assert T.fit_iterations(10) * T.SAMPLE_RATE >= 10
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    vectors = []
    for parts in (2, 8):
        model = T.fit_topics(docs.repartition(parts))
        rows = T.with_topics(model, docs).select("doc_id", "lda").collect()
        vectors.append({r.doc_id: [round(x, 6) for x in r.lda] for r in rows})
    assert vectors[0] == vectors[1] and len(vectors[0]) == docs.count()
    terms = {r.term for r in T.topic_vocabulary(docs).collect()}
    assert set(model.stages[0].vocabulary) == terms


def test_empty_query_batch_has_no_hits(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id bigint, embedding array<double>")
    none = spark.createDataFrame([], "query_id bigint, embedding array<double>")
    for metric in ("l2", "cosine"):
        assert R.vector_topk(none, index, 3, metric).collect() == []


def test_more_queries_than_a_block_meet_stored_vectors_once(spark, monkeypatch):
    """One plan, whatever the number of queries; lengths, ties and nulls included."""
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 4, (300, 5)) * rng.integers(0, 9, (300, 1))
    index = spark.createDataFrame(
        [(i, [float(x) for x in r] if i % 50 else None) for i, r in enumerate(rows)],
        "chunk_id bigint, embedding array<double>",
    )
    queries = index.select(F.col("chunk_id").alias("query_id"), "embedding").where("query_id < 70")
    for metric in ("l2", "cosine"):
        want = R.vector_topk(queries, index, 4, metric).collect()
        monkeypatch.setattr(R, "QUERY_BLOCK", 20)
        monkeypatch.setattr(scoring, "GROUP", 60)
        got = R.vector_topk(queries, index, 4, metric)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        monkeypatch.undo()
        assert sorted(got.collect()) == sorted(want) and len(want) == 68 * 4
        assert "Union" not in plan


def test_best_pairs_skip_only_what_cannot_be_among_the_best(monkeypatch):
    monkeypatch.setattr(scoring, "GROUP_VECTORS", 7)
    monkeypatch.setattr(scoring, "GROUP_QUERIES", 5)
    rng = np.random.default_rng(5)
    vectors = rng.integers(0, 5, (200, 3)) * rng.integers(0, 30, (200, 1)).astype(float)
    ids = rng.permutation(200)
    for metric in ("l2", "cosine"):
        q, v, score = scoring.best_pairs(vectors[:23], ids, vectors, metric, 6)
        full = scoring.round_half_up(scoring.dense_scores(vectors[:23], vectors, metric))
        for at in range(23):
            want = np.lexsort((ids, -full[at]))[:6]
            assert sorted(v[q == at]) == sorted(want)
            assert sorted(score[q == at]) == sorted(full[at][want])


def test_limited_vocabulary_counts_only_pairs_that_can_get_in(spark, monkeypatch):
    rng = np.random.default_rng(9)
    names = [f"w{i}" for i in range(30)]
    texts = [[names[i] for i in np.minimum(rng.geometric(0.15, 25) - 1, 29)] for _ in range(40)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    grams = [t + [" ".join(p) for p in zip(t, t[1:])] for t in texts]
    cf, seen = Counter(g for t in grams for g in t), Counter(g for t in grams for g in set(t))
    counted = []
    plainly = L._frequent_pairs
    monkeypatch.setattr(L, "_frequent_pairs", lambda *a: counted.append(len(a[2])) or plainly(*a))
    for most in (5, 12, 10_000):
        able = sorted((g for g in cf if 2 <= seen[g] <= 0.8 * 40), key=lambda g: (-cf[g], g))[:most]
        got = {r.term: (r.df, r.cf) for r in L.tfidf_vocabulary(df, max_features=most).collect()}
        assert got == {g: (seen[g], cf[g]) for g in able}
    # Without a full vocabulary every pair counts.
    assert len(counted) == 2 and counted[0] < counted[1] < 30


def test_pairs_of_words_are_found_by_number_in_bounded_steps(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    lists = [[f"w{i}" for i in rng.integers(0, 6, n)] for n in (0, 1, 9, 30, 2)] + [None]
    terms = pa.array(["w0", "w1 w2", "w2 w1", "w3 w3", "w5", "nowhere else"])
    grams = pa.array([t and t + [" ".join(p) for p in zip(t, t[1:])] for t in lists], pa.list_(pa.string()))
    want = scoring.term_pairs(grams, terms)
    batch = pa.record_batch([pa.array(lists, pa.list_(pa.string()))], ["words"])
    got = scoring.Grams(terms).pairs(batch.column(0))
    assert all(np.array_equal(a, b) for a, b in zip(want[:3], got[:3]))
    monkeypatch.setattr(scoring, "TOKENS_PER_STEP", 10)
    steps = [s.to_pydict()["words"] for s in scoring.bounded(batch, ["words"])]
    assert len(steps) > 2 and [x for s in steps for x in s] == lists
