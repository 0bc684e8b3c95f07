import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import crf, language_id as L
from tests.llm.cases import ROWS, no_docs, odd_docs, rows
from tests.llm.test_dedup_tokens_warc import SPACE
from tests.llm.test_jaccard import shingles

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    model = crf.Model.blank(["a", "b", "c"], np.zeros(0, np.uint64), np.zeros((0, 3), np.float32))
    model.start[:] = rng.normal(size=3)
    model.move[:] = rng.normal(size=(3, 3))
    words = crf.words_of(["one two three four. five six\nseven", "eight", "nine ten"])
    assert np.diff(words.sentence).tolist() == [0, 0, 0, 1, 0, 1, 1, 1, 0]
    score = rng.normal(size=(len(words.size), 3)).astype(np.float32)
    chains = crf._chains(words)
    prob, pairs = crf.forward_backward(model, score, chains, pairs=True)
    expected = np.zeros((3, 3))
    for s in np.unique(words.sentence):
        at = np.flatnonzero(words.sentence == s)
        total, single = 0.0, np.zeros((len(at), 3))
        double = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=len(at)):
            w = model.start[path[0]] + sum(score[i, y] for i, y in zip(at, path, strict=True))
            w = np.exp(w + sum(model.move[x, y] for x, y in itertools.pairwise(path)))
            total += w
            for i, y in enumerate(path):
                single[i, y] += w
            for x, y in itertools.pairwise(path):
                double[x, y] += w
        assert prob[at] == pytest.approx(single / total, rel=1e-4)
        expected += double / total
    assert pairs == pytest.approx(expected, rel=1e-4)


def test_words_and_features():
    words = crf.words_of(["Été d'or", "", "42", "\U00010400x y"])
    assert words.size.tolist() == [3, 1, 2, 2, 1] and words.text.tolist() == [0, 0, 0, 3, 3]
    found, of = crf.features(words)
    # Bigrams and trigrams with two end marks, and both affixes of three letters.
    assert np.bincount(of).tolist() == [4 + 3 + 2, 2 + 1, 3 + 2, 3 + 2, 2 + 1]
    assert crf.features(crf.words_of(["", "1"]))[0].size == 0
    long = crf.words_of(["ab " * 100_000])
    assert len(long.size) == 100_000


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(L.held_out(F.col("doc_id")))
    found = L.identify(docs, model).join(docs, "doc_id")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 250 and right > 0.97
    ids = [r["doc_id"] for r in docs.collect()]
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in ids)


def test_switching_text_is_labelled_by_word(spark, model):
    text = "The ontion of the and. Der keitung und die chlich ist. Le eauoi des tion et la"
    got = L.label_words(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).first()
    lang = {w["word"]: w["lang"] for w in got["words"]}
    assert (lang["the"], lang["keitung"], lang["eauoi"]) == ("en", "de", "fr")
    assert all(0 <= w["p"] <= 1 for w in got["words"])


def test_held_out_documents_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lied = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    a, b = L.fit(docs, 20), L.fit(lied.repartition(5), 20)
    assert a.labels == b.labels and np.array_equal(a.flat(), b.flat())


def test_odd_rows(spark, model):
    got = {r["doc_id"]: r for r in L.identify(odd_docs(spark).where("doc_id <> 6"), model).collect()}
    for i in (2, 3, 4, 7):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[1]["lang_pred"] == "en" and 0 < got[5]["score"] <= 1
    assert L.identify(odd_docs(spark), model).count() == len(ROWS)
    assert L.fit(no_docs(spark)) is None
    assert rows(L.identify(odd_docs(spark), None).where("doc_id = 1"), "lang_pred", "score") == [("und", 0.0)]
    assert L.identify(no_docs(spark), model).collect() == []
    assert L.fit(odd_docs(spark)).labels


def brute_copies(data):
    best = {}
    for d, t in data:
        key = "".join(c for c in t or "" if c not in SPACE)
        rank = (-len(t or ""), d)
        best[key] = min(best.get(key, (rank, d)), (rank, d))
    return {d for _, d in best.values()}


def brute_near(data):
    sets = {d: shingles(t, 5) for d, t in data}
    gone, ids = set(), sorted(sets)
    root = {d: d for d in ids}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, x in enumerate(ids):
        for y in ids[:i]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 80 * len(sets[x] | sets[y]):
                a, b = top(x), top(y)
                root[max(a, b)] = min(a, b)
    gone = {d for d in ids if top(d) != d}
    return set(ids) - gone


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "quality_classifier",
        "exact_dedup",
        "ngram_jaccard_join",
        "benchmark_decontamination",
        "mixing",
    ]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = at
        at = stage(spark, before, SF).cache()
        assert at.schema == docs.schema
        if name == "quality_classifier":
            good = labels.where("quality = 1").select("doc_id")
            lost = ids(before.join(good, "doc_id")) - ids(at)
            assert len(lost) <= 0.03 * good.count()
        elif name == "exact_dedup":
            assert ids(at) == brute_copies(pairs(before))
        elif name == "ngram_jaccard_join":
            assert ids(at) == brute_near(pairs(before))
        else:
            leaks = {d for d, t in pairs(before) if any(b in t for b in bench)}
            assert leaks and ids(before) - ids(at) == leaks
    mixed = corpus_pipeline.mix_sources(spark, at, SF)
    assert ids(mixed) == ids(at) and mixed.count() == at.count()


def test_pipeline_takes_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
