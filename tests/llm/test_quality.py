"""The distributed model against plain dictionaries."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality as Q
from tests.llm.cases import ROWS, no_docs, odd_docs, rows

SF = "/root/testdata/sf0.001"


def symbols(text):
    out = []
    for c in map(ord, text):
        if c >= 1 << 14:
            out += [768 + (c >> 14), 896 + (c >> 7) % 128, 896 + c % 128]
        elif c >= 768:
            out += [768 + (c >> 7), 896 + c % 128]
        elif c >= 128:
            out.append(c)
        elif c == 10:
            out.append(10)
        elif 48 <= c <= 57:
            out.append(48)
        else:
            out.append(c if 33 <= c < 127 else 32)
    return out


def test_no_two_characters_share_their_symbols():
    texts = ["".join(map(chr, range(0x21, 0x30))), "日本語\U0001f600é", "", "ш" + chr(ord("ш") + 64)]
    found, lengths = Q.symbols_of(texts)
    assert found.tolist() == [x for t in texts for x in symbols(t)]
    assert lengths.tolist() == [len(symbols(t)) for t in texts]
    points = [c for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000]
    found, lengths = Q.symbols_of([chr(c) for c in points])
    assert found.max() < Q.SYMBOLS
    pieces = np.split(found, np.cumsum(lengths)[:-1])
    assert len({x.tobytes() for x in pieces}) == len(points)


def ngrams(text):
    line = [0] * (Q.ORDER - 1) + symbols(text) + [1]
    return [tuple(line[i - Q.ORDER + 1 : i + 1]) for i in range(Q.ORDER - 1, len(line))]


class KneserNey:
    def __init__(self, texts):
        self.counts = {Q.ORDER: Counter(g for t in texts for g in ngrams(t))}
        for order in range(Q.ORDER - 1, 0, -1):
            self.counts[order] = Counter(g[1:] for g in self.counts[order + 1])
        self.cut, self.total, self.mass = {}, {}, {}
        for order, counts in self.counts.items():
            n = Counter(counts.values())
            y = n[1] / (n[1] + 2 * n[2])
            cut = []
            for i in (1, 2, 3):
                d = i - (i + 1) * y * n[i + 1] / n[i] if n[i] and n[i + 1] else 0.5
                cut.append(max(0.05, min(d, i - 0.05)))
            self.cut[order] = cut
            total, mass = defaultdict(int), defaultdict(float)
            for g, c in counts.items():
                total[g[:-1]] += c
                mass[g[:-1]] += cut[min(c, 3) - 1]
            self.total[order], self.mass[order] = total, mass

    def p(self, gram):
        order = len(gram)
        if not order:
            return 1 / Q.SYMBOLS
        lower = self.p(gram[1:])
        total = self.total[order].get(gram[:-1])
        if total is None:
            return lower
        weight = self.mass[order][gram[:-1]] / total
        c = self.counts[order].get(gram, 0)
        return (c - self.cut[order][min(c, 3) - 1]) / total + weight * lower if c else weight * lower

    def logp(self, text):
        return sum(math.log(self.p(g)) for g in ngrams(text))


def test_log_likelihoods_equal_dictionaries(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500")
    data = [(r["doc_id"], r["lang"], r["text"]) for r in docs.collect()]
    languages = sorted({lang for _, lang, _ in data})
    number = {lang: i + 1 for i, lang in enumerate(languages)}
    models = {number[x]: KneserNey([t for d, lang, t in data if lang == x and d % 2]) for x in languages}
    models[0] = KneserNey([t for d, _, t in data if d % 2])
    want = {d: models[number[x] if d % 3 else 0].logp(t) for d, x, t in data}

    def table(rows_):
        return spark.createDataFrame(rows_, "doc_id bigint, lang string, model bigint, text string")

    path = Q.shared_dir(spark)
    fit = table([(d, x, number[x], t) for d, x, t in data if d % 2])
    probs, contexts = Q.model_tables(Q.count_tables(fit.select("model", "text"), path), path)
    every = table([(d, x, number[x] if d % 3 else 0, t) for d, x, t in data])
    grams = Q.written(Q.corpus_grams(every.select("model", "text"), probs, contexts, path), f"{path}/g")
    for rows_of_shard in (Q.SHARD_ROWS, 5_000):
        monkeypatch.setattr(Q, "SHARD_ROWS", rows_of_shard)
        got = {r["doc_id"]: r["logp"] for r in Q.log_likelihoods(every, grams, Q.shared_dir(spark)).collect()}
        assert got.keys() == want.keys()
        for d, x in want.items():
            assert got[d] == pytest.approx(x, rel=1e-5)
    # Repeated rows keep their number over several shards.
    twice = Q.log_likelihoods(every.unionByName(every.where("doc_id < 5")), grams, Q.shared_dir(spark))
    assert twice.count() == len(data) + sum(d < 5 for d, *_ in data)
    # Probabilities of a context add up to one over all symbols.
    model = models[0]
    for gram in list(model.counts[Q.ORDER])[:5]:
        assert sum(model.p((*gram[:-1], s)) for s in range(Q.SYMBOLS)) == pytest.approx(1, abs=1e-6)


def test_keeps_good_and_rejects_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = Q.perplexities(docs, labels)
    assert found.count() == docs.count()
    share = {
        r["quality"]: r["share"]
        for r in found.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    }
    assert share[1] > 0.97 and share[0] < 0.2


def test_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (5, 1), (6, 1), (6, 0), (None, 1), (99, 1)], "doc_id bigint, quality int")
    got = Q.perplexities(docs, labels)
    assert rows(got, "doc_id") == sorted([(r[0],) for r in ROWS], key=repr)
    for r in got.where("n_symbols = 0").collect():
        assert r["perplexity"] is None and r["kept"]
    kept = Q.accepted(docs, labels)
    assert kept.columns == docs.columns and {2, 3} <= {r["doc_id"] for r in kept.collect()}
    nothing = spark.createDataFrame([], labels.schema)
    assert Q.perplexities(docs, nothing).where("kept").count() == len(ROWS)
    assert Q.perplexities(no_docs(spark), labels).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_languages_with_a_few_trusted_documents(spark, n):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = docs.join(labels, "doc_id").where("lang = 'de'").groupBy("doc_id").agg(F.min("quality").alias("q"))
    few = labels.join(known.where("q = 1").orderBy("doc_id").limit(n).select("doc_id"), "doc_id", "left_semi")
    others = labels.join(docs.where("lang <> 'de'").select("doc_id"), "doc_id", "left_semi")
    found = Q.perplexities(docs, others.unionByName(few)).join(known, "doc_id")
    share = {r["q"]: r["share"] for r in found.groupBy("q").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.9 and share[0] < 0.7


def test_too_little_trusted_text_sets_no_threshold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 10 = 0")
    labels = docs.orderBy("doc_id").limit(Q.MIN_HELD - 1).select("doc_id", F.lit(1).alias("quality"))
    found = Q.perplexities(docs, labels)
    assert found.count() == found.where("kept and threshold is null").count() == docs.count()


def test_one_rejected_row_takes_no_other_with_it(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi").where("lang = 'en'").orderBy("doc_id").limit(1)
    text = good.first()["text"]
    junk = "".join(chr(33 + (i * i * 31 + i * 7) % 90) for i in range(2000))
    more = spark.createDataFrame(
        [(None, "en", text), (None, "en", junk), (-1, "en", text), (-1, "en", junk)], docs.schema
    )
    kept = Q.accepted(docs.unionByName(more), labels).where("doc_id is null or doc_id = -1")
    assert rows(kept, "doc_id", "text") == sorted([(None, text), (-1, text)], key=repr)
