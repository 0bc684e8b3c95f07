import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import vectors as V


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr).first()[0]


def test_whitespace_tokens_follow_python_split(spark):
    samples = ["A b\tC", "", "  \n ", "x y z", "a\x0bb\x1cc", "one", "É Ü　ñ"]
    got = spark.createDataFrame([(s,) for s in samples], "t string").select(
        X.whitespace_tokens(F.col("t")), X.is_blank(F.col("t")), X.strip(F.col("t"))
    )
    for sample, row in zip(samples, got.collect()):
        assert row[0] == sample.lower().split()
        assert row[1] == (not sample.strip())
        assert row[2] == sample.strip()


def test_topic_tokens(spark):
    assert one(spark, X.topic_tokens(F.col("t")), t="The tree4 trees, élan wörter") == ["élan", "wörter"]


def test_ngrams_form_after_stop_words(spark):
    got = one(spark, X.word_ngrams(F.col("t")), t="The state of the ART a b_c")
    assert got == ["state", "art", "b_c", "state art", "art b_c"]
    assert one(spark, X.word_ngrams(F.col("t"), (2, 3), None), t="ab cd ef") == ["ab cd", "cd ef", "ab cd ef"]


def test_stop_words_are_sparks(spark):
    theirs = set(StopWordsRemover.loadDefaultStopWords("english"))
    assert set(X.ENGLISH_STOP_WORDS) == {w for w in theirs if w.isalpha() and len(w) > 1}


def test_sentences(spark):
    assert one(spark, X.sentences(F.col("t")), t="A b. C?\nD! e.f g") == ["A b.", "C?", "D!", "e.f g"]


def test_term_counts(spark):
    got = one(spark, X.term_counts(X.whitespace_tokens(F.col("t"))), t="b a b c b a")
    assert [(r.term, r.tf) for r in got] == [("a", 2), ("b", 3), ("c", 1)]
    assert one(spark, X.term_counts(X.whitespace_tokens(F.col("t"))), t=" ") == []


def test_cosine_and_norm(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([3.0, 4.0], [3.0, 4.0])],
        "a array<double>, b array<double>",
    )
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert math.isclose(got[0], 1 / math.sqrt(2)) and got[1] == 0.0 and math.isclose(got[2], 1.0)
    unit = [r[0] for r in df.select(V.l2_normalise(F.col("a"))).collect()]
    assert unit[1] == [0.0, 0.0] and unit[2] == [0.6, 0.8]


@settings(max_examples=15, deadline=None)
@given(words=st.lists(st.sampled_from("alpha beta gamma delta é".split()), max_size=30))
def test_hashed_bag_counts_every_token(spark, words):
    import hashlib

    want = [0.0] * 16
    for w in words:
        want[int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % 16] += 1
    assert one(spark, V.hashed_bag(F.col("t"), 16), t=" ".join(words)) == want
