"""The registered queries: each reads whole tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.functions.exprs import round6
from corpusloom.operators import answers as A
from corpusloom.operators import chunking as C
from corpusloom.operators import definitions as D
from corpusloom.operators import lexical as L
from corpusloom.operators import maintenance as M
from corpusloom.operators import retrieval as R
from corpusloom.operators import topics as T
from corpusloom.operators.debounce import debounce
from corpusloom.operators.embedding import embed, hashed_embedder
from corpusloom.plans.source_samples import KEY, SAMPLES, UNSUPPORTED
from corpusloom.sources import files as S
from corpusloom.sources.index_store import live_rows
from corpusloom.sources.feature_table import FeatureTable
from corpusloom.sources.tables import spread, table, work_dir
from corpusloom.sources.term_index import TermIndex
from corpusloom.sources.vector_index import VectorIndex

# Width of the vectors in the provided tables.
DIM = 64
K = 10


def documents(spark: SparkSession, root: str) -> DataFrame:
    return spread(table(spark, root, "documents"))


def benchmark_queries(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def label_means(spark: SparkSession, root: str) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    rows = table(spark, root, "embeddings").select("label", F.posexplode("embedding"))
    means = rows.groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]
        ).alias("embedding")
    )


# --- statistics and fitted representations -------------------------------


def bm25_stats(spark, root):
    return L.bm25_stats(documents(spark, root)).select(
        "term", "df", "cf", round6(F.col("idf")).alias("idf")
    )


def tfidf_vocabulary(spark, root):
    return L.tfidf_vocabulary(documents(spark, root)).select(
        "term", "df", "cf", round6(F.col("idf")).alias("idf")
    )


def tfidf_fit(spark, root):
    docs = documents(spark, root)
    return L.tfidf_weights(docs, L.tfidf_vocabulary(docs)).select(
        "doc_id", "term", round6(F.col("weight")).alias("weight")
    )


# --- chunking and embedding ----------------------------------------------


def sentence_split(spark, root):
    return C.sentence_rows(documents(spark, root))


def semantic_chunks(spark, root):
    return C.semantic_chunks(documents(spark, root), dim=DIM)


def hashed_embeddings(spark, root):
    return embed(documents(spark, root), "text", "embedding", hashed_embedder(DIM)).select(
        "doc_id", F.array_join(F.col("embedding").cast("array<int>"), ",").alias("counts")
    )


def l2_normalised(spark, root):
    vecs = table(spark, root, "embeddings")
    unit = V.l2_normalise(V.as_doubles(F.col("embedding")))
    return vecs.select("vec_id", F.posexplode(unit).alias("pos", "x")).select(
        "vec_id", "pos", round6(F.col("x")).alias("x")
    )


# --- retrieval -----------------------------------------------------------


def _vector_topk(spark, root, metric):
    corpus = spread(table(spark, root, "embeddings"))
    return R.vector_topk(
        label_means(spark, root), corpus, K, metric, id_col="vec_id"
    )


def vector_l2_topk(spark, root):
    return _vector_topk(spark, root, "l2")


def vector_cosine_topk(spark, root):
    return _vector_topk(spark, root, "cosine")


def _vector_index_topk(spark, root, metric):
    index = VectorIndex(spark, work_dir(spark), metric)
    index.build(spread(table(spark, root, "embeddings")), id_col="vec_id")
    return index.search(label_means(spark, root), K).withColumnRenamed("id", "vec_id")


def vector_index_topk(spark, root):
    """The hits of vector_l2_topk from a stored index that leaves clusters unread."""
    return _vector_index_topk(spark, root, "l2")


def vector_index_cosine(spark, root):
    return _vector_index_topk(spark, root, "cosine")


def bm25_topk(spark, root):
    return R.bm25_topk(benchmark_queries(spark, root), documents(spark, root), K)


def _term_index(spark, root) -> TermIndex:
    """An index that grew in two batches, with some documents taken out and
    put back in between."""
    docs = documents(spark, root).select("doc_id", "text")
    index = TermIndex(spark, work_dir(spark))
    early, again = docs.where("doc_id % 3 < 2"), docs.where("doc_id % 3 < 2 and doc_id % 7 = 0")
    index.append(early)
    index.remove(again)
    index.append(docs.where("doc_id % 3 = 2").unionByName(again))
    return index


def bm25_index_topk(spark, root):
    """The hits of bm25_topk from a stored index."""
    hits = _term_index(spark, root).search(benchmark_queries(spark, root), K)
    return hits.withColumnRenamed("id", "doc_id")


def bm25_stats_after_events(spark, root):
    """Statistics kept up to date through additions and removals."""
    index = _term_index(spark, root)
    index.remove(documents(spark, root).where("doc_id % 5 = 0"))
    return index.stats().select("term", "df", "cf", round6(F.col("idf")).alias("idf"))


def tfidf_topk(spark, root):
    return R.tfidf_topk(benchmark_queries(spark, root), documents(spark, root), K)


# The code profile's weights for the methods other than topics.
HYBRID_WEIGHTS = {"vector": 0.5, "tfidf": 0.2, "bm25": 0.3}


def hybrid_topk(spark, root):
    hits = R.hybrid_topk(
        benchmark_queries(spark, root), documents(spark, root), HYBRID_WEIGHTS, K, dim=DIM
    )
    return hits.select(
        "query_id",
        "rank",
        "doc_id",
        "score",
        *[round6(F.col(m)).alias(f"{m}_score") for m in HYBRID_WEIGHTS],
    )


def _feature_table(spark, root) -> FeatureTable:
    features = FeatureTable(spark, work_dir(spark), DIM)
    features.build(documents(spark, root))
    return features


def hybrid_stored_topk(spark, root):
    """The hits of hybrid_topk from stored features; the text is not read again."""
    hits = _feature_table(spark, root).search(benchmark_queries(spark, root), HYBRID_WEIGHTS, K)
    scores = [round6(F.col(m)).alias(f"{m}_score") for m in HYBRID_WEIGHTS]
    return hits.select("query_id", "rank", F.col("id").alias("doc_id"), "score", *scores)


def hybrid_two_stage(spark, root):
    """Hybrid candidates from stored features, reranked by term coverage."""
    texts = documents(spark, root).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    hits = _feature_table(spark, root).reranked(benchmark_queries(spark, root), HYBRID_WEIGHTS, texts)
    return hits.select("query_id", "rank", F.col("id").alias("doc_id"), "score")


def hybrid_without_bm25(spark, root):
    """The same weights where BM25 is not available."""
    hits = R.hybrid_topk(
        benchmark_queries(spark, root), documents(spark, root), HYBRID_WEIGHTS, K, dim=DIM, missing=("bm25",)
    )
    return hits.select(
        "query_id", "rank", "doc_id", "score",
        round6(F.col("vector")).alias("vector_score"), round6(F.col("tfidf")).alias("tfidf_score"),
    )


# --- two-stage search and the answer side --------------------------------


def document_index(spark: SparkSession, root: str) -> DataFrame:
    """Documents as index rows: one chunk each, with its vector."""
    docs = documents(spark, root)
    return docs.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("text").alias("content"),
        "source",
        "lang",
        "n_chars",
        V.hashed_bag(F.col("text"), DIM).alias("embedding"),
    )


def raw_search(spark, root):
    """Vector search with a k of its own per query (0 and null: the default)."""
    queries = benchmark_queries(spark, root).withColumn(
        "top_k", F.when(F.col("query_id") % 4 > 0, F.col("query_id") % 4).cast("int")
    )
    hits = R.search(queries, document_index(spark, root), embedder=hashed_embedder(DIM))
    return hits.select(
        "query_id", "rank", "chunk_id", "content", "source", "score", "score_kind", "metadata.lang", "metadata.n_chars"
    )


def _two_stage(spark, root):
    return R.search(
        benchmark_queries(spark, root),
        document_index(spark, root),
        rerank_enabled=True,
        embedder=hashed_embedder(DIM),
    )


def two_stage_search(spark, root):
    return _two_stage(spark, root).select(
        "query_id", "rank", "chunk_id", "source", "score", "score_kind"
    )


def rerank_topk(spark, root):
    """Rerank the fused candidates instead of the nearest vectors."""
    queries = benchmark_queries(spark, root)
    docs = documents(spark, root)
    hits = R.bm25_topk(queries, docs, 4 * R.DEFAULT_K).drop("score")
    texts = docs.select("doc_id", F.col("text").alias("content"))
    asked = hits.join(queries, "query_id")
    most = queries.count() * 4 * R.DEFAULT_K
    candidates = R.with_content(asked, texts, "doc_id", ("content",), max_hits=most)
    return R.rerank(candidates, R.DEFAULT_K, 4 * R.DEFAULT_K, id_col="doc_id").select(
        "query_id", "rank", "doc_id", "score"
    )


def prompt_context(spark, root):
    return A.prompts(benchmark_queries(spark, root), _two_stage(spark, root))


def _turns(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "conversations").withColumn(
        "query_id", F.concat_ws("-", "conv_id", "turn")
    )


def grounding_check(spark, root):
    """Assistant turns against the documents that a search finds for the turn
    before them."""
    turns = spread(_turns(spark, root))
    said = turns.where(F.col("role") == "assistant")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("query"))
    asked = said.select("query_id", "conv_id", "turn").join(before, ["conv_id", "turn"]).select("query_id", "query")
    sources = R.search(asked, document_index(spark, root), embedder=hashed_embedder(DIM))
    answers = said.select("query_id", F.col("text").alias("answer"))
    return A.grounding_check(answers, sources, embedder=hashed_embedder(DIM)).select(
        "query_id", "is_hallucination", "score", "method"
    )


def answer_fallback(spark, root):
    """User turns with the assistant turn that follows, or the default answer."""
    turns = _turns(spark, root)
    asked = turns.where(F.col("role") == "user").select("query_id")
    given = turns.where(F.col("role") == "assistant").select(
        F.concat_ws("-", F.col("conv_id"), F.col("turn") - 1).alias("query_id"),
        F.col("text").alias("answer"),
        F.lit(None).cast("string").alias("error"),
    )
    return A.answers_with_fallback(asked, given)


# --- index maintenance ---------------------------------------------------

# Notification bits by event number: the four kinds, two combinations and one
# that no kind claims.
OPS = (1, 2, 4, 8, 3, 12, 16)


def file_events(spark: SparkSession, root: str) -> DataFrame:
    """The event table as file events of twenty times as few paths as users."""
    op = F.element_at(F.array(*[F.lit(o) for o in OPS]), (F.col("event_id") % 7 + 1).cast("int"))
    return (
        table(spark, root, "events")
        .withColumnRenamed("event_type", "kind")
        .withColumn("event_type", M.event_type(op))
        .where(F.col("event_type").isNotNull())
        .select("event_id", "ts", "user_id", "kind", "event_type", F.col("event_id").alias("seq"))
    )


def event_kinds(spark, root):
    return file_events(spark, root).select("event_id", "event_type")


def _paths_of_events(spark, root):
    return file_events(spark, root).select(
        F.concat(F.lit("src"), F.col("user_id") % 15).alias("path"), "event_type", "ts", "seq"
    )


def _stored_rows(spark, root):
    return table(spark, root, "documents").select(
        "source", F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")
    )


def apply_events(spark, root):
    index = _stored_rows(spark, root)
    fresh = index.select(
        "source",
        (-F.col("chunk_id") - 1).alias("chunk_id"),
        F.concat(F.lit("v2 "), "content").alias("content"),
    )
    return M.apply_events(index, _paths_of_events(spark, root), fresh).select(
        "source", "chunk_id", F.md5(F.col("content").cast("binary")).alias("digest")
    )


def delete_by_source(spark, root):
    return M.delete_by_source(_stored_rows(spark, root), "src7").select("source", "chunk_id")


def debounce_last_event(spark, root):
    events = file_events(spark, root).select(
        F.concat(F.lit("u"), "user_id").alias("root"),
        F.col("kind").alias("path"),
        "event_type",
        "ts",
        "seq",
    )
    out = debounce(
        events,
        gap_seconds=3600,
        slice_seconds=86_400,
    )
    return out.select(
        "root", F.col("session_start").cast("timestamp_ntz"), "path", "event_type", "ts"
    )


# The instant of the first listing; the second one is after all events.
LISTED_AT = "2024-01-16"


def _snapshots(spark, root):
    """What a listing shows before and after: paths whose last event until then
    did not remove them, with the time of that event."""
    seen = file_events(spark, root).select(
        F.col("user_id").alias("root"), F.col("kind").alias("path"), "event_type", "ts", "seq"
    )

    # One pass over the events: both listings are columns of one aggregate.
    early = F.col("ts") < F.lit(LISTED_AT).cast("timestamp_ntz")
    order, last = F.struct("ts", "seq"), F.struct("event_type", "ts")
    both = seen.groupBy("root", "path").agg(
        F.max_by(F.when(early, last), F.when(early, order)).alias("before"), F.max_by(last, order).alias("now")
    )

    def listing(at):
        there = ~F.col(f"{at}.event_type").isin(*M.REMOVING)
        return both.where(there).select("root", "path", F.col(f"{at}.ts").alias("mtime"))

    return listing("before"), listing("now")


def polling_state(spark, root):
    """What two ticks leave behind, and what a third finds: nothing."""
    before, now = _snapshots(spark, root)
    every = before.select("root").union(now.select("root"))
    kept = M.next_snapshot(before, now, detect_deletes=True, listed=every)
    again = M.snapshot_diff(kept, now, detect_deletes=True, listed=every).groupBy("root").agg(
        F.count(F.lit(1)).alias("again")
    )
    return kept.join(again, "root", "left").select(
        "root", "path", "mtime", F.coalesce("again", F.lit(0).cast("bigint")).alias("again")
    )


def index_live_rows(spark, root):
    """Documents as the rows of six batches, one of them not committed, with
    the events' paths touched by the batches they fall into."""
    batch = lambda n: F.concat(F.lit("b"), n % 6)
    chunks = _stored_rows(spark, root).withColumn("batch", batch(F.col("chunk_id")))
    removed = F.col("event_type").isin(*M.REMOVING)
    touched = (
        _paths_of_events(spark, root)
        .where(removed & (F.col("seq") % 6 < 4))
        .select("path", batch(F.col("seq")).alias("batch"))
    )
    commits = chunks.select("batch").distinct().where(F.col("batch") != "b3")
    place = F.substring("batch", 2, 1).cast("bigint")
    return live_rows(chunks, touched, commits.withColumn("place", place)).select("source", "chunk_id")


def snapshot_diff(spark, root):
    return M.snapshot_diff(*_snapshots(spark, root))


def dispatch_changed(spark, root):
    before, now = _snapshots(spark, root)
    name = lambda df: df.withColumn("path", F.concat_ws("/", "root", "path"))
    every = before.select("root").union(now.select("root"))
    changed = M.snapshot_diff(name(before), name(now), detect_deletes=True, listed=every)
    return M.dispatch_changes(changed, name(now)).select("root", "path", "change", "event_type")


# --- sources -------------------------------------------------------------

EXTENSIONS = (*S.LANGUAGE_OF_EXTENSION, ".PY", ".txt", "", ".Pdf", ".pdf")
DIRS = ("src", "lib/core", "node_modules/x", ".hidden", "build", "_private")


def path_table(spark: SparkSession, root: str) -> DataFrame:
    """A path for every document, over all extensions and kinds of directory."""
    pick = lambda items, at: F.element_at(F.array(*[F.lit(i) for i in items]), (at + 1).cast("int"))
    n = F.col("doc_id")
    return table(spark, root, "documents").select(
        "doc_id",
        F.concat(
            F.col("source"),
            F.lit("/"),
            pick(DIRS, n % len(DIRS)),
            F.lit("/"),
            F.when(n % 5 == 0, F.lit(".")).when(n % 5 == 1, F.lit("_")).otherwise(F.lit("")),
            F.lit("f"),
            n,
            pick(EXTENSIONS, n % len(EXTENSIONS)),
        ).alias("path"),
    )


def language_scan(spark, root):
    return S.source_files(path_table(spark, root))


def language_filter(spark, root):
    return S.source_files(path_table(spark, root), ["python", "go", "tsx"], prune=False)


def route_by_extension(spark, root):
    paths = path_table(spark, root).select("path").unionByName(
        table(spark, root, "pages").select(F.col("url").alias("path"))
    )
    return paths.select("path", S.route(F.col("path")).alias("route"))


def pdf_listing(spark, root):
    return path_table(spark, root).where(S.name_matches(F.col("path"))).select("doc_id", "path")


def source_default(spark, root):
    docs = table(spark, root, "documents").select(
        "doc_id",
        F.nullif(F.col("source"), F.lit("src3")).alias("source"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/d/"), "doc_id")).alias("path"),
    )
    return S.with_source(docs, "path").select("doc_id", "source")


# --- code and fallback chunks --------------------------------------------


def module_fallback(spark, root):
    """Which documents stay whole, and the line range of those."""
    docs = C.drop_blank(documents(spark, root))
    chunks = C.fallback_chunks(docs, "doc_id", "text", keep=("lang",))
    return chunks.where(F.col("symbol_type") == "module").select(
        "doc_id", "lang", "start_line", "end_line", F.col("chunk").alias("content")
    )


def recursive_split(spark, root):
    docs = documents(spark, root)
    return C.fallback_chunks(docs, "doc_id", "text", keep=(), size=500, overlap=50)


def generated_sources(spark: SparkSession, root: str) -> DataFrame:
    """One source file per part, with as many methods as the part's size.

    The tables hold no source code, so files are derived from them in four
    languages, and some without any definition.
    """
    k = F.col("p_partkey").cast("string")
    steps = lambda sep, make: F.array_join(
        F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: make(i.cast("string"))), sep
    )
    cat = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    python = cat(
        "class Part", k, ':\n    label = "', F.col("p_name"), '"\n\n',
        steps("\n", lambda i: cat("    def step_", i, "(self):\n        return ", i, "\n")),
        "\n\ndef make_", k, "(x):\n    return Part", k, "()\n",
    )
    go = cat(
        "package parts\n\ntype Part", k, " struct {\n\tName string\n}\n\n",
        steps("\n\n", lambda i: cat(
            "func (p *Part", k, ") Step", i,
            "() int {\n\tif p == nil {\n\t\treturn 0\n\t}\n\treturn ", i, "\n}")),
        "\n",
    )
    java = cat(
        "class Part", k, " {\n",
        steps("", lambda i: cat("    int step", i, "() {\n        return ", i, ";\n    }\n")),
        "}\n",
    )
    ruby = cat(
        "class Part", k, "\n",
        steps("", lambda i: cat("  def step_", i, "\n    ", i, "\n  end\n")),
        "end\n",
    )
    kind = F.col("p_partkey") % 5
    by_kind = lambda *v: (
        F.when(kind == 0, v[0]).when(kind == 1, v[1]).when(kind == 2, v[2]).when(kind == 3, v[3])
    )
    lit = F.lit
    return spread(table(spark, root, "part")).select(
        cat("part/", k, by_kind(lit(".py"), lit(".go"), lit(".java"), lit(".rb")).otherwise(".py")).alias("path"),
        by_kind(lit("python"), lit("go"), lit("java"), lit("ruby")).otherwise("python").alias("language"),
        by_kind(python, go, java, ruby).otherwise(cat("x = ", k, "\n")).alias("content"),
    )


def code_definitions(spark, root):
    return D.code_chunks(generated_sources(spark, root))


def sampled_sources(spark: SparkSession, root: str) -> DataFrame:
    """One source file per part: the samples of ten languages in turn, with the
    part's key in their names, and files in a language without rules."""
    samples = F.array(
        *[F.struct(*map(F.lit, (f"{s.language}/", s.extension, s.language, s.text))) for s in SAMPLES],
        F.struct(*map(F.lit, ("other/", ".cob", "cobol", UNSUPPORTED))),
    )
    sample = samples[(F.col("p_partkey") % (len(SAMPLES) + 1)).cast("int")]
    key = F.col("p_partkey").cast("string")
    return spread(table(spark, root, "part")).select(key.alias("k"), sample.alias("s")).select(
        F.concat("s.col1", "k", "s.col2").alias("path"),
        F.col("s.col3").alias("language"),
        F.replace(F.col("s.col4"), F.lit(KEY), F.col("k")).alias("content"),
    )


def code_outline(spark, root):
    """All definitions of the ten languages, and the files that have to be put aside."""
    return D.chunks_and_errors(sampled_sources(spark, root))


# --- topics --------------------------------------------------------------


def lda_vocab(spark, root):
    return T.topic_vocabulary(documents(spark, root))


def doc_topics(spark, root):
    """Topic vectors of all documents: how many topics, and what they add up to."""
    docs = documents(spark, root)
    total = F.aggregate("lda", F.lit(0.0), lambda acc, x: acc + x)
    return T.with_topics(T.fit_topics(docs), docs).select(
        "doc_id", F.size("lda").alias("topics"), round6(total).alias("total")
    )


def topic_cosine_topk(spark, root):
    """Given topic vectors through the topic method alone: shares of the
    embeddings' magnitudes, asked for with the mean of each label."""
    rows = table(spark, root, "embeddings")
    size = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    shares = rows.select(
        F.col("vec_id").alias("doc_id"),
        "label",
        F.transform("embedding", lambda x: F.abs(x.cast("double")) / size).alias("lda"),
    )
    means = shares.select("label", F.posexplode("lda")).groupBy("label", "pos").agg(F.avg("col").alias("m"))
    asked = means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("lda")
    )
    return R.vector_topk(
        asked, shares, K, "cosine", id_col="doc_id", vector_col="lda"
    ).select("query_id", "rank", "doc_id", "score")


def lda_topk(spark, root):
    """All four methods fused with the default weights."""
    docs = documents(spark, root)
    model = T.fit_topics(docs)
    hits = R.hybrid_topk(
        benchmark_queries(spark, root), docs, R.DEFAULT_WEIGHTS, K, dim=DIM, topics=T.topics_by(model)
    )
    return hits.select("query_id", "rank", "doc_id", "score", round6(F.col("lda")).alias("lda_score"))


def corpus_fingerprint(spark, root):
    return T.corpus_fingerprint(table(spark, root, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        # The first query also pays for the start of the session.
        source_default,
        bm25_stats,
        bm25_topk,
        bm25_index_topk,
        bm25_stats_after_events,
        tfidf_vocabulary,
        tfidf_fit,
        tfidf_topk,
        sentence_split,
        semantic_chunks,
        hashed_embeddings,
        l2_normalised,
        vector_l2_topk,
        vector_cosine_topk,
        vector_index_topk,
        vector_index_cosine,
        hybrid_topk,
        hybrid_without_bm25,
        hybrid_stored_topk,
        hybrid_two_stage,
        raw_search,
        two_stage_search,
        rerank_topk,
        prompt_context,
        grounding_check,
        answer_fallback,
        event_kinds,
        apply_events,
        delete_by_source,
        debounce_last_event,
        snapshot_diff,
        dispatch_changed,
        polling_state,
        index_live_rows,
        topic_cosine_topk,
        language_scan,
        language_filter,
        route_by_extension,
        pdf_listing,
        module_fallback,
        recursive_split,
        code_definitions,
        code_outline,
        lda_vocab,
        doc_topics,
        lda_topk,
        corpus_fingerprint,
    )
}
