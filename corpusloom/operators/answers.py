"""Answer side: context and prompt assembly, grounding check, fallback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V

# Answer given when none could be produced, the grounding
# threshold, and the wording of context entries.
DEFAULT_ANSWER = "I don't know"
DEFAULT_THRESHOLD = 0.5
CONTEXT_ENTRY = ("Context:\ncontent:", "\nsource:")
CONTEXT_SEPARATOR = "\n\n"
# The instructions in front of the context.
INSTRUCTIONS = (
    "1. Use the following pieces of context to answer the question at the end.",
    "2. If you don't know the answer, say \"I don't know\".",
    "3. Keep the answer crisp (3-4 sentences).",
)


def context_entry(content: Column, source: Column) -> Column:
    head, middle = CONTEXT_ENTRY
    return F.concat(F.lit(head), content, F.lit(middle), source)


def assemble_context(hits: DataFrame) -> DataFrame:
    """One context string per query: its hits in rank order.

    The group is the top-k of one query, so its size is k, not the corpus.
    """
    entry = F.struct("rank", context_entry(F.col("content"), F.col("source")).alias("entry"))
    return hits.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["entry"]),
            CONTEXT_SEPARATOR,
        ).alias("context")
    )


def render_prompt(context: Column, question: Column) -> Column:
    return F.concat(
        F.lit("\n".join(INSTRUCTIONS) + "\n\nContext: "),
        context,
        F.lit("\n\nQuestion: "),
        question,
        F.lit("\n\nHelpful Answer:"),
    )


def prompts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``(query_id, prompt)`` for offline inference; no hits, empty context."""
    return queries.join(assemble_context(hits), "query_id", "left").select(
        "query_id",
        render_prompt(F.coalesce("context", F.lit("")), F.col("query")).alias("prompt"),
    )


CHECK_METHODS = ("embedding_similarity",)


def grounding_check(
    answers: DataFrame,
    sources: DataFrame,
    key: str = "query_id",
    threshold: float | None = None,
    embedder: Callable[[Column], Column] | None = None,
    method: str = "embedding_similarity",
) -> DataFrame:
    """Is an answer close to any of its sources?

    ``answers`` has the key and ``answer``, ``sources`` the key and
    ``content``. The score is the highest cosine; below the threshold the
    answer is flagged. No answer or no source leaves both null. The vectors
    are made before the join, once per text, and the join is an equi-join on
    the key followed by a combinable ``max``.
    """
    if method not in CHECK_METHODS:
        raise NotImplementedError(f"Unsupported grounding method: {method}")
    limit = DEFAULT_THRESHOLD if threshold is None else threshold
    embed = embedder or V.hashed_bag
    texts = sources.where(F.col("content").isNotNull()).select(
        key, embed(F.col("content")).alias("_source_vec")
    )
    said = F.coalesce(F.col("answer"), F.lit("")) != ""
    best = (
        answers.where(said)
        .select(key, embed(F.col("answer")).alias("_answer_vec"))
        .join(texts, key)
        .groupBy(key)
        .agg(F.max(V.cosine(F.col("_answer_vec"), F.col("_source_vec"))).alias("_score"))
    )
    return answers.join(best, key, "left").select(
        *answers.columns,
        (F.col("_score") < limit).alias("is_hallucination"),
        F.round(F.col("_score"), 6).alias("score"),
        F.lit(method).alias("method"),
    )


def answers_with_fallback(
    queries: DataFrame,
    answers: DataFrame,
    sources: DataFrame | None = None,
    checks: DataFrame | None = None,
    default_answer: str = DEFAULT_ANSWER,
) -> DataFrame:
    """Every query gets a row: its answer, or the default and the error.

    ``answers`` has ``query_id``, ``answer`` and ``error``; a query without an
    answer, or with an error, gets the default. Retrieved sources (``query_id,
    rank, content, source``) are kept either way, and a failed check never
    replaces an answer.
    """
    failed = F.col("answer").isNull() | F.col("error").isNotNull()
    out = queries.join(answers, "query_id", "left").select(
        "query_id",
        F.when(failed, F.lit(default_answer)).otherwise(F.col("answer")).alias("result"),
        F.when(failed, F.coalesce("error", F.lit("no answer"))).alias("error"),
    )
    if sources is not None:
        kept = sources.groupBy("query_id").agg(
            F.sort_array(F.collect_list(F.struct("rank", "content", "source"))).alias(
                "source_documents"
            )
        )
        out = out.join(kept, "query_id", "left")
    if checks is not None:
        out = out.join(
            checks.select(
                "query_id",
                F.struct("is_hallucination", "score", "method").alias("hallucination_check"),
            ),
            "query_id",
            "left",
        )
    return out
