"""The registered queries of this subpackage: each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm import (
    decontaminate,
    exact_dedup,
    html_text,
    jaccard_join,
    language_id,
    mixing,
    pii,
    prefix_trie,
    quality,
    secret_scan,
    spelling,
    token_counts,
    warc,
)
from corpusloom.llm.store import shared_dir
from corpusloom.sources.tables import table

TOKENIZER = "piece_bpe_32k.model"


def op1_mixing(spark, root):
    return mixing.mix(table(spark, root, "documents"))


def op2_decontaminate(spark, root):
    return decontaminate.overlaps(
        table(spark, root, "documents"), table(spark, root, "benchmark")
    )


def op3_quality(spark, root):
    return quality.perplexities(table(spark, root, "documents"), table(spark, root, "labels"))


def op4_token_counts(spark, root):
    import public_tokenizers

    work = shared_dir(spark)
    return token_counts.token_counts(
        table(spark, root, "documents"),
        public_tokenizers.path(TOKENIZER),
        cache_path=f"{work}/cache",
        work_path=f"{work}/work",
    ).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_secret_scan(spark, root):
    found = secret_scan.scan_secrets(table(spark, root, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]

    def joined(spans):
        parts = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
        return F.array_join(parts, ",")

    def of(kinds):
        return F.filter("spans", lambda x: x["kind"].isin(kinds))

    basic = of(base)
    counts = [F.size(of([k])).cast("bigint").alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(basic), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op6_html_text(spark, root):
    return html_text.extract_text(table(spark, root, "pages"))


def op7_jaccard_join(spark, root):
    return jaccard_join.near_duplicates(table(spark, root, "documents"), k=3, least=90)


def op8_warc(spark, root):
    path = shared_dir(spark)
    warc.archive(table(spark, root, "pages"), path)
    return warc.read_index(spark, path).drop("url")


def op9_exact_dedup(spark, root):
    return exact_dedup.exact_dedup(table(spark, root, "documents")).select(
        "doc_id", "keep_id", F.col("group_size").cast("bigint"), "kept", "text_sha256"
    )


def op10_language_id(spark, root):
    docs = table(spark, root, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    held_out = language_id.held_out(F.col("doc_id")).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


def op11_prefix_trie(spark, root):
    return prefix_trie.prefix_trie(table(spark, root, "conversations"))


def op12_spelling(spark, root):
    return spelling.spelling_variants(table(spark, root, "documents"))


def op13_personal_data(spark, root):
    found = pii.personal_data(table(spark, root, "documents"))
    return found.select(
        "doc_id",
        *[f"n_{k}" for k in pii.KINDS],
        F.sha2("base", 256).alias("base_sha256"),
        pii.spans_text(F.col("base"), F.col("terms")).alias("spans"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_decontaminate,
        op3_quality,
        op4_token_counts,
        op5_secret_scan,
        op6_html_text,
        op7_jaccard_join,
        op8_warc,
        op9_exact_dedup,
        op10_language_id,
        op11_prefix_trie,
        op12_spelling,
        op13_personal_data,
    )
}
