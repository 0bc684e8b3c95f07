"""Tokenizers and text predicates as Column expressions (no Python per row)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.exprs import index_range, let, run_starts

# The white space characters that Python's str.split and
# str.strip act on, as a character class valid in both Java and RE2.
WHITESPACE = (
    r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Spark ML's public English stop word list, without the entries
# that the two-character word pattern below can never produce.
ENGLISH_STOP_WORDS = (
    "me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what "
    "which who whom this that these those am is are was were be been being have has had "
    "having do does did doing an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too "
    "very can will just don should now cannot could ought would"
).split()

# A word is a run of at least two letters, digits or underscores.
NON_WORD = r"[^\p{L}\p{N}_]"


def is_blank(text: Column) -> Column:
    """True when nothing but white space is left (null counts as blank)."""
    return ~F.coalesce(text.rlike(WHITESPACE.replace("[", "[^", 1)), F.lit(False))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WHITESPACE}+|{WHITESPACE}+\z", "")


def whitespace_tokens(text: Column) -> Column:
    """Lower-cased white space tokens: the BM25 and rerank tokenizer."""
    return F.array_remove(F.split(F.lower(text), WHITESPACE + "+"), "")


def topic_tokens(text: Column) -> Column:
    """White space tokens of more than three characters, letters only."""
    return F.filter(
        F.split(F.lower(text), WHITESPACE + "+"),
        lambda w: (F.length(w) > 3) & w.rlike(r"^\p{L}+\z"),
    )


def word_ngrams(
    text: Column,
    ngram_range: tuple[int, int] = (1, 2),
    stop_words: Sequence[str] | None = tuple(ENGLISH_STOP_WORDS),
) -> Column:
    """Word n-grams of the TF-IDF vectorizer; stop words go before n-grams form."""
    words = F.split(F.lower(text), NON_WORD + "+")
    keep = lambda w: F.length(w) > 1
    if stop_words:
        keep = lambda w: (F.length(w) > 1) & ~w.isin(list(stop_words))
    low, high = ngram_range

    def of_length(tokens: Column, n: int) -> Column:
        if n == 1:
            return tokens
        return F.transform(
            index_range(F.size(tokens) - (n - 1)),
            lambda i: F.concat_ws(" ", *[tokens[i + k] for k in range(n)]),
        )

    return let(
        F.filter(words, keep),
        lambda tokens: F.concat(*[of_length(tokens, n) for n in range(low, high + 1)]),
    )


def sentences(text: Column) -> Column:
    """Split after ``.``, ``?`` or ``!`` followed by white space."""
    return F.split(text, rf"(?<=[.?!]){WHITESPACE}+")


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of a token array, terms ascending.

    Counting inside the row (sort, then run lengths) means that term
    frequencies never need a shuffle on (document, term).
    """

    def runs(ordered: Column) -> Column:
        return let(
            run_starts(ordered),
            lambda starts: F.transform(
                starts,
                lambda s, j: F.struct(
                    ordered[s].alias("term"),
                    (
                        F.when(j + 1 < F.size(starts), starts[F.least(j + 1, F.size(starts) - 1)])
                        .otherwise(F.size(ordered))
                        - s
                    ).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(tokens), runs)


def line_count(text: Column) -> Column:
    """Number of lines the way an editor counts them: newlines plus one."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
