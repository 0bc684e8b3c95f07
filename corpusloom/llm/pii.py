"""Personal data: patterns, and terms that give away what the patterns protect.

The patterns (e-mail and IP addresses, card and telephone numbers) find the base
spans. What they find, normalised, are the protected entities of a document. A
term that stays behind can still disclose an entity, so the corpus tells how
strongly: with p(c) the share of documents that mention entity c, p(t) that of
documents that hold term t, and p(c, t) that of documents with t within a few
words of c,

    information  IC(c)     = -log2 p(c)
    disclosure   PMI(c; t) =  log2 p(c, t) / (p(c) p(t))

A term discloses an entity where PMI(c; t) >= IC(c) / ALPHA, which it reaches in
full if it occurs nowhere else. A chance meeting of rare words must not count, so
the documents with both have to give EVIDENCE bits together, and be two at least.
In a document that mentions c such a term is replaced by its class (a name, a
code, a number, a word) where the class stands below the threshold, and removed
where even the class discloses c.

Null texts count as empty, rows are documents (copies count each), and ids are
only passed on; equal texts get equal spans. Empty tables give no rows. Only
`doc_id` and `text` are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import slices
from corpusloom.llm.store import shared_dir, written

# Fixed kinds, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
TERM, REMOVED = "term", "removed"

WINDOW = 8
ALPHA = 1.25
EVIDENCE = 16.0
SHORTEST = 3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Only the first digit of a run can begin a match, so runs are read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]{%d,}" % SHORTEST)
_SLICE = 1 << 22
_HELD = 200_000


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost match before an @ begins with the run of characters that
    leads up to it; looking from the @ reads every character at most twice."""
    used, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            used = found.end()
        at = text.find("@", max(at + 1, used))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """`(kind, start, end, entity)` of the patterns, by kind, then start."""
    out = [(0, s, e, text[s:e].lower()) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((1, *m.span(), ".".join(p or "0" for p in parts)))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span(), digits))
    for m in _PHONE.finditer(text):
        digits = _digits(m[0])
        if 8 <= len(digits) <= 15:
            out.append((3, *m.span(), digits))
    return out


def class_of(word: str) -> str:
    """What a term is generalised to. Classes are terms of their own, whose
    brackets no word has."""
    if word.isdigit():
        return "[number]"
    if any(c.isdigit() for c in word):
        return "[code]"
    return "[name]" if word[0].isupper() else "[word]"


def words_of(text: str, spans: list[tuple[int, int, int, str]]) -> tuple[list, list]:
    """The words outside the base spans, as (word, start, end), and for each
    span (entity, number of words before it, number before its end)."""
    cover: list[list[int]] = []
    for start, end in sorted((s, e) for _, s, e, _ in spans):
        if cover and start < cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], end)
        else:
            cover.append([start, end])
    words, k = [], 0
    for m in _WORD.finditer(text):
        start, end = m.span()
        while k < len(cover) and cover[k][1] <= start:
            k += 1
        if k == len(cover) or cover[k][0] >= end:
            words.append((m[0], start, end))
    starts = [w[1] for w in words]
    return words, [
        (f"{KINDS[kind]}:{entity}", bisect_left(starts, s), bisect_left(starts, e))
        for kind, s, e, entity in spans
    ]


def _joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, _ in spans)


_SPANS = pa.list_(pa.struct([("class", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
# One pass over the texts gives four kinds of rows.
_FREQUENCY, _NEAR, _PLACES, _BASE = range(4)


def _scanned(docs: DataFrame, window: int) -> DataFrame:
    """What one pass over the texts finds, by `what`:

    - how many documents of some batches hold a `term`: `n`
    - that a document mentions `entity` (term null) or has `term` near it
    - where a document that mentions any entity has a term that is near one
    - the base spans and counts of a document
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def table(what, size, **columns):
            kinds = {
                "doc_id": ids, "digest": pa.string(), "entity": pa.string(), "term": pa.string(),
                "n": pa.int64(), "places": _SPANS, "base": pa.string(), **dict.fromkeys(counts, pa.int64()),
            }
            arrays = [pa.array([what] * size, pa.int32())]
            for name, kind in kinds.items():
                given = columns.get(name)
                arrays.append(pa.nulls(size, kind) if given is None else pa.array(given, kind) if isinstance(given, list) else given)
            return pa.record_batch(arrays, ["what", *kinds])

        ids = pa.null()
        for batch in slices(batches, "text", _SLICE):
            ids = batch.schema.field("doc_id").type
            base, digests, found = [], [], {k: [] for k in counts}
            near, places = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                digest = hashlib.sha256(text.encode("utf-8")).hexdigest()
                digests.append(digest)
                base.append(_joined(spans))
                for i, name in enumerate(counts):
                    found[name].append(sum(s[0] == i for s in spans))
                if spans:
                    words, mentions = words_of(text, spans)
                    plain = {w for w, _, _ in words}
                else:
                    plain = set(_WORD.findall(text))
                held.update({w.lower() for w in plain} | {class_of(w) for w in plain})
                if spans:
                    pairs, close = _near(words, mentions, window)
                    near += [(digest, e, t) for e, t in pairs]
                    at: dict[str, list] = {}
                    for w, s, e in words:
                        if (t := w.lower()) in close:
                            at.setdefault(t, []).append({"class": class_of(w), "start": s, "end": e})
                    places += [(digest, t, p) for t, p in at.items()]
                if len(held) > _HELD:
                    yield table(_FREQUENCY, len(held), term=list(held), n=list(held.values()))
                    held.clear()
            yield table(_BASE, batch.num_rows, doc_id=batch.column("doc_id"), digest=digests, base=base, **found)
            for i in range(0, len(near), _HELD):
                d, e, t = map(list, zip(*near[i : i + _HELD], strict=True))
                yield table(_NEAR, len(d), digest=d, entity=e, term=t)
            if places:
                d, t, p = map(list, zip(*places, strict=True))
                yield table(_PLACES, len(d), digest=d, term=t, places=p)
        if held:
            yield table(_FREQUENCY, len(held), term=list(held), n=list(held.values()))

    out = (
        f"what int, doc_id {id_type}, digest string, entity string, term string, n bigint, "
        "places array<struct<class: string, start: bigint, end: bigint>>, base string, "
        + ", ".join(f"{c} bigint" for c in counts)
    )
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, out)


def _near(words: list, mentions: list, window: int) -> tuple[set, set]:
    """The (entity, term) pairs of a document, classes among the terms and null
    for the mention itself, and all terms near any entity."""
    pairs, close = set(), set()
    for entity, before, after in mentions:
        pairs.add((entity, None))
        for w, _, _ in words[max(0, before - window) : before] + words[after : after + window]:
            pairs.add((entity, w.lower()))
            pairs.add((entity, class_of(w)))
            close.add(w.lower())
    return pairs, close


def disclosures(scanned: DataFrame, alpha: float = ALPHA, evidence: float = EVIDENCE) -> DataFrame:
    """`entity, term, n_both, n_entity, n_term, information, disclosure, over`
    for every pair that is near each other in some document. The documents are
    counted over the whole corpus; counts combine before they are shuffled."""
    together = scanned.where(F.col("what") == _NEAR).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
    mentioned = together.where("term is null").select("entity", F.col("n_both").alias("n_entity"))
    pairs = together.where("term is not null")
    frequency = (
        scanned.where(F.col("what") == _FREQUENCY).groupBy("term").agg(F.sum("n").alias("n_term"))
    )
    n = F.lit(float(scanned.where(F.col("what") == _BASE).count()))
    known = pairs.join(mentioned, "entity").join(frequency, "term")
    known = known.withColumns(
        {
            "information": F.log2(n / F.col("n_entity")),
            "disclosure": F.log2(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term"))),
        }
    )
    bits = F.col("disclosure") * F.col("n_both")
    return known.select(
        "entity", "term", "n_both", "n_entity", "n_term", "information", "disclosure",
        (
            (F.col("information") > 0)
            & (F.col("disclosure") >= F.col("information") / alpha)
            & (F.col("n_both") >= 2)
            & (bits >= evidence)
        ).alias("over"),
    )


def _term_spans(scanned: DataFrame, over: DataFrame) -> DataFrame:
    """`digest, terms`: for each text with disclosing terms, where they are."""
    near = scanned.where(F.col("what") == _NEAR).where("term is not null").select("digest", "entity", "term").distinct()
    hit = near.join(over.select("entity", "term"), ["entity", "term"])
    terms = hit.where(~F.col("term").startswith("["))
    classes = hit.where(F.col("term").startswith("[")).select("digest", F.col("term").alias("class")).distinct()
    places = (
        scanned.where(F.col("what") == _PLACES)
        .groupBy("digest", "term")
        .agg(F.first("places").alias("places"))
        .join(terms.select("digest", "term").distinct(), ["digest", "term"])
        .select("digest", F.explode("places").alias("p"))
        .select("digest", "p.*")
    )
    marked = places.join(classes.withColumn("gone", F.lit(True)), ["digest", "class"], "left")
    kind = F.when(F.col("gone"), F.lit(REMOVED)).otherwise(F.lit(TERM))
    return marked.groupBy("digest").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", kind.alias("kind"), "class"))).alias("terms")
    )


def personal_data(
    docs: DataFrame, window: int = WINDOW, alpha: float = ALPHA, evidence: float = EVIDENCE
) -> DataFrame:
    """For every row of `doc_id, text`: `doc_id, digest` (of the text), `n_email,
    n_ip, n_card, n_phone, base` (the base spans as text) and `terms`, an array
    of `start, end, kind, class` of the terms to generalise (kind `term`) or to
    remove (`removed`); null for none."""
    path = shared_dir(docs.sparkSession)
    scanned = written(_scanned(docs, window), f"{path}/scanned")
    over = written(disclosures(scanned, alpha, evidence).where("over"), f"{path}/over")
    terms = _term_spans(scanned, over)
    base = scanned.where(F.col("what") == _BASE).select("doc_id", "digest", *[f"n_{k}" for k in KINDS], "base")
    return base.join(terms, "digest", "left")


def spans_text(base: Column, terms: Column) -> Column:
    """All spans as `kind:start:end`, by kind as listed, then start."""

    def of(kind):
        return F.transform(
            F.filter(terms, lambda x: x["kind"] == kind),
            lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]),
        )

    more = F.coalesce(F.concat(of(TERM), of(REMOVED)), F.array().cast("array<string>"))
    first = F.when(base != "", F.array(base)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(first, more), ",")


def sanitised(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` with `text` sanitised: base spans become their kind in
    brackets, disclosing terms their class, or nothing. Overlapping spans become
    one, named after the first. Null stays null; other columns are left alone."""
    found = personal_data(docs.select("doc_id", "text"), **settings).dropDuplicates(["digest"])
    found = found.where("base <> '' or terms is not null").select(
        F.col("digest").alias("__digest"), F.struct("base", "terms").alias("__found")
    )
    names = docs.columns
    numbered = docs.select(
        F.struct("*").alias("__row"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("__digest")
    )
    return (
        numbered.join(found, "__digest", "left")
        .select(
            *[
                F.col("__row")[c].alias(c)
                if c != "text"
                else _replaced(F.col("__row")["text"].cast("string"), F.col("__found")).alias("text")
                for c in names
            ]
        )
    )


def _rewritten(text: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
    def one(t, spans, more):
        if t is None:
            return None
        cuts = []
        for part in spans.split(",") if spans else []:
            kind, s, e = part.split(":")
            cuts.append((int(s), int(e), f"[{kind}]"))
        for x in more if more is not None else []:
            cuts.append((x["start"], x["end"], x["class"] if x["kind"] == TERM else ""))
        out, at = [], 0
        for s, e, said in sorted(cuts):
            if s >= at:
                out += [t[at:s], said]
            at = max(at, e)
        return "".join([*out, t[at:]])

    return pd.Series([one(*x) for x in zip(text, base, terms, strict=True)])


def _replaced(text: Column, found: Column) -> Column:
    return F.when(found.isNull(), text).otherwise(
        F.pandas_udf(_rewritten, "string")(text, F.coalesce(found["base"], F.lit("")), found["terms"])
    )
