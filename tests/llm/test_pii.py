import hashlib
import re
from collections import Counter
from math import log2

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import pii, queries
from tests.llm.cases import ROWS, SCHEMA, clashing, no_docs, odd_docs, rows

# The patterns as the contract has them.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def brute_base(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def luhn(s):
        double = [int(c) * (1 + i % 2) for i, c in enumerate(s[::-1])]
        return sum(d - 9 if d > 9 else d for d in double) % 10 == 0

    keep = [
        lambda s: True,
        lambda s: all(int(p) <= 255 for p in s.split(".")),
        lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)),
        lambda s: 8 <= len(digits(s)) <= 15,
    ]
    return [
        (k, *m.span())
        for k, pattern in enumerate((EMAIL, IP, CARD, PHONE))
        for m in re.finditer(pattern, text)
        if keep[k](m[0])
    ]


PIECES = st.sampled_from(
    ["a", "b.c", "@", "@@", ".", "..", "-", "x@y.z", "1", "255", "256", "0001", " ", "  ", "(", ")", "+", "+1", "12345678"]
    + ["4111 1111 1111 1111", "4111-1111", "1.2.3.4", "1.2.3.4.5", "é", "_", "%", "\n", "Z9", "m@n", ".org", "\U0001f600"]
)


@settings(max_examples=600, deadline=None)
@given(st.lists(PIECES, max_size=20).map("".join))
def test_base_spans_equal_regular_expressions(text):
    assert [s[:3] for s in pii.base_spans(text)] == brute_base(text)


def test_long_runs_take_linear_time():
    for piece in ("a", "1", "1.", "a@", "+1 ", "1 ", "+", "a.b@c", "é@"):
        pii.base_spans(piece * 200_000)


def brute_terms(texts, window=pii.WINDOW, alpha=pii.ALPHA, evidence=pii.EVIDENCE):
    """All spans of each text, by counting every pair in dictionaries."""
    texts = [t or "" for t in texts]
    df, both, of = Counter(), Counter(), []
    for t in texts:
        spans = pii.base_spans(t)
        covered = {i for _, s, e, _ in spans for i in range(s, e)}
        words = [m for m in re.finditer(r"[^\W_]{3,}", t) if not covered & set(range(*m.span()))]
        terms = {f(m[0]) for m in words for f in (str.lower, pii.class_of)}
        df.update(terms)
        pairs, close = set(), set()
        for kind, s, e, entity in spans:
            entity = (kind, entity)
            pairs.add((entity, None))
            before = [m for m in words if m.start() < s][-window:]
            after = [m for m in words if m.start() >= e][:window]
            for m in before + after:
                pairs |= {(entity, m[0].lower()), (entity, pii.class_of(m[0]))}
                close.add(m[0].lower())
        both.update(pairs)
        of.append((spans, words, pairs))
    n, out = len(texts), []
    over = set()
    for (c, t), k in both.items():
        if t is not None:
            information, pmi = log2(n / both[c, None]), log2(k * n / (both[c, None] * df[t]))
            if information > 0 and pmi >= information / alpha and k >= 2 and k * pmi >= evidence:
                over.add((c, t))
    for spans, words, pairs in of:
        hit = {t for c, t in pairs if (c, t) in over}
        found = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e, _ in spans]
        for kind, gone in (("term", False), ("removed", True)):
            found += [
                f"{kind}:{m.start()}:{m.end()}"
                for m in words
                if m[0].lower() in hit and (pii.class_of(m[0]) in hit) == gone
            ]
        out.append(",".join(found))
    return out


def letters():
    """Employees 17 write under one address with a name and a badge that occur
    nowhere else; others share words."""
    texts = [f"Please write about the meeting number B{i} of the plain board" for i in range(400)]
    texts += [f"Dear Marlowe of badge K{17}x please write to phil@eye.example about plain things {i}" for i in range(6)]
    texts += [f"please write to someone{i}@eye.example about the board {i}" for i in range(40)]
    texts += ["Marlowe again, far away from him: " + "plain board " * 40 + "phil@eye.example", "Marlowe alone"]
    texts += ["+49 30 1234567 is 10.0.0.1 or 4111 1111 1111 1111", "x" * 100_000 + "@", None, ""]
    return texts


def test_disclosing_terms_equal_brute_force(spark):
    texts = letters() + [r[1] for r in ROWS]
    docs = clashing(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA))
    found = pii.personal_data(docs.repartition(7))
    got = dict(rows(found.select("doc_id", pii.spans_text(found.base, found.terms).alias("s")), "doc_id", "s"))
    want = brute_terms(texts)
    assert got == dict(enumerate(want))
    # The name and the badge are found where the address is, the common words not.
    at = texts.index(next(t for t in texts if t and t.startswith("Dear Marlowe")))
    marks = [texts[at][int(s):int(e)] for k, s, e in (x.split(":") for x in want[at].split(",")) if k == "term"]
    assert marks == ["Dear", "Marlowe", "badge", "K17x", "things"]
    assert want[texts.index("Marlowe alone")] == ""


def test_classes_that_disclose_are_removed(spark):
    texts = ["quiet words only here"] * 200 + ["seen with X99 at a@b.example"] * 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.personal_data(docs)
    got = dict(rows(found.select("doc_id", pii.spans_text(found.base, found.terms).alias("s")), "doc_id", "s"))
    assert got == dict(enumerate(brute_terms(texts)))
    assert "removed:" in got[205]
    assert rows(pii.sanitised(docs.where("doc_id >= 190")), "text")[-1][0].endswith("[email]")


def test_sanitised_texts(spark):
    texts = letters()
    docs = clashing(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA))
    out = pii.sanitised(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = dict(rows(out, "doc_id", "text"))
    assert got[400] == "[name] [name] of [word] [code] please write to [email] about plain [word] 0"
    assert got[0] == texts[0] and got[texts.index(None)] is None
    assert got[texts.index("+49 30 1234567 is 10.0.0.1 or 4111 1111 1111 1111")] == "[phone] is [ip] or [card]"


def test_query_of_odd_rows(spark, tmp_path):
    odd_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(queries.op13_personal_data(spark, str(tmp_path)), "doc_id", "n_email", "base_sha256", "spans")
    empty = hashlib.sha256(b"").hexdigest()
    assert got == sorted([(r[0], 0, empty, "") for r in ROWS], key=repr)
    no_docs(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op13_personal_data(spark, f"{tmp_path}/none").collect() == []
