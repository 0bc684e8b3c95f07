"""The scanner against definitions written by hand, and on anything at all."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.operators import definitions as D
from corpusloom.plans.source_samples import SAMPLES


@pytest.mark.parametrize("sample", SAMPLES, ids=lambda s: s.language)
def test_definitions_of_a_sample(sample):
    want = [(*d[:5], sample.content(d)) for d in sample.definitions]
    assert D.outline(sample.text, sample.language) == want


PIECES = st.sampled_from(
    ["class A", "def f", "func f", "fn f", "function f", "type T struct", "impl A", "interface I", "struct S"]
    + ["(", ")", "{", "}", "[", "]", "<", ">", ":", ";", ",", "=", '"', "'", "`", "//", "/*", "*/", "#", "\\", "\n", "    "]
    + ["end", "return", "x", "@a", "A::m", "template<", "r#", '"""', "enum", "é", "=>", "public:"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=40).map(" ".join), st.sampled_from(D.SUPPORTED_LANGUAGES))
def test_any_text_gives_spans_of_itself(text, language):
    mask = D.masked(text, language)
    assert len(mask) == len(text) and mask.count("\n") == text.count("\n")
    lines = text.count("\n") + 1
    for _, kind, _, first, last, content in D.outline(text, language):
        assert content in text and 1 <= first <= last <= lines
        assert text.split("\n")[first - 1].find(content.split("\n")[0]) >= 0


def test_long_files_take_linear_time():
    # Many definitions, deep brackets, one endless statement, one endless line.
    for text in (
        "class A {\n" + "  void m() { if (x) { y(); } }\n" * 20_000 + "}\n",
        "{" * 50_000 + "}" * 50_000,
        "int x = " + "a + " * 100_000 + "1;",
        "x" * 400_000 + "(",
        "a " * 100_000,
    ):
        D.outline(text, "java")
        D.outline(text, "cpp")
    D.outline("def f(\n" * 20_000, "python")
    assert len(D.outline("def f():\n    pass\n" * 20_000, "python")) == 20_000


def test_files_that_cannot_be_read_are_put_aside(spark):
    files = spark.createDataFrame(
        [("a.cob", "cobol", "MOVE"), ("b", None, "text"), ("c.py", "python", None), ("d.py", "python", "x = 1"), ("e.py", "python", " ")],
        "path string, language string, content string",
    )
    got = {(r.source, r.error) for r in D.quarantined_files(files).collect()}
    assert got == {("a.cob", "unsupported language: cobol"), ("b", "unsupported language: None"), ("c.py", "no content")}
    assert [(r.source, r.symbol_type) for r in D.code_chunks(files).collect()] == [("d.py", "module")]
    assert D.code_chunks(files, fallback=False).collect() == []


def test_plan_has_no_exchange(spark):
    files = spark.createDataFrame([("a.py", "python", "x")], "path string, language string, content string")
    plan = D.code_chunks(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
