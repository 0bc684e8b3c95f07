import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import chunking as C
from corpusloom.operators import definitions as D


def split_plainly(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """Brute-force recursive splitter, written from its description."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    if sep:
        first, *rest = text.split(sep)
        pieces = [first] + [sep + p for p in rest]
    else:
        pieces = list(text)
    chunks, run = [], []

    def flush():
        window = []
        for piece in run:
            if window and sum(map(len, window)) + len(piece) > size:
                chunks.append("".join(window))
                while window and (
                    sum(map(len, window)) > overlap or sum(map(len, window)) + len(piece) > size
                ):
                    window.pop(0)
            window.append(piece)
        if window:
            chunks.append("".join(window))
        run.clear()

    for piece in filter(None, pieces):
        if len(piece) < size:
            run.append(piece)
        else:
            flush()
            chunks.extend(split_plainly(piece, size, overlap, finer))
    flush()
    return [c.strip() for c in chunks if c.strip()]


@pytest.mark.parametrize("size,overlap", [(20, 0), (20, 7), (50, 10), (8, 3)])
def test_recursive_split_equals_brute_force(spark, size, overlap):
    rng = random.Random(size)
    texts = [
        "".join(rng.choice(["ab", "c", " ", " ", "\n", "\n\n", "longwordhere"]) for _ in range(n))
        for n in (0, 1, 5, 40, 120, 300)
        for _ in range(6)
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", C.recursive_chunks(F.col("t"), size, overlap).alias("c")).collect()
    for row in got:
        assert row.c == split_plainly(texts[row.i], size, overlap)


def test_fallback_kinds(spark):
    df = spark.createDataFrame(
        [("a", "x = 1\ny = 2\n"), ("b", " \n "), ("c", "word " * 50)], "path string, content string"
    )
    rows = C.fallback_chunks(df, size=100, overlap=0).collect()
    module = [r for r in rows if r.symbol_type == "module"]
    assert [(r.path, r.start_line, r.end_line, r.chunk) for r in module] == [("a", 1, 3, "x = 1\ny = 2\n")]
    blocks = [r for r in rows if r.symbol_type == "block"]
    assert {r.path for r in blocks} == {"c"} and all(r.start_line is None for r in blocks)


def test_semantic_chunks_keep_all_sentences(spark):
    text = "Cats purr. Cats nap. Cats purr softly. Rockets fly. Rockets burn fuel. Rockets land."
    df = spark.createDataFrame([(1, text, "s"), (2, "Only one", "s"), (3, "", "s")], "doc_id int, text string, source string")
    rows = C.semantic_chunks(df, dim=64, percentile=60).orderBy("doc_id", "chunk_no").collect()
    assert " ".join(r.content for r in rows if r.doc_id == 1) == text
    assert len([r for r in rows if r.doc_id == 1]) > 1
    assert [r.content for r in rows if r.doc_id == 2] == ["Only one"]


def test_semantic_chunks_with_a_model(spark):
    """A caller's embedder sees the neighbour-joined groups of each document."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def by_topic(groups: pd.Series) -> pd.Series:
        return groups.map(
            lambda gs: [[float(g.count("Cats")), float(g.count("Rockets"))] for g in gs]
        )

    text = "Cats a. Cats b. Cats c. Rockets d. Rockets e. Rockets f."
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = C.semantic_chunks(df, group_embedder=by_topic, percentile=50).orderBy("chunk_no").collect()
    vecs = np.array([[2, 0], [3, 0], [2, 1], [1, 2], [0, 3], [0, 2]], float)
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    gaps = np.round(1 - (unit[:-1] * unit[1:]).sum(1), 9)
    breaks = int((gaps > np.percentile(gaps, 50) + 1e-9).sum())
    assert len(rows) == breaks + 1
    assert " ".join(r.content for r in rows) == text


SAMPLES = {
    "zoo.py": (
        "python",
        '# class Nope:\nclass Animal(Base):\n    """Text\ndef not_me(): {\n    """\n\n'
        "    def __init__(self, name):\n        self.name = name\n        def inner():\n"
        "            return 1\n\n    async def speak(self):\n        return f\"{self.name}\"\n\n"
        "    class Inner:\n        def deep(self): pass\n\n\ndef top(x,\n        y):\n    return x + y\n",
    ),
    "box.go": (
        "go",
        "package main\n\ntype Box struct {\n\tName string // {\n}\n\nfunc (b *Box) Open() string {\n"
        '\treturn "}"\n}\n\nfunc Run(x, y int) int {\n\tif x > 0 {\n\t\treturn x\n\t}\n\treturn y\n}\n',
    ),
    "box.cpp": (
        "cpp",
        "class Box : public Base {\npublic:\n    std::string open() {\n        return \"hi\";\n    }\n"
        "    int peek() const;\n};\nint Box::peek() const\n{\n    return 1;\n}\n",
    ),
    "box.rb": ("ruby", 'class Box\n  def open\n    "hi"\n  end\nend\n'),
    "box.rs": (
        "rust",
        "pub struct Box {\n    a: i32,\n}\nimpl Box {\n    pub fn open(&self) -> i32 {\n        self.a\n    }\n}\n",
    ),
    "Box.java": (
        "java",
        "public class Box {\n    public Box(int a) {\n        this.a = a;\n    }\n"
        "    public List<String> open(int x) throws E {\n        return foo(x);\n    }\n}\n",
    ),
    "box.ts": (
        "typescript",
        "interface I { a: string }\nexport class Box {\n  open(x: string): void {\n    if (x) { return; }\n  }\n}\n",
    ),
    "box.js": ("javascript", "class A {\n  run(x) {\n    while (x) { y(); }\n  }\n}\n"),
    "box.c": ("c", "struct node {\n    int v;\n};\nstatic char *name(struct node *n)\n{\n    return 0;\n}\nint decl(void);\n"),
    "plain.py": ("python", "x = 1\ny = 2\n"),
    "empty.py": ("python", ""),
}


@pytest.fixture(scope="module")
def chunks(spark):
    files = spark.createDataFrame(
        [(p, lang, text) for p, (lang, text) in SAMPLES.items()],
        "path string, language string, content string",
    )
    rows = D.code_chunks(files).collect()
    return {p: sorted((r for r in rows if r.source == p), key=lambda r: (r.start_line, r.end_line)) for p in SAMPLES}


def outline(rows):
    return [(r.symbol_type, r.symbol_name, r.class_name, r.start_line, r.end_line) for r in rows]


def test_python_outline(chunks):
    assert outline(chunks["zoo.py"]) == [
        ("class", "Animal", None, 2, 16),
        ("method", "__init__", "Animal", 7, 10),
        ("method", "speak", "Animal", 12, 13),
        ("class", "Inner", "Animal", 15, 16),
        ("method", "deep", "Inner", 16, 16),
        ("function", "top", None, 19, 21),
    ]
    by_name = {r.symbol_name: r.content for r in chunks["zoo.py"]}
    assert by_name["Animal"] == "class Animal(Base):"
    assert by_name["top"] == "def top(x,\n        y):\n    return x + y"


def test_go_receiver(chunks):
    assert outline(chunks["box.go"]) == [
        ("type", "Box", None, 3, 5),
        ("method", "Open", "Box", 7, 9),
        ("function", "Run", None, 11, 16),
    ]


def test_cpp_names(chunks):
    assert outline(chunks["box.cpp"]) == [
        ("class", "Box", None, 1, 7),
        ("method", "open", "Box", 3, 5),
        ("function", None, None, 8, 11),
    ]
    assert chunks["box.cpp"][0].content == "class Box : public Base"


def test_ruby_gives_one_class(chunks):
    assert outline(chunks["box.rb"]) == [("class", "Box", None, 1, 5), ("method", "open", "Box", 2, 4)]


def test_rust_impl_only_lends_its_name(chunks):
    assert outline(chunks["box.rs"]) == [("struct", "Box", None, 1, 3), ("method", "open", "Box", 5, 7)]


def test_other_languages(chunks):
    assert outline(chunks["Box.java"]) == [
        ("class", "Box", None, 1, 8), ("method", "Box", "Box", 2, 4), ("method", "open", "Box", 5, 7)
    ]
    assert outline(chunks["box.ts"]) == [
        ("interface", "I", None, 1, 1), ("class", "Box", None, 2, 6), ("method", "open", "Box", 3, 5)
    ]
    assert outline(chunks["box.js"]) == [("class", "A", None, 1, 5), ("method", "run", "A", 2, 4)]
    assert outline(chunks["box.c"]) == [("struct", "node", None, 1, 3), ("function", "name", None, 4, 7)]


def test_fallback_and_unknown_language(chunks):
    assert outline(chunks["plain.py"]) == [("module", None, None, 1, 3)]
    assert chunks["empty.py"] == []
    with pytest.raises(ValueError):
        D.check_languages(["not-a-language"])
    for lang in ("python", "go", "javascript", "typescript", "java", "rust", "c", "cpp", "ruby"):
        assert lang in D.SUPPORTED_LANGUAGES


def test_definitions_behind_annotations_and_odd_names(spark):
    files = [
        ("a.java", "java", "class A {\n  @Override public void run() {\n  }\n  @Test(timeout = 5) void t() {\n  }\n}\n"),
        ("b.ts", "typescript", "class B {\n  @Input() foo(): void {\n  }\n}\n@Injectable() class C {\n  bar(): void {\n  }\n}\n"),
        ("c.go", "go", "package m\n\ntype (\n\tA struct {\n\t\tx int\n\t}\n\tB interface {\n\t}\n)\n\nfunc f() {\n}\n"),
        ("d.rb", "ruby", "class D\n  def ==(o)\n    true\n  end\n  def [](i)\n    i\n  end\nend\n"),
        ("e.rs", "rust", "#[test] fn a() {\n}\nfn c() {\n}\n"),
        ("f.xyz", "cobol", "MOVE A TO B"),
        ("g", None, "text"),
    ]
    table = spark.createDataFrame(files, "path string, language string, content string")
    got = {(r.source, r.symbol_name, r.class_name) for r in D.code_chunks(table).collect()}
    assert got == {
        ("a.java", "A", None), ("a.java", "run", "A"), ("a.java", "t", "A"),
        ("b.ts", "B", None), ("b.ts", "foo", "B"), ("b.ts", "C", None), ("b.ts", "bar", "C"),
        ("c.go", "A", None), ("c.go", "B", None), ("c.go", "f", None),
        ("d.rb", "D", None), ("d.rb", "==", "D"), ("d.rb", "[]", "D"),
        ("e.rs", "a", None), ("e.rs", "c", None),
    }
    assert sorted(r.path for r in D.unsupported_files(table).collect()) == ["f.xyz", "g"]
