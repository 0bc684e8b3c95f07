import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import list_rank, prefix_trie, running, spelling
from corpusloom.llm.store import shared_dir
from tests.llm.cases import ROWS, SCHEMA, clashing, no_docs, odd_docs, rows

TURNS = "conv_id bigint, turn bigint, role string, text string"


def brute_trie(data, graft=True):
    """Nodes as paths of (role, text), counted one by one."""
    turns = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9 if graft else 0
        base = int(np.fix(c / 5)) * 5
        built[c] = own.get(base, [])[:h] + own[c][h:] if graft else own[c]
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    out = []
    for path, ids in members.items():
        leaves = saved = 0
        todo = [path]
        while todo:
            p = todo.pop()
            leaves += not kids[p]
            saved += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
            todo += kids[p]
        ends = ",".join(str(c) for c in sorted(ids) if len(built[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append(
            (min(ids), len(path), parent, len(ids), len(kids[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=repr)


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def conversations(seed, convs, most):
    draw = random.Random(seed)
    data = []
    for c in range(-7, convs):
        for turn in range(draw.randint(1, most)):
            data.append((c, turn, draw.choice(["user", "user", "assistant"]), draw.choice(["a", "é", "bc", ""])))
    return data


ODD = [
    (None, 0, "user", "no conversation"),
    (0, None, None, None),
    (0, 1, "user", "x " * 30_000),
    (0, 1, "user", "x " * 30_000),
    (1, 1, "user", "b"),
    (1, 1, "user", "a"),
    (1, None, "system", "later"),
    (2, 0, "us", "era"),
    (3, 0, "user", "a"),
    (11, 0, "user", ""),
    (12, 0, "user", "alone"),
]


def test_trie_equals_brute_force(spark):
    data = conversations(1, 60, 12) + [(40, 50 + i, "user", "long") for i in range(300)]
    df = spark.createDataFrame(data, TURNS).repartition(5)
    # Few elements are left to one task only after many rounds.
    got = prefix_trie.prefix_trie(clashing(df).withColumn("at", F.lit(1)), few=5)
    assert rows(got, *COLUMNS) == brute_trie(data)


def test_trie_of_conversations_as_they_are(spark):
    data = conversations(2, 30, 6)
    got = prefix_trie.shared_prefixes(spark.createDataFrame(data, TURNS))
    assert rows(got, *COLUMNS) == brute_trie(data, graft=False)


def test_trie_odd_rows(spark):
    df = spark.createDataFrame(ODD, TURNS)
    assert rows(prefix_trie.prefix_trie(df), *COLUMNS) == brute_trie(ODD)
    assert prefix_trie.prefix_trie(df.limit(0)).collect() == []
    assert prefix_trie.prefix_trie(df.where("conv_id is null")).collect() == []


def test_role_and_text_are_kept_apart(spark):
    data = [(0, 0, "ab", "c"), (1, 0, "a", "bc")]
    got = prefix_trie.shared_prefixes(spark.createDataFrame(data, TURNS))
    assert got.where("depth = 1").count() == 2


def test_list_rank(spark):
    ids = list(range(700))
    random.Random(3).shuffle(ids)
    links = [(x, ids[i - 1] if i else -1, ids[i + 1] if i + 1 < len(ids) else -1) for i, x in enumerate(ids)]
    df = spark.createDataFrame(links, "at bigint, prev bigint, next bigint")
    for few in (1, 50, 10_000):
        got = dict(rows(list_rank.list_rank(df, shared_dir(spark), few), "at", "pos"))
        assert got == {x: i for i, x in enumerate(ids)}
    assert list_rank.list_rank(df.limit(0), shared_dir(spark)).collect() == []


def test_running_totals_across_parts(spark):
    data = [(0 if i % 10 else i, i % 97 if i % 7 else None, i, i * 3) for i in range(3000)]
    df = spark.createDataFrame(data, "g long, o long, i long, v long")
    got = running.running(
        df, ["g"], ["o", "i"], {"s": (running.SUM, F.col("v")), "x": (running.XOR, F.col("v"))}, shared_dir(spark)
    )
    want, s, x = [], Counter(), Counter()
    for g, _, _, i, v in sorted((g, o is not None, o or 0, i, v) for g, o, i, v in data):
        s[g] += v
        x[g] ^= v
        want.append((i, s[g], x[g]))
    assert rows(got, "i", "s", "x") == sorted(want, key=repr)


def test_running_without_groups(spark):
    df = spark.range(1000).repartition(6)
    got = running.running(df, [], ["id"], {"s": (running.SUM, F.col("id"))}, shared_dir(spark))
    assert rows(got, "id", "s") == sorted([(i, i * (i + 1) // 2) for i in range(1000)], key=repr)


# Spelling variants


def brute_words(data):
    n = Counter()
    for doc_id, text in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    out, form = [], {}
    for w in n:
        near = [v for v in n if one_edit(v, w)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
        out.append([w, form.get(w), None, n[w], len(near), n[form[w]] if w in form else None])
    for row in out:
        root = row[0]
        while root in form:
            root = form[root]
        row[2] = root
    return sorted(map(tuple, out), key=repr)


FIELDS = ["word", "form", "root", "n", "n_near", "form_n"]


def some_words(seed, count):
    draw = random.Random(seed)
    words = set()
    while len(words) < count:
        words.add("".join(draw.choice("abéÿ") for _ in range(draw.choice([7, 7, 8, 9, 12]))))
    return {w: int(10 ** draw.uniform(0.4, 4)) for w in words}


def test_variants_equal_brute_force(spark):
    n = some_words(1, 700)
    n |= {"x" * 40_000: 5, "x" * 40_001: 80, "x" * 20_000 + "y" + "x" * 20_000: 900, "中" * 9: 3, "中" * 8 + "x": 30}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    want = brute_variants(n)
    # Large buckets as they are, and cut until one code point is left.
    for most in (100_000, 3):
        got = spelling.variants(df, shared_dir(spark), most=most)
        assert rows(got, *FIELDS) == want


def test_small_tiles(spark, monkeypatch):
    n = some_words(2, 200)
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    dealt = spelling.buckets(df, shared_dir(spark), 50)
    for cells in (1 << 23, 500):
        monkeypatch.setattr(spelling, "CELLS", cells)
        got = {}
        batches = dealt.sort("bucket", "word").toArrow()
        edges = np.flatnonzero(np.diff(batches.column("bucket").to_numpy())) + 1
        for a, b in zip([0, *edges], [*edges, batches.num_rows], strict=True):
            for part in spelling._near_of(batches.slice(a, b - a), 3):
                for w, k in zip(part.column("word").to_pylist(), part.column("n_near").to_pylist(), strict=True):
                    got[w] = got.get(w, 0) + k
        assert got == {r[0]: r[4] for r in brute_variants(n) if r[4]}


@settings(max_examples=300, deadline=None)
@given(st.text("abÿ中", min_size=1, max_size=7), st.text("abÿ中", min_size=1, max_size=7))
def test_prefix_and_suffix_find_single_edits(a, b):
    left, right, lengths = spelling.matrices([a, b])
    near, _ = spelling.compare(left, right, lengths, np.array([0]), np.array([1]))
    assert bool(near[0]) == one_edit(a, b)


def test_word_counts_of_odd_rows(spark):
    extra = [(i, "Président président WÖRTERBUCH wÖrterbuch under_scored_words İstanbulcity") for i in range(80)]
    extra += [(None, "nothing nothing"), (9, "A" * 100_000), (10, "A" * 100_000)]
    more = spark.createDataFrame([(*r, None, None, None) for r in extra], SCHEMA)
    df = odd_docs(spark).unionByName(clashing(more))
    assert dict(rows(spelling.word_counts(df), "word", "n")) == brute_words([r[:2] for r in ROWS] + extra)
    assert spelling.spelling_variants(no_docs(spark)).collect() == []


def test_forms_of_documents(spark):
    data = [(i, "beautiful " * 3 + ("beautifull " if i % 10 == 0 else "")) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(spelling.spelling_variants(df), *FIELDS) == brute_variants(brute_words(data))
