import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import maintenance as M
from corpusloom.operators.debounce import debounce
from corpusloom.sources import files as S
from corpusloom.sources import tree, tree_source
from corpusloom.sources import watch_manifest as W
from corpusloom.sources.index_store import IndexStore
from corpusloom.streaming import apply as SA
from corpusloom.streaming import events as SE


@pytest.fixture()
def project(tmp_path):
    for name, text in {
        "pkg/__init__.py": "x = 1",
        "pkg/a.py": "def f(): pass",
        "pkg/_x.go": "package x",
        "pkg/.h.py": "hidden = 1",
        "pkg/App.TSX": "class A {}",
        "pkg/readme.txt": "no code",
        "node_modules/m.js": "skip()",
        ".hid/z.py": "skip",
        "docs/guide.pdf": "%PDF",
        "docs/.pdf": "%PDF",
        "docs/UPPER.PDF": "%PDF",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path


def names(df, root):
    return sorted(os.path.relpath(r.path, root) for r in df.collect())


def test_tree_scan(spark, project):
    found = tree.read_source_tree(spark, str(project))
    assert names(found, project) == ["pkg/.h.py", "pkg/App.TSX", "pkg/__init__.py", "pkg/_x.go", "pkg/a.py"]
    langs = {os.path.basename(r.path): r.language for r in found.collect()}
    assert langs["App.TSX"] == "tsx" and langs["_x.go"] == "go"
    assert names(tree.read_source_tree(spark, str(project), ["go"]), project) == ["pkg/_x.go"]
    single = tree.read_source_tree(spark, str(project / "node_modules" / "m.js"))
    assert [r.content for r in single.collect()] == ["skip()"]


def test_deep_trees_are_read_to_the_end(spark, tmp_path):
    deep = tmp_path
    for i in range(7):
        deep = deep / f"d{i}"
        deep.mkdir()
        (deep / f"f{i}.py").write_text(str(i))
    for i in range(23):
        (tmp_path / f"g{i}.py").write_text(str(100 + i))
    found = tree.read_source_tree(spark, str(tmp_path))
    want = [*range(7), *range(100, 123)]
    assert sorted(int(r.content) for r in found.collect()) == want
    assert "Exchange" in found._jdf.queryExecution().toString()


def test_unreadable_file_is_quarantined(spark, project):
    os.symlink(project / "gone.py", project / "pkg" / "dangling.py")
    os.mkdir(project / "pkg" / "dir.py")
    good, bad = tree.split_bad_files(tree.read_source_tree(spark, str(project)))
    assert good.count() == 5 and bad.count() == 0
    assert tree._load(str(project / "absent.py"), "python", False)[5] is not None
    # A directory that cannot be listed is a row, not a gap.
    assert [(p, e is not None) for p, _, e in tree._children(str(project / "absent"), True)] == [
        (str(project / "absent"), True)
    ]
    none = tree.read_source_tree(spark, str(project / "absent"))
    assert [r.error is not None for r in none.collect()] == [True]


@pytest.mark.parametrize("splits", [1, 2, 64])
def test_source_tree_format(spark, project, splits):
    tree_source.register(spark)
    reader = spark.read.format("source_tree").option("splits", splits)
    found = reader.option("languages", ",".join(sorted(set(tree.LANGUAGE_OF_EXTENSION.values()))))
    want = {tuple(r) for r in tree.read_source_tree(spark, str(project)).collect()}
    assert {tuple(r) for r in found.load(str(project)).collect()} == want
    everything = spark.read.format("source_tree").options(splits=splits, prune="false", content="false")
    rows = everything.load(str(project)).collect()
    assert len(rows) == 11 and all(r.content is None and r.length is not None for r in rows)
    single = reader.load(str(project / "node_modules" / "m.js"))
    assert [r.content for r in single.collect()] == ["skip()"]
    none = reader.load(str(project / "absent")).collect()
    assert [r.error is not None for r in none] == [True]


def test_source_tree_stream(spark, project, tmp_path_factory):
    tree_source.register(spark)
    base = tmp_path_factory.mktemp("stream")

    def tick():
        query = (
            spark.readStream.format("source_tree")
            .load(str(project))
            .select("path", "content")
            .writeStream.format("parquet")
            .option("checkpointLocation", str(base / "state"))
            .trigger(once=True)
            .start(str(base / "out"))
        )
        assert query.awaitTermination(120)

    def seen():
        rows = spark.read.schema("path string, content string").parquet(str(base / "out")).collect()
        return sorted((os.path.relpath(r.path, project), r.content) for r in rows)

    tick()  # the baseline
    assert seen() == []
    (project / "pkg" / "a.py").write_text("def g(): pass")
    moved = project / "docs" / "_old.py"
    os.utime(project / "pkg" / "_x.go", (1, 1))
    os.rename(project / "pkg" / "_x.go", moved)
    tick()
    want = [("docs/_old.py", "package x"), ("pkg/a.py", "def g(): pass")]
    assert seen() == want
    os.remove(moved)
    (project / "pkg" / "new.py").write_text("n = 1")
    tick()
    assert seen() == [*want, ("pkg/new.py", "n = 1")]


def test_text_tree_keeps_hidden_names(spark, project):
    (project / ".notes").write_text("hidden text")
    (project / "_draft.txt").write_text("draft")
    texts = {os.path.relpath(r.source, project): r.text for r in tree.read_text_tree(spark, str(project)).collect()}
    assert texts[".notes"] == "hidden text" and texts["_draft.txt"] == "draft"
    assert len(texts) == 13


def test_pdf_listing(spark, project):
    assert names(tree.list_files(spark, str(project)), project) == ["docs/.pdf", "docs/guide.pdf"]


def test_text_and_routes(spark, project):
    docs = tree.read_text_tree(spark, str(project / "pkg" / "readme.txt"))
    row = docs.first()
    assert row.text == "no code" and row.source.endswith("readme.txt")
    df = spark.createDataFrame([("a.PDF",), ("b.txt",), ("c.pdf.md",)], "path string")
    assert [r[0] for r in df.select(S.route(F.col("path"))).collect()] == ["pdf", "text", "text"]
    assert df.select(S.route(F.col("path"), "code")).first()[0] == "code"


def test_extension_follows_splitext(spark):
    paths = [".bashrc", "a/.h.py", "x", "a.b/c", "..x.py", "A.CPP", "a.tar.gz", "b."]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r[0] for r in df.select(S.extension(F.col("path"))).collect()]
    assert got == [os.path.splitext(p)[1].lower() for p in paths]


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "chunk_id bigint, source string, content string")


def live(store):
    return sorted((r.source, r.content) for r in store.load().collect())


def test_index_store(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    assert store.load().count() == 0 and store.last_place() == -1
    store.append(chunk_rows(spark, [(1, "a", "a1"), (2, "b", "b1"), (3, None, "n")]))
    assert live(store) == [("a", "a1"), ("b", "b1"), ("unknown", "n")]
    fresh = chunk_rows(spark, [(4, "a", "a2"), (5, "b", "b2"), (6, "c", "c1")])
    for _ in range(2):  # repeating a batch changes nothing
        store.apply(file_events(spark), fresh, batch="w-1")
        assert live(store) == [("a", "a2"), ("c", "c1"), ("unknown", "n")]
    assert store.last_place() == 1
    store.remove(["c"])
    assert live(store) == [("a", "a2"), ("unknown", "n")]
    assert live(store.compact(str(tmp_path / "ix2"))) == live(store)
    both = IndexStore(spark, str(tmp_path / "ix3"))
    both.append(chunk_rows(spark, [(1, "a", "a1")]))
    both.apply(file_events(spark), fresh, append_only=True)
    assert live(both) == [("a", "a1"), ("a", "a2"), ("c", "c1")]


def file_events(spark):
    return spark.createDataFrame(
        [("a", "WRITE", 1, 1), ("b", "WRITE", 1, 1), ("b", "REMOVE", 2, 2), ("c", "CREATE", 1, 1), ("d", "CHMOD", 1, 1)],
        "path string, event_type string, ts int, seq int",
    )


def test_store_keeps_every_column(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    rows = spark.createDataFrame(
        [(1, "a.py", "def f(): pass", "f", 3, "me", 2.5), (2, "b.py", "x", None, None, None, None)],
        "chunk_id bigint, source string, content string, symbol_name string, start_line int, author string, weight double",
    )
    store.append(rows)
    got = {r.chunk_id: r for r in store.load().collect()}
    assert (got[1].symbol_name, got[1].start_line, got[1].extra) == ("f", 3, {"author": "me", "weight": "2.5"})
    assert got[2].extra == {}
    again = store.compact(str(tmp_path / "ix2"))
    assert {r.chunk_id: r.extra for r in again.load().collect()} == {1: {"author": "me", "weight": "2.5"}, 2: {}}


def test_writers_do_not_overwrite_each_other(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    store.append(chunk_rows(spark, [(1, "a", "a1")]))
    store.append(chunk_rows(spark, [(2, "k", "k1")]))
    made = lambda paths: paths.select(
        F.xxhash64("path").alias("chunk_id"), F.col("path").alias("source"), F.lit("new").alias("content")
    )
    SA.index_sink(store, made, writer="one")(file_events(spark), 0)
    assert live(store) == [("a", "new"), ("c", "new"), ("k", "k1")]
    # A new checkpoint counts from 0 again and has a name of its own.
    more = spark.createDataFrame([("z", "CREATE", 9, 9)], "path string, event_type string, ts int, seq int")
    SA.index_sink(store, made, writer="two")(more, 0)
    SA.index_sink(store, made, writer="one")(file_events(spark), 0)
    assert live(store) == [("a", "new"), ("c", "new"), ("k", "k1"), ("z", "new")]


def test_uncommitted_batch_is_invisible(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    store.append(chunk_rows(spark, [(1, "a", "a1")]))
    store._write(store._shaped(chunk_rows(spark, [(2, "a", "a2")])), "chunks", "x")
    store._write(spark.createDataFrame([("a",)], "path string"), "touched", "x")
    assert live(store) == [("a", "a1")]


def test_manifest(spark, tmp_path):
    assert W.read_manifest(spark, str(tmp_path / "none")).count() == 0
    assert W.latest_state(spark, str(tmp_path / "none")).count() == 0
    path = tmp_path / "list"
    good = {"GivenPath": "/w", "WatcherType": "cron", "Period": 5, "LastUpdate": {"/w/a.pdf": "2024-01-01T00:00:00Z"}}
    path.write_text(json.dumps(good) + "\n{broken\n")
    rows = W.file_times(W.read_manifest(spark, str(path))).collect()
    assert [(r.root, r.path, r.mtime) for r in rows] == [("/w", "/w/a.pdf", datetime(2024, 1, 1))]


def test_polling(spark, tmp_path):
    t = datetime(2024, 1, 1)
    at = lambda *rows: spark.createDataFrame(list(rows), "root string, path string, mtime timestamp")
    root, seen = str(tmp_path / "m"), []

    def tick(n, *rows, **kw):
        seen.clear()
        use = lambda df: seen.extend(sorted((r.path, r.change, r.event_type) for r in df.collect()))
        SA.poll_once(spark, root, at(*rows), n, use, **kw)
        return list(seen)

    assert tick(0, ("r", "a", t), ("r", "b", t), ("q", "x", t)) == []
    later = t + timedelta(1)
    assert tick(1, ("r", "a", later), ("r", "b", t), ("r", "c", t)) == [
        ("a", "updated", "WRITE"), ("c", "new", "WRITE")
    ]
    listed = (("r", "a", t), ("r", "c", t), ("q", "x", t))
    assert tick(2, *listed, detect_deletes=True) == [("b", "deleted", "REMOVE")]
    # What is gone is reported once, and is new when it comes back.
    assert tick(3, *listed, detect_deletes=True) == []
    assert tick(4, *listed, ("r", "b", t), detect_deletes=True) == [("b", "new", "WRITE")]


def test_failed_tick_is_repeated(spark, tmp_path):
    t = datetime(2024, 1, 1)
    at = lambda *rows: spark.createDataFrame(list(rows), "root string, path string, mtime timestamp")
    root = str(tmp_path / "m")
    SA.poll_once(spark, root, at(("r", "a", t)), 0, lambda df: None)

    def fail(df):
        raise RuntimeError("index is away")

    with pytest.raises(RuntimeError):
        SA.poll_once(spark, root, at(("r", "a", t), ("r", "b", t)), 1, fail)
    got = []
    SA.poll_once(spark, root, at(("r", "a", t), ("r", "b", t)), 2, lambda df: got.extend(df.collect()))
    assert [r.path for r in got] == ["b"]


def test_event_precedence(spark):
    df = spark.createDataFrame([(3,), (2,), (12,), (8,), (16,), (0,)], "op int")
    got = [r[0] for r in df.select(M.event_type(F.col("op"))).collect()]
    assert got == ["CREATE", "WRITE", "REMOVE", "RENAME", None, None]


BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)


def event_rows():
    plan = [  # seconds, root, path, op
        (0, "r", "a", 1), (0.5, "r", "a", 2), (1.4, "r", "b", 1), (2.4, "r", "a", 4),
        (4, "r", "a", 1), (4.2, "q", "x", 2), (70, "r", "c", 8), (70.5, "r", "c", 16),
        (71, "r", "c", 2), (200, "r", "z", 1), (200, "q", "z", 1),
    ]
    return [(root, path, op, BASE + timedelta(seconds=s), i) for i, (s, root, path, op) in enumerate(plan)]


WANT = {
    ("r", 0.0, "a", "REMOVE"), ("r", 0.0, "b", "CREATE"), ("r", 4.0, "a", "CREATE"),
    ("q", 4.2, "x", "WRITE"), ("r", 70.0, "c", "WRITE"),
}
OPEN = {("r", 200.0, "z", "CREATE"), ("q", 200.0, "z", "CREATE")}


def seconds(ts):
    return round((ts.replace(tzinfo=timezone.utc) - BASE).total_seconds(), 3)


@pytest.mark.parametrize("slice_seconds", [1, 3, 3600])
def test_debounce_does_not_depend_on_slices(spark, slice_seconds):
    raw = spark.createDataFrame(event_rows(), SE.EVENT_SCHEMA)
    rows = debounce(SE.known_events(raw), 1.0, slice_seconds).collect()
    assert {(r.root, seconds(r.session_start), r.path, r.event_type) for r in rows} == WANT | OPEN
    closed = debounce(SE.known_events(raw), 1.0, slice_seconds, closed_at="2024-01-01 00:03:00").collect()
    assert {(r.root, seconds(r.session_start), r.path, r.event_type) for r in closed} == WANT


def test_stream_equals_batch_and_feeds_index(spark, tmp_path):
    source = str(tmp_path / "events")
    spark.createDataFrame(event_rows(), SE.EVENT_SCHEMA).coalesce(1).write.parquet(source)
    seen = []
    table = lambda: SE.known_events(spark.read.schema(SE.EVENT_SCHEMA).parquet(source))
    store = IndexStore(spark, str(tmp_path / "ix"))
    store.append(chunk_rows(spark, [(1, "a", "old a"), (2, "keep", "k")]))
    made = lambda paths: paths.select(
        F.xxhash64("path").alias("chunk_id"), F.col("path").alias("source"), F.concat(F.lit("new "), "path").alias("content")
    )
    feed = SA.index_sink(store, made)

    def sink(events, batch_id):
        seen.extend((r.root, seconds(r.start), r.path, r.event_type) for r in events.collect())
        feed(events, batch_id)

    query = SE.debounced(SE.read_events(spark, source), table, sink, str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert set(seen) == WANT and len(seen) == len(WANT)
    assert live(store) == [("a", "new a"), ("b", "new b"), ("c", "new c"), ("keep", "k"), ("x", "new x")]


def test_ticks_come_at_a_period(spark, tmp_path):
    ticks = []
    query = SA.every(spark, 1, ticks.append, str(tmp_path / "cp"))
    try:
        for _ in range(60):
            if len(ticks) >= 2:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert ticks[:2] == [0, 1]


def test_no_event_is_lost_however_late(spark, tmp_path):
    """Micro-batches of one file each; events arrive up to 90 seconds late."""
    from datetime import datetime, timedelta

    from corpusloom.operators.debounce import debounce

    zero = datetime(2024, 1, 1)
    files = [
        [("r", "a", 1, 0.0), ("r", "b", 1, 0.5), ("q", "x", 1, 3.0)],
        [("r", "c", 1, 40.0), ("r", "a", 2, 40.5)],
        # Late: a path of its own, one inside a closed session, an older one of a.
        [("r", "d", 1, 0.7), ("r", "b", 4, 0.9), ("r", "a", 4, 10.0), ("q", "y", 2, 5.0)],
        [("r", "e", 1, 100.0), ("q", "z", 1, 100.0)],
        # Older than what has been handed on of its path, which stands.
        [("r", "a", 4, 11.0), ("q", "x", 4, 12.0), ("r", "end", 1, 200.0), ("q", "end", 1, 200.0)],
    ]
    source, rows = f"{tmp_path}/in", []
    for n, part in enumerate(files):
        data = [(root, p, op, zero + timedelta(seconds=s), 100 * n + i) for i, (root, p, op, s) in enumerate(part)]
        rows += data
        spark.createDataFrame(data, SE.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(source)
    raw = spark.readStream.schema(SE.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    got = []

    def sink(events, batch):
        got.extend((r.root, r.path, r.event_type, (r.ts - zero).total_seconds(), batch) for r in events.collect())

    query = SE.debounced_all(SE.known_events(raw), sink, f"{tmp_path}/state", f"{tmp_path}/cp")
    query.awaitTermination(180)
    assert query.exception() is None
    everything = SE.known_events(spark.createDataFrame(rows, SE.EVENT_SCHEMA))
    want = {}
    for r in debounce(everything).orderBy("ts").collect():
        if r.path != "end":  # still pending, for nothing newer has come
            want[r.root, r.path] = (r.event_type, (r.ts - zero).total_seconds())
    last = {}
    for root, p, kind, s, _ in got:
        last[root, p] = (kind, s)
    assert last == want
    assert ("r", "a", "REMOVE", 11.0) not in [g[:4] for g in got]
    assert {g[1] for g in got} == {"a", "b", "c", "d", "e", "x", "y", "z"}
