"""What jobs leave on disk: shuffles go with the write they were made for, tables with their last reader."""

from pathlib import Path

import pyarrow as pa

from corpusloom.llm import jaccard_join
from corpusloom.llm.store import written
from corpusloom.operators import retrieval
from corpusloom.sources import tables, term_index
from corpusloom.sources.tables import perhaps_among, work_dir
from corpusloom.sources.term_index import TermIndex
from pyspark.sql import functions as F


def _shuffle_files(spark) -> set[str]:
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    names = {files.apply(i).getName() for i in range(files.size())}
    return {n for n in names if n.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    out = written(spark.range(1000).repartition(4, "id").groupBy(F.col("id") % 7).count(), work_dir(spark))
    assert not _shuffle_files(spark) - before
    assert out.count() == 7 and spark.conf.get(tables.SHUFFLE_CLEANUP, "false") == "false"


def test_rows_that_are_not_wanted_are_dropped_before_the_join(spark, monkeypatch):
    rows = spark.range(20_000).select(F.when(F.col("id") % 100 > 0, F.col("id")).alias("a"), F.col("id").alias("b"))
    wanted = rows.where("b % 50 = 0")  # every other one without a
    keys = [F.col("a"), F.col("b")]
    left = {r.b for r in perhaps_among(rows, keys, wanted).collect()}
    assert left >= set(range(0, 20_000, 50)) and len(left) < 1_500
    assert not perhaps_among(rows, keys, wanted.limit(0)).count()
    # A filter that is too small lets more pass, but none is lost.
    monkeypatch.setattr(tables, "BITS_PER_ROW", 64)
    monkeypatch.setattr(tables, "MOST_BITS", 64)
    assert {r.b for r in perhaps_among(rows, keys, wanted).collect()} >= set(range(0, 20_000, 50))


def test_the_join_shuffles_no_text_and_keeps_no_fronts(spark, monkeypatch):
    base = [f"w{i} x{i} y{i} z{i} " * 20 + "long tail of words that differ " + "q" * i for i in range(40)]
    rows = [(i, base[i % 40] + (" more" if i >= 40 else "")) for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, base[0]), (3, base[3])], "doc_id bigint, text string")
    path = work_dir(spark)
    monkeypatch.setattr(jaccard_join, "shared_dir", lambda s: path)
    found = {(r.doc_id, r.class_id, r.component_id) for r in jaccard_join.near_duplicates(docs, 2, 80).collect()}
    assert (45, 45, 5) in found and (3, 3, 3) in found and (None, 0, 0) in found
    left = {p.name for p in Path(path.removeprefix("file:")).iterdir()}
    assert {"members", "named"} <= left and not left & {"fronts", "tied", "clusters", "labelled", "tokens"}


def test_a_search_moves_only_the_best_of_each_range(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "common " + "x " * (i % 40) + f"w{i}") for i in range(640)], "doc_id long, text string")
    index = TermIndex(spark, work_dir(spark), parts=8, range_docs=40)
    index.append(docs.repartitionByRange(4, "doc_id"))
    blocks = spark.read.parquet(f"{index.path}/postings")
    assert not blocks.where(F.col("part") != index._part()).count()
    ranges = spark.read.parquet(f"{index.path}/documents").groupBy("range").count().collect()
    assert sum(r["count"] for r in ranges) == 640 and max(r["count"] for r in ranges) <= 40
    index.remove(docs.where("doc_id % 40 = 0"))
    path = work_dir(spark)
    monkeypatch.setattr(term_index, "work_dir", lambda s: path)
    asked = spark.createDataFrame([(7, "common w3"), (8, "x")], "query_id long, query string")
    found = index.search(asked, 2, lead=1)
    moved = spark.read.parquet(f"{path}/scored").unionByName(spark.read.parquet(f"{path}/more"))
    assert moved.count() <= 2 * 4 * len(ranges) < 2 * 600
    live = docs.where("doc_id % 40 <> 0")
    want = retrieval.bm25_topk(asked, live, 2).select("query_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want))


def test_a_range_that_two_tasks_read_is_scored_whole():
    kind = pa.list_(pa.int64()), pa.list_(pa.int32())
    row = lambda term, ids: (term, pa.scalar(ids, kind[0]), pa.scalar([1] * len(ids), kind[1]))

    def scores(rows):
        term, ids, tfs = zip(*rows)
        blocks = pa.table(
            {"term": list(term), "ids": [x.as_py() for x in ids], "tfs": [x.as_py() for x in tfs], "lengths": [x.as_py() for x in tfs]}
        )
        asked = pa.table({"query_id": [1], "terms": [["a", "b"]], "weights": [[1.0, 2.0]]})
        return sorted(zip(*term_index._best(1.0, 3)(blocks, asked).select(["id", "score"]).to_pydict().values()))

    whole = scores([row("a", [1, 2, 3, 4]), row("b", [2, 4])])
    assert whole == scores([row("a", [1, 2]), row("b", [2]), row("a", [3, 4]), row("b", [4])]) and len(whole) == 4
    assert [i for i, _ in scores([row("a", [1, 2, 3, 4]), row("b", [2, 4]), (None, *row("", [4])[1:])])] == [1, 2, 3]
