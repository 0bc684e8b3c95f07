import hashlib

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, token_counts, warc
from corpusloom.llm.store import shared_dir
from tests.llm.cases import ROWS, no_docs, odd_docs, rows

SPACE = " \t\n\x0b\x0c\r"


def brute_dedup(data):
    norm = lambda t: "".join(c for c in t or "" if c not in SPACE)
    groups = {}
    for i, (doc_id, text, *_) in enumerate(data):
        groups.setdefault(norm(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, i, doc_id))
    out = []
    for body, same in groups.items():
        # One row of a group stays, whatever ids repeat.
        keep = min(same)
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(r[-1], keep[-1], len(same), r is keep, sha) for r in same]
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_exact_dedup_odd_rows(spark):
    assert rows(exact_dedup.exact_dedup(odd_docs(spark)), *COLUMNS) == brute_dedup(ROWS)


def test_one_row_of_a_group_stays(spark):
    data = [(1, "a b c"), (1, "a  b  c  "), (1, "a b c"), (None, "x y"), (None, "x y"), (2, "ab c")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    assert rows(exact_dedup.exact_dedup(docs), *COLUMNS) == brute_dedup(data)
    kept = exact_dedup.without_copies(docs.repartition(5))
    assert rows(kept, "doc_id", "text") == [(1, "a  b  c  "), (None, "x y")]


def test_exact_dedup_digests_that_collide(spark):
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    data = [(i, f"text {i % 40}", "en", "a", 7) for i in range(120)] + ROWS
    docs = spark.createDataFrame(data, odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars").schema)
    assert rows(exact_dedup.exact_dedup(docs, weak), *COLUMNS) == brute_dedup(data)


def test_without_copies(spark):
    docs = odd_docs(spark)
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id") == [(4,), (5,), (6,), (7,), (8,)]
    assert exact_dedup.without_copies(no_docs(spark)).collect() == []


def test_state_survives_and_takes_new_files(spark):
    path = shared_dir(spark)
    make = lambda data: spark.createDataFrame(
        data, "digest string, doc_id bigint, n_chars bigint, row bigint, locator string"
    )
    make([("x", 5, 3, 0, "f"), ("y", 1, 1, 1, "f")]).write.parquet(f"{path}/in")
    digests = spark.read.parquet(f"{path}/in")
    exact_dedup.digest_state(digests, f"{path}/in", f"{path}/ck")
    make([("x", 9, 4, 0, "g")]).write.mode("append").parquet(f"{path}/in")
    state = exact_dedup.digest_state(digests, f"{path}/in", f"{path}/ck")
    assert rows(state, "digest", "group_size", "keep_id", "keep_locator") == [
        ("x", 2, 9, "g"),
        ("y", 1, 1, "f"),
    ]


def counted(spark, docs, name="piece_bpe_32k.model", cache=None):
    import public_tokenizers

    work = shared_dir(spark)
    return token_counts.token_counts(
        docs, public_tokenizers.path(name), cache or f"{work}/cache", f"{work}/work", limit=100
    )


def test_token_counts_odd_rows(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for doc_id, text, *_ in ROWS:
        n = len(sp.encode(text or ""))
        want.append((doc_id, len((text or "").encode()), n, n > 100))
    got = rows(counted(spark, odd_docs(spark)), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == sorted(want, key=repr)
    assert counted(spark, no_docs(spark)).collect() == []


def test_token_cache_encodes_misses_only(spark):
    cache = shared_dir(spark)
    docs = odd_docs(spark)
    first = rows(counted(spark, docs.where("doc_id < 5"), cache=cache), "doc_id", "n_tokens")
    size = spark.read.parquet(cache).count()
    assert size == 3  # the sentence, nothing, white space
    again = rows(counted(spark, docs, cache=cache), "doc_id", "n_tokens")
    assert set(first) <= set(again)
    full = spark.read.parquet(cache)
    assert full.count() == full.select("content_sha256").distinct().count() == 7
    counted(spark, docs, cache=cache).collect()
    assert spark.read.parquet(cache).count() == 7
    counted(spark, docs, "byte_bpe_50k.json", cache=cache).collect()
    assert spark.read.parquet(cache).count() == 14


PAGES = [
    (1, "http://a/\r\nX: y", "<p>" + "a" * 200),
    (2, None, "<p>" + "a" * 200),
    (3, "http://c", None),
    (4, "http://d", ""),
    (5, "http://e", "<p>ü" * 50_000),
    (6, "http://f", "tiny"),
    (7, "http://g", "tiny"),
    (8, "http://h", "<p>" + "a" * 200),
    (None, "http://i", "<p>" + "b" * 200),
]


def test_warc_round_trip(spark):
    from tests.llm.cases import clashing

    pages = clashing(spark.createDataFrame(PAGES, "page_id bigint, url string, html string"))
    path = shared_dir(spark)
    warc.archive(pages, path)
    index = {r["page_id"]: r for r in warc.read_index(spark, path).collect()}
    assert len(index) == len(PAGES)
    for page_id, _, html in PAGES:
        body = (html or "").encode()
        row = index[page_id]
        assert row["payload_bytes"] == len(body)
        assert row["payload_digest"] == hashlib.sha256(body).hexdigest()
    assert {i: r["refers_to"] for i, r in index.items() if r["record_type"] == "revisit"} == {2: 1, 8: 1}
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == stored.distinct().count() == 5
    full = {r["page_id"]: r for r in warc.read_records(spark, path, resolve=True).collect()}
    for page_id, url, html in PAGES:
        body = (html or "").encode()
        record = bytes(full[page_id]["record"])
        head, rest = record.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        assert lines[0] == "WARC/1.1" and fields["WARC-Target-URI"] == (url or "").replace("\r\n", "")
        own = b"" if fields["WARC-Type"] == "revisit" else body
        assert rest == own + b"\r\n\r\n" and int(fields["Content-Length"]) == len(own)
        assert bytes(full[page_id]["payload"]) == body


def test_warc_damage_and_empty(spark):
    path = shared_dir(spark)
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.archive(empty, path)
    assert warc.read_index(spark, path).collect() == []
    path = shared_dir(spark)
    warc.archive(spark.createDataFrame([(1, "u", "x" * 300)], empty.schema), path)
    bad = spark.read.parquet(f"{path}/payloads").select("payload_digest", F.lit(b"other").alias("payload"))
    bad.write.parquet(f"{path}/other")
    table = pq.read_table(f"{path}/other".removeprefix("file://"))
    assert table.num_rows == 1
    spark.read.parquet(f"{path}/other").write.mode("append").parquet(f"{path}/payloads")
    try:
        warc.read_index(spark, path).collect()
        raise AssertionError("damage was not seen")
    except Exception as e:
        assert "damaged payload" in str(e)


def test_warc_repeated_rows(spark):
    path = shared_dir(spark)
    row, none = (1, "u", "y" * 150), (None, "v", "z" * 150)
    pages = spark.createDataFrame([row, none, row, none, none], "page_id bigint, url string, html string")
    warc.archive(pages.withColumn("payload", F.lit(1)).withColumn("row", F.lit(1)), path)
    got = rows(warc.read_index(spark, path), "page_id", "record_type", "refers_to")
    assert got == sorted(
        [(1, "response", None), (1, "revisit", 1), (None, "response", None)] + [(None, "revisit", None)] * 2, key=repr
    )
