"""WARC records in a content-addressed archive.

`archive` writes two tables into shared storage. `payloads` holds the bytes of
each distinct payload once, under their SHA-256. `headers` holds, per record,
the exact header block and the payload's digest. `read_records` rebuilds the
original records byte for byte by joining both, after checking every stored
payload against its digest; `read_index` gives what a reader learns from those.

Of records with equal payloads of `min_bytes` or more, that with the smallest id
is a `response`, the others are `revisit` records without a body of their own
that name it. Smaller payloads are always written as responses, but their bytes
are stored once as well.

Defined results: a null html is an empty payload; a null url an empty target.
Null ids come after all others and are never referred to by number. Of rows
that repeat an id and a payload, the first as read is the response. An empty
table gives an empty archive. Further columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
# The profile and version strings of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:page:{}>"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit(CRLF))


def _record_id(page_id: Column) -> Column:
    before, after = RECORD_ID.split("{}")
    return F.concat(F.lit(before), F.coalesce(page_id.cast("string"), F.lit("-")), F.lit(after))


def _header() -> Column:
    revisit = F.col("record_type") == "revisit"
    length = F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))
    return F.concat(
        F.lit(VERSION + CRLF),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        # A line break inside a URL would end the header line.
        _line("WARC-Target-URI", F.translate(F.coalesce("url", F.lit("")), "\r\n", "")),
        _line("WARC-Date", F.col("date")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, _line("WARC-Refers-To", _record_id(F.col("refers_to")))).otherwise(""),
        F.when(revisit, _line("WARC-Profile", F.lit(REVISIT_PROFILE))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", length),
        F.lit(CRLF),
    )


def archive(
    pages: DataFrame, path: str, min_bytes: int = 100, date: str = "1970-01-01T00:00:00Z"
) -> None:
    """Writes `payloads` and `headers` under `path`, a new shared folder.

    The reference record of a digest is a combinable aggregate over small rows.
    Payload bytes move once, joined on the id of the one row that supplies them,
    so that no number of copies gathers in a task.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages.select(
        "page_id",
        "url",
        F.monotonically_increasing_id().alias("row"),
        F.sha2(html, 256).alias("payload_digest"),
        F.octet_length(html).cast("bigint").alias("payload_bytes"),
    ).write.parquet(f"{path}/captures")
    captures = spark.read.parquet(f"{path}/captures")
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")).alias("first")
    captures.groupBy("payload_digest").agg(first).select(
        "payload_digest", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row")
    ).write.parquet(f"{path}/firsts")
    firsts = spark.read.parquet(f"{path}/firsts")

    bodies = pages.select(
        "page_id", F.sha2(html, 256).alias("_sha"), F.encode(html, "UTF-8").alias("payload")
    )
    supplies = F.col("page_id").eqNullSafe(F.col("first_id")) & (
        F.col("_sha") == F.col("payload_digest")
    )
    # Rows that repeat an id and a payload would supply it twice.
    repeated = captures.groupBy("page_id", "payload_digest").count().where("count > 1")
    payloads = bodies.join(firsts, supplies).select("payload_digest", "payload")
    if not repeated.isEmpty():
        payloads = payloads.dropDuplicates(["payload_digest"])
    payloads.write.parquet(f"{path}/payloads")

    large = F.col("payload_bytes") >= min_bytes
    other = F.col("row") != F.col("first_row")
    records = (
        captures.join(firsts, "payload_digest")
        .withColumn("record_type", F.when(large & other, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("first_id")))
        .withColumn("date", F.lit(date))
    )
    records.select(
        "page_id", "payload_digest", F.encode(_header(), "UTF-8").alias("header")
    ).write.parquet(f"{path}/headers")


def _field(name: str) -> Column:
    return F.regexp_extract(F.decode("header", "UTF-8"), f"(?m)^{name}: (.*)$", 1)


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads; raises where bytes do not match their digest."""
    stored = spark.read.parquet(f"{path}/payloads")
    actual = F.sha2(F.col("payload"), 256)
    return stored.select(
        F.when(actual == F.col("payload_digest"), actual)
        .otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "payload_digest")))
        .alias("payload_digest"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        "payload",
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """What a reader learns from the rebuilt records: `page_id, payload_bytes,
    payload_digest, record_type, refers_to, url`. Size and digest are those of
    the payload that the record carries or, for revisits, refers to."""
    before, after = RECORD_ID.split("{}")
    number = lambda name: _field(name).substr(
        F.lit(len(before) + 1), F.length(_field(name)) - len(before) - len(after)
    ).try_cast("bigint")
    records = read_records(spark, path, resolve=True)
    end = F.instr(F.decode("record", "ISO-8859-1"), CRLF + CRLF)
    return records.withColumn("header", F.substring("record", F.lit(1), end + 1)).select(
        number("WARC-Record-ID").alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Target-URI").alias("url"),
    )


def read_records(spark: SparkSession, path: str, resolve: bool = False) -> DataFrame:
    """`page_id, record`: the exact bytes of every record. With `resolve`, the
    payload of revisits is put back, and `payload` returned as well."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = verified_payloads(spark, path).select("payload_digest", "payload")
    joined = headers.join(payloads, "payload_digest")
    empty = F.lit(b"")
    body = F.when(_field("WARC-Type") == "revisit", empty).otherwise(F.col("payload"))
    record = F.concat("header", body, F.lit((CRLF + CRLF).encode())).alias("record")
    columns = ["page_id", record] + (["payload"] if resolve else [])
    return joined.select(*columns)
