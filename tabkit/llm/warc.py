"""Content-addressed web archive: payload bytes once by digest, exact record headers apart, records by joins.

An archive is a folder of two Parquet tables. ``payloads`` holds each different payload once under its
SHA-256; ``headers`` holds the exact bytes of every record's header block and the digest of its payload.
``read_archive`` joins them, checks every payload against its digest, and ``record_bytes`` puts together the
record as a WARC file would hold it.

A header holds what a page says about itself, so nothing of it may pass for a header line: control characters, white
space and line and paragraph separators of a URI are percent-encoded, all but letters, digits, ``_`` and ``-`` of an
id as well, and fields are read between the line ends of the header only.

Defined cases: a null payload is empty; a null URI leaves its header line out. Rows that repeat an id are records of
their own, the further ones named by the id, a dot and a number: those with the smallest id among equal payloads are
all responses. A row without an id is a response unless another row with the same payload has an id. An empty table
makes an empty archive. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.llm.common import met, stored

REVISIT_BYTES = 100
#: Repeated ids, and owners of repeated payloads, that are broadcast: about 120 bytes each.
BROADCAST_ROWS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
#: Characters that do not stand in a header as they are: in a URI, and in an id.
UNSAFE_URI = r"[\x00-\x20\x7F-\xA0\u1680\u2000-\u200F\u2028-\u202F\u205F\u3000\uFEFF]"
UNSAFE_ID = "[^A-Za-z0-9_-]"


def _line(name: str, value: Column) -> Column:
    """One header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _safe(text: Column, unsafe: str) -> Column:
    """The text with the UTF-8 bytes of unsafe characters percent-encoded."""
    coded = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    each = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(unsafe), coded(c)).otherwise(c))
    return F.when(text.rlike(unsafe), F.array_join(each, "")).otherwise(text)


def _header(uri: Column, date: str) -> Column:
    """The record header and the HTTP header below it, ending where the payload begins."""
    revisit = F.col("owner").isNotNull()
    size = F.col("payload_bytes").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:record:"), F.col("name"), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _safe(uri, UNSAFE_URI)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:record:"), F.col("owner"), F.lit(">"))),
        _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit("\r\n"), http,
    )


def write_archive(
    df: DataFrame, folder: str, id_col: str, payload_col: str, uri_col: str, *,
    revisit_bytes: int = REVISIT_BYTES, date: str = EPOCH,
) -> None:
    """Write one record per row. Equal payloads of ``revisit_bytes`` or more are revisits of the smallest id.

    The owner of a payload comes from a pre-aggregated count of digests, so copies are counted before they
    move; a payload that many rows share is joined by its digest only, without its bytes.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).alias("rid"), F.col(uri_col).alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows.select("digest", "payload").dropDuplicates(["digest"]).write.parquet(f"{folder}/payloads")
    records = stored(
        rows.select("rid", "uri", "digest", F.octet_length("payload").cast("long").alias("payload_bytes")).withColumn("number", F.monotonically_increasing_id()),
        "warc-records",
    )
    firsts = records.groupBy(F.col("rid").alias("r")).agg(F.min("number").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    code = F.coalesce(_safe(F.col("rid").cast("string"), UNSAFE_ID), F.lit(""))
    again = F.col("number") > F.col("first")
    named = met(records.withColumn("r", F.col("rid")), stored(firsts, "warc-repeats"), ["r"], "left", BROADCAST_ROWS).withColumn(
        "name", F.when(again, F.concat(code, F.lit("."), F.col("number").cast("string"))).otherwise(code)
    )
    large = named.filter(F.col("payload_bytes") >= revisit_bytes)
    first = F.min(F.when(F.col("rid").isNotNull(), F.struct("rid", "number", "name"))).alias("o")
    owners = large.groupBy(F.col("digest").alias("d")).agg(first, F.count("*").alias("n")).filter("n > 1").drop("n")
    owned = met(named.withColumn("d", F.col("digest")), stored(owners, "warc-owners"), ["d"], "left", BROADCAST_ROWS)
    owner = F.when(F.col("rid").isNull() | (F.col("rid") != F.col("o.rid")), F.col("o.name"))
    headed = owned.withColumn("owner", owner).select("digest", _header(F.col("uri"), date).cast("binary").alias("header"))
    headed.write.parquet(f"{folder}/headers")


def _field(name: str, pattern: str) -> Column:
    """What a line of the record's header holds; null where there is no such line."""
    head = F.concat(F.substring_index(F.col("header").cast("string"), "\r\n\r\n", 1), F.lit("\r\n"))
    found = F.regexp_extract(head, rf"\r\n{name}: {pattern}\r\n", 1)
    return F.when(found != "", found)


def _id(name: str) -> Column:
    """The id in a record's name, without the number of a repetition."""
    return F.nullif(F.url_decode(F.substring_index(_field(name, r"<urn:record:([^\r\n>]*)>"), ".", 1)), F.lit(""))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of an archive: its name, id, type, header, and its payload with size and digest.

    The payload is read, digested and compared with the name it is stored under before the join, once per
    payload; a wrong or missing payload fails the read. Columns that nobody asks for are never moved.
    """
    actual = F.sha2("payload", 256)
    payloads = spark.read.parquet(f"{folder}/payloads").select(
        F.col("digest").alias("name"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(actual == F.col("digest"), actual).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))).alias("payload_digest"),
    )
    headers = spark.read.parquet(f"{folder}/headers").select(
        "header", "digest",
        _field("WARC-Record-ID", r"<urn:record:([^\r\n>]*)>").alias("record_name"), _id("WARC-Record-ID").alias("record_id"),
        _field("WARC-Type", "(response|revisit)").alias("record_type"), _id("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("claimed"),
    )
    # a payload that very many records share is one row against many: Spark splits such a join while it runs
    joined = headers.join(payloads, headers["claimed"] == payloads["name"], "left")
    checked = F.coalesce("payload_digest", F.raise_error(F.concat(F.lit("no payload "), F.col("digest"))))
    return joined.select("record_name", "record_id", "record_type", "refers_to", "header", "payload", "payload_bytes", checked.alias("payload_digest"))


def record_bytes() -> Column:
    """The whole record as it stands in a WARC file; a revisit has its headers only."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return F.concat(F.col("header"), body, F.lit(b"\r\n\r\n"))
