"""WARC archives with repeated payloads resolved to revisit records."""

from __future__ import annotations

import gzip
import hashlib
import io
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm.common import own_columns, shared_dir

#: Payloads with fewer bytes are always written in full.
MIN_REVISIT_BYTES = 1000
#: Records in an archive file, at most.
FILE_RECORDS = 4096
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"

_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def headers(pages: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest)`` of each page: what the archive's index has of it."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select(
        "page_id", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest")
    )


def revisits(index: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(page_id, payload_digest, refers_to)`` of the records that repeat the payload of a larger ``page_id``.

    Only headers are shuffled, by digest. The largest id of a digest is found by an aggregate that
    combines before the shuffle; the join that follows splits hot digests.
    """
    large = index.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    originals = large.groupBy("payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")
    )
    originals = originals.where("refers_to <> least").drop("least")
    found = large.join(originals, ["payload_digest", "payload_bytes"]).where("page_id <> refers_to")
    return found.select("page_id", "payload_digest", "refers_to").distinct()


def records(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """One WARC record a page as text, without the two line ends that close it."""
    html = F.coalesce("html", F.lit(""))
    digest = F.sha1(html.cast("binary"))
    again = F.col("refers_to").isNotNull()
    block = F.concat(
        F.lit(_HTTP + "Content-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), F.when(again, "").otherwise(html)
    )
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "_")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(
            again,
            F.concat(
                line("WARC-Profile", F.lit(PROFILE)),
                line("WARC-Refers-To", F.concat(F.lit(f"<{RECORD_ID}"), F.col("refers_to").cast("string"), F.lit(">"))),
            ),
        ).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    digested = pages.withColumn("payload_digest", digest)
    return digested.join(resolved, ["page_id", "payload_digest"], "left").select(record.alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Writes ``pages (page_id, url, html)`` as compressed WARC files below ``path``, a folder that
    every executor reaches. Spark's committed text output ends each record with two line ends."""
    rows = own_columns(pages, "page_id", "url", "html")
    resolved = revisits(headers(rows), min_bytes)
    out = records(rows, resolved).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    out.option("maxRecordsPerFile", file_records).text(path)


_FIELD = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")
ARCHIVE_SCHEMA = (
    "page_id long, record_type string, refers_to long, url string, digest string, payload_bytes long, payload_digest string, html binary"
)


def parse_archive(stream) -> list[tuple]:
    """The records of an open archive, in order; lengths, not separators, bound them."""

    def number(value: bytes) -> int | None:
        digits = value.rsplit(b":", 1)[-1].rstrip(b">")
        return int(digits) if digits else None

    found = []
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            name, value = _FIELD.fullmatch(line).groups()
            fields[name.lower()] = value
        block = stream.read(int(fields[b"content-length"]))
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        kind = fields[b"warc-type"].decode()
        revisit = kind == "revisit"
        found.append(
            (
                number(fields[b"warc-record-id"]),
                kind,
                number(fields[b"warc-refers-to"]) if revisit else None,
                fields[b"warc-target-uri"].decode(),
                fields[b"warc-payload-digest"].decode().removeprefix("sha1:"),
                None if revisit else len(payload),
                None if revisit else hashlib.sha1(payload).hexdigest(),
                None if revisit else payload,
            )
        )
    return found


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``; length and digest are those of the bytes read.
    Revisits have null there until ``resolve_revisits``."""

    def run(batches):
        schema = pa.schema(
            [
                ("page_id", pa.int64()),
                ("record_type", pa.string()),
                ("refers_to", pa.int64()),
                ("url", pa.string()),
                ("digest", pa.string()),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
                ("html", pa.binary()),
            ]
        )
        for batch in batches:
            for content in batch.column(0):
                got = parse_archive(gzip.open(io.BytesIO(content.as_py())))
                for k in range(0, len(got), 500):
                    columns = list(zip(*got[k : k + 500]))
                    if not payloads:
                        columns[-1] = [None] * len(columns[0])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, ARCHIVE_SCHEMA)


def resolve_revisits(found: DataFrame) -> DataFrame:
    """Revisits joined to the response they refer to: its length, checked digest and payload fill theirs."""
    originals = found.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"),
        "digest",
        F.col("payload_bytes").alias("_bytes"),
        F.col("payload_digest").alias("_digest"),
        F.col("html").alias("_html"),
    )
    joined = found.join(originals.dropDuplicates(["refers_to", "digest"]), ["refers_to", "digest"], "left")
    return joined.select(
        "page_id",
        "record_type",
        "refers_to",
        "url",
        "digest",
        F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "_digest").alias("payload_digest"),
        F.coalesce("html", "_html").alias("html"),
    )


def archived(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes the archives and reads them back: a row for each row of ``pages``.

    ``record_type`` is ``revisit`` for a payload of at least ``min_bytes`` bytes that a larger
    ``page_id`` has as well, else ``response``. Null html is an empty payload, a null url is empty,
    a null ``page_id`` comes back null and is always a response. Rows that repeat a ``page_id``
    are written as often as they occur; revisits refer to an id, never to themselves. An
    empty table gives an empty archive and no rows. Other columns are not written.
    """
    spark = pages.sparkSession
    path = path or shared_dir(spark)
    write_archives(pages, path, min_bytes)
    return resolve_revisits(read_archives(spark, path, payloads=False)).drop("html")
