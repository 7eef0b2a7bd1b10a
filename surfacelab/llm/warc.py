"""Operator 9, WARC: one record per page, later copies of a payload kept as revisits.

Headers alone (digest, id, URI and size, no payload) are shuffled by payload digest; the group's largest
page_id is the response, and revisit headers are joined to it. Revisit records are written from those
headers. Payloads are shuffled once for each digest that a task has, to the headers of the responses.
A record is one gzip member; members are put together to archives of about archive_bytes bytes, each begun by a
warcinfo record, and written by Spark's text writer: an archive is one value, and the separator that the writer puts after it is an
empty member. Archives are read as binary files, one at a time in a task, record by record, by Content-Length.

Cases: null html is an empty payload; a null url is an empty URI, line breaks in it are percent
encoded; rows that tie for the largest page_id of a payload are all responses; a null page_id is
never an original unless the payload has no other, then each such row is a response; a repeated page_id
gets a record id of its own; a very long page is one record, held by one task with its compressed form; an archive
beyond 2 GB, which only a page of that size makes, can't be read back by Spark's binary files; an empty
table writes no record; further input columns are ignored. The reader takes members that hold several records or none, too,
and leaves out records other than responses and revisits.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surfacelab.llm.shared import new_path, table, written

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"
ARCHIVE_BYTES = 32_000_000
#: An empty gzip member (fixed value).
EMPTY = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean"


def base32(digits: Column) -> Column:
    """Bare upper-case base32 of 40 hexadecimal digits: 40 bits at a time through radix 32."""
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and its sha1 (hexadecimal) of pages."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha1"))


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, sha1, payload_bytes, record_type, refers_to and again (the record's number among those of one page_id and payload) of each page."""
    heads = payloads(pages).select("page_id", "url", "sha1", F.octet_length("payload").cast("long").alias("payload_bytes"))
    originals = heads.where(F.col("payload_bytes") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND original IS NOT NULL").drop("copies")
    later = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return heads.join(originals, "sha1", "left").select(
        "page_id", "url", "sha1", "payload_bytes", F.when(later, "revisit").otherwise("response").alias("record_type"), F.when(later, F.col("original")).alias("refers_to"),
        F.row_number().over(Window.partitionBy("page_id", "sha1").orderBy("url")).alias("again"),
    )


def record(date: str) -> Column:
    """The WARC record of a resolved page, without the blank lines that end it; a revisit has no payload."""
    uri = F.replace(F.replace(F.coalesce(F.col("url"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"
    digest = base32(F.upper("sha1"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit(END))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit(f"\r\nWARC-Record-ID: <{ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), digest, F.when(F.col("again") > 1, F.concat(F.lit(":"), F.col("again"))).otherwise(F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), uri, F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), digest,
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{ID}"), F.col("refers_to"), F.lit(":"), digest, F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("long"), F.lit(END),
        http, F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.compress(END.encode()) + packer.flush()


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Deduplicated gzip archives of pages (page_id, url, html) in path."""
    heads = written(resolve(pages, min_bytes), "warc-heads")
    # The sort before the partial aggregate lets a task send each payload once, however many pages have it.
    bodies = payloads(pages).groupBy("sha1").agg(F.first("payload").alias("payload"))
    responses = heads.where("record_type = 'response'").join(bodies, "sha1").select(record(date).alias("record"))
    revisits = heads.where("record_type = 'revisit'").withColumn("payload", F.lit("")).select(record(date).alias("record"))

    def archives(batches):
        info, part, made = b"software: surfacelab\r\nformat: WARC File Format 1.1\r\n", TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0

        def out():
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-archive:{part}-{made}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}{END}"
            return pa.RecordBatch.from_arrays([pa.array([b"".join([_member(head.encode() + info), *held])], pa.binary())], ["archive"])

        for b in batches:
            for x in b.column("record"):
                held.append(_member(x.as_buffer().to_pybytes()))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield out()
                    held, size, made = [], 0, made + 1
        if held:
            yield out()

    packed = responses.unionByName(revisits).mapInArrow(archives, "archive binary").select(F.col("archive").cast("string").alias("value"))
    packed.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def _fields(lines: list[bytes]) -> dict[bytes, bytes]:
    pairs = (x.split(b":", 1) for x in lines if b":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _head(stream: io.BufferedIOBase) -> tuple[bytes, dict[bytes, bytes]]:
    """First line and fields up to a blank line; a first line of b"" is the end."""
    first = stream.readline()
    while first in (b"\r\n", b"\n"):
        first = stream.readline()
    lines = []
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        lines.append(line)
    return first.strip(), _fields(lines)


def parse_archive(data: bytes) -> Iterator[tuple[dict[bytes, bytes], int, bytes | None]]:
    """Responses and revisits of an archive, of however many members: (headers, payload length, payload or None)."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data))
    while True:
        first, head = _head(stream)
        if not first:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError("damaged archive: no record where one should begin")
        body = stream.read(int(head[b"content-length"]))
        if head[b"warc-type"] in (b"response", b"revisit"):
            cut = body.index(b"\r\n\r\n") + 4
            http = _fields(body[: cut - 4].split(b"\r\n"))
            payload = body[cut:] if head[b"warc-type"] == b"response" else None
            yield head, int(http.get(b"content-length", len(body) - cut)), payload


def _number(uri: bytes) -> int | None:
    digits = uri.decode()[len(ID) + 1 : -1].split(":")[0]
    return int(digits) if digits else None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in path; intact: a response's payload has its digest and length."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for head, size, payload in parse_archive(content.as_buffer()):
                    digest = head[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
                    intact = payload is None or (len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
                    refers = head.get(b"warc-refers-to")
                    rows.append((_number(head[b"warc-record-id"]), head[b"warc-target-uri"].decode(), head[b"warc-type"].decode(), _number(refers) if refers else None, size, digest, intact))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(parse, RECORDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select(
        "page_id", "payload_bytes", F.when(F.col("intact"), F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to"
    )


def op9_sql() -> str:
    return """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS hex FROM p),
g AS (SELECT hex, max(page_id) AS original, count(*) AS copies FROM h WHERE payload_bytes >= 0 GROUP BY hex)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h.hex, 1 + 10 * (k // 8), 10))::BIGINT >> (5 * (7 - k % 8))::BIGINT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM h JOIN g ON h.hex = g.hex"""
