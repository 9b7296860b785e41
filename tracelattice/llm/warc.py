"""WARC archives: records written with Spark's text sink, read back by Content-Length, and assembled
into one nested row per capture.

Each capture is a request, a response (or a revisit of an equal payload) and a metadata record.  Requests
and metadata name the response in WARC-Concurrent-To.  A revisit keeps the HTTP headers, whose
Content-Length is the payload's, and names the response in WARC-Refers-To.

A record is a gzip member of its own, so a reader can begin at any record.  Members are put together to
values of about ``VALUE_BYTES``, which Spark's text sink writes as they are, so files go to any store that
Spark writes; the sink's line separator is an empty gzip member.  A file is closed at ``FILE_BYTES``, so it
holds that much and one record at most.  The reader takes any WARC file, plain or gzip with one or more
members, and reads it as a stream of records, one file at a time in a task.

Defined cases: null payload and url are empty; a very long payload is one record, which is held once as text
and once compressed; a null page_id is smaller than any other; among repeated rows of the largest page_id one
is the response; other columns are left out; an empty table makes an empty archive.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelattice import scratch
from tracelattice.llm.common import RID, dropping_shuffles

CRLF, END = "\r\n", "\r\n\r\n"  # fixed values of the format
VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: the alphabet of base32
VALUE_BYTES, FILE_BYTES = 4 << 20, 32 << 20  # compressed
LEAST_BYTES = 0  # payloads of fewer bytes are always responses
FIELDS = ("type", "record_id", "concurrent_to", "refers_to", "target_uri", "payload_digest", "payload_length", "payload", "start_line", "fields")
SCHEMA = "type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_length long, payload binary, start_line string, fields map<string,string>"


def base32(digits: Column) -> Column:
    """40 hex digits as base32, by way of numbers of base 32 (digits 0-9, A-V).  Null stays null."""
    part = lambda at, n: F.lpad(F.conv(F.substring(digits, at, n), 16, 32), n * 4 // 5, "0")
    return F.translate(F.concat(part(1, 15), part(16, 15), part(31, 10)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", LETTERS)


def urn(kind: str, row: Column) -> Column:
    """A record id that depends on the row alone."""
    h = F.md5(F.concat(F.lit(kind + ":"), row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def record(headers: dict[str, str | Column], block: Column) -> Column:
    """A record without its final line ends; headers that are null are left out."""
    head = {**headers, "WARC-Date": DATE, "Content-Length": F.octet_length(block).cast("string")}
    lines = [F.concat(F.lit(f"{CRLF}{k}: "), v if isinstance(v, Column) else F.lit(v)) for k, v in head.items()]
    return F.concat(F.lit(VERSION), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(END), block)


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, key: str = "page_id", url: str = "url", html: str = "html", value_bytes: int = VALUE_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Three records per row.  Of rows with equal payloads the one of the largest key is the response."""
    one_line = F.regexp_replace(F.coalesce(F.col(f"`{url}`"), F.lit("")), "[\\x00-\\x20]+", "%20")
    rows = pages.select(F.monotonically_increasing_id().alias(RID), F.col(f"`{key}`").alias("key"), one_line.alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    staged = scratch.new_path(pages.sparkSession, "pages")
    rows = scratch.materialise(rows.withColumn("digest", base32(F.sha1(F.encode("html", "UTF-8")))), "pages", at=staged)
    best = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max(F.struct(F.col("key").isNotNull().alias("some"), "key", RID)).alias("best"))
    best = scratch.materialise(best.select("digest", F.col(f"best.{RID}").alias("first")), "payloads")
    rows = rows.join(best, "digest", "left")
    revisit = F.coalesce(F.col("first") != F.col(RID), F.lit(False))
    rid, request, meta = urn("response", F.col(RID)), urn("request", F.col(RID)), urn("metadata", F.col(RID))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    common = {"WARC-Target-URI": F.col("url"), "WARC-Payload-Digest": F.concat(F.lit("sha1:"), "digest")}
    answer = F.when(
        revisit,
        record(
            {"WARC-Type": "revisit", "WARC-Record-ID": rid, "WARC-Refers-To": urn("response", F.col("first")), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
             "Content-Type": "application/http;msgtype=response", **common}, http,
        ),
    ).otherwise(record({"WARC-Type": "response", "WARC-Record-ID": rid, "Content-Type": "application/http;msgtype=response", **common}, F.concat(http, "html")))
    host = F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    target = F.concat(F.lit("/"), F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/?([^#]*)", 1))
    asked = record(
        {"WARC-Type": "request", "WARC-Record-ID": request, "WARC-Concurrent-To": rid, "WARC-Target-URI": F.col("url"), "Content-Type": "application/http;msgtype=request"},
        F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(END)),
    )
    about = record(
        {"WARC-Type": "metadata", "WARC-Record-ID": meta, "WARC-Concurrent-To": rid, "WARC-Target-URI": F.col("url"), "Content-Type": "application/warc-fields"},
        F.coalesce(F.concat(F.lit("page-id: "), F.col("key").cast("string"), F.lit(CRLF)), F.lit("")),
    )
    members = rows.select(*[r.cast("binary").alias(n) for r, n in ((asked, "a"), (answer, "b"), (about, "c"))]).mapInArrow(lambda batches: compress(batches, value_bytes, file_bytes), "file long, value binary").select("file", F.col("value").cast("string").alias("value"))
    with dropping_shuffles(rows.sparkSession):
        members.write.partitionBy("file").option("lineSep", member(b"").decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    scratch.delete(rows.sparkSession, staged)


def member(data: bytes) -> bytes:
    bits = max(9, min(15, len(data).bit_length()))  # a small record needs no large window
    z = zlib.compressobj(6, zlib.DEFLATED, 16 + bits, 8 if bits > 12 else 5)
    return z.compress(data) + z.flush()


def compress(batches: Iterator[pa.RecordBatch], value_bytes: int, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """(file, value): members of the records, put together; a file's number depends on the task and its place there."""
    file, size, held, held_size = TaskContext.get().partitionId() << 32, 0, [], 0
    emit = lambda: pa.RecordBatch.from_arrays([pa.array([file]), pa.array([b"".join(held)], pa.binary())], names=["file", "value"])
    for batch in batches:
        for row in zip(*batch.columns):
            for record in row:
                held.append(member(record.as_py() + END.encode()))
                held_size += len(held[-1])
            if held_size >= value_bytes:
                yield emit()
                size += held_size
                held, held_size = [], 0
                if size >= file_bytes:
                    file, size = file + 1, 0
    if held:
        yield emit()


def named(block: bytes) -> dict[str, str]:
    """``Name: value`` lines, names in lower case."""
    pairs = (line.partition(b":") for line in block.split(b"\r\n"))
    return {a.strip().decode("utf-8", "replace").lower(): b.strip().decode("utf-8", "replace") for a, c, b in pairs if c}


def records(file: BinaryIO) -> Iterator[tuple]:
    """The records of one file, by their Content-Length; a file that ends within a record is an error."""
    packed = file.read(2) == b"\x1f\x8b"
    file.seek(0)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=file)) if packed else file
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        head = []
        while (line := stream.readline()).strip():
            head.append(line.rstrip(b"\r\n"))
        h = named(b"\r\n".join(head))
        size = int(h["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("the file ends within a record")
        kind, payload, length, start, fields = h.get("warc-type"), None, None, None, None
        if h.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            start, _, rest = top.partition(b"\r\n")
            start, fields = start.decode("utf-8", "replace"), named(rest)
            length = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None
            payload = None if kind == "revisit" else payload
        elif h.get("content-type", "").startswith("application/warc-fields"):
            fields = named(block)
        else:
            payload = block
        digest = h.get("warc-payload-digest", "").partition(":")[2] or None
        yield kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), digest, length, payload, start, list((fields or {}).items())


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path``; ``payload_length`` is the HTTP Content-Length."""
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.string(), pa.map_(pa.string(), pa.string())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list(FIELDS))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                held, size = [], 0
                for r in records(io.BytesIO(content.as_buffer())):
                    held.append(r)
                    size += len(r[7] or b"")
                    if size > 4 << 20 or len(held) >= 5000:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(parse, SCHEMA)


def measured(recs: DataFrame) -> DataFrame:
    """Adds ``payload_bytes`` and ``digest`` of the full payload: its own, or what a revisit says of it."""
    return recs.withColumns({
        "payload_bytes": F.when(F.col("type") == "revisit", F.col("payload_length")).otherwise(F.octet_length("payload").cast("bigint")),
        "digest": F.when(F.col("type") == "revisit", F.col("payload_digest")).when(F.col("type") == "response", base32(F.sha1("payload"))),
    })


def assemble(recs: DataFrame) -> DataFrame:
    """One row per response or revisit of ``measured`` records: record_id, refers_to, payload_bytes, digest,
    request, response, metadata (structs; null if missing).  ``response`` has the payload if the records have it.

    Of several requests or metadata records of one capture, the one with the smallest record id counts.
    """
    names = [c for c in ("type", "target_uri", "payload_digest", "payload_length", "payload", "start_line", "fields") if c in recs.columns]
    answers = recs.where(F.col("type").isin("response", "revisit")).select("record_id", "refers_to", F.struct(*names).alias("response"), "payload_bytes", "digest")
    one = lambda kind: F.min_by(F.when(F.col("type") == kind, F.struct("record_id", "target_uri", "start_line", "fields")), F.when(F.col("type") == kind, F.col("record_id"))).alias(kind)
    sides = recs.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("record_id")).agg(one("request"), one("metadata"))
    return answers.join(sides, "record_id", "left")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, capture) of an archive; ``refers_to``
    is the page_id of the response that a revisit names, ``capture`` the nested row as JSON, without payload
    and ids."""
    capture = F.struct(
        F.struct("request.start_line", F.col("request.fields")["host"].alias("host")).alias("request"),
        F.struct("response.type", "response.target_uri", F.col("response.fields")["content-type"].alias("media_type"), "response.payload_length").alias("response"),
        F.struct(F.col("metadata.fields")["page-id"].alias("page_id")).alias("metadata"),
    )
    recs = scratch.materialise(measured(read(spark, path)).drop("payload"), "records")  # files are parsed once
    rows = assemble(recs).select(
        "record_id", F.col("refers_to").alias("target"), F.col("response.type").alias("record_type"), F.col("metadata.fields")["page-id"].cast("bigint").alias("page_id"),
        "payload_bytes", F.col("digest").alias("payload_digest"), F.to_json(capture, {"ignoreNullFields": "false"}).alias("capture"),
    )
    rows = scratch.materialise(rows, "captures")
    found = rows.where("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "capture"]
    # Only records that name another are joined: a null key of all the rest would be one partition.
    alone = rows.where("target is null").withColumn("refers_to", F.lit(None).cast("bigint")).select(*columns)
    return rows.where("target is not null").join(found, "target", "left").select(*columns).unionByName(alone)
