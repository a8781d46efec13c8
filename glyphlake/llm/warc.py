"""Content-addressed WARC archive.

A payload is stored once, under its SHA-256; record headers are stored apart, byte for byte; a record is put together
again by a join on the digest. Both are Parquet tables in a folder that Spark writes and reads, so any store works:

* payloads(strong, n_bytes, packed): `packed` is the payload, zstd-compressed;
* headers(page_id, strong, header): the exact WARC and HTTP header bytes of each record.

A payload is verified on the way in (SHA-256 and length computed from the bytes kept) and on the way back (recomputed from
the bytes stored; a mismatch raises).

Of records with equal payloads, the one with the largest page_id is the `response`, the others `revisit` it; payloads
shorter than `least` bytes always make responses. page_id is an integer. Nulls, empties, ties: a null html is the empty payload; a null url is
written as an empty WARC-Target-URI; page_id must not be null for WARC identity, null ids are written as `null` and sort
first; rows that repeat a page_id are records of their own, of which one with the largest page_id is the response. An empty
table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def base32_of_hex(digest):
    """Base32 of a 40-digit hex SHA-1, as a Column: five hex digits make four letters."""
    letters = []
    for k in range(8):
        n = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _pack(batches):
    """Each payload of a task once, compressed; the digests seen are as many as the task's payloads."""
    import zstandard

    packer, seen = zstandard.ZstdCompressor(level=3), set()
    for b in batches:
        strong, rows = b.column(0).to_pylist(), []
        for k, name in enumerate(strong):
            if name not in seen:
                seen.add(name)
                rows.append(k)
        packed = [packer.compress(b.column(2)[k].as_buffer()) for k in rows]
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(packed, pa.binary())], names=["strong", "n_bytes", "packed"])


def _verify(batches):
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    for b in batches:
        sizes, sha1 = [], []
        for strong, n, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            payload = unpacker.decompress(packed.as_buffer(), max_output_size=max(n, 1))
            if hashlib.sha256(payload).hexdigest() != strong or len(payload) != n:
                raise ValueError(f"stored payload {strong} does not match its digest")
            sizes.append(len(payload))
            sha1.append(base64.b32encode(hashlib.sha1(payload).digest()).decode())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(sha1, pa.string())], names=["strong", "payload_bytes", "payload_digest"])


def headers(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, strong, header): header is the record's exact header block as bytes. Only digests and
    ids are shuffled."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.sha2(payload, 256).alias("strong"), F.octet_length(payload).cast("long").alias("n_bytes"), F.sha1(payload).alias("sha1"))
    largest = rows.groupBy("strong").agg(F.max("page_id").alias("first_id"))
    # rows that repeat a page_id: one of them is the first
    one = Window.partitionBy("strong", "page_id").orderBy("url")
    rows = rows.join(largest, "strong").withColumn("turn", F.when(F.col("page_id").eqNullSafe(F.col("first_id")), F.row_number().over(one)).otherwise(0))
    first = F.col("turn") == 1
    response = first | (F.col("n_bytes") < least)
    ident = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(response, "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), ident, F.lit(">\r\nWARC-Date: " + DATE + "\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "%0A"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha1")),
        F.when(response, F.lit("")).otherwise(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.coalesce(F.col("first_id").cast("string"), F.lit("null")), F.lit(">"))),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.length(http) + F.when(response, F.col("n_bytes")).otherwise(0)).cast("string"),
        F.lit("\r\n\r\n"), http,
    )
    return rows.select("page_id", "strong", F.encode(head, "UTF-8").alias("header"))


def write_archive(pages: DataFrame, path: str, least: int = 0) -> str:
    """Stores the archive of pages under path and returns path."""
    heads = headers(pages, least)
    heads.write.option("compression", "zstd").parquet(f"{path}/headers")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.sha2(payload, 256).alias("strong"), F.octet_length(payload).cast("long").alias("n_bytes"), payload.alias("payload"))
    # a task sends a payload once, compressed as it is stored; equal payloads pack to equal bytes, so any of them may stay
    sent = rows.mapInArrow(_pack, PAYLOADS)
    sent.groupBy("strong").agg(F.first("n_bytes").alias("n_bytes"), F.first("packed").alias("packed")).write.option("compression", "none").parquet(f"{path}/payloads")
    return path


HEADERS = "page_id long, strong string, header binary"
PAYLOADS = "strong string, n_bytes long, packed binary"


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The header fields of each stored record: page_id, strong, record_type, refers_to."""
    text = F.decode("header", "UTF-8")
    refers = F.regexp_extract(text, r"\r\nWARC-Refers-To: <urn:page:(-?\d+)>", 1)
    return spark.read.schema(HEADERS).parquet(f"{path}/headers").select(
        F.regexp_extract(text, r"\r\nWARC-Record-ID: <urn:page:(-?\d+|null)>", 1).try_cast("long").alias("page_id"),
        "strong",
        F.regexp_extract(text, r"\r\nWARC-Type: (\w+)", 1).alias("record_type"),
        F.when(refers != "", refers.try_cast("long")).alias("refers_to"),
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """strong, payload_bytes, payload_digest, each computed again from the stored bytes, which are checked."""
    stored = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    return stored.mapInArrow(_verify, "strong string, payload_bytes long, payload_digest string")


def _unpack(batches):
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    for b in batches:
        whole = []
        for header, n, packed in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            block = unpacker.decompress(packed.as_buffer(), max_output_size=max(n, 1)) if b"\r\nWARC-Type: response\r\n" in header else b""
            whole.append(header + block + b"\r\n\r\n")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(whole, pa.binary())], names=["page_id", "record"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """The original WARC records, byte for byte: headers joined to payloads by digest. page_id, record."""
    heads = spark.read.schema(HEADERS).parquet(f"{path}/headers")
    stored = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    return heads.join(stored, "strong").select("page_id", "header", "n_bytes", "packed").mapInArrow(_unpack, "page_id long, record binary")


def op9_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archive of all pages to the shared folder and reads it back. Payloads are verified once each; what is
    joined to the headers are their digests, so a payload shared by a third of all records isn't sent around."""
    import uuid

    path = write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read_headers(spark, path).join(read_payloads(spark, path), "strong").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_OP9 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', ((('0x' || substr(x, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM h
"""
