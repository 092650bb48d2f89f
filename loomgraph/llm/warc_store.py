"""A content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records rebuilt by a join.

An archive is a folder with two tables. ``payloads``: key (SHA-256), payload. ``headers``: key, page_id, header (the exact bytes
of the WARC header with its closing blank line), http (the exact bytes of the HTTP header before the payload). A record is
header + block + two line ends; the block of a response is http + payload, that of a revisit is http alone.

Digests are verified twice. On writing, a second hash and the lengths of all payloads of one key must agree. On reading, the
key is computed anew from the stored bytes, and the payload digest must be that of the header; otherwise the read fails.

Defined cases: a null html is an empty payload, a null url has no target line, line ends inside a url are percent-encoded.
Of rows with equal payloads, one is the response: the smallest page_id, then the smallest url, then the first read (a null
page_id or url comes last), so repeated rows revisit each other. Columns that aren't named are ignored. An empty table
makes an empty archive. Very long payloads are kept whole, a row each. The payloads of a key meet in partial aggregates, so that a very common one is sent once a task.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import dropped, new_path, table, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digests(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, key, sha1 of every row."""

    def run(batches):
        for batch in batches:
            raw = [(t.as_py() or "").encode() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array([hashlib.sha256(r).digest() for r in raw], pa.binary()), pa.array([base32_sha1(r) for r in raw], pa.string())], names=["page_id", "url", "payload", "key", "sha1"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, payload binary, key binary, sha1 string")


def _uuid(*columns: str) -> F.Column:
    h = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def write_archive(pages: DataFrame, path: str, least: int = 0, date: str = DATE) -> None:
    """Writes the archive of all rows. Payloads under least bytes are responses each time."""
    rows = _digests(pages)
    stored = rows.select("key", "payload").groupBy("key").agg(
        F.first("payload").alias("payload"), F.min(F.xxhash64("payload")).alias("lo"), F.max(F.xxhash64("payload")).alias("hi"), F.min(F.octet_length("payload")).alias("short"), F.max(F.octet_length("payload")).alias("long")
    )
    same = (F.col("lo") == F.col("hi")) & (F.col("short") == F.col("long"))
    stored.select("key", F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("different payloads have one digest")).cast("binary")).alias("payload")).write.parquet(f"{path}/payloads")

    small = written(rows.select("page_id", "url", "key", "sha1", F.octet_length("payload").cast("long").alias("size"), F.monotonically_increasing_id().alias("at")), "records")
    order = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("page_id"), F.col("url").isNull().alias("b"), F.col("url").alias("url"), F.col("at").alias("at"))
    first = small.groupBy("key").agg(F.min(order).alias("response"))
    record = small.join(first, "key").withColumn("revisit", (F.col("size") >= least) & (F.col("response.at") != F.col("at")))
    record = record.withColumns({"id": _uuid("page_id", "url", "sha1", "at"), "response_page": F.col("response.page_id")}).withColumn("response_id", _uuid("response.page_id", "response.url", "sha1", "response.at"))
    safe = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    length = F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("size"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.col("id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", safe),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        line("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
        line("WARC-Refers-To", F.when(F.col("revisit"), F.col("response_id"))),
        line("X-Page-ID", F.col("page_id").cast("string")),
        line("X-Refers-To-Page-ID", F.when(F.col("revisit"), F.col("response_page").cast("string"))),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    out = record.withColumn("http", http).select("key", "page_id", header.cast("binary").alias("header"), F.col("http").cast("binary").alias("http"))
    out.write.parquet(f"{path}/headers")
    dropped(small)


def fields(header: bytes) -> dict[str, str]:
    """The named fields of a record's header."""
    return dict(x.split(": ", 1) for x in header.decode().split("\r\n")[1:] if x)


def read_archive(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and, if whole, payload and record (the original bytes), of every record."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, header, http, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hashlib.sha256(payload).digest() != key:
                    raise ValueError("a stored payload doesn't have its digest")
                named, digest = fields(header), base32_sha1(payload)
                if named["WARC-Payload-Digest"] != f"sha1:{digest}":
                    raise ValueError("a payload isn't that of its record")
                number = lambda name: int(named[name]) if name in named else None  # noqa: E731, B023
                block = http if named["WARC-Type"] == "revisit" else http + payload
                if len(block) != int(named["Content-Length"]):
                    raise ValueError("a record's block hasn't the length in its header")
                row = (number("X-Page-ID"), len(payload), digest, named["WARC-Type"], number("X-Refers-To-Page-ID"))
                rows.append((*row, payload, header + block + b"\r\n\r\n") if whole else row)
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "record"][: 7 if whole else 5]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds)], names=names)

    headers, payloads = (spark.read.parquet(f"{path}/{x}") for x in ("headers", "payloads"))
    rows = headers.join(payloads, "key").select("key", "header", "http", "payload")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return rows.mapInArrow(run, schema + (", payload binary, record binary" if whole else ""))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        named = fields(data[at:end])
        if not re.match(rb"WARC/1\.[01]\r\n", data[at:end]):
            raise ValueError("no WARC record")
        size = int(named["Content-Length"])
        yield named, data[end : end + size]
        at = end + size + 4


def op4_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path, whole=False)


QUERIES = {"op4_warc_store": op4_warc_store}
ORACLES = {
    "op4_warc_store": """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
    SELECT page_id, payload, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p
)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
}
