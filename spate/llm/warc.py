"""WARC archives with revisit resolution.

Headers (record id, payload digest, payload length) are shuffled by digest and
joined with the original of each digest; every other record with that payload
becomes a revisit that refers to it.  Archives are written by Spark's own
writer into any file system it knows, one record per row, and read back by
Content-Length framing.

Null payloads are empty payloads.  Records with a null id are written and read
back with a null id; they never become an original while a record with an id
has the same payload.  Rows that repeat the largest id of their payload are
all responses.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spate.llm.common import stage

#: Payload bytes per archive file, from the mean record; one reader task holds one file.
ARCHIVE_BYTES = 24 << 20
_END = "\r\n\r\n"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: RFC 4648 base32


def base32_sha1(col: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string's UTF-8 bytes (160 bits = 32 letters)."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(F.sha1(col.cast("binary")), k, 10), 16, 2), 40, "0") for k in (1, 11, 21, 31)])
    letters = [
        F.substring(F.lit(_ALPHABET), F.conv(F.substring(bits, 5 * k + 1, 5), 2, 10).cast("int") + F.lit(1), F.lit(1))
        for k in range(32)
    ]
    return F.concat(*letters)


def headers(records: DataFrame, record_id: str, payload: str) -> DataFrame:
    """(record_id, sha1 hex, payload bytes) of each record: what is shuffled instead of payloads."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    return records.select(
        F.col(record_id).cast("long").alias("record_id"),
        F.sha1(body).alias("sha1"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
    )


def originals(head: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The largest record id of each payload, by a partial aggregate on the digest.

    Hash-aggregated on both sides of the shuffle, so a payload that a third of
    all records share costs one row per task.
    """
    return (
        head.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("sha1")
        .agg(F.max("record_id").alias("original"), F.count(F.lit(1)).alias("copies"))
    )


def resolve(head: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records that revisit another one: (record_id, sha1, refers_to)."""
    orig = originals(head, min_bytes).filter((F.col("copies") > 1) & F.col("original").isNotNull())
    return (
        head.join(orig, "sha1")
        .filter(~F.col("record_id").eqNullSafe(F.col("original")))
        .select("record_id", "sha1", F.col("original").alias("refers_to"))
    )


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(record_id.cast("string"), F.lit("null")), F.lit(">"))


def record_text(record_id: Column, uri: Column, date: Column, digest: Column, payload: Column, refers_to: Column) -> Column:
    """One WARC/1.1 record without its two closing line ends (the writer's line separator)."""
    revisit = refers_to.isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(payload)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(record_id)),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(uri, F.lit("")), "[\\x00-\\x20\\x7f]", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(refers_to))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), body)


def write_archives(
    records: DataFrame,
    path: str,
    record_id: str = "page_id",
    uri: str = "url",
    payload: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    min_bytes: int = 0,
) -> None:
    """Write one record per row under ``path`` (gzip files), revisits resolved.

    Payloads are not shuffled by digest: the only wide rows that move are those
    of the join that tells each record its original, on the record id.
    """
    head = stage(headers(records, record_id, payload), "warc-headers")
    mean = head.agg(F.avg("payload_bytes")).first()[0] or 0
    rev = resolve(head, min_bytes).select("record_id", F.col("sha1").alias("__sha1"), "refers_to").distinct()
    src = records.select(
        F.col(record_id).cast("long").alias("record_id"),
        F.col(uri).cast("string").alias("uri"),
        F.coalesce(F.col(payload), F.lit("")).alias("payload"),
    ).withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    joined = src.join(rev, src["record_id"].eqNullSafe(rev["record_id"]) & (src["sha1"] == rev["__sha1"]), "left")
    joined.select(
        record_text(
            src["record_id"], F.col("uri"), F.lit(date), base32_sha1(F.col("payload")), F.col("payload"), F.col("refers_to")
        ).alias("value")
    ).write.option("lineSep", _END).option("compression", "gzip").option(
        "maxRecordsPerFile", max(1, int(ARCHIVE_BYTES / (mean + 512)))
    ).text(path)


_HEADER = re.compile(rb"([A-Za-z-]+): ([^\r\n]*)")


def parse(content: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(header fields, block) of each record of one archive file, framed by Content-Length."""
    data, at = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content, 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        body = data.index(b"\r\n\r\n", at) + 4
        fields = dict(_HEADER.findall(data[at:body]))
        end = body + int(fields[b"Content-Length"])
        yield fields, data[body:end]
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        at = end + 4


def read_archives(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """Records of the archives under ``path``: record_id, uri, type, digest, digest_ok, refers_to, block_bytes[, block].

    ``digest_ok`` recomputes a response's SHA-1 from the block that was read.
    """
    import hashlib

    names = ["record_id", "uri", "record_type", "payload_digest", "digest_ok", "refers_to", "block_bytes"]
    schema = "record_id long, uri string, record_type string, payload_digest string, digest_ok boolean, refers_to long, block_bytes long"
    if with_block:
        names.append("block")
        schema += ", block binary"

    def number(urn: bytes | None) -> int | None:
        return int(urn[12:-1]) if urn and urn != b"<urn:record:null>" else None

    def flush(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names
        )

    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows, size = [], 0
                for f, block in parse(b.column(0)[k].as_py()):
                    kind = f[b"WARC-Type"].decode()
                    digest = f[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
                    ok = base64.b32encode(hashlib.sha1(block).digest()).decode() == digest if kind == "response" else None
                    row = [number(f[b"WARC-Record-ID"]), f[b"WARC-Target-URI"].decode(), kind, digest, ok, number(f.get(b"WARC-Refers-To")), len(block)]
                    rows.append([*row, block] if with_block else row)
                    size += len(block)
                    if with_block and size > 4 << 20 or len(rows) >= 10_000:
                        yield flush(rows)
                        rows, size = [], 0
                if rows:
                    yield flush(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return files.mapInArrow(run, schema)


def page_digests(read: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit has no block of its own; its payload length comes from the
    response it refers to, joined on digest and id.
    """
    response = read.filter("record_type = 'response'").filter(F.col("digest_ok"))
    revisit = read.filter("record_type = 'revisit'")
    orig = response.select(
        F.col("record_id").alias("refers_to"), "payload_digest", F.col("block_bytes").alias("payload_bytes")
    ).distinct()
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    a = response.select(
        F.col("record_id").alias("page_id"), F.col("block_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
    b = revisit.join(orig, ["refers_to", "payload_digest"]).withColumnRenamed("record_id", "page_id")
    return a.select(*out).unionByName(b.select(*out))


def dedupe_archives(spark: SparkSession, source: str, target: str) -> None:
    """Read archives, resolve their equal payloads, and write them anew with fresh headers."""
    read = read_archives(spark, source)
    full = read.filter("record_type = 'response'")
    back = (
        read.filter("record_type = 'revisit'")
        .drop("block")
        .join(full.select(F.col("record_id").alias("refers_to"), "block").distinct(), "refers_to")
    )
    records = full.select("record_id", "uri", "block").unionByName(back.select("record_id", "uri", "block"))
    write_archives(
        records.withColumn("block", F.col("block").cast("string")), target, record_id="record_id", uri="uri", payload="block"
    )


#: DuckDB restatement (SHA-1 hex to base32 by five-bit groups).
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS x FROM p),
m AS (SELECT x, max(page_id) AS orig FROM h GROUP BY x),
bits AS (
    SELECT x, array_to_string(list_transform(string_split(x, ''), lambda c: right(bin(instr('0123456789abcdef', c) - 1 + 16), 4)), '') AS b
    FROM m
),
dig AS (
    SELECT x, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
        16 * CAST(substr(b, 5 * k + 1, 1) AS INTEGER) + 8 * CAST(substr(b, 5 * k + 2, 1) AS INTEGER) + 4 * CAST(substr(b, 5 * k + 3, 1) AS INTEGER)
        + 2 * CAST(substr(b, 5 * k + 4, 1) AS INTEGER) + CAST(substr(b, 5 * k + 5, 1) AS INTEGER), 1)), '') AS payload_digest
    FROM bits
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = orig THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> orig THEN orig END AS refers_to
FROM h JOIN m USING (x) JOIN dig USING (x)"""
