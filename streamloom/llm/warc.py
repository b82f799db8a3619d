"""WARC archives with revisit resolution.

Headers (payload digest, page id) are shuffled by digest; the smallest page id
of a digest is the original.  Records are joined to it and written with fresh
headers: the original as a response, the others as revisits without payload
that refer to it.

Every record is a gzip member of its own, as the format asks; one of MEMBER_BYTES
or more is cut over several.  Archives are written by Spark's own committed
writer, so they can lie in any store that Spark reaches: a row of its text format
holds the members of one file, and its line separator is the zero byte with which
a member of less than 16 MiB ends.  A file holds ``file_bytes`` and the rest of
its last record.

Defined results: a null page is an empty payload; a very long page is a record
like others; payloads shorter than
``min_bytes`` are always responses; of rows that repeat the smallest page id of
a payload every one is a response, and the least of their urls is referred to;
a null page id is an original only where no
row of the payload has one, and is read back as null; a null url is empty;
an empty table gives empty archives; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, salted_left_join, scratch_path

CRLF = "\r\n"
#: Compressed bytes of an archive file: bounds what a writer or reader holds in memory.
FILE_BYTES = 16_000_000
#: Bytes of a record in one gzip member at most; below 16 MiB the last byte of a member is zero.
MEMBER_BYTES = 16_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}')}>"


def _header_text(value: object) -> str:
    """A value that stays on its header line."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in str(value))


def _record(page_id, url, payload: bytes, digest: str, original, original_url, date: str) -> bytes:
    refers = original is not None
    block = (
        f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}"
    ).encode()
    if not refers:
        block += payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_header_text(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers:
        lines += [
            f"WARC-Refers-To: {record_id(original, digest)}",
            f"WARC-Refers-To-Target-URI: {_header_text(original_url)}",
            f"WARC-Profile: {PROFILE}",
            f"X-Refers-To-Page-Id: {original}",
        ]
    return (CRLF.join(lines) + CRLF + CRLF).encode() + block + (CRLF + CRLF).encode()


def _members(record: bytes) -> bytes:
    out = []
    for k in range(0, len(record), MEMBER_BYTES):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += [packer.compress(record[k : k + MEMBER_BYTES]), packer.flush()]
    return b"".join(out)


def _writer(date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])

        held, size = [], 0
        for batch in batches:
            for page_id, url, html, digest, original, original_url in zip(*batch.columns, strict=True):
                name = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                payload = html.as_buffer().to_pybytes()
                record = _record(page_id.as_py(), url.as_py(), payload, name, original.as_py(), original_url.as_py(), date)
                held.append(_members(record))
                size += len(held[-1])
                if size >= file_bytes:
                    yield file()
                    held, size = [], 0
        if held:
            yield file()

    return run


def write_archives(
    pages: DataFrame,
    path: str,
    min_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write the deduplicated archives of ``pages`` (gzip) into the folder ``path``."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    digested = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        html.alias("html"),
        F.sha1(html.cast("binary")).alias("digest"),
    )
    headers = materialize(
        digested.where(F.octet_length("html") >= min_bytes).select("digest", "page_id", "url"), "headers"
    )
    identified = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    originals = (
        headers.groupBy("digest")
        .agg(F.min(identified).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("digest", F.col("first.page_id").alias("original"), F.col("first.url").alias("original_url"))
    )
    salt = F.struct("page_id", "url")
    joined = salted_left_join(digested, materialize(originals, "originals"), "digest", salt, 5_000)
    long_enough = F.octet_length("html") >= min_bytes
    revisits = long_enough & (F.col("page_id").isNull() | (F.col("original") != F.col("page_id")))
    cast = [F.when(revisits, F.col(c)).alias(c) for c in ("original", "original_url")]
    (
        joined.select("page_id", "url", "html", "digest", *cast)
        .mapInArrow(_writer(date, file_bytes), "value binary")
        .select(F.col("value").cast("string"))  # keeps the bytes as they are
        .write.option("lineSep", "\0")
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The (headers, block) of each record of an uncompressed archive, by content length."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        first = stop + 4
        end = first + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield headers, data[first:end]
        at = end + 4


def _gunzip(data: bytes) -> Iterator[bytes]:
    """The content of each gzip member."""
    while data:
        member = zlib.decompressobj(31)
        yield member.decompress(data) + member.flush()
        if not member.eof:
            raise ValueError("a gzip member is cut off")
        data = member.unused_data


def _whole_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive; one that is cut over members is put together."""
    held = b""
    for content in _gunzip(data):
        held += content
        if len(content) < MEMBER_BYTES:
            yield from parse_records(held)
            held = b""
    yield from parse_records(held)


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for headers, block in _whole_records(content):
                http, _, payload = block.partition(b"\r\n\r\n")
                kind = headers["WARC-Type"]
                stated = dict(line.split(": ", 1) for line in http.decode().split(CRLF)[1:])
                n_bytes = int(stated["Content-Length"])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload) != n_bytes or base32_sha1(payload) != digest):
                    raise ValueError(f"payload of {headers['WARC-Record-ID']} is not what its headers say")
                rows.append(
                    (
                        headers.get("X-Page-Id"),
                        headers["WARC-Target-URI"],
                        n_bytes,
                        digest,
                        kind,
                        headers.get("X-Refers-To-Page-Id"),
                        payload if kind == "response" else None,
                    )
                )
            yield pd.DataFrame(rows, columns=_READ).astype({"page_id": "Int64", "refers_to": "Int64"})


_READ = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
READ_SCHEMA = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, payload binary"
)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``, checked against their headers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(_reader, READ_SCHEMA)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)
