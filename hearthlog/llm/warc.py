"""WARC archives: write one record per page, and read archives back even where they are damaged.

**Writing.** Each row becomes one record with payload and block digests. Of the rows with equal payloads
of at least ``min_dedup_bytes`` bytes, the one with the smallest id carries the payload (``response``) and
the others are ``revisit`` records, which keep the HTTP head with its content length and refer to the
first. The smallest id per digest is a combined aggregate, so thousands of copies are no hot group; rows
that repeat the smallest id are all responses. Payloads move once. Records go out through
Spark's text writer, so any store Spark can write to will do: a row is a record's bytes without the last
one or two, which the writer adds as its line separator. Uncompressed archives end every record with CR
LF; in compressed ones each record is one gzip member, whose last byte is the zero top byte of its
length. A member of 16 MB or more does not end in zero and is followed by an empty member that does.

**Reading** (salvage). A file is walked record by record; a record counts when its member inflates, its
version line and length are sound, it ends in CR LF CR LF, and its digests agree. After a failed check
the reader searches, from the byte behind the failed start, for the next member or version line at which
a whole sound record begins, goes on there, and logs the bytes between as a quarantined gap with the
reason. So damage costs the records it touches and no later ones. Record text that looks like a version
line inside a sound payload is never tried.

A file is one task's unit of work; the writer bounds files by ``file_bytes`` (one record may exceed it).
Null payloads are empty; null ids are written as empty and read back as null; repeated rows give repeated
records; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog.session import scratch_dir

VERSION = b"WARC/1.1"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = "1970-01-01T00:00:00Z"
LEVEL = 6
FILE_BYTES = 32 * 1024 * 1024

RECORD_SCHEMA = (
    "file string, start long, finish long, gap_reason string, record_type string, record_id string, uri string, "
    "page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"
)
_ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("start", pa.int64()),
        ("finish", pa.int64()),
        ("gap_reason", pa.string()),
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("uri", pa.string()),
        ("page_id", pa.int64()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_value(text: str | None) -> str:
    """A value that cannot break out of its header line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def record_bytes(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One response record, or a revisit record if ``refers_to`` is given."""
    digest = sha1_base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    key = "" if page_id is None else str(page_id)
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {uri} {refers_to} {digest}')}>"),
        ("WARC-Date", _EPOCH),
        ("WARC-Target-URI", _header_value(uri)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Id", key),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", _REVISIT_PROFILE), ("X-Refers-To-Page-Id", str(refers_to))]
    headers.append(("Content-Length", str(len(block))))
    head = b"\r\n".join([VERSION, *[f"{k}: {v}".encode() for k, v in headers]])
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def _stored(record: bytes, compress: bool) -> bytes:
    """A record as the text writer needs it, without what the line separator will add."""
    if not compress:
        return record[:-2]
    member = gzip.compress(record, LEVEL, mtime=0)
    return (member if member[-1] == 0 else member + gzip.compress(b"", LEVEL, mtime=0))[:-1]


def with_revisits(pages: DataFrame, id_col: str, uri_col: str, payload_col: str, min_dedup_bytes: int) -> DataFrame:
    """(id, uri, payload, refers_to): the id of the record that carries an equal payload, or null."""
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(uri_col).cast("string").alias("uri"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
    )
    # A null id counts as larger than any other.
    rank = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("first_id"))
    first = rows.groupBy("digest").agg(F.min(rank).alias("r"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = rows.join(first.select("digest", "r"), "digest", "left")
    repeat = (F.octet_length("payload") >= min_dedup_bytes) & ~F.col("r.first_id").eqNullSafe(F.col("id"))
    return again.select("id", "uri", "payload", F.when(repeat, F.col("r.first_id")).alias("refers_to"))


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    *,
    compress: bool = True,
    min_dedup_bytes: int = 0,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write WARC files below ``path``, of about ``file_bytes`` before compression at most."""
    rows = with_revisits(pages, id_col, uri_col, payload_col, min_dedup_bytes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("id", "uri", "payload", "refers_to")]
            stored = [_stored(record_bytes(i, u, p or b"", r), compress) for i, u, p, r in zip(*columns)]
            yield pa.record_batch([pa.array(stored, pa.binary())], names=["value"])

    records = rows.mapInArrow(encode, "value binary").select(F.col("value").cast("string"))
    mean = pages.agg(F.avg(F.coalesce(F.octet_length(payload_col), F.lit(0)))).first()[0] or 0
    writer = records.write.mode("overwrite").option("maxRecordsPerFile", max(1, int(file_bytes / (mean + 1_000))))
    writer.option("lineSep", "\0" if compress else "\r\n").text(path)


class Record(NamedTuple):
    finish: int
    headers: dict[str, str]
    block: bytes


class Damaged(Exception):
    """A check failed at the current position."""


def _parse(data: bytes, start: int) -> tuple[int, dict[str, str], bytes]:
    """The record whose version line is at ``start``: its end, headers and block."""
    if not _VERSION_LINE.match(data, start):
        raise Damaged("no version line")
    head_end = data.find(b"\r\n\r\n", start)
    if head_end < 0:
        raise Damaged("unfinished header")
    headers = {}
    for line in data[start:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("malformed header")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no content length")
    begin = head_end + 4
    finish = begin + int(length)
    if data[finish : finish + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where its length says")
    return finish + 4, headers, data[begin:finish]


def _check_digests(headers: dict[str, str], block: bytes) -> None:
    declared = headers.get("warc-block-digest", "")
    if declared.startswith("sha1:") and declared[5:] != sha1_base32(block):
        raise Damaged("block digest differs")
    declared = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and declared.startswith("sha1:"):
        if declared[5:] != sha1_base32(block.partition(b"\r\n\r\n")[2]):
            raise Damaged("payload digest differs")


def _inflate(data: bytes, start: int) -> tuple[int, bytes]:
    """The gzip member at ``start``: its end and contents."""
    inflater, parts, at = zlib.decompressobj(31), [], start
    view = memoryview(data)
    try:
        while not inflater.eof and at < len(data):
            # Small steps: what lies behind the member is copied, and must not be the rest of the file.
            parts.append(inflater.decompress(view[at : at + 16_384]))
            at += 16_384
    except zlib.error as error:
        raise Damaged("member does not inflate") from error
    if not inflater.eof:
        raise Damaged("member is cut off")
    return min(at, len(data)) - len(inflater.unused_data), b"".join(parts)


def _record_at(data: bytes, start: int) -> Record | int:
    """The sound record at ``start``, or the end of an empty member there."""
    if data.startswith(_MEMBER, start):
        finish, body = _inflate(data, start)
        if not body:
            return finish
        end, headers, block = _parse(body, 0)
        if end != len(body):
            raise Damaged("member holds more than one record")
    else:
        finish, headers, block = _parse(data, start)
    _check_digests(headers, block)
    return Record(finish, headers, block)


def _next_candidate(data: bytes, start: int) -> int:
    """Where the next member or version line may begin; the end of the file if nowhere."""
    member = data.find(_MEMBER, start)
    line = _VERSION_LINE.search(data, start, len(data) if member < 0 else member)
    if line:
        return line.start()
    return len(data) if member < 0 else member


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, Record | None]]:
    """(start, end, reason, record) of every sound record and, with a reason, of every gap."""
    at, gap, reason = 0, None, None
    while at < len(data):
        try:
            found = _record_at(data, at)
        except Damaged as failed:
            if gap is None:
                gap, reason = at, str(failed)
            at = _next_candidate(data, at + 1)
            continue
        if gap is not None:
            yield gap, at, reason, None
            gap = None
        if isinstance(found, int):
            at = found
        else:
            yield at, found.finish, None, found
            at = found.finish
    if gap is not None:
        yield gap, len(data), reason, None


def _row(file: str, start: int, finish: int, reason: str | None, record: Record | None) -> tuple:
    if record is None:
        return file, start, finish, reason, None, None, None, None, None, None, None, None
    h = record.headers
    http, _, payload = record.block.partition(b"\r\n\r\n")
    kind = h.get("warc-type")
    number = lambda name: int(h[name]) if re.fullmatch(r"-?\d+", h.get(name, "")) else None
    length = len(payload)
    if kind == "revisit":
        told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        length, payload = (int(told[1]) if told else None), None
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return (
        file, start, finish, None, kind, h.get("warc-record-id"), h.get("warc-target-uri"),
        number("x-page-id"), number("x-refers-to-page-id"), length, digest, payload,
    )


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``path``; a gap has a ``gap_reason`` and no record fields."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                rows, held = [], 0
                for part in salvage(content.as_py()):
                    row = _row(file.as_py(), *part)
                    row = row if with_payload else (*row[:-1], None)
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held > 4_000_000 or len(rows) >= 10_000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], _ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], _ARROW)

    return files.mapInArrow(walk, RECORD_SCHEMA)


def gaps(records: DataFrame) -> DataFrame:
    """The log of quarantined bytes."""
    return records.filter("gap_reason IS NOT NULL").select("file", "start", "finish", "gap_reason")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, and describe every record."""
    spark = pages.sparkSession
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    records = read_archives(spark, path, with_payload=False).filter("gap_reason IS NULL")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
