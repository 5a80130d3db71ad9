"""Legacy archives to WARC.

An ARC file opens with a version block whose second line names the fields of every header line: five in
version 1, ten in version 2.  A record is a header line, as many bytes as its length field declares, and
a newline.  The converter reads the fields from the right, so that an address may hold spaces, splits
HTTP messages into header and payload, and synthesises what WARC needs: a record id from the record's
own bytes, an ISO date from the 14 digits, a type, a payload digest.

Records with equal payloads are told by digest and length.  The last one (largest page id, then date,
then record id) is a response, the others become revisits of it without their payload.  Which records
those are is settled on narrow rows; payloads move only if the list of revisits is too long to send to
all executors (``SENT``), and then once, by record id.

Cases: null payload - empty; empty payloads - equal to each other; null or empty address - ``urn:page:``
and the id; null page id - smallest, several of them are all responses when nothing else decides;
repeated rows - equal records with equal ids, all responses or all revisits; a record cut short - kept
with ``WARC-Truncated: length``; empty table - one empty archive; other columns - ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import stored, text_bytes

ARC_BYTES = 4 << 20
SENT = 200_000
# fixed values of the formats
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, page_id long, warc_type string, uri string, warc_date string, content_type string, head binary, payload binary, payload_bytes long, payload_digest string, truncated boolean"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- ARC ------------------------------------------------------------------------------------


def write_arc(records: list[tuple], version: int, name: str, date: str) -> bytes:
    """An archive of (page id, url, payload) in the given version."""
    fields = ARC_FIELDS[version].split()
    body = f"{version} 0 pageloom\n{ARC_FIELDS[version]}\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain {'200 - - 0 ' + name + ' ' if version == 2 else ''}{len(body)}\n".encode(), body, b"\n"]
    for page_id, url, payload in records:
        url = re.sub(r"[\r\n]", "", url or "") or f"urn:page:{page_id}"
        number = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
        message = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{number}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
        value = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Archive-length": str(len(message)), "Result-code": "200", "Filename": name}
        out += [" ".join(value.get(f, "-") for f in fields).encode(), b"\n", message, b"\n"]
    return b"".join(out)


def read_arc(content: bytes) -> Iterator[tuple]:
    """Rows of ``RECORD`` of one archive, plain or gzipped."""
    if content[:2] == b"\x1f\x8b":
        content = b"".join(_inflate(content))
    line, at = _line(content, 0)
    size = int(line.rsplit(b" ", 1)[-1])
    block = content[at : at + size].split(b"\n")
    fields = (block[1].decode() if len(block) > 1 and block[1].startswith(b"URL") else ARC_FIELDS[int(block[0].split()[0])]).split()
    at += size
    while True:
        while content[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(content):
            return
        line, at = _line(content, at)
        parts = line.decode().rsplit(" ", len(fields) - 1)
        value = dict(zip(fields, parts))
        size = int(value["Archive-length"])
        body = content[at : at + size]
        at += size
        yield _record(line, value, body, len(body) < size)


def _line(content: bytes, at: int) -> tuple[bytes, int]:
    end = content.find(b"\n", at)
    end = len(content) if end < 0 else end
    return content[at:end].rstrip(b"\r"), end + 1


def _record(line: bytes, value: dict, body: bytes, truncated: bool) -> tuple:
    head, payload = b"", body
    if body.startswith(b"HTTP/"):
        cut = body.find(b"\r\n\r\n")
        cut = len(body) if cut < 0 else cut + 4
        head, payload = body[:cut], body[cut:]
    number = re.search(rb"(?im)^X-Page-Id: *(-?\d+)", head)
    date = value["Archive-date"].ljust(14, "0")
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    own = hashlib.sha1(line + b"\n" + body).digest()
    return (
        f"urn:uuid:{uuid.UUID(bytes=own[:16], version=5)}",
        int(number[1]) if number else None,
        "response" if head else "resource",
        value["URL"],
        stamp,
        "application/http; msgtype=response" if head else value["Content-type"],
        head,
        payload,
        len(payload),
        digest_of(payload),
        truncated,
    )


def arc_archives(pages: DataFrame, date: str = "20200101000000") -> DataFrame:
    """Pages (page_id, url, html) in legacy archives of some megabytes, versions in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "body"))):
                held.append(row)
                size += len(row[2])
                if size >= ARC_BYTES:
                    yield _archive(held, n, date)
                    held, size, n = [], 0, n + 1
        if held:
            yield _archive(held, n, date)

    return pages.select("page_id", "url", text_bytes("html").alias("body")).mapInArrow(run, "archive string, content binary")


def _archive(held: list, n: int, date: str) -> pa.RecordBatch:
    content = write_arc(held, 1 + n % 2, "pages.arc", date)
    return pa.RecordBatch.from_arrays([pa.array(["pages.arc"]), pa.array([content], pa.binary())], names=["archive", "content"])


def _rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kinds[f.dataType.simpleString()]) for c, f in zip(columns, schema)], names=schema.names
    )


def _parsed(archives: DataFrame, read, schema: str, limit: int = 2 << 20) -> DataFrame:
    """Rows that ``read`` yields from the content of each archive, in batches of some megabytes."""
    kind = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                held, size = [], 0
                for row in read(content):
                    held.append(row)
                    size += 200 + sum(len(x) for x in row if isinstance(x, bytes))
                    if size > limit:
                        yield _rows(held, kind)
                        held, size = [], 0
                if held:
                    yield _rows(held, kind)

    return archives.select("content").mapInArrow(run, kind)


def arc_records(archives: DataFrame) -> DataFrame:
    """One row per record of ARC archives (a column ``content`` of whole files)."""
    return _parsed(archives, read_arc, RECORD)


# -- WARC -----------------------------------------------------------------------------------


def revisits(records: DataFrame) -> DataFrame:
    """(record_id, refers_to, refers_uri, refers_date) of the records that repeat a later payload."""
    order = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("page_id"), "warc_date", "record_id", "uri")
    narrow = records.select("record_id", "payload_digest", "payload_bytes", order.alias("own"))
    last = narrow.groupBy("payload_digest", "payload_bytes").agg(F.max("own").alias("last"), F.count("*").alias("n")).where("n > 1")
    joined = narrow.join(last, ["payload_digest", "payload_bytes"]).where("own.record_id <> last.record_id and own.page_id < last.page_id")
    return joined.select("record_id", F.col("last.record_id").alias("refers_to"), F.col("last.uri").alias("refers_uri"), F.col("last.warc_date").alias("refers_date")).distinct()


def warc_bytes(row: dict) -> bytes:
    """One WARC record without the blank lines that end it."""
    revisit = row["refers_to"] is not None
    block = row["head"] + (b"" if revisit else row["payload"])
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else row['warc_type']}",
        f"WARC-Record-ID: <{row['record_id']}>",
        f"WARC-Target-URI: {row['uri']}",
        f"WARC-Date: {row['warc_date']}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"Content-Type: {row['content_type']}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: <{row['refers_to']}>",
            f"WARC-Refers-To-Target-URI: {row['refers_uri']}",
            f"WARC-Refers-To-Date: {row['refers_date']}",
        ]
    if row["truncated"]:
        lines.append("WARC-Truncated: length")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def convert(records: DataFrame, path: str) -> None:
    """Write ARC records as gzipped WARC files below ``path``, one file per task.

    Which payloads repeat is settled on a written copy of the narrow columns, so records are made
    twice: once for that, once to be written.
    """
    spark: SparkSession = records.sparkSession
    narrow = records.select("record_id", "payload_digest", "payload_bytes", "page_id", "warc_date", "uri")
    repeats = stored(revisits(stored(narrow, "payloads")), "revisits")
    if repeats.count() <= SENT:
        repeats = F.broadcast(repeats)
    columns = [*records.columns, "refers_to", "refers_uri", "refers_date"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = b"software: pageloom\r\nformat: WARC File Format 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'pageloom')}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
        yield pa.RecordBatch.from_arrays([pa.array([head.encode() + info], pa.binary())], names=["record"])
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([warc_bytes(r) for r in rows], pa.binary())], names=["record"])

    whole = records.join(repeats, "record_id", "left").select(*columns).mapInArrow(run, "record binary")
    # the two line ends after a record are the writer's line separator
    whole.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    spark.catalog.refreshByPath(path)


def _inflate(content: bytes) -> Iterator[bytes]:
    """The members of a gzip file, some megabytes at a time."""
    while content:
        one = zlib.decompressobj(31)
        for at in range(0, len(content), 1 << 18):
            yield one.decompress(content[at : at + (1 << 18)])
            if one.eof:
                content = one.unused_data + content[at + (1 << 18) :]
                break
        else:
            return


def read_warc(content: bytes) -> Iterator[tuple]:
    """(record id, page id, type, uri, payload, payload bytes, payload digest, refers to) per record."""
    buffer, parts = b"", _inflate(content) if content[:2] == b"\x1f\x8b" else iter([content])

    def fill(n: int) -> bool:
        nonlocal buffer
        held, size = [buffer], len(buffer)
        while size < n:
            more = next(parts, None)
            if more is None:
                break
            held.append(more)
            size += len(more)
        buffer = b"".join(held)
        return size >= n

    while True:
        cut = buffer.find(b"\r\n\r\n")
        while cut < 0:
            if not fill(len(buffer) + 1):
                return
            cut = buffer.find(b"\r\n\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in buffer[:cut].decode().split("\r\n")[1:])}
        size = int(head["content-length"])
        if not fill(cut + 4 + size):
            raise ValueError(f"record {head.get('warc-record-id')} is cut short")
        block = buffer[cut + 4 : cut + 4 + size]
        fill(cut + 4 + size + 4)
        buffer = buffer[cut + 4 + size + 4 :]
        if head["warc-type"] == "warcinfo":
            continue
        http = head["content-type"].startswith("application/http")
        split = block.find(b"\r\n\r\n") + 4 if http else 0
        payload = block[split:]
        number = re.search(rb"(?im)^X-Page-Id: *(-?\d+)", block[:split])
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] == "revisit":
            declared = re.search(rb"(?im)^Content-Length: *(\d+)", block[:split])
            length = int(declared[1]) if declared else None
        else:
            length = len(payload)
            if digest_of(payload) != digest:
                raise ValueError(f"record {head['warc-record-id']} does not match its digest")
        yield (
            head["warc-record-id"].strip("<>"),
            int(number[1]) if number else None,
            head["warc-type"],
            head["warc-target-uri"],
            None if head["warc-type"] == "revisit" else payload,
            length,
            digest,
            head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
        )


WARC_ROW = "record_id string, page_id long, record_type string, uri string, payload binary, payload_bytes long, payload_digest string, refers_to_id string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files below ``path``."""
    return _parsed(spark.read.format("binaryFile").load(path), read_warc, WARC_ROW)
