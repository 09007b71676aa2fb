"""Web archives: legacy ARC files in, WARC files out, and both read back.

The converter reads each ARC file's version block, parses the header lines of that version (1: five fields,
2: ten fields), takes as many bytes as the line declares, and synthesises what WARC asks for: record id, date,
type, block and payload digests. Of records with equal payloads the one with the largest page id is kept as
response; the others become revisit records that name it and hold only their HTTP header. Blocks without an HTTP
header (dns and ftp records, say) become resource records.

All files are written and read by Spark, so they may lie in any store that Spark reaches, under any names; those that
begin with `_` or `.` are hidden. Gzip files may have one member or one for each record. A file is unpacked as a stream: a
task holds its packed bytes, one record, and a batch. When writing, a row is a record, the line separator of Spark's text
writer is the end mark of a record, and files are gzip-compressed as a whole.

HTTP headers may end in CRLF CRLF or, as in old crawls, in LF LF. A url with spaces in an ARC header line stays whole. A
record's id follows from its ARC file and its number there, so rows that are equal in all columns have ids of their own.
Null payload: empty. Null url: `about:blank`. Null page id: a record without id, it counts as smaller than all ids.
Rows that repeat the largest id are all responses. Empty table: archives without records. Other columns are left
out, whatever their names. A file that does not start with a version block, that has a header line of another form, or
that ends inside a declared length is an error: a truncated archive must not pass as a short one. With `strict=False` its
good records are read and a row with `error` tells where the file was left.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codehealth.llm.shared import fresh_path

#: Fields of an ARC header line by version.
ARC_FIELDS = {
    "1": ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    "2": ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Bytes of payload in one batch that leaves a Python worker.
BATCH = 8 << 20

#: Level of compression: higher ones take far more time than they save in bytes.
PACKED = {"compression": "gzip", "zlib.compress.level": "THREE"}

RECORD = "file string, at long, page_id long, url string, fetched string, kind string, http binary, payload binary, payload_digest string, error string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about `most` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def arc_url(url: str | None) -> str:
    """The url without bytes that a header line cannot hold."""
    return re.sub(rb"[^\x21-\x7E]", lambda m: b"%%%02X" % m[0][0], (url or "about:blank").encode("utf-8", "replace")).decode() or "about:blank"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_line(version: str, url: str, date: str, kind: str, n: int, ip: str = "0.0.0.0", file: str = "-") -> bytes:
    middle = "" if version == "1" else f" 200 - - 0 {file}"
    return f"{url} {ip} {date} {kind}{middle} {n}\n".encode()


def version_block(version: str, name: str, date: str) -> bytes:
    body = f"{version} 0 codehealth\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_line(version, f"filedesc://{name}", date, "text/plain", len(body), file=name) + body


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000", version: str | None = None) -> None:
    """One ARC file for each part of pages; versions take turns unless one is named."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own = version or "12"[part % 2]

        def rows() -> Iterator[tuple]:
            first = True
            for batch in batches:
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    if first:
                        yield (version_block(own, f"part-{part}.arc", date),)
                        first = False
                    block = http_block(page_id, html or b"")
                    yield (arc_line(own, arc_url(url), date, "text/html", len(block), file=f"part-{part}.arc") + block,)

        yield from batched(rows(), ["value"], [pa.binary()])

    source = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").cast("binary").alias("html"))
    source.mapInArrow(work, "value binary").select(F.col("value").cast("string")).write.options(lineSep="\n", **PACKED).text(path)


def arc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record of an ARC file, without version blocks."""
    fields = None
    while line := stream.readline():
        line = line.rstrip(b"\r\n").decode("latin-1")
        if not line:  # between records
            continue
        described = line.startswith("filedesc://")
        if fields is None and not described:
            raise ValueError("an ARC file starts with a version block")
        names = fields or ()
        parts = line.split(" ") if described else line.rsplit(" ", len(names) - 1)
        if not parts[-1].isdigit() or not described and len(parts) != len(names):
            raise ValueError(f"a header line of {len(parts)} fields that ends in {parts[-1][:40]!r}")
        n = int(parts[-1])
        body = stream.read(n)
        if len(body) != n:
            raise ValueError("the file ends inside a record")
        if described:
            fields = ARC_FIELDS.get(body.split(b" ", 1)[0].decode("latin-1"))
            if fields is None:
                raise ValueError("a version block of an unknown version")
        else:
            yield dict(zip(names, parts)), body


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP header with the empty line that ends it, and the payload; a block without a header is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [at + len(x) for x in (END, b"\n\n") if (at := block.find(x)) >= 0]
    return (block[: min(ends)], block[min(ends) :]) if ends else (block, b"")


def http_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("latin-1").replace("\r\n", "\n").split("\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if _}


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def unpacked(data: bytes) -> BinaryIO:
    raw = io.BytesIO(data)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if data[:2] == b"\x1f\x8b" else raw


def page_of(head: bytes) -> int | None:
    """The page id that write_arc left in the header; archives of others have none."""
    own = http_fields(head).get("x-page-id", "")
    return int(own) if re.fullmatch("-?[0-9]{1,19}", own) and -(1 << 63) <= int(own) < 1 << 63 else None


def read_arc(spark: SparkSession, path: str, payloads: bool = True, strict: bool = True) -> DataFrame:
    """The records of all ARC files under path, with their file and number in it; without payloads, http and payload are
    null. A row with `error` stands for the rest of a damaged file; with `strict` it fails the job."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for file, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                at = 0
                try:
                    for fields, block in arc_records(unpacked(packed.as_py())):
                        http, payload = http_parts(block)
                        full = (http, payload) if payloads else (None, None)
                        yield file, at, page_of(http), fields["URL"], fields["Archive-date"], fields["Content-type"], *full, digest(payload), None
                        at += 1
                except (ValueError, OSError, EOFError, zlib.error) as e:  # a damaged file, packed or not
                    if strict:
                        raise ValueError(f"{file}, record {at}: {e}") from e
                    yield file, at, None, None, None, None, None, None, None, str(e)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        names, types = zip(*(x.split() for x in RECORD.split(", ")))
        yield from batched(rows(batches), list(names), [kinds[x] for x in types])

    return whole_files(spark, path).mapInArrow(work, RECORD)


def record_id(file: str, at: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{at} {file}')}>"


def warc_record(file, at, url, fetched, kind, http, payload, payload_digest, refers_to, to_file, to_at) -> bytes:
    """A response or resource, or a revisit of the record that stands at to_at in to_file, without its end mark."""
    d, again = (fetched if fetched.isdigit() else "").ljust(14, "0")[:14], to_file is not None
    block = http if again else http + payload
    fields = [
        ("WARC-Type", "revisit" if again else "response" if http else "resource"),
        ("WARC-Record-ID", record_id(file, at)),
        ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response" if http else kind),
        ("Content-Length", str(len(block))),
    ]
    if again:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(to_file, to_at)), ("X-Payload-Length", str(len(payload)))]
        fields += [("X-Refers-To-Page-Id", str(refers_to))] if refers_to is not None else []
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block


def convert(spark: SparkSession, arc_path: str, warc_path: str, strict: bool = True) -> None:
    """WARC files with one record for each record of the ARC files. Of records with equal payloads that with the greatest page id stays a
    response; archives of others have no ids, so that of the latest date does, then that of the last place. Payloads are read twice and shuffled once, by their place:
    however many copies a payload has, no key gathers them."""
    seen = read_arc(spark, arc_path, payloads=False, strict=strict).filter("error is null").select("file", "at", "page_id", "fetched", "payload_digest")
    # null is the least: an id wins over none, and without any the latest date
    newest = seen.groupBy("payload_digest").agg(F.max(F.struct("page_id", "fetched", "file", "at")).alias("to"))
    itself = F.when(F.col("to.page_id").isNull(), (F.col("file") == F.col("to.file")) & (F.col("at") == F.col("to.at"))).otherwise(F.col("page_id").eqNullSafe(F.col("to.page_id")))
    older = seen.join(newest, "payload_digest").filter(~itself)
    older = older.select("file", "at", F.col("to.page_id").alias("refers_to"), F.col("to.file").alias("to_file"), F.col("to.at").alias("to_at"))
    rows = read_arc(spark, arc_path, strict=strict).filter("error is null").join(older, ["file", "at"], "left")
    rows = rows.select("file", "at", "url", "fetched", "kind", "http", "payload", "payload_digest", "refers_to", "to_file", "to_at")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(((warc_record(*(x.as_py() for x in row)),) for batch in batches for row in zip(*batch.columns)), ["value"], [pa.binary()])

    rows.mapInArrow(work, "value binary").select(F.col("value").cast("string")).write.options(lineSep=END.decode(), **PACKED).text(warc_path)


def warc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (lower case) and block of each record of a WARC file."""
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            raise ValueError("not a WARC record, or one of another length than declared")
        head = [line]
        while (line := stream.readline()).strip():
            head.append(line)
        fields = http_fields(b"".join(head))
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) != n or stream.read(4) != END:
            raise ValueError("not a WARC record, or one of another length than declared")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_id, record_type, payload_bytes, payload_digest, refers_to, refers_to_record of every record. Payload
    and block digests are computed anew and must equal the stored ones; a revisit has the length and digest of the full
    payload."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for packed in batch.column(1):
                for fields, block in warc_records(unpacked(packed.as_py())):
                    http, payload = http_parts(block)
                    kept, to = fields["warc-payload-digest"].removeprefix("sha1:"), fields.get("x-refers-to-page-id")
                    again = fields["warc-type"] == "revisit"
                    if fields["warc-block-digest"] != f"sha1:{digest(block)}" or not again and digest(payload) != kept:
                        raise ValueError(f"a digest of {fields['warc-record-id']} does not fit its content")
                    n = int(fields["x-payload-length"]) if again else len(payload)
                    yield page_of(http), fields["warc-target-uri"], fields["warc-record-id"], fields["warc-type"], n, kept, int(to) if to is not None else None, fields.get("warc-refers-to")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "refers_to_record"]
        yield from batched(rows(batches), names, [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()])

    return whole_files(spark, path).mapInArrow(work, "page_id long, url string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, refers_to_record string")


def archived(pages: DataFrame, **columns) -> DataFrame:
    """pages written as ARC files, converted to WARC files, and read back from those."""
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc, **columns)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
