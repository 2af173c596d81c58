"""WARC archives: writing with payload deduplication, and a reader that salvages damaged archives.

The reader checks each record (version line, headers, length, closing blank lines, digest of the block). Where a check
fails, it looks for the nearest valid gzip member or version line from there on, whatever kind came before, goes on with
it, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shared_folder

# Fixed values of the format.
VERSION, GZIP_MAGIC = b"WARC/1.1", b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always stored, as a revisit record would save nothing.
SMALLEST = 100
#: Bytes of payload and records of one archive file at most, so that it fits in a task's memory; a longer payload is a file of its own.
FILE_BYTES, FILE_RECORDS = 128 << 20, 2000


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    start: int
    end: int


@dataclass
class Gap:
    start: int
    end: int
    reason: str


def block_digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def build(headers: dict[str, str], block: bytes) -> bytes:
    """One record with its closing blank lines."""
    head = {**headers, "WARC-Block-Digest": block_digest(block), "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _one(data: bytes, at: int) -> tuple[Record | None, str]:
    """The record that starts at a place, or why there is none."""
    version = _VERSION.match(data, at)
    if not version:
        return None, "no version line"
    headers: dict[str, str] = {}
    line = version.end()
    while (stop := data.find(b"\r\n", line)) > line:  # headers may be long, but each line must be well-formed
        key, colon, value = data[line:stop].partition(b":")
        if not colon or not key or b" " in key:
            return None, "malformed header"
        headers[key.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
        line = stop + 2
    if stop < 0:
        return None, "headers do not end"
    size = headers.get("content-length", "")
    if not size.isdecimal() or "warc-type" not in headers or "warc-record-id" not in headers:
        return None, "a mandatory header is missing"
    start, end = stop + 2, stop + 2 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, "the block does not end where its length says"
    block = data[start:end]
    told = headers.get("warc-block-digest")
    if told and told.lower().startswith("sha1:") and told != block_digest(block):
        return None, "block digest differs"
    return Record(headers, block, at, end + 4), ""


def _member(data: memoryview, at: int) -> tuple[bytes | None, int]:
    """A gzip member's content and end; zlib checks its length and CRC. It is fed bit by bit, as what is left over is copied."""
    unpack, content, fed = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof and fed < len(data):
            content.append(unpack.decompress(data[fed : fed + 16384]))
            fed += 16384
    except zlib.error:
        return None, at
    return (b"".join(content), min(fed, len(data)) - len(unpack.unused_data)) if unpack.eof else (None, at)


def _read_plain(data: bytes, at: int) -> tuple[list[Record | Gap], int, str]:
    record, why = _one(data, at)
    return ([record], record.end, "") if record else ([], at, why)


def _read(data: bytes, at: int) -> tuple[list[Record | Gap], int, str]:
    """What is at a place - a record, or a member's records with the gaps between them - and its end; or nothing and why."""
    if not data.startswith(GZIP_MAGIC, at):
        return _read_plain(data, at)
    content, end = _member(memoryview(data), at)
    found = [] if content is None else list(_walk(content, _read_plain))
    if not any(isinstance(x, Record) for x in found):
        return [], at, "no valid member" if content is None else found[0].reason if found else "an empty member"
    while end < len(data) and data[end] == 0:  # padding
        end += 1
    for x in found:
        x.start, x.end = at, end
    return found, end, ""


def _walk(data: bytes, read: Callable[[bytes, int], tuple[list[Record | Gap], int, str]]) -> Iterator[Record | Gap]:
    """Read on from each record's end, or after a failed check from the nearest of the next member and the next version line."""
    at, gap, why = 0, None, ""
    member = version = -1  # the next of each behind a failed place, searched for again only once passed
    while at < len(data):
        found, end, reason = read(data, at)
        if found:
            if gap is not None:
                yield Gap(gap, at, why)
                gap = None
            yield from found
            at = end
            continue
        if gap is None:
            gap, why = at, reason
        if member <= at:
            member = data.find(GZIP_MAGIC, at + 1)
            member = member if member >= 0 else len(data)
        if version <= at:
            line = _VERSION.search(data, at + 1)
            version = line.start() if line else len(data)
        at = min(member, version)
    if gap is not None:
        yield Gap(gap, len(data), why)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records and quarantined gaps of an archive, in order; together they cover every byte. All that a gzip member holds has the member's place."""
    return _walk(data, _read)


def pack(record: bytes) -> bytes:
    """A record as a gzip member of its own."""
    return gzip.compress(record, 6, mtime=0)


def _roles(pages: DataFrame) -> DataFrame:
    """page_id, payload, its digest, and refers_to where an equal payload of a smaller page_id is stored.

    Only digests that repeat are joined back, and each is copied to a few salts, so that no digest is hot however many pages share it.
    """
    salts = 32
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    ids = base.where((F.col("bytes") >= SMALLEST) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return base.withColumn("salt", F.abs(F.hash("page_id")) % salts).join(first, ["digest", "salt"], "left").drop("salt")


def _record_text() -> F.Column:
    """A record as text without its closing blank lines, made by SQL functions alone; it is the block's bytes as they are, as payloads are UTF-8."""
    revisit = F.col("first") < F.col("page_id")
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit(VERSION.decode() + "\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(header, block)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member without its last byte, the top one of its length: that is 0 for less than 16 MB, and the writer's separator puts it back."""
    for batch in batches:
        packed = [pack(r.encode() + b"\r\n\r\n") for r in batch.column("value").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([p[:-1] if p[-1] == 0 else p for p in packed], pa.binary())], ["value"])


def write_archives(pages: DataFrame, folder: str, compress: bool = True) -> None:
    """Write pages (page_id, url, html) as WARC files, with a gzip member for each record or plain, to a folder of any store that Spark writes to.

    Of equal payloads of 100 bytes and more, the one with the smallest page_id is a response and the others revisit it;
    smaller ones and rows with a null page_id are all responses. A null html is an empty payload. Repeated rows each give
    a record; a repeat of the smallest page_id is a response as well.
    """
    longest = pages.agg(F.max(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    small = FILE_BYTES // FILE_RECORDS  # a file of as many such payloads is within the bound
    sizes = F.coalesce(F.col("bytes"), F.lit(0))
    roles = _roles(pages)
    parts = [(roles, FILE_RECORDS)] if longest <= small else [(roles.where(sizes <= small), FILE_RECORDS), (roles.where(sizes > small), max(1, FILE_BYTES // longest))]
    for rows, records in parts:
        text = rows.select(_record_text().alias("value"))
        if compress:  # a longer record's member stays whole, and the separator is padding, which readers skip
            text = text.mapInArrow(_members, "value binary").select(F.col("value").cast("string"))
        separator = "\0" if compress else "\r\n\r\n"  # closes each record
        text.write.mode("append").option("lineSep", separator).option("maxRecordsPerFile", records).text(folder)


RECORDS = "path string, start long, `end` long, record_id string, record_type string, uri string, refers_to string, payload_digest string, payload_length long, block binary, gap string"


def read_archives(spark, folder: str, blocks: bool = True) -> DataFrame:
    """Records of every archive in a folder, and its quarantined gaps: rows with a reason in `gap` and nulls else.

    blocks: whether to give the records' blocks.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, data, rows = batch.column("path")[i].as_py(), batch.column("content")[i].as_py() or b"", []
                for x in salvage(data):
                    if isinstance(x, Gap):
                        rows.append((path, x.start, x.end, *[None] * 7, x.reason))
                        continue
                    h = x.headers
                    size = h.get("x-payload-length", "")
                    told = h.get("warc-block-digest", "")
                    bad = told.startswith("sha256:") and told[7:] != hashlib.sha256(x.block).hexdigest()
                    rows.append((path, x.start, x.end, *[None] * 7, "block digest differs") if bad else (path, x.start, x.end, h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), int(size) if size.isdecimal() else len(x.block), x.block if blocks else None, None))
                for at in range(0, len(rows), 256):
                    columns = list(zip(*rows[at : at + 256], strict=True))
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "start", "end", "record_id", "record_type", "uri", "refers_to", "payload_digest", "payload_length", "block", "gap"])

    return files.mapInArrow(run, RECORDS)


def archive_digest(pages: DataFrame) -> DataFrame:
    """Write archives of pages to the shared folder, read them back, and give page_id, payload_bytes, payload_digest, record_type and refers_to of each record.

    The digest of a response is made from the block that was read; a revisit's is that of its payload, which its record names.
    A gap in what was just written is an error. Nulls and repeats are as in write_archives(), further columns are ignored,
    an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    whole = F.assert_true(F.col("gap").isNull(), F.concat(F.lit("a fresh archive has a gap: "), F.coalesce("gap", F.lit(""))))
    records = read_archives(spark, folder).where(F.coalesce(whole.cast("boolean"), F.lit(True)))
    number = lambda c: F.regexp_extract(c, r"page:(-?\d+)", 1).try_cast("long")
    response = F.col("record_type") == "response"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("block")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("block", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def discard(spark, folder: str) -> None:
    """Delete archives that are no longer read."""
    remove(spark, folder)
