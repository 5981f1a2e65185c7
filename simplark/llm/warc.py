"""WARC archives in ZIP packages: writing with deduplication, reading by ranges.

A package is a ZIP file that stores (without compression) a WARC file of gzip records and an index
with the offset and length of each record. Reading parses the central directory, ZIP64 included,
finds the stored members, and reads each record by its range, from the file itself where pyarrow has
a file system for its path; where only Spark's readers can open it, ranges are cut from what they
read. Nothing is extracted.

Packages are written by Spark's own file sink, one to a file, so that they land in any store that
Spark writes to and a lost executor's attempt is discarded with its task. That sink ends a file
with a line feed, which is here the one byte of the ZIP comment.

Of records with equal payloads of at least ``least`` bytes, that with the smallest page_id is the
response and the others are revisits of it. Defined cases: a null payload is empty, a null url is
left out; rows that share the smallest page_id of a payload are all responses, as are all rows of
a payload without any page_id; repeated rows each have a record; payloads are kept whole, however
long; other columns may have any names and aren't read; an empty table gives no package and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplark.llm.common import cut, named, small

PACKAGE_BYTES = 8 << 20
BROADCAST_ROWS = 1_000_000
DATE = "2024-01-01T00:00:00Z"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- records


def base32_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(raw: bytes) -> tuple[dict[str, str], int]:
    """(fields in lower case, where the block begins) of a record."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


def page_of(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").rpartition(":")[2]
    return int(value) if value else None


# -- ZIP packages


@dataclass
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


class Package:
    """A ZIP package behind ``read(offset, length)``."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size = read, size
        self.begins: dict[str, int] = {}
        self.members = {m.name: m for m in self._directory()}

    @classmethod
    def of(cls, raw: bytes) -> Package:
        view = memoryview(raw)
        return cls(lambda at, n: bytes(view[at : at + n]), len(raw))

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 65557)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):  # it may stand in the comment too
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if 0xFFFF in (count,) or 0xFFFFFFFF in (length, start):
            locator = self.read(tail_at + at - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            end = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", end, 32)
        raw, at = self.read(start, length), 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            stored, size, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", raw, at + 20)
            header = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + 46 + name_n : at + 46 + name_n + extra_n]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # the 64-bit values of the fields that are full, in this order
                    values = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    size = next(values) if size == 0xFFFFFFFF else size
                    stored = next(values) if stored == 0xFFFFFFFF else stored
                    header = next(values) if header == 0xFFFFFFFF else header
                extra = extra[4 + n :]
            yield Member(name, method, size, stored, header)
            at += 46 + name_n + extra_n + comment_n

    def data_at(self, member: Member) -> int:
        """Where the bytes of a stored member begin."""
        if member.name not in self.begins:
            if member.method:
                raise ValueError(f"{member.name} isn't stored")
            head = self.read(member.header, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header of {member.name}")
            self.begins[member.name] = member.header + 30 + sum(struct.unpack_from("<HH", head, 26))
        return self.begins[member.name]

    def index(self) -> Iterator[dict]:
        """The entries of all stored indexes, with the archive's name under filename."""
        for m in self.members.values():
            if m.name.startswith("indexes/") and m.name.endswith(".cdxj"):
                for line in self.read(self.data_at(m), m.size).splitlines():
                    yield json.loads(line[line.index(b"{") :])

    def record(self, filename: str, offset: int, length: int) -> bytes:
        """The bytes of one record, by its range in a stored archive."""
        m = self.members[f"archive/{filename}"]
        if offset < 0 or offset + length > m.size:
            raise ValueError("the range leaves the archive")
        raw = self.read(self.data_at(m) + offset, length)
        return zlib.decompress(raw, wbits=31) if raw[:2] == b"\x1f\x8b" else raw


def build_package(records: list[tuple[str, bytes]]) -> bytes:
    """A package of (index key, gzip record)s; ends with its comment, a line feed."""
    archive, lines = io.BytesIO(), []
    for key, raw in records:
        lines.append(f"{key} " + json.dumps({"offset": archive.tell(), "length": len(raw), "filename": ARCHIVE.partition("/")[2]}, sort_keys=True))
        archive.write(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"\n"
        for name, raw in ((ARCHIVE, archive.getvalue()), (INDEX, "".join(f"{x}\n" for x in sorted(lines)).encode())):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), raw)
    return out.getvalue()


# -- on Spark


def write_packages(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, package_bytes: int = PACKAGE_BYTES, level: int = 6) -> None:
    """Write a record for each page into packages under ``path``."""
    payload = F.coalesce(named(html), F.lit("")).cast("binary")
    rows = pages.select(named(key).alias("page_id"), named(url).cast("string").alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("sha"), F.octet_length(payload).alias("size"))
    firsts = cut(rows.where(F.col("size") >= least).groupBy("sha", "size").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    if firsts.count() <= BROADCAST_ROWS:  # 36 bytes each
        firsts = F.broadcast(firsts)
    joined = rows.join(firsts, ["sha", "size"], "left").select("page_id", "url", "payload", "sha", "first_id")

    def run(batches):
        held, size = [], 0
        for batch in small(batches, 2):
            for page, link, body, sha, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                revisit = first is not None and first != page
                record = build_record(page, link, body, base32_digest(sha), first, revisit)
                held.append((f"{'' if page is None else page:0>20}", gzip.compress(record, level, mtime=0)))
                size += len(held[-1][1])
                if size >= package_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([build_package(held)[:-1]], pa.binary())], ["blob"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([build_package(held)[:-1]], pa.binary())], ["blob"])

    blobs = joined.mapInArrow(run, "blob binary")
    blobs.select(F.col("blob").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "none").text(path)


RECORDS = {
    "page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "payload": "binary", "package": "string",
    "record_offset": "long", "record_length": "long",
}
ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a path as Spark writes it, and the path there."""
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def ranged(path: str) -> bool:
    """Whether ranges of the files under a path can be read."""
    try:
        system, inner = opened(path)
        return system.get_file_info(inner).type == fs.FileType.Directory
    except (pa.ArrowException, OSError, ValueError):
        return False


def read_packages(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the packages under ``path``; a revisit's payload is null.

    A response whose payload doesn't have the digest it claims is an error.
    """
    names = [n for n in RECORDS if payloads or n != "payload"]
    arrow = pa.schema([(n, ARROW[RECORDS[n]]) for n in names])

    def rows(name: str, package: Package):
        for entry in package.index():
            record = package.record(entry["filename"], entry["offset"], entry["length"])
            head, at = parse_head(record)
            block = record[at : at + int(head["content-length"])]
            http_end = block.index(b"\r\n\r\n") + 4
            http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in block[:http_end].split(b"\r\n")[1:])}
            kind, digest = head["warc-type"], head["warc-payload-digest"].partition(":")[2]
            body = block[http_end:] if kind == "response" else None
            if body is not None and base32_digest(hashlib.sha1(body).digest()) != digest:
                raise ValueError(f"{name}: the payload at {entry['offset']} doesn't match its digest")
            yield {
                "page_id": page_of(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "payload_bytes": int(http[b"content-length"]), "payload_digest": digest, "record_type": kind,
                "refers_to": page_of(head.get("warc-refers-to")), "payload": body, "package": name, "record_offset": entry["offset"], "record_length": entry["length"],
            }

    def table(name: str, package: Package):
        found, size = [], 0
        for row in rows(name, package):
            found.append({k: row[k] for k in names})
            size += len(row["payload"] or b"") if payloads else 0
            if len(found) == 500 or size > 4 << 20:
                yield pa.RecordBatch.from_pylist(found, schema=arrow)
                found, size = [], 0
        yield pa.RecordBatch.from_pylist(found, schema=arrow)

    def run_ranges(batches):
        for batch in batches:
            for name, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, inner = opened(name)
                with system.open_input_file(inner) as f:
                    yield from table(name, Package(lambda at, n, f=f: f.read_at(n, at), size))

    def run_whole(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from table(name, Package.of(raw.as_buffer()))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files, run = (files.select("path", "length"), run_ranges) if ranged(path) else (files.select("path", "content"), run_whole)
    return files.mapInArrow(run, ", ".join(f"{n} {RECORDS[n]}" for n in names))


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write the pages to packages, read them back, and return what the records say."""
    write_packages(pages, path)
    return read_packages(pages.sparkSession, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
