"""WARC records in ZIP archives: write, locate by directory and index, range-read.

An archive is a ZIP file with stored (uncompressed) members: gzip members of
WARC records one after the other in ``archive/data.warc.gz``, and an index of
them in ``indexes/index.cdx`` with one line per record (offset and length in
the member).  A reader needs the file's tail for the end record (and the ZIP64
one where sizes need it), the central directory, one local header per member,
the index, and then the byte ranges of the records it wants; nothing is
extracted.

Writers build archives of bounded size, each under a fresh name, and report
them in a manifest table; a retried task leaves an unlisted file behind and no
wrong result.  Archives lie in the shared folder and are read by file system
URI, so any executor can read any archive.

Defined results: a null payload is empty; equal payloads with the same
page_id are all responses; a null page_id is a response only where no record
of its payload has an id.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, new_path, small_batches

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
ARCHIVE_BYTES = 16 << 20
READ_BYTES = 4 << 20

# Fixed values of the ZIP format: signatures and the fixed parts' layouts.
END, END_FORMAT = b"PK\x05\x06", "<4s4H2LH"
END64_LOCATOR, LOCATOR_FORMAT = b"PK\x06\x07", "<4sLQL"
END64, END64_FORMAT = b"PK\x06\x06", "<4sQ2H2L4Q"
CENTRAL, CENTRAL_FORMAT = b"PK\x01\x02", "<4s6H3L5H2L"
LOCAL, LOCAL_FORMAT = b"PK\x03\x04", "<4s5H3L2H"
FULL16, FULL32, ZIP64_FIELD = 0xFFFF, 0xFFFFFFFF, 1


class ArchiveError(ValueError):
    """The bytes are no archive that this reader can read by range."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # offset of the local header
    stored: int  # bytes in the archive


def _zip64(extra: bytes, values: list[int], limits: list[int]) -> list[int]:
    """Replaces the values that stand at their limit by those of the ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == ZIP64_FIELD:
            wide = [i for i, (v, limit) in enumerate(zip(values, limits, strict=True)) if v == limit]
            body, out, pos = extra[at + 4 : at + 4 + n], list(values), 0
            for i in wide:
                width = 4 if limits[i] == FULL16 else 8
                if pos + width > len(body):
                    raise ArchiveError("short ZIP64 field")
                out[i] = int.from_bytes(body[pos : pos + width], "little")
                pos += width
            return out
        at += 4 + n
    return values


def directory(source: io.IOBase | pa.NativeFile, size: int) -> dict[str, Member]:
    """The archive's members by name, from its tail and central directory."""

    def read(at: int, n: int) -> bytes:
        source.seek(at)
        got = source.read(n)
        if len(got) != n:
            raise ArchiveError("the archive is cut off")
        return got

    tail_size = min(size, struct.calcsize(END_FORMAT) + 0xFFFF)
    tail = read(size - tail_size, tail_size)
    at = tail.rfind(END)
    while at >= 0:
        if at + 22 <= len(tail):
            *_, count, length, start, comment = struct.unpack_from(END_FORMAT, tail, at)
            if at + 22 + comment <= len(tail):
                break
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ArchiveError("no end record")
    end_at = size - tail_size + at
    if count == FULL16 or length == FULL32 or start == FULL32:
        locator = read(end_at - 20, 20) if end_at >= 20 else b""
        if locator[:4] == END64_LOCATOR:
            _, _, where, _ = struct.unpack(LOCATOR_FORMAT, locator)
            end64 = read(where, struct.calcsize(END64_FORMAT))
            if end64[:4] != END64:
                raise ArchiveError("no ZIP64 end record where the locator points")
            *_, count, length, start = struct.unpack(END64_FORMAT, end64)
    central = read(start, length)
    members, at = {}, 0
    for _ in range(count):
        if central[at : at + 4] != CENTRAL:
            raise ArchiveError("broken central directory")
        fields = struct.unpack_from(CENTRAL_FORMAT, central, at)
        method, stored, plain = fields[4], fields[8], fields[9]
        n_name, n_extra, n_comment, disk = fields[10:14]
        header = fields[16]
        name = central[at + 46 : at + 46 + n_name].decode("utf-8" if fields[3] & 0x800 else "cp437")
        extra = central[at + 46 + n_name : at + 46 + n_name + n_extra]
        plain, stored, header, _ = _zip64(extra, [plain, stored, header, disk], [FULL32, FULL32, FULL32, FULL16])
        members[name] = Member(name, method, plain, header, stored)
        at += 46 + n_name + n_extra + n_comment
    return members


def data_start(source: io.IOBase | pa.NativeFile, member: Member) -> int:
    """Where a stored member's bytes begin; its local header may be longer than the central one."""
    if member.method != zipfile.ZIP_STORED:
        raise ArchiveError(f"{member.name} is compressed; only stored members can be read by range")
    source.seek(member.header)
    head = source.read(30)
    if head[:4] != LOCAL:
        raise ArchiveError("no local header where the directory points")
    *_, n_name, n_extra = struct.unpack(LOCAL_FORMAT, head)
    return member.header + 30 + n_name + n_extra


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header (with the full length) and drops the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """(WARC fields in lower case, the HTTP header's Content-Length, the payload at hand)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ArchiveError("no WARC record where the index points")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")[1:]) if k.lower() == b"content-length")
    return fields, length, payload


class ArchiveWriter:
    """Builds archives in memory, each of about ``limit`` bytes at most, and hands them to the file system."""

    def __init__(self, folder: str, limit: int = ARCHIVE_BYTES, zip64: bool = False):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.folder, self.limit, self.zip64 = folder, limit, zip64
        self.fs.create_dir(self.root, recursive=True)
        self._fresh()

    def _fresh(self) -> None:
        self.data, self.lines = io.BytesIO(), []

    def add(self, page_id: int | None, raw: bytes) -> Iterator[tuple[str, int, int]]:
        """Adds a record; yields (name, bytes, records) of an archive that it fills."""
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        self.lines.append(f"{'-' if page_id is None else page_id} {self.data.tell()} {len(packed)}\n")
        self.data.write(packed)
        if self.data.tell() >= self.limit:
            yield from self.close()

    def close(self) -> Iterator[tuple[str, int, int]]:
        if not self.lines:
            return
        whole = io.BytesIO()
        with zipfile.ZipFile(whole, "w", zipfile.ZIP_STORED) as out:
            for name, body in ((DATA, self.data.getbuffer()), (INDEX, "".join(self.lines).encode())):
                with out.open(zipfile.ZipInfo(name), "w", force_zip64=self.zip64) as member:
                    member.write(body)
        name = f"{uuid.uuid4().hex}.wacz"
        with self.fs.open_output_stream(f"{self.root}/{name}") as f:
            f.write(whole.getbuffer())
        n = len(self.lines)
        self._fresh()
        yield f"{self.folder}/{name}", whole.getbuffer().nbytes, n


def read_archive(uri: str) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """The records of one archive, by its index; neighbouring ranges are read together."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        members = directory(f, f.size())
        index = members[INDEX]
        f.seek(data_start(f, index))
        ranges = [tuple(map(int, line.split()[1:])) for line in f.read(index.stored).decode().splitlines()]
        base = data_start(f, members[DATA])
        at = 0
        while at < len(ranges):
            stop, end = at + 1, sum(ranges[at])
            while stop < len(ranges) and ranges[stop][0] == end and end + ranges[stop][1] - ranges[at][0] <= READ_BYTES:
                end += ranges[stop][1]
                stop += 1
            f.seek(base + ranges[at][0])
            together = memoryview(f.read(end - ranges[at][0]))
            for offset, length in ranges[at:stop]:
                start = offset - ranges[at][0]
                yield parse_record(zlib.decompress(together[start : start + length], 31))
            at = stop


def deduplicated(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest as hex, first): first is the smallest page_id with the payload.

    Only digests that occur more than once are joined; they are written first,
    so that the pages of one very common payload can be split in the join.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    repeated = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = materialize(repeated, "warc-repeated")
    return rows.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", "first")


def write_archives(rows: DataFrame, folder: str, limit: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Writes deduplicated rows below ``folder``; returns the manifest (path, bytes, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, limit, zip64)

        def listed(done: Iterator[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
            for path, size, n in done:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "bytes", "records"])

        for batch in batches:
            for row in zip(*(c for c in batch.columns), strict=True):
                page_id, url, payload, digest, first = (v.as_py() for v in row)
                revisit = first is not None and first != page_id
                name = base64.b32encode(bytes.fromhex(digest)).decode()
                yield from listed(writer.add(page_id, record(page_id, url, payload, name, first if revisit else None, revisit)))
        yield from listed(writer.close())

    small_batches(rows.sparkSession)
    return materialize(rows.select("page_id", "url", "payload", "digest", "first").mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every record of the listed archives: url, payload and what the header tells."""
    tasks = max(1, min(manifest.count(), 100_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

        def number(name: str | None) -> int | None:
            digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
            return int(digits) if digits and digits != "null" else None

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for fields, length, payload in read_archive(path):
                    revisit = fields["warc-type"] == "revisit"
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and (sha1_base32(payload) != digest or len(payload) != length):
                        raise ArchiveError(f"{path}: a payload differs from its digest")
                    rows.append((number(fields["warc-record-id"]), fields["warc-target-uri"], length, digest, fields["warc-type"], number(fields.get("warc-refers-to")), None if revisit else payload))
                    held += len(payload)
                    if held > READ_BYTES or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    paths = manifest.select("path").repartition(tasks)
    return paths.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages as deduplicated WARC archives into the shared folder and reads them back."""
    spark = pages.sparkSession
    manifest = write_archives(deduplicated(pages), new_path(spark, "warc"), limit)
    return read_archives(spark, manifest)
