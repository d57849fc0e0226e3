"""WARC records in ZIP packages: writing pages, and reading records back by ranges without extraction.

Each task packs its pages into ZIP packages in the shared folder. A package holds stored members ``archive/*.warc.gz`` (a gzip
member for each record) and an index member ``indexes/index.cdxj`` with a line for each record: member, offset, length. Names
carry the task attempt, and only packages in the manifest that the finished job wrote are read, so a lost or repeated task
leaves nothing behind that counts.

Reading takes the end record of a package (the ZIP64 one where there is one), parses the central directory, finds where the
stored members begin and reads the index; a package without an index is walked record by record. Each record is then a range
of the package file, read and unpacked on its own. Ranges are dealt over tasks by blocks of a package.

Of pages with equal payloads the one with the largest page_id is the response and the others are revisits of it. Rows that tie
for the largest id are all responses. A null html is an empty payload; empty payloads are equal like others. A page without an
id is a revisit if a page with an id has the same payload, else a response.

Paths are opened with ``pyarrow.fs``, which knows file, hdfs, s3 and gs.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameops.llm.tables import Scratch

#: Bytes after which a new member or a new package begins; bytes of a package that one task reads; rows that are surely small.
MEMBER_BYTES, PACKAGE_BYTES, READ_BLOCK, BROADCAST_ROWS = 64_000_000, 512_000_000, 16_000_000, 100_000
INDEX = "indexes/index.cdxj"

_MANIFEST = "path string, records long, bytes long"
_RANGES = "path string, offset long, length long"
_RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    found = name.strip().removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of ``refers_to`` that keeps only the HTTP header with the payload's length."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        fields.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    fields.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is None:
        block += payload
    else:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The row of a record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    kind, hashed = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != hashed):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return {"page_id": _id(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": size, "payload_digest": hashed,
            "refers_to": _id(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


class _Package:
    """A ZIP package being written."""

    def __init__(self, path: str) -> None:
        self.path, self.records, self.member, self.in_member = path, 0, 0, 0
        store, place = fs.FileSystem.from_uri(path)
        store.create_dir(place.rpartition("/")[0], recursive=True)
        self.stream = store.open_output_stream(place, compression=None)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.open, self.index = None, []

    def add(self, raw: bytes) -> None:
        if self.open is None or self.in_member >= MEMBER_BYTES:
            self._end_member()
            self.name = f"archive/data-{self.member:05d}.warc.gz"
            self.open, self.in_member, self.member = self.zip.open(self.name, "w", force_zip64=True), 0, self.member + 1
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        self.open.write(packed)
        self.index.append(json.dumps({"filename": self.name, "offset": self.in_member, "length": len(packed)}))
        self.in_member += len(packed)
        self.records += 1

    def _end_member(self) -> None:
        if self.open is not None:
            self.open.close()
            self.open = None

    def close(self) -> tuple[str, int, int]:
        self._end_member()
        self.zip.writestr(INDEX, "".join(f"{line}\n" for line in self.index))
        self.zip.close()
        size = self.stream.tell()
        self.stream.close()
        return self.path, self.records, size


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html, refers_to) and return the manifest; run it once, and keep what it returns."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, package = [], None
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch[c] for c in ("page_id", "url", "html", "refers_to"))):
                if package is None:
                    package = _Package(f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz")
                package.add(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py()))
                if package.stream.tell() >= PACKAGE_BYTES:
                    done.append(package.close())
                    package = None
        if package is not None:
            done.append(package.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), row)) for row in done], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, _MANIFEST)


class Member(NamedTuple):
    name: str
    method: int
    packed: int
    size: int
    header: int


def _read(file: BinaryIO, offset: int, length: int) -> bytes:
    file.seek(offset)
    return file.read(length)


def central_directory(file: BinaryIO, size: int) -> list[Member]:
    """Members of a ZIP file by its central directory, whichever of the two formats gives its place."""
    tail = _read(file, max(0, size - 65_557), min(size, 65_557))
    # the signature may also stand in the comment: the record is the last one whose comment ends with the file
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HLL", tail[end + 10 : end + 20])
    if tail[max(0, end - 20) : end][:4] == b"PK\x06\x07":
        (at,) = struct.unpack("<Q", tail[end - 12 : end - 4])
        wide = _read(file, at, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", wide[32:56])
    table, at, found = _read(file, start, length), 0, []
    for _ in range(count):
        if table[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        (method,) = struct.unpack("<H", table[at + 10 : at + 12])
        packed, full, n_name, n_extra, n_comment = struct.unpack("<LLHHH", table[at + 20 : at + 34])
        (header,) = struct.unpack("<L", table[at + 42 : at + 46])
        name = table[at + 46 : at + 46 + n_name].decode()
        extra, k = table[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack("<HH", extra[k : k + 4])
            if tag == 1:  # wide values stand in this order, each only if its narrow field is full
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[k + 4 : k + 4 + n // 8 * 8]))
                full, packed, header = [next(wide) if v == 0xFFFFFFFF else v for v in (full, packed, header)]
            k += 4 + n
        found.append(Member(name, method, packed, full, header))
        at += 46 + n_name + n_extra + n_comment
    return found


def data_start(file: BinaryIO, member: Member) -> int:
    head = _read(file, member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack("<HH", head[26:30]))


def _walk(file: BinaryIO, start: int, length: int) -> Iterator[tuple[int, int]]:
    """Ranges of the gzip members between ``start`` and ``start + length``."""
    begin, unpack, at = start, zlib.decompressobj(31), start
    while at < start + length:
        data = _read(file, at, min(1 << 20, start + length - at))
        at += len(data)
        while data:
            unpack.decompress(data)
            data = unpack.unused_data if unpack.eof else b""
            if unpack.eof:
                yield begin, at - len(data) - begin
                begin, unpack = at - len(data), zlib.decompressobj(31)


def record_ranges(file: BinaryIO, size: int) -> Iterator[tuple[int, int]]:
    """Where the records of a package lie in its file, by its indexes, or by a walk through its archives if it has none."""
    members = central_directory(file, size)
    archives = {m.name: m for m in members if m.name.endswith(".warc.gz")}
    for m in archives.values():
        if m.method:
            raise ValueError(f"{m.name} isn't stored: its records have no ranges in the package")
    starts = {name: data_start(file, m) for name, m in archives.items()}
    indexed = False
    for m in members:
        if m.name.startswith("indexes/") and m.name.endswith(".cdxj"):
            indexed = True
            raw = _read(file, data_start(file, m), m.packed)
            for line in (zlib.decompress(raw, -15) if m.method else raw).decode().splitlines():
                entry = json.loads(line[line.index("{") :])
                yield starts[entry["filename"]] + int(entry["offset"]), int(entry["length"])
    if not indexed:
        for name, m in archives.items():
            yield from _walk(file, starts[name], m.packed)


def _open(path: str) -> BinaryIO:
    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def read_packages(manifest: DataFrame) -> DataFrame:
    """A row for each record of the packages named in ``manifest`` (path, bytes)."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                with _open(path) as file:
                    rows = list(record_ranges(file, file.size()))
                for low in range(0, len(rows), 50_000):
                    part = rows[low : low + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([a for a, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64())], names=["path", "offset", "length"])

    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, BinaryIO] | None = None
        for batch in batches:
            rows, held = [], 0
            for path, offset, length in zip(*(batch[c].to_pylist() for c in ("path", "offset", "length"))):
                if opened is None or opened[0] != path:
                    if opened is not None:
                        opened[1].close()
                    opened = (path, _open(path))
                rows.append(parse_record(zlib.decompress(_read(opened[1], offset, length), 31)))
                held += rows[-1]["payload_bytes"]
                if held > 16_000_000:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)
        if opened is not None:
            opened[1].close()

    size = manifest.agg(F.count("*").alias("packages"), F.sum("bytes").alias("bytes")).first()
    # a stated number of partitions: ranges are small, so their own bytes would say nothing about the payloads they stand for
    ranges = manifest.select("path").repartition(max(1, size["packages"]), "path").mapInArrow(locate, _RANGES)
    block = F.floor(F.col("offset") / READ_BLOCK)
    return ranges.repartition(max(1, size["packages"], -(-(size["bytes"] or 0) // READ_BLOCK)), "path", block).sortWithinPartitions("path", "offset").mapInArrow(read, _RECORDS)


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` with refers_to: the page with the largest id among those of the same payload, null for that page itself.

    Only payload hashes are shuffled as long as the groups of several pages are few and come back by broadcast; more come back by
    a join that shuffles the pages once.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("sha1"))
    groups = hashed.groupBy("sha1").agg(F.max("page_id").alias("lead"), F.count("*").alias("pages")).where("pages > 1").select("sha1", "lead")
    groups = Scratch(spark, "payloads").keep(groups, "groups")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    other = F.col("lead").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("lead"))
    return hashed.join(groups, "sha1", "left").select("page_id", "url", "html", F.when(other, F.col("lead")).alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read all records back."""
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = scratch.keep(write_packages(with_revisits(pages), scratch.path("packages")), "manifest")
    return read_packages(manifest)
