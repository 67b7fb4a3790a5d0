"""WARC archives: written one gzip member per record, read back record by record.

Writing gives every page a ``response`` record, or a ``revisit`` record where an equal payload
is stored elsewhere. Reading goes through an archive in order with incremental decompression:
a member is a record, Content-Length frames its block, and digests are checked. A task holds
one record at a time, whatever the size of the archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RowsmithError
from ..session import cut_lineage, scratch_path
from .files import opened
from .words import row_slices

CHUNK = 1 << 16            # compressed bytes read at once
ARCHIVE_BYTES = 256 << 20  # an archive this large is closed and the next begun
HTTP_HEADER = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BrokenArchive(RowsmithError):
    """An archive that is cut short, wrongly framed, or whose digests do not match."""


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _clean(value: str) -> str:
    """A header value on one line: control characters, and blanks at its ends, are percent-coded."""
    inner = value.strip(" ")
    lead = len(value) - len(value.lstrip(" ")) if inner else len(value)
    coded = "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in inner)
    return "%20" * lead + coded + "%20" * (len(value) - lead - len(inner))


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record, uncompressed."""
    head = ["WARC/1.1", *(f"{name}: {value}" for name, value in fields), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def page_record(page_id, url, digest: str, payload: bytes, refers_to, date: str, record_id: str) -> bytes:
    """The record of one page: a revisit if ``refers_to`` is given, else a response with the payload."""
    raw = bytes.fromhex(digest)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    fields += [("WARC-Payload-Digest", _base32(raw)), ("WARC-Payload-Length", str(len(payload)))]
    block = HTTP_HEADER % len(payload)
    if refers_to is None:
        block += payload
        fields.append(("Content-Type", "application/http; msgtype=response"))
    else:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Page-ID", str(refers_to)), ("Content-Type", "application/http; msgtype=response")]
    fields.append(("WARC-Block-Digest", _base32(hashlib.sha1(block).digest())))
    return record(fields, block)


def _info_record(path: str, date: str) -> bytes:
    """The record that begins an archive."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, path)
    fields = [("WARC-Type", "warcinfo"), ("WARC-Date", date), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("Content-Type", "application/warc-fields")]
    return record(fields, b"format: WARC File Format 1.1\r\n")


class Reader:
    """Records of an open archive, in order: ``(fields, block)`` with fields by lower-case name."""

    def __init__(self, stream, name: str, chunk: int = CHUNK):
        self.stream, self.name, self.chunk, self.rest = stream, name, chunk, b""

    def _member(self) -> bytes | None:
        """The next gzip member, decompressed step by step; None at the end of the archive."""
        inflate, parts = zlib.decompressobj(31), []
        if not self.rest:
            self.rest = self.stream.read(self.chunk)
            if not self.rest:
                return None
        while True:
            try:
                parts.append(inflate.decompress(self.rest))
            except zlib.error as e:
                raise BrokenArchive(f"{self.name}: {e}") from e
            self.rest = inflate.unused_data
            if inflate.eof:
                return b"".join(parts)
            self.rest = self.stream.read(self.chunk)
            if not self.rest:
                raise BrokenArchive(f"{self.name}: ends inside a record")

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while (member := self._member()) is not None:
            yield self._parsed(member)

    def _parsed(self, member: bytes) -> tuple[dict[str, str], bytes]:
        at = member.find(b"\r\n\r\n")
        lines = member[:max(at, 0)].decode().split("\r\n")
        if at < 0 or not lines[0].startswith("WARC/"):
            raise BrokenArchive(f"{self.name}: a record without a header")
        fields = {name.strip(" ").lower(): value.strip(" ") for name, _, value in (line.partition(":") for line in lines[1:])}
        length = fields.get("content-length", "")
        if not length.isdigit() or len(member) != at + 4 + int(length) + 4 or not member.endswith(b"\r\n\r\n"):
            raise BrokenArchive(f"{self.name}: Content-Length {length!r} does not frame its record")
        block = member[at + 4:-4]
        if "warc-block-digest" in fields and fields["warc-block-digest"] != _base32(hashlib.sha1(block).digest()):
            raise BrokenArchive(f"{self.name}: wrong block digest in {fields.get('warc-record-id')}")
        return fields, block


def payload_of(fields: dict[str, str], block: bytes, name: str = "") -> bytes | None:
    """The payload of a response, checked against its digest; None for other records."""
    if fields.get("warc-type") != "response":
        return None
    payload = block[block.index(b"\r\n\r\n") + 4:]
    if fields.get("warc-payload-digest") != _base32(hashlib.sha1(payload).digest()):
        raise BrokenArchive(f"{name}: wrong payload digest in {fields.get('warc-record-id')}")
    return payload


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_bytes: int = 1000, date: str = "2000-01-01T00:00:00Z", level: int = 6, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write ``pages`` to ``.warc.gz`` files in ``folder``; returns ``(path, records)`` of the files.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the largest id are
    responses and the others revisits of it; all else is a response. A null payload is empty, a
    null url leaves out the target. A row with a null id revisits like the others and is a
    response where the group has no id at all. Repeated rows that share the largest id are all
    responses. Only the three named columns are read, so names of other columns do not matter.

    A file's name is its task attempt's own, and only files of successful attempts are in the
    result, so attempts that were lost leave nothing that is read.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("bigint").alias("bytes"))
    # checkpointed, so that the join below reads both sides from a shuffle and a hot payload can be split
    owners = cut_lineage(
        rows.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes")
        .agg(F.max("id").alias("owner"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("owner").isNotNull()).drop("n")
    )
    refers = F.when(F.col("id").isNull() | (F.col("id") != F.col("owner")), F.col("owner"))
    dealt = rows.join(owners, ["digest", "bytes"], "left").select("id", "url", "digest", "payload", refers.alias("refers"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get()
        stem = f"{attempt.partitionId():06d}-{attempt.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        files, out, path, held, done = 0, None, None, 0, []
        for batch in batches:
            for row in (row for part in row_slices(batch, "payload") for row in part.to_pylist()):
                if out is None:
                    path = f"{folder}/{stem}-{files:04d}.warc.gz"
                    system, place = opened(path)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    out, held, count = system.open_output_stream(place), 0, 0
                    out.write(_member(_info_record(path, date), level))
                name = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{path}#{count}"))
                member = _member(page_record(row["id"], row["url"], row["digest"], row["payload"], row["refers"], date, name), level)
                out.write(member)
                held, count = held + len(member), count + 1
                if held >= archive_bytes:
                    out.close()
                    out, files = None, files + 1
                    done.append((path, count))
        if out is not None:
            out.close()
            done.append((path, count))
        names, counts = [p for p, _ in done], [n for _, n in done]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    return cut_lineage(dealt.mapInArrow(each, "path string, records bigint"))


def _member(data: bytes, level: int) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


SCHEMA = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
FLUSH_BYTES = 8 << 20


def read_archives(archives: DataFrame, path_col: str = "path", payloads: bool = True) -> DataFrame:
    """The page records of the archives named in ``path_col``, in the columns of SCHEMA.

    ``payload_digest`` is the hex SHA-1 and ``payload_bytes`` the length of the full payload, for
    revisits as stated in the record. ``payload`` is null for revisits, and everywhere unless
    ``payloads``; it is checked against its digest in any case. Null paths are passed over. A
    damaged archive raises BrokenArchive.
    """

    def rows(path: str) -> Iterator[tuple]:
        system, place = opened(path)
        with system.open_input_stream(place) as stream:
            for fields, block in Reader(stream, path):
                kind = fields.get("warc-type")
                if kind not in ("response", "revisit"):
                    continue
                payload = payload_of(fields, block, path)
                number = len(payload) if payload is not None else int(fields["warc-payload-length"])
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                page, refers = fields.get("warc-page-id"), fields.get("warc-refers-to-page-id")
                yield (page and int(page), fields.get("warc-target-uri"), kind, number, digest, refers and int(refers), payload if payloads else None)

    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), types)], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths in batches:
            for path in paths.column("path").to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += len(row[-1] or b"") + 200
                    if size >= FLUSH_BYTES:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    named = archives.select(F.col(path_col).cast("string").alias("path")).where("path is not null")
    return named.repartition(F.col("path")).mapInArrow(each, SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame, payloads: bool = True, **options) -> DataFrame:
    """Write ``pages`` to a fresh folder under the shared one and read the archives back."""
    return read_archives(write_archives(pages, scratch_path(spark, "warc"), **options), payloads=payloads)
