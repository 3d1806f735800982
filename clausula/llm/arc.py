"""Legacy archive converter: ARC files to WARC files, and readers of both.

An ARC file is records one after the other: a header line, the declared number of bytes, a newline. The first record
is the version block, whose second line names the version, and whose third the fields of the header lines that follow:
version 1 has URL, IP address, date, content type and length; version 2 adds result code, checksum, location, offset and
file name before the length. Each content record becomes a WARC/1.1 record: a UUID of version 5 from collection and
address as identifier, the 14-digit date as a timestamp, the type from the content, and SHA-1 digests of payload and block.
The version block becomes a warcinfo record.

Of records with equal payloads of at least `least_bytes`, the one with the largest key stays a response; the others are
revisits, which carry the HTTP header only. Which record refers to which is found from a table of keys, lengths and
digests, aggregated by digest before it is shuffled; payloads move at most once, by key.

Archives lie in the shared folder, one gzip member for each record, under names that depend on the partition alone, put
in place by a rename: a task that runs again writes the same file. They are read back as streams in small pieces.

Defined results: null html: an empty payload; null keys: '-' in the address, null again when read, and smaller than any
other; rows of equal key and payload: all are responses, if theirs is the largest key. Empty table: no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausula.llm.common import blobs, parts, place, shared_dir, written

#: The fields of the header lines of ARC versions 1 and 2.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArcError(ValueError):
    """The bytes are no ARC record."""


def _line(stream) -> bytes:
    return stream.readline()


def arc_file(name: str, version: int, records: Iterator[tuple[str, str, str, bytes]], ip: str = "0.0.0.0", date: str = "20000101000000") -> Iterator[bytes]:
    """An ARC file's bytes from (url, date, content type, content) records."""
    about = f"{version} 0 clausula\n{' '.join(FIELDS[version])}\n\n".encode()
    offset = 0

    def record(url: str, when: str, kind: str, content: bytes) -> bytes:
        first = [url, ip, when, kind]
        if version == 2:
            first += ["200", "-", "-", str(offset), name]
        return " ".join([*first, str(len(content))]).encode() + b"\n" + content + b"\n"

    for item in [(f"filedesc://{name}", date, "text/plain", about)]:
        block = record(*item)
        yield block
        offset += len(block)
    for item in records:
        block = record(*item)
        yield block
        offset += len(block)


def read_arc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """(header fields, offset, content) of each record; the version block comes first and decides how the others are parsed."""
    fields, offset = None, 0
    while line := _line(stream):
        size = len(line)
        if not line.strip():
            offset += size
            continue
        values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if not values[-1].isdigit():
            raise ArcError(f"no length at byte {offset}: {line[:80]!r}")
        content = stream.read(int(values[-1]))
        if len(content) < int(values[-1]):
            raise ArcError(f"the record at byte {offset} is cut off")
        if fields is None:
            lines = content.decode("utf-8", "replace").split("\n")
            version = lines[0].split(" ")[0]
            fields = lines[1].split(" ") if len(lines) > 1 and len(lines[1].split(" ")) >= 5 else FIELDS.get(int(version) if version.isdigit() else 0)
            if fields is None:
                raise ArcError(f"unknown version {version!r}")
        names = fields if len(values) >= len(fields) else FIELDS[1]
        if len(values) < len(names):
            raise ArcError(f"{len(values)} fields at byte {offset}")
        # a space within the address makes it more values than fields
        values = [" ".join(values[: len(values) - len(names) + 1]), *values[len(values) - len(names) + 1 :]]
        yield dict(zip(names, values)), offset, content
        offset += size + len(content)


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP header block (with its blank line) and payload; no header: all is payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content, b"") if end < 0 else (content[: end + 4], content[end + 4 :])


def warc_record(header: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*header, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _timestamp(date: str) -> str:
    try:
        return datetime.strptime(date[:14], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(source: str, url: str) -> str:
    """One identifier for one address in one collection, so that revisits can name their response."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}/{url}')}>"


def convert_record(fields: dict[str, str], content: bytes, source: str, original: str | None = None) -> bytes:
    """The WARC record of an ARC record; original: the address whose payload it repeats, if it is to be a revisit."""
    url, when = fields["URL"], _timestamp(fields["Archive-date"])
    if url.startswith("filedesc:"):
        return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(source, url)), ("WARC-Date", when), ("WARC-Filename", url.removeprefix("filedesc://")), ("Content-Type", "application/warc-fields")], content)
    http, payload = split_http(content)
    kind = "revisit" if original is not None else "response" if http else "resource"
    block = http if original is not None else content
    header = [("WARC-Type", kind), ("WARC-Target-URI", url), ("WARC-Date", when), ("WARC-Record-ID", record_id(source, url)), ("WARC-IP-Address", fields["IP-address"])]
    header += [("Content-Type", "application/http;msgtype=response" if http else fields["Content-type"]), ("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block))]
    if original is not None:
        header += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(source, original)), ("WARC-Refers-To-Target-URI", original)]
    return warc_record(header, block)


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := _line(stream):
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        header: dict[str, str] = {}
        while (line := _line(stream)).strip():
            key, _, value = line.decode().partition(":")
            header[key] = value.strip()
        yield header, stream.read(int(header["Content-Length"]))


class _Pieces(io.RawIOBase):
    """An iterator's bytes as a stream."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.left = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self.left:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.left = memoryview(piece)
        n = min(len(target), len(self.left))
        target[:n] = self.left[:n]
        self.left = self.left[n:]
        return n


class _Members(io.RawIOBase):
    """The bytes of consecutive gzip members of a file, in pieces."""

    def __init__(self, source, piece: int = 1 << 18):
        self.source, self.piece, self.raw, self.inflate, self.out = source, piece, b"", zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self.out:
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.source.read(self.piece)
                if not self.raw:
                    return 0
            self.out = self.inflate.decompress(self.raw, 1 << 20)
            self.raw = self.inflate.unconsumed_tail
        n = min(len(target), len(self.out))
        target[:n] = self.out[:n]
        self.out = self.out[n:]
        return n


def _address(key: object, url: str | None) -> str:
    return f"urn:page:{'-' if key is None else key}:{(url or '').replace(' ', '%20')}"


def _key(address: str) -> str | None:
    key = address.split(":", 3)[2]
    return None if key == "-" else key


def archive_pages(pages: DataFrame, folder: str, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, collection: str = "pages", level: int = 1) -> DataFrame:
    """Writes pages as ARC records (version 1 or 2 by file), converted to WARC files in folder; returns their paths as a written table (path, records)."""
    rows = pages.select(F.col(key_col).alias("key"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    digest = F.sha1("payload")
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.max(F.struct("key", "url")).alias("top")).where("n > 1").select("digest", "top")
    small = rows.select("key", digest.alias("digest"))
    repeats = small.join(groups, "digest").where(F.col("key").isNull() | (F.col("key") < F.col("top.key"))).where("top.key IS NOT NULL").select("key", "digest", "top").distinct()
    repeats = written(repeats, "repeats")
    # texts move by key, or not at all if Spark finds the repeats small enough to send: a hot payload's rows have keys of their own
    told = repeats.select(F.col("key").alias("same"), F.col("digest").alias("known"), "top")
    joined = rows.join(told, F.col("key").eqNullSafe(F.col("same")) & (digest == F.col("known")), "left").select("key", "url", "payload", "top")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pa.fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:05d}.arc"
        path, draft = f"{base}/part-{part:05d}.warc.gz", f"{base}/.part-{part:05d}-{uuid.uuid4().hex}"
        originals: deque[str | None] = deque()

        def records() -> Iterator[tuple[str, str, str, bytes]]:
            for batch in batches:
                for key, url, payload, top in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), blobs(batch.column(2)), batch.column(3).to_pylist()):
                    originals.append(None if top is None else _address(top["key"], top["url"]))
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    yield _address(key, url), "20000101000000", "text/html", http + payload

        count = 0
        with files.open_output_stream(draft, compression=None) as out:
            for fields, _, content in read_arc(io.BufferedReader(_Pieces(arc_file(name, version, records())))):
                original = None
                if not fields["URL"].startswith("filedesc:"):
                    original = originals.popleft()
                    count += 1
                packed = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(packed.compress(convert_record(fields, content, collection, original)) + packed.flush())
        place(files, draft, path)
        yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64())})

    return written(joined.mapInArrow(run, "path string, records long"), "archives")


def read_archives(archives: DataFrame, folder: str, key_kind: str = "bigint") -> DataFrame:
    """The content records of archives (column path) in folder: key, payload_bytes, payload_digest (hex), record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pa.fs.FileSystem.from_uri(folder)
        names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found: list[tuple] = []
                with files.open_input_stream(path, compression=None) as source:
                    for header, block in read_warc(io.BufferedReader(_Members(source), 1 << 18)):
                        if header["WARC-Type"] == "warcinfo":
                            continue
                        http, payload = split_http(block)
                        hexadecimal = base64.b32decode(header["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if header["WARC-Type"] == "revisit":
                            declared = next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:"))
                            size = int(declared.split(":")[1])
                        else:
                            size = len(payload)
                            if hashlib.sha1(payload).hexdigest() != hexadecimal:
                                raise ValueError(f"{header['WARC-Record-ID']}: payload and digest differ")
                        refers = header.get("WARC-Refers-To-Target-URI")
                        found.append((_key(header["WARC-Target-URI"]), size, hexadecimal, header["WARC-Type"], refers and _key(refers)))
                        if len(found) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _KINDS)], names)
                            found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _KINDS)], names)

    out = archives.select("path").repartition(max(1, parts(archives.sparkSession)), "path").mapInArrow(run, "key string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.select(F.col("key").cast(key_kind).alias("key"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(key_kind).alias("refers_to"))


_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]


def round_trip(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """Pages to archives and back, one row for each page."""
    folder = shared_dir(pages.sparkSession, "warc")
    archives = archive_pages(pages, folder, key_col, url_col, html_col, least_bytes)
    return read_archives(archives, folder, pages.schema[key_col].dataType.simpleString()).withColumnRenamed("key", key_col)
