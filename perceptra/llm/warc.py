"""WARC archives: capture, revisit resolution by payload digest, and reading back."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, shared_dir, slices, spread

#: The date in fresh headers: a parameter, so that reruns agree.
DATE = "2024-01-01T00:00:00Z"
#: Payloads under this many bytes are never revisits.
MIN_BYTES = 0
#: An archive is closed when its compressed size passes this.
ARCHIVE_BYTES = 64 << 20
#: Bytes of an archive that one task rewrites at once.
RUN_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, number: str, url: str, payload_digest: str, length: int, payload: bytes | None, refers_to: str | None = None, date: str = DATE) -> bytes:
    """A WARC/1.1 record: a response with its HTTP head and payload, or a revisit with the head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = head + (payload or b"")
    fields = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{number}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    return "\r\n".join([*fields, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the payload (of a revisit: none)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def packed(raw: bytes) -> bytes:
    """One gzip member, so that records can be read apart."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Archives:
    """Writes members to files of bounded size in one folder. A file's name is new in each attempt of a task; the rows that a task returns say which files count."""

    def __init__(self, folder: str):
        self.fs, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.uri, self.out, self.at = folder, None, 0

    def add(self, member: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= ARCHIVE_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.fs.create_dir(self.folder, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        place = self.at
        self.out.write(member)
        self.at += len(member)
        return self.name, place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def _text(x) -> str:
    """A value fit for a header line."""
    return "" if x is None else str(x).replace("\r", "%0D").replace("\n", "%0A")


HEADERS = "archive string, place long, size long, {key} {kind}, url string, payload_bytes long, payload_digest string"


def capture(pages: DataFrame, folder: str, key: str, url: str, html: str) -> DataFrame:
    """Writes a response record for every row and returns their headers with archive, place and size."""
    kind = pages.schema[key].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Archives(folder)
        for batch in slices(batches):
            rows = []
            for k, u, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (body or "").encode()
                d = digest(payload)
                member = packed(record("response", _text(k), _text(u), d, len(payload), payload))
                rows.append((*out.add(member), len(member), _text(u), len(payload), d))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            a, p, s, u, n, d = (pa.array(c, t) for c, t in zip(columns, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([a, p, s, batch.column(0), u, n, d], names=["archive", "place", "size", "_key", "url", "payload_bytes", "payload_digest"])
        out.close()

    return materialize(pages.select(key, url, html).mapInArrow(write, HEADERS.format(key="_key", kind=kind)), "headers")


def resolve_revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Adds refers_to: null for responses, for revisits the key of the first record with the payload.

    Headers alone are shuffled, by digest and a salt; first is the smallest key (null last), then the place in the archives.
    """
    order = F.struct(F.col("_key").isNull().alias("z"), F.col("_key").alias("k"), F.col("archive").alias("a"), F.col("place").alias("p"))
    found = spread(headers, ["payload_digest", "payload_bytes"], {"_first": ("min", order)}, ["archive", "place"])
    first = (F.col("_first.a") == F.col("archive")) & (F.col("_first.p") == F.col("place")) | (F.col("payload_bytes") < min_bytes)
    return found.select(*headers.columns, (~first).alias("revisit"), F.when(~first, F.col("_first.k")).alias("refers_to"))


def deduplicate(resolved: DataFrame, source: str, folder: str) -> DataFrame:
    """Rewrites the records of the archives in source to folder with fresh headers, revisits without payload; rows (archive, records)."""
    total = resolved.agg(F.sum("size")).first()[0] or 0
    ordered = resolved.select("archive", "place", "size", "_key", "url", "payload_bytes", "payload_digest", "revisit", "refers_to")
    ordered = ordered.repartition(max(1, 2 * total // RUN_BYTES), "archive", F.floor(F.col("place") / RUN_BYTES)).sortWithinPartitions("archive", "place")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(source)
        out, written, name, file = Archives(folder), {}, None, None
        for batch in batches:
            for archive, place, size, k, url, n, d, revisit, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if revisit:
                    raw = record("revisit", _text(k), url, d, n, None, _text(to))
                else:
                    if archive != name:
                        name, file = archive, fs.open_input_file(f"{base}/{archive}")
                    file.seek(place)
                    fields, payload = parse(zlib.decompress(file.read(size), 31))
                    raw = record("response", _text(k), fields["warc-target-uri"], d, n, payload)
                at, _ = out.add(packed(raw))
                written[at] = written.get(at, 0) + 1
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(written), pa.string()), pa.array(list(written.values()), pa.int64())], names=["archive", "records"])

    return materialize(ordered.mapInArrow(write, "archive string, records long"), "archives")


def members(fs: pa.fs.FileSystem, path: str) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    with fs.open_input_stream(path, compression=None) as file:
        z, raw, held = zlib.decompressobj(31), [], b""
        while block := held or file.read(1 << 20):
            raw.append(z.decompress(block))
            held = b""
            if z.eof:
                yield b"".join(raw)
                held, z, raw = z.unused_data, zlib.decompressobj(31), []


def read_archives(archives: DataFrame, folder: str, key: str, kind: str) -> DataFrame:
    """Rows (key, url, payload_bytes, payload_digest, record_type, refers_to) of the records in the archives of folder; checks the digests of responses."""
    number = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())

    def ident(x: str | None):
        x = x and x.removeprefix("<urn:x-page:").removesuffix(">")
        return None if not x else x if number == pa.string() else int(x)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                for raw in members(fs, f"{base}/{archive}"):
                    fields, payload = parse(raw)
                    d = fields["warc-payload-digest"].removeprefix("sha1:")
                    length = int(raw.partition(b"\r\n\r\nHTTP")[2].partition(b"Content-Length: ")[2].partition(b"\r\n")[0])
                    if fields["warc-type"] == "response" and digest(payload) != d:
                        raise ValueError(f"{archive}: payload of {fields['warc-record-id']} does not match its digest")
                    rows.append((ident(fields["warc-record-id"]), fields["warc-target-uri"], length, d, fields["warc-type"], ident(fields.get("warc-refers-to"))))
                kinds = [number, pa.string(), pa.int64(), pa.string(), pa.string(), number]
                for i in range(0, len(rows), 5000):
                    columns = zip(*rows[i : i + 5000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    many = archives.select("archive").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 2), "archive")
    return many.mapInArrow(read, f"`{key}` {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Captures every row of pages as a WARC record, resolves revisits, writes deduplicated archives and reads them back.

    Rows (key, url, payload_bytes, payload_digest, record_type, refers_to). Null html is an empty payload, a null url an empty target. Of rows
    with equal payloads that with the smallest key is the response; of rows that also share the key, one is. A null
    key comes last and is written as an empty id. An empty table gives an empty result; other columns are ignored.
    """
    kind = pages.schema[key].dataType.simpleString()
    if kind not in ("bigint", "int", "string"):
        raise TypeError(f"{key} must be an integer or a string")
    source, folder = shared_dir(pages.sparkSession, "warc-in"), shared_dir(pages.sparkSession, "warc-out")
    headers = capture(pages, source, key, url, html)
    archives = deduplicate(resolve_revisits(headers, min_bytes), source, folder)
    discard(pages.sparkSession, source)
    return read_archives(archives, folder, key, kind)
