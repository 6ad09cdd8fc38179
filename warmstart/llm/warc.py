"""WARC archives: a writer and a sequential reader.

Writing: each task writes one archive, a gzip member per record. Which record is a ``revisit`` is settled before by
one aggregation over payload digests. A file gets a new name at every attempt, and only the names that the finished tasks
report (a stored manifest) are read: files of lost or repeated attempts are never seen.

Reading: an archive is read in blocks of ``BLOCK`` bytes; zlib inflates them member by member as they come, the
record is framed by its Content-Length, and block and payload digests are verified. At most one record is in memory.
Files are opened through ``pyarrow.fs`` by URI, so any store that pyarrow knows will do.

Defined results: a null payload is an empty one; a null page id is written without an id and never wins
against another id; a null url is written without a target URI; rows that repeat id and payload of a response are
responses too; line breaks in urls are written percent-encoded; an empty table writes empty archives and reads
back no rows; a very long payload is one value, inflated piece by piece; other columns are ignored. A damaged archive raises ``WarcError`` with the record's offset among the inflated bytes.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warmstart.llm.common import store
from warmstart.session import scratch_path

BLOCK = 1 << 16
MIN_REVISIT_BYTES = 1000
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"  # the pages have no date; a fixed one keeps reruns equal
_END = b"\r\n\r\n"


class WarcError(ValueError):
    pass


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(_END)[2]

    def http(self) -> dict[str, str]:
        return _headers(self.block.partition(_END)[0])


def _sha1(data: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(data).digest()).decode()


def _line(name: str, value: str) -> str:
    return f"{name}: " + value.replace("\r", "%0D").replace("\n", "%0A") + "\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"header line without a colon: {line[:80]!r}")
        out[name.decode("utf-8").lower()] = value.strip().decode("utf-8")
    return out


def record_bytes(kind: str, payload: bytes, page_id: int | None, url: str | None, refers_to: int | None = None) -> bytes:
    """One record as a gzip member; a revisit has the HTTP headers but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = VERSION + "\r\n" + _line("WARC-Type", kind) + _line("WARC-Date", _DATE)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{kind}:{hashlib.sha1(block).hexdigest()}")
    head += _line("WARC-Record-ID", f"<urn:uuid:{name}>")
    if page_id is not None:
        head += _line("X-Page-ID", str(page_id))
    if url is not None:
        head += _line("WARC-Target-URI", url)
    if kind == "revisit":
        head += _line("WARC-Profile", PROFILE) + _line("X-Refers-To-Page-ID", str(refers_to))
    head += _line("Content-Type", "application/http; msgtype=response")
    head += _line("WARC-Block-Digest", _sha1(block)) + _line("WARC-Payload-Digest", _sha1(payload))
    head += _line("Content-Length", str(len(block)))
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode("utf-8") + b"\r\n" + block + _END) + pack.flush()


def _inflated(stream) -> Iterator[tuple[bytes, bool]]:
    """Inflated pieces of a gzip file in order, with a flag after the last piece of each member."""
    z = zlib.decompressobj(31)
    begun = False
    while data := stream.read(BLOCK):
        while data:
            try:
                piece = z.decompress(data, 4 * BLOCK)
            except zlib.error as e:
                raise WarcError(f"bad gzip data: {e}") from e
            begun = True
            yield piece, z.eof
            if z.eof:
                data, z, begun = z.unused_data, zlib.decompressobj(31), False
            else:
                data = z.unconsumed_tail
    if begun:
        raise WarcError("the archive ends within a gzip member")


def read_records(stream) -> Iterator[Record]:
    """Records of a gzipped archive, one member each, with framing and digests verified."""
    held, at = bytearray(), 0
    for piece, last in _inflated(stream):
        held += piece
        if not last:
            continue
        raw = bytes(held)
        held.clear()
        head, sep, rest = raw.partition(_END)
        if not sep or not head.startswith(b"WARC/"):
            raise WarcError(f"no record header at {at}")
        headers = _headers(head)
        try:
            size = int(headers["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError(f"no content length at {at}") from e
        if len(rest) != size + len(_END) or rest[size:] != _END:
            raise WarcError(f"content length {size} does not frame the record at {at}")
        record = Record(headers, rest[:size])
        if headers.get("warc-block-digest", _sha1(record.block)) != _sha1(record.block):
            raise WarcError(f"block digest differs at {at}")
        if headers.get("warc-type") == "response" and headers.get("warc-payload-digest", _sha1(record.payload)) != _sha1(record.payload):
            raise WarcError(f"payload digest differs at {at}")
        yield record
        at += len(raw)


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for responses."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"))
    big = F.octet_length("html") >= min_bytes
    keyed = rows.withColumn("digest", F.when(big, F.sha1(F.encode("html", "UTF-8"))))
    # only payloads that occur more than once matter to the join
    most = (keyed.filter("digest is not null").groupBy("digest", F.octet_length("html").alias("size"))
            .agg(F.max("page_id").alias("most"), F.count(F.lit(1)).alias("n")).filter("n > 1")
            .select(F.col("digest").alias("d"), F.col("size").alias("s"), "most"))
    refers = F.when(F.col("most").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("most")), F.col("most"))
    return (keyed.join(most, (F.col("digest") == F.col("d")) & (F.octet_length("html") == F.col("s")), "left")
            .select("page_id", "url", "html", refers.alias("refers_to")))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``folder``; returns the manifest (path, records)."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for b in batches:
                for page_id, url, html, refers in zip(*(b.column(i) for i in range(4))):
                    to = refers.as_py()
                    kind = "response" if to is None else "revisit"
                    out.write(record_bytes(kind, html.as_py().encode("utf-8"), page_id.as_py(), url.as_py(), to))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["path", "records"])

    return store(mark_revisits(pages, min_bytes).mapInArrow(write, "path string, records long"), "manifest")


_ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                  ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_ROW_DDL = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
            "payload binary")


def _row(r: Record) -> tuple:
    h = r.headers
    number = lambda name: int(h[name]) if name in h else None
    digest = b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
    return (number("x-page-id"), h.get("warc-target-uri"), h["warc-type"], int(r.http()["content-length"]), digest,
            number("x-refers-to-page-id"), r.payload if h["warc-type"] == "response" else None)


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Rows of all archives named in ``manifest`` (path, records); a missing record raises."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, name = pafs.FileSystem.from_uri(path)
                rows, held, n = [], 0, 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for r in read_records(stream):
                        rows.append(_row(r))
                        held += len(r.block)
                        n += 1
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)
                            rows, held = [], 0
                if n != records:
                    raise WarcError(f"{path}: {n} records, the manifest has {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)

    files = manifest.select("path", "records")
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(read, _ROW_DDL)


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared scratch space, as a URI."""
    path = scratch_path(spark, "warc")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


__all__ = ["Record", "WarcError", "archive_folder", "mark_revisits", "read_archives", "read_records", "record_bytes",
           "write_archives"]
