"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent frames, each with whole records of about `frame_bytes`; then a skippable frame that
maps record identifiers to a frame and the offset within it; then the seek table of the public seekable format in the
last skippable frame. A reader needs the footer, the index and one frame to fetch a record.
Which records are revisits is decided before anything is written, from digests only; payloads are dealt by page_id,
so a payload that a third of all pages share is no hot key.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewright.llm.files import binary, put, store
from scorewright.llm.shared import prepare, workspace, written

#: Fixed values of the seekable Zstandard format and of WARC 1.1.
SEEK_FRAME, SEEK_MAGIC, INDEX_FRAME = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NULL = -(1 << 63)
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, seq: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}{seq}')}>"


def _clean(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else "%{:02X}".format(ord(c)) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record; a revisit has no block, its payload's length and digest stand in headers."""
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
        block = b""
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, end) of the record at an offset of a frame."""
    if data[at : at + 10] != b"WARC/1.1\r\n":
        raise ValueError(f"no WARC record at {at}")
    end = data.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in data[at + 10 : end].decode().split("\r\n"))
    block = data[end + 4 : (stop := end + 4 + int(head["Content-Length"]))]
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    return head, block.partition(b"\r\n\r\n")[2], stop + 4


class Bundle:
    """A bundle being written."""

    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open, self.open_size, self.index, self.size = [], 0, [], 0

    def add(self, page_id: int | None, data: bytes) -> tuple[int, int]:
        """Where the record is: its frame and the offset within it."""
        if self.open and self.open_size + len(data) > self.frame_bytes:
            self.close_frame()
        at = len(self.frames), self.open_size
        self.index.append((_NULL if page_id is None else page_id, *at, len(data)))
        self.open.append(data)
        self.open_size += len(data)
        return at

    def close_frame(self) -> None:
        if self.open:
            self.frames.append(frame := self.zstd.compress(b"".join(self.open)))
            self.sizes.append((len(frame), self.open_size))
            self.size += len(frame)
            self.open, self.open_size = [], 0

    def bytes(self) -> bytes:
        self.close_frame()
        index = np.array(self.index, dtype="<i8").reshape(-1, 4).tobytes()
        index = self.zstd.compress(index)
        own = struct.pack("<II", INDEX_FRAME, len(index)) + index
        sizes = [*self.sizes, (len(own), 0)]
        table = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEK_MAGIC)
        return b"".join(self.frames) + own + struct.pack("<II", SEEK_FRAME, len(table)) + table


class Reader:
    """Random access to a bundle; read(offset, length) gives its bytes."""

    def __init__(self, read, size: int):
        self.read, self.zstd = read, zstandard.ZstdDecompressor()
        n, _, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        sizes = np.frombuffer(read(size - 9 - 8 * n, 8 * n), "<u4").reshape(n, 2).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes[:, 0])])
        self.frames = n - 1
        self.index = np.frombuffer(self.zstd.decompress(read(int(self.start[-2]) + 8, int(sizes[-1, 0]) - 8)), "<i8").reshape(-1, 4)

    def frame(self, k: int) -> bytes:
        return self.zstd.decompress(self.read(int(self.start[k]), int(self.start[k + 1] - self.start[k])))

    def fetch(self, page_id: int) -> list[tuple[dict[str, str], bytes]]:
        """The records of a page, each from one frame."""
        return [parse(self.frame(int(f)), int(o))[:2] for _, f, o, _ in self.index[self.index[:, 0] == page_id]]


def revisits(pages: DataFrame, ws: str, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, first): pages whose payload of at least min_bytes is that of a page with a smaller page_id."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.where("page_id is not null").select("page_id", F.unhex(F.sha1(body)).alias("sha1"), F.octet_length(body).alias("n"))
    rows = written(rows.where(F.col("n") >= min_bytes), ws, "digests")
    first = rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    return rows.join(first.select("sha1", "first"), "sha1").where("page_id > first").select("page_id", "sha1", "first").distinct()


def write_archives(pages: DataFrame, folder: str, ws: str, min_bytes: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 24, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for every row of pages (page_id, url, html) and return (page_id, file, frame, offset, length).

    Of rows with equal payloads of at least min_bytes that with the smallest page_id is a response and the others
    revisit it; of rows that repeat with one page_id and payload the first is. A null html is an empty payload, a null url is left out;
    rows with a null page_id are responses. Bundles have deterministic names and contents, so a task that runs
    again replaces its files.
    """
    spark = pages.sparkSession
    prepare(spark)
    found = revisits(pages, ws, min_bytes).withColumnsRenamed({"page_id": "__id", "sha1": "__sha1"})
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"), F.unhex(F.sha1(body)).alias("sha1"))
    rows = rows.join(found, (F.col("page_id") == F.col("__id")) & (F.col("sha1") == F.col("__sha1")), "left")
    # rows without an id repeat nothing: each is dealt by itself, so that many of them are no hot group
    alone = F.when(F.col("page_id").isNull(), F.monotonically_increasing_id())
    rows = rows.withColumn("__alone", alone)
    again = F.row_number().over(Window.partitionBy("page_id", "sha1", "__alone").orderBy("url")) > 1
    first = F.when(F.col("first").isNotNull(), F.col("first")).when(F.col("page_id").isNotNull() & (F.length("payload") >= min_bytes) & again, F.col("page_id"))
    rows = rows.select("page_id", "url", "payload", first.alias("first"))
    schema = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, bundle, kept = TaskContext.get().partitionId(), 0, Bundle(frame_bytes, level), []

        def close() -> pa.RecordBatch:
            put(folder, name := f"part-{part:06d}-{seq:05d}.warc.zst", bundle.bytes())
            ids, frame, offset, length = zip(*bundle.index)
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array([name] * len(ids)), pa.array(frame, pa.int32()), pa.array(offset, pa.int32()), pa.array(length, pa.int32())], schema=schema)

        for b in it:
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in b.columns)):
                bundle.add(page_id, record(page_id, url, payload, first, first is not None, date))
                kept.append(page_id)
                if bundle.size >= bundle_bytes:
                    yield close()
                    seq, bundle, kept = seq + 1, Bundle(frame_bytes, level), []
        if kept:
            yield close()

    return written(rows.mapInArrow(run, "page_id long, file string, frame int, offset int, length int"), ws, "records")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of every record of the folder's bundles.

    Lengths and digests of responses are computed from the payloads read and must equal their headers.
    """
    prepare(spark)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def rows(content: bytes) -> Iterator[tuple]:
        reader = Reader(lambda at, n: content[at : at + n], len(content))
        for k in range(reader.frames):
            frame, at = reader.frame(k), 0
            while at < len(frame):
                head, payload, at = parse(frame, at)
                kind, own, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                if kind == "response" and (digest(payload), len(payload)) != (own, size):
                    raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
                page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                yield page and int(page), size, own, kind, refers and int(refers), payload if kind == "response" else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for content in b.column("content"):
                got: list[tuple] = []
                size = 0
                for r in rows(content.as_py()):
                    got.append(r)
                    size += r[1]
                    if size > 1 << 22 or len(got) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*got), schema)], schema=schema)
                        got, size = [], 0
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*got), schema)], schema=schema)

    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return binary(spark, folder, ".warc.zst").mapInArrow(run, out)


def fetch_record(folder: str, file: str, page_id: int) -> list[tuple[dict[str, str], bytes]]:
    """One page's records by random access: footer, index and one frame are read."""
    system, path = store(folder)
    with system.open_input_file(f"{path}/{file}") as f:
        def read(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        return Reader(read, f.size()).fetch(page_id)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives written to the shared workspace and read back."""
    ws = workspace(pages.sparkSession)
    index = write_archives(pages, f"{ws}/archives", ws, min_bytes)
    if index.isEmpty():
        return pages.sparkSession.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return read_archives(pages.sparkSession, f"{ws}/archives")
