"""Token-id files: every document's ids compressed on their own with one shared Zstandard dictionary.

The dictionary is trained on the serialised ids of a bounded sample and stored once. A file holds a header (with the
dictionary's hash, the id width and the end id), the frames in ascending doc_id order, an index (doc_id, offset,
length, tokens) and a footer; one document is read with the index and its own frame. Starts across files come from
the sums of the files before, so no task counts the whole corpus.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewright.llm.files import binary, put, store
from scorewright.llm.shared import Published, prepare, published, spans, texts_of, workspace, written

MAGIC, END = b"SWTOKEN1", b"1NEKOTWS"
DICTIONARY = "shared.zdict"
_NULL = -(1 << 63)
_ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("tokens", "<u4")])


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, sample_rows: int = 512, sample_bytes: int = 1 << 15, size: int = 1 << 16) -> bytes:
    """A dictionary from at most sample_rows documents, those of the smallest doc_id hashes, and sample_bytes of each.

    It only affects sizes. Where there is too little to train on, the samples themselves are the dictionary.
    """
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    some = docs.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            tok = published(tokenizer)
            end = _serial(tok, end_id)
            yield pa.RecordBatch.from_arrays([pa.array([(tok.serial(t) + end)[:sample_bytes] for t in texts_of(b, "text")], pa.binary())], names=["ids"])

    samples = [bytes(r[0]) for r in some.mapInArrow(run, "ids binary").limit(2 * sample_rows).collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _serial(tok: Published, token: int) -> bytes:
    return np.array([token], tok.dtype).tobytes()


class Writer:
    """A file being written; width: bytes of an id."""

    def __init__(self, dictionary: bytes, end_id: int, level: int, width: int = 2):
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zstd = zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=True)
        self.head = {"dictionary_sha256": hashlib.sha256(dictionary).hexdigest(), "end_id": end_id, "width": width}
        self.width = width
        self.parts: list[bytes] = []
        self.index: list[tuple] = []
        self.size = self.tokens = 0

    def add(self, doc_id: int | None, serial: bytes) -> None:
        """serial: the little-endian ids of a document, end id included."""
        frame = self.zstd.compress(serial)
        n = len(serial) // self.width
        self.index.append((_NULL if doc_id is None else doc_id, self.size, len(frame), n))
        self.parts.append(frame)
        self.size += len(frame)
        self.tokens += n

    def bytes(self) -> bytes:
        head = json.dumps(self.head).encode()
        index = zstandard.compress(np.array(self.index, _ENTRY).tobytes(), 3)
        start = len(MAGIC) + 4 + len(head)
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, *self.parts, index, struct.pack("<QQI", start, start + self.size, len(index)), END])


class TokenFile:
    """Random access to a file; read(offset, length) gives its bytes."""

    def __init__(self, read, size: int, dictionary: bytes):
        tail = read(size - 28, 28)
        if tail[20:] != END:
            raise ValueError("not a token file")
        self.start, at, n = struct.unpack("<QQI", tail[:20])
        self.head = json.loads(read(len(MAGIC) + 4, self.start - len(MAGIC) - 4))
        if self.head["dictionary_sha256"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError("the file was written with another dictionary")
        self.read = read
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.index = np.frombuffer(zstandard.decompress(read(at, n)), _ENTRY)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, with the end id."""
        e = self.index[k]
        frame = self.read(self.start + int(e["offset"]), int(e["length"]))
        return np.frombuffer(self.zstd.decompress(frame), f"<u{self.head['width']}")


def write_token_files(docs: DataFrame, folder: str, ws: str, tokenizer: str, end_id: int = 0, file_bytes: int = 1 << 24, level: int = 3) -> DataFrame:
    """Write all rows of docs (doc_id, text) in ascending doc_id order; returns the manifest (file, n_docs, n_tokens, base).

    A null text is empty and holds the end id only; rows with a null doc_id come first; rows that repeat stay, side by
    side, and so many of them that they fill several partitions are dealt by their texts; other columns are not looked
    at; an empty table gives an empty manifest; a very long text is one frame. Files have deterministic names and
    contents. base: the ids in all files before.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(rows, tokenizer, end_id)
    put(folder, DICTIONARY, dictionary)
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = published(tokenizer)
        end, width = _serial(tok, end_id), tok.dtype.itemsize
        part, seq, out = TaskContext.get().partitionId(), 0, Writer(dictionary, end_id, level, width)

        def close() -> pa.RecordBatch:
            put(folder, name := f"part-{part:06d}-{seq:05d}.tok", out.bytes())
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "n_docs": len(out.index), "n_tokens": out.tokens}], schema=schema)

        for b in it:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts_of(b, "text")):
                out.add(doc_id, tok.serial(text) + end)
                if out.size >= file_bytes:
                    yield close()
                    seq, out = seq + 1, Writer(dictionary, end_id, level, width)
        if out.index:
            yield close()

    ties = [F.substring("text", 1, 16), F.xxhash64("text")]  # only which of equal ids comes first
    ordered = rows.repartitionByRange("doc_id", *ties).sortWithinPartitions("doc_id", *ties)
    manifest = written(ordered.mapInArrow(run, "part int, seq int, file string, n_docs long, n_tokens long"), ws, "manifest")
    # one row a file
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return written(manifest.select("file", "n_docs", "n_tokens", before.alias("base")), ws, "bases")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, doc_id, start, n_tokens, ids) of every document in the folder's files; start is within its file, ids are
    little-endian unsigned 32-bit integers with the end id."""
    prepare(spark)
    schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    system, path = store(folder)
    with system.open_input_stream(f"{path}/{DICTIONARY}") as f:
        dictionary = f.read()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, content in zip(b.column("file").to_pylist(), b.column("content")):
                data = content.as_py()
                file = TokenFile(lambda at, n: data[at : at + n], len(data), dictionary)
                size = file.index["tokens"].astype(np.int64)
                start = np.cumsum(size) - size
                for i, j in spans(size, 1 << 20):
                    ids = [file.ids(k).astype("<u4").tobytes() for k in range(i, j)]
                    doc = file.index["doc_id"][i:j]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * (j - i)), pa.array(doc.astype(np.int64), mask=doc == _NULL), pa.array(start[i:j]), pa.array(size[i:j]), pa.array(ids, pa.binary())], schema=schema)

    return binary(spark, folder, ".tok").mapInArrow(run, "file string, doc_id long, start long, n_tokens long, ids binary")


def read_document(folder: str, file: str, doc_id: int) -> list[np.ndarray]:
    """One document's ids by random access."""
    system, path = store(folder)
    with system.open_input_stream(f"{path}/{DICTIONARY}") as f:
        dictionary = f.read()
    with system.open_input_file(f"{path}/{file}") as f:
        def read(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        t = TokenFile(read, f.size(), dictionary)
        return [t.ids(int(k)) for k in np.flatnonzero(t.index["doc_id"] == doc_id)]


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """Files written to the shared workspace: (their documents read back, their manifest)."""
    spark = docs.sparkSession
    ws = workspace(spark)
    manifest = write_token_files(docs, f"{ws}/tokens", ws, tokenizer, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], "file string, doc_id long, start long, n_tokens long, ids binary"), manifest
    return read_token_files(spark, f"{ws}/tokens"), manifest
