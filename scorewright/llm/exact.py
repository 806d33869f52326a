"""Exact deduplication by an extendible-hash index on shared files.

Texts are equal when they are identical after lower-casing A-Z only. Each task first chains its own equal texts: an entry
holds a text once, as a Zstandard frame, with the ids of its documents. Entries are written to the shared folder. The
directory is then made from the sizes of 65,536 key ranges: a bucket over its capacity is split by one more bit of the
hash, and where its depth is already the directory's, the directory doubles. Owner tasks get runs of neighbouring
buckets of about equal size, read them in key order, chain the entries of each hash and compare their bytes, so that
different texts with the same hash stay apart. What they find is the index: for each entry its place in the chain, the
document that stays and the number of copies. A hash that a third of all rows have costs its owner one entry for each
task of the first pass, and documents learn their group through their own entry, which is unique.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm.shared import prepare, workspace, written

#: Bits of the hash that the directory may use: it has at most 65,536 slots.
DEPTH = 16
#: Bytes of frames in a bucket before it is split.
CAPACITY = 4 << 20
#: Bytes and rows that a task of the first pass chains before it writes its entries.
_BYTES, _ROWS = 32 << 20, 1 << 18
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = bytes.maketrans(_CAPITALS.encode(), _SMALL.encode())
_ENTRY = pa.schema([("entry", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("best", pa.int64()), ("frame", pa.binary()), ("sha", pa.binary()), ("ids", pa.list_(pa.int64()))])
_INDEX = pa.schema([("entry", pa.int64()), ("bucket", pa.int32()), ("hash", pa.int64()), ("chain", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("holds", pa.bool_())])


def normal(text):
    """A column of texts with A-Z in lower case; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _SMALL)


def _entries(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (doc_id, text): an entry for each text and flush of a task."""
    press = zstandard.ZstdCompressor(level=1).compress
    chains: dict[int, list[tuple[bytes, list[int | None]]]] = {}
    made, size, rows = TaskContext.get().partitionId() << 33, 0, 0

    def flushed() -> Iterator[pa.RecordBatch]:
        nonlocal made, size, rows
        nodes = [(h, text, ids) for h, chain in chains.items() for text, ids in chain]
        for i in range(0, len(nodes), 256):
            part = nodes[i : i + 256]
            columns = {
                "entry": range(made, made + len(part)),
                "hash": np.array([h for h, _, _ in part], np.uint64).view(np.int64),
                "n": [len(ids) for _, _, ids in part],
                "best": [max((x for x in ids if x is not None), default=None) for _, _, ids in part],
                "frame": [press(text) for _, text, _ in part],
                "sha": [hashlib.sha256(text).digest() for _, text, _ in part],
                "ids": [ids for _, _, ids in part],
            }
            made += len(part)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _ENTRY], schema=_ENTRY)
        chains.clear()
        size = rows = 0

    for b in it:
        for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            text = (text or b"").translate(_LOWER)
            chain = chains.setdefault(xxhash.xxh3_64_intdigest(text), [])
            ids = next((ids for own, ids in chain if own == text), None)
            if ids is None:
                chain.append((text, ids := []))
                size += len(text)
            ids.append(i)
            rows += 1
            if size > _BYTES or rows >= _ROWS:
                yield from flushed()
    yield from flushed()


def directory(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each slot, depth of each bucket) for the sizes of 2**k ranges of the hash's first bits.

    One bucket of depth 0 holds all at first. A bucket over `capacity` is split by its next bit; if its depth is that of
    the directory, the directory doubles first. A bucket of a single range is not split further.
    """
    most = len(sizes).bit_length() - 1
    total = np.concatenate([[0], np.cumsum(sizes)])
    slots, depths, spread, over = np.zeros(1, np.int64), [0], 0, [0]
    while over:
        b = over.pop()
        mine = np.flatnonzero(slots == b)
        width = len(sizes) >> spread
        if total[(mine[-1] + 1) * width] - total[mine[0] * width] <= capacity or depths[b] == most:
            continue
        if depths[b] == spread:
            slots, spread = np.repeat(slots, 2), spread + 1
            mine = np.arange(2 * mine[0], 2 * mine[-1] + 2)
        slots[mine[len(mine) // 2 :]] = len(depths)
        depths[b] += 1
        depths.append(depths[b])
        over += [b, len(depths) - 1]
    return slots, np.array(depths)


def owners(slots: np.ndarray, sizes: np.ndarray, tasks: int) -> np.ndarray:
    """The task of each slot: neighbouring buckets together, of about equal sizes in sum."""
    per_slot = sizes.reshape(len(slots), -1).sum(axis=1) + 1e-9
    first = np.concatenate([[True], slots[1:] != slots[:-1]])
    before = (np.cumsum(per_slot) - per_slot)[first]
    return np.minimum(before / per_slot.sum() * tasks, tasks - 1).astype(np.int64)[np.cumsum(first) - 1]


def _chained(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over an owner's entries in key order: the chain of each hash, by comparing bytes."""
    plain = zstandard.ZstdDecompressor().decompress
    last, chain, out = None, [], []

    def equal(a: bytes, b: bytes) -> bool:
        return a == b or plain(a) == plain(b)

    def ended() -> None:
        for place, (_, n, best, holder, entries) in enumerate(chain):
            out.extend((e, *last, place, best, n, e == holder) for e in entries)

    def batch() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _INDEX)], schema=_INDEX)
        out.clear()
        return found

    for b in it:
        for bucket, h, entry, n, best, frame in zip(*(b.column(c).to_pylist() for c in ("bucket", "hash", "entry", "n", "best", "frame"))):
            if (bucket, h) != last:
                ended()
                last, chain = (bucket, h), []
                if len(out) >= 1 << 14:
                    yield batch()
            node = next((x for x in chain if equal(x[0], frame)), None)
            if node is None:
                chain.append([frame, n, best, entry, [entry]])
                continue
            node[1] += n
            if best is not None and (node[2] is None or best > node[2]):
                node[2:4] = best, entry
            node[4].append(entry)
    ended()
    if out:
        yield batch()


def build_index(docs: DataFrame, ws: str, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, directory, index), each a table in the shared folder ws.

    entries (entry, hash, n, best, frame, sha, ids), directory (slot, bucket, depth, owner), index (entry, bucket, hash,
    chain, keep_id, group_size, holds: whether the row that stays is one of this entry's).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sql = "entry long, hash long, n long, best long, frame binary, sha binary, ids array<long>"
    entries = written(rows.mapInArrow(_entries, sql), ws, "entries")
    key = F.shiftrightunsigned("hash", 64 - DEPTH).alias("key")
    sizes = np.zeros(1 << DEPTH)
    for r in entries.groupBy(key).agg(F.sum(F.octet_length("frame") + 64).alias("size")).collect():  # at most 2**16 rows
        sizes[r.key] = r.size
    slots, depths = directory(sizes, max(capacity, int(sizes.sum()) >> DEPTH - 2))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(sizes.sum()) >> 27)
    own = owners(slots, sizes, tasks)
    table = [(i, int(b), int(depths[b]), int(o)) for i, (b, o) in enumerate(zip(slots, own))]
    book = written(spark.createDataFrame(table, "slot long, bucket int, depth int, owner int").coalesce(1), ws, "directory")
    bits = len(slots).bit_length() - 1
    placed = entries.select("entry", "hash", "n", "best", "frame", F.shiftright(F.shiftrightunsigned("hash", 64 - DEPTH), DEPTH - bits).alias("slot"))
    placed = placed.join(F.broadcast(book), "slot").select("bucket", "hash", "entry", "n", "best", "frame", "owner")  # at most 2**16 rows
    dealt = placed.repartitionById(tasks, F.col("owner")).sortWithinPartitions("bucket", "hash", "entry")
    sql = "entry long, bucket int, hash long, chain int, keep_id long, group_size long, holds boolean"
    return entries, book, written(dealt.mapInArrow(_chained, sql), ws, "index")


def groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs (doc_id, text).

    keep_id is the largest doc_id with an equal text, group_size the number of rows with it, and of each group exactly
    one row is kept, also where rows repeat that doc_id. A null text is empty. Rows without a doc_id count in their group
    but give way to any that has one; a group without any doc_id has the keep_id null and keeps one row. Other columns are
    left out, whatever their names. An empty table gives none. Of very long texts a task holds one and those of its flush.
    """
    prepare(docs.sparkSession)
    entries, _, index = build_index(docs, workspace(docs.sparkSession), capacity)
    both = entries.select("entry", "sha", "ids").join(index.select("entry", "keep_id", "group_size", "holds"), "entry")
    place = F.coalesce(F.array_position("ids", F.col("keep_id")), F.lit(1)) - 1
    rows = both.select("keep_id", "group_size", "holds", place.alias("place"), F.lower(F.hex("sha")).alias("text_sha256"), F.posexplode("ids").alias("at", "doc_id"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("holds") & (F.col("at") == F.col("place"))).alias("kept"), "text_sha256")


def keep_last(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that `groups` keeps, all columns as they are, one row of each text; which of two rows with the same
    doc_id and text it is, when they differ in other columns, is left open."""
    kept = groups(docs, capacity).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), F.sha2(normal(docs["text"]), 256).alias("sha"))
    own, other = rows.alias("own"), kept.alias("other")
    found = own.join(other, (F.col("own.sha") == F.col("other.sha")) & F.col("own.id").eqNullSafe(F.col("other.id")), "left_semi")
    return found.dropDuplicates(["sha"]).select("row.*")
