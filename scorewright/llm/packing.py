"""Packing documents into sequences of a fixed number of tokens by minimum bin slack.

What decides a packing is how many pieces there are of each length, at most `size` numbers. The driver packs these
counts: it opens a sequence with the longest length left, finds by subset sums over bitsets the fullest combination
of the lengths left, and takes as many sequences of that pattern as the counts allow. Every pattern uses up a length,
so the plan is bounded by `size`, not by the corpus. Pieces then find their place by their rank within their length:
the task that wrote a piece numbered it among those of its length, and sums over the tasks before give the rest, so no
task ever holds all pieces of a frequent length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.shared import lean, prepare, published, texts_of, workspace, written

def fullest(room: int, counts: dict[int, int]) -> list[tuple[int, int]]:
    """The (length, times) of the lengths' fullest combination within room; longer ones are tried first."""
    reach, full, steps = 1, 1 << room, []
    mask = (1 << (room + 1)) - 1
    for n in sorted((n for n in counts if n <= room and counts[n] > 0), reverse=True):
        left, k = min(counts[n], room // n), 1
        while left:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= reach << (n * k) & mask
            if reach & full:
                break
            left, k = left - k, 2 * k
        if reach & full:
            break
    at, out = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            out[n] = out.get(n, 0) + k
            at -= n * k
    return sorted(out.items(), reverse=True)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(sequences, lengths in each) that hold all pieces."""
    left, out = {n: c for n, c in counts.items() if c}, []
    longest = sorted(left)
    while longest:
        n = longest[-1]
        if left.get(n, 0) == 0:
            longest.pop()
            continue
        left[n] -= 1
        rest = fullest(size - n, left)
        left[n] += 1
        times = {n: 1}
        for k, t in rest:
            times[k] = times.get(k, 0) + t
        copies = min(left[k] // t for k, t in times.items())
        for k, t in times.items():
            left[k] -= copies * t
            if not left[k]:
                del left[k]
        out.append((copies, [k for k in sorted(times, reverse=True) for _ in range(times[k])]))
    return out


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every row of docs; ids are little-endian unsigned 32-bit integers.

    A document's ids end with end_id; one of more than `size` is cut into pieces of `size`, of which the first may be
    shorter. A null text is empty: one piece with the end id. Rows that repeat or lack a doc_id keep their pieces; other
    columns are not looked at; an empty table gives none; a very long text is one row of a batch of its own.
    """
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = published(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for b in lean(it):
            rows: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts_of(b, "text")):
                ids = tok.ids(text).astype("<u4").tobytes() + end
                at, total = 0, len(ids) // 4
                for k in range(n := -(-total // size)):
                    to = total - (n - 1 - k) * size
                    rows.append((doc_id, k, at, to - at, ids[4 * at : 4 * to]))
                    at = to
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with __part, the task that they pass, and __own, their number from 0 among its rows of their length."""
    fields = rows.schema.fieldNames()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for b in it:
            length = b.column(fields.index("length")).to_numpy(zero_copy_only=False)
            order = np.argsort(length, kind="stable")
            own = np.zeros(len(length), np.int64)
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(group):
                    n = int(length[group[0]])
                    own[group] = seen.get(n, 0) + np.arange(len(group))
                    seen[n] = seen.get(n, 0) + len(group)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(own)], names=[*fields, "__part", "__own"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", __part int, __own long"
    return rows.mapInArrow(run, out)


def pack(rows: DataFrame, ws: str, size: int = 2048) -> DataFrame:
    """rows with sequence_id and offset; rows have a column length of 1 to size, and keep their other columns.

    Rows of one length are interchangeable, so ranks within it need no order. Rows that repeat or hold nulls in other
    columns get a place each; an empty table gives an empty result. The rows are written once, numbered.
    """
    spark = rows.sparkSession
    prepare(spark)
    fields = rows.schema.fieldNames()
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    rows = written(numbered(rows), ws, "numbered")
    counts = {int(r[0]): int(r[1]) for r in rows.groupBy("length").count().collect()}  # at most `size` rows
    if any(not 1 <= n <= size for n in counts):
        raise ValueError(f"lengths must be 1 to {size}")
    slots: dict[int, list[tuple[int, int, int]]] = {}
    rank, base = dict.fromkeys(counts, 0), 0
    for copies, lengths in plan(counts, size):
        at = 0
        for n in lengths:
            slots.setdefault(n, []).append((rank[n], base, at))
            rank[n] += copies
            at += n
        base += copies
    places = {n: tuple(np.array(x, np.int64) for x in zip(*s)) for n, s in slots.items()}
    # a row for each length and task
    tasks = rows.groupBy("length", "__part").count()
    first = tasks.select("length", "__part", (F.sum("count").over(Window.partitionBy("length").orderBy("__part")) - F.col("count")).alias("__before"))
    ranked = rows.join(first, ["length", "__part"]).select(*[F.col(f"`{c}`") for c in fields], (F.col("__own") + F.col("__before")).alias("__rank"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            length, rank = b.column("length").to_numpy(zero_copy_only=False), b.column("__rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(group):
                    start, seq, at = places[int(length[group[0]])]
                    k = np.searchsorted(start, rank[group], side="right") - 1
                    sequence[group], offset[group] = seq[k] + rank[group] - start[k], at[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in fields), pa.array(sequence), pa.array(offset)], names=[*fields, "sequence_id", "offset"])

    return ranked.mapInArrow(run, out)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """Every piece of docs with its place: (doc_id, piece, start, length, ids or ids_crc32, sequence_id, offset).

    With keep_ids the ids travel along; without, only their crc32 does. An empty table gives an empty result.
    """
    ws = workspace(docs.sparkSession)
    rows = pieces(docs, tokenizer, size, end_id)
    if not keep_ids:
        rows = rows.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(rows, ws, size)
