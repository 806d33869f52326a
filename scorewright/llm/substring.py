"""Removal of passages of `window` words that an earlier document has too, by difference-cover anchors.

D is a difference cover modulo p: for any two positions some shift below p takes both to residues in D. So two
documents that share a window of W words share the shorter window of W - p + 1 words at a position that is a cover
position in both. Only windows at cover positions are hashed (6 in 31) and compared; those that two documents have
are anchors. Around an anchor a match extends to the windows of W words that contain it: they are compared by a
128-bit hash of all their words, and the smallest document of each decides which words go.

Hashes travel in blocks: a batch of documents sends one row of arrays for each range of hashes. What a batch finds
within itself is settled there and of each hash only the smallest document is sent on, so a passage that a third of
all documents share costs a row for each batch, not for each document, in the task that compares it. Texts are dealt
by doc_id. Documents with equal words are a class whose smallest doc_id stands for it in the extension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.shared import prepare, workspace, written

#: Perfect difference sets: every residue modulo the period is a difference of two members.
COVERS = ((31, (0, 1, 3, 8, 12, 18)), (13, (0, 1, 3, 9)), (7, (0, 1, 3)), (3, (0, 1)))
#: Occurrences that one task compares.
COMPARED = 1_500_000
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers: of bytes in a word, and of words in the two halves of a window's hash.
_BYTE, _FIRST, _SECOND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SEGMENT = 1 << 20


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of a third of the window, and its cover."""
    return next((c for c in COVERS if window - c[0] + 1 >= max(2, window // 3)), (1, (0,)))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(_SEGMENT + 1, _BYTE, np.uint64)
        down = np.full(_SEGMENT + 1, np.uint64(pow(int(_BYTE), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


_UP, _DOWN = _powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread by multiplications and shifts, since low bits of a polynomial hang on low bits only."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) in bytes of the words [^\\x20\\x09-\\x0D]+."""
    edge = np.diff(np.concatenate([[True], _WHITE[data], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial over the bytes."""
    start, end = word_spans(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    out, i = [], 0
    while i < len(start):  # whole words in segments of bounded length; a longer word is hashed on its own
        j = max(i + 1, int(np.searchsorted(end, start[i] + _SEGMENT, side="right")))
        a, b = int(start[i]), int(end[j - 1])
        if b - a > _SEGMENT:
            out.append(np.array([xxhash.xxh64_intdigest(data[a:b].tobytes())], np.uint64))
        else:
            with np.errstate(over="ignore"):
                total = np.zeros(b - a + 1, np.uint64)
                np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * _UP[: b - a], out=total[1:])
                s, e = start[i:j] - a, end[i:j] - a
                out.append((total[e] - total[s]) * _DOWN[s])
        i = j
    return mixed(np.concatenate(out))


def rolling(h: np.ndarray, n: int, multiplier: np.uint64) -> np.ndarray:
    """The polynomial hash modulo 2**64 of every run of n values, by doubling."""
    if len(h) < n:
        return h[:0]
    m = len(h) - n + 1
    out, done, part, width, step = np.zeros(len(h), np.uint64), 0, h, 1, multiplier
    with np.errstate(over="ignore"):
        while width <= n:
            if n & width:
                out = out[: len(h) - done - width + 1] * step + part[done : len(h) - width + 1]
                done += width
            if 2 * width <= n:
                part = part[: len(part) - width] * step + part[width:]
            step, width = step * step, 2 * width
    return mixed(out[:m])


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of a document's windows at cover positions; h: its word hashes."""
    period, cover = cover_for(window)
    short = rolling(h, window - period + 1, _FIRST) if len(h) >= window else h[:0]
    at = (np.arange(0, len(short), period)[:, None] + np.array(cover)).ravel()
    at = at[at < len(short)]
    return at, short[at]


_BLOCK = np.dtype([("doc", "<i8"), ("row", "<i8"), ("at", "<u4")])
_MOVED = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("hash", pa.binary()), ("doc", pa.binary()), ("row", pa.binary()), ("at", pa.binary())])
_MOVED_SQL = "bucket int, settled boolean, hash binary, doc binary, row binary, at binary"
_FOUND = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.binary())])
_FOUND_SQL = "doc_id long, row long, at binary"
_HASH = np.dtype([("a", "<u8"), ("b", "<u8")])


def _groups(first: np.ndarray, second: np.ndarray | None, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group of each in that order, smallest document of each group): equal hashes side by side, by document."""
    order = np.lexsort((doc, first) if second is None else (doc, second, first))
    f = first[order]
    new = np.concatenate([[True], f[1:] != f[:-1]]) if len(f) else np.zeros(0, bool)
    if second is not None and len(f):
        s = second[order]
        new[1:] |= s[1:] != s[:-1]
    head = np.flatnonzero(new)
    return order, np.cumsum(new) - 1, doc[order][head]


def _settle(first, second, doc, shared: bool):
    """Which occurrences are found (in two documents if shared, else in a smaller one), and which of each hash is sent on."""
    order, group, least = _groups(first, second, doc)
    found, sent = np.zeros(len(first), bool), np.zeros(len(first), bool)
    if len(first):
        later = doc[order] > least[group]
        if shared:
            several = np.zeros(len(least), bool)
            several[group[later]] = True
            found[order] = several[group]
        else:
            found[order] = later
        head = np.concatenate([[True], group[1:] != group[:-1]])
        # of a hash found here its first occurrence is enough to tell others; a hash of one document sends all of its own
        sent[order] = head | ~found[order] if shared else ~later
    return found, sent


def _move(first, second, doc, row, at, buckets: int, shared: bool, salt: int) -> pa.RecordBatch:
    found, sent = _settle(first, second, doc, shared)
    rows = []
    if found.any():
        rows.append((salt % buckets, True, b"", doc[found].tobytes(), row[found].tobytes(), at[found].tobytes()))
    bucket = ((first >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    pick = np.flatnonzero(sent)
    pick = pick[np.argsort(bucket[pick], kind="stable")]
    for part in np.split(pick, np.flatnonzero(np.diff(bucket[pick])) + 1):
        if len(part):
            h = first[part].tobytes() + (b"" if second is None else second[part].tobytes())
            rows.append((int(bucket[part[0]]), False, h, doc[part].tobytes(), row[part].tobytes(), at[part].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _MOVED)], schema=_MOVED)


_FOR_DOC = pa.schema([("bucket", pa.int32()), ("doc", pa.binary()), ("row", pa.binary()), ("at", pa.binary())])
_FOR_DOC_SQL = "bucket int, doc binary, row binary, at binary"


def _by_document(parts: list[tuple], deal: int) -> pa.RecordBatch:
    """Occurrences (doc, row, at) in a block for each of `deal` ranges of document hashes."""
    doc, row, at = (np.concatenate(x) for x in zip(*parts))
    bucket = ((mixed(doc.view(np.uint64)) >> np.uint64(32)) * np.uint64(deal) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    doc, row, at, bucket = doc[order], row[order], at[order], bucket[order]
    head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(head[1:], len(bucket))
    blocks = [[x[a:b].tobytes() for a, b in zip(head, ends)] for x in (doc, row, at)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[head].astype(np.int32)), *(pa.array(x, pa.binary()) for x in blocks)], schema=_FOR_DOC)


def _compare(shared: bool, wide: bool, deal: int):
    """mapInArrow over the rows of _move: the occurrences found, in blocks by document."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[tuple] = []
        ready: list[tuple] = []
        for b in it:
            for settled, h, doc, row, at in zip(*(b.column(c).to_pylist() for c in ("settled", "hash", "doc", "row", "at"))):
                own = np.frombuffer(doc, "<i8"), np.frombuffer(row, "<i8"), np.frombuffer(at, "<u4")
                if settled:
                    ready.append(own)
                    if sum(len(x[0]) for x in ready) > COMPARED:
                        yield _by_document(ready, deal)
                        ready = []
                else:
                    h = np.frombuffer(h, "<u8")
                    blocks.append((*(h.reshape(2, -1) if wide else (h, None)), *own))
        if blocks:
            first, second, doc, row, at = (None if x[0] is None else np.concatenate(x) for x in zip(*blocks))
            del blocks
            found, _ = _settle(first, second, doc, shared)
            ready.append((doc[found], row[found], at[found]))
        if sum(len(x[0]) for x in ready):
            yield _by_document(ready, deal)

    return run


def _gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over the blocks of one range of documents: a row for each document, with all its positions."""
    parts = [tuple(np.frombuffer(x, t) for x, t in zip(r, ("<i8", "<i8", "<u4"))) for b in it for r in zip(*(b.column(c).to_pylist() for c in ("doc", "row", "at")))]
    if parts:
        doc, row, at = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((at, row, doc))
        doc, row, at = doc[order], row[order], at[order]
        head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])]))
        ends = np.append(head[1:], len(doc))
        for i in range(0, len(head), 4096):
            a, z = head[i : i + 4096], ends[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(row[a]), pa.array([at[x:y].tobytes() for x, y in zip(a, z)], pa.binary())], schema=_FOUND)


def _found(moved: DataFrame, shared: bool, wide: bool, deal: int) -> DataFrame:
    """(doc_id, row, at) of the occurrences found, a row for each document."""
    compared = moved.repartitionById(deal, F.col("bucket")).mapInArrow(_compare(shared, wide, deal), _FOR_DOC_SQL)
    return compared.repartitionById(deal, F.col("bucket")).mapInArrow(_gather, _FOUND_SQL)


def _bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text, not copied; null is empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    valid = column.is_valid().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield data[offsets[i] : offsets[i + 1]] if valid is None or valid[i] else data[:0]


def _deal(total: int, spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // COMPARED))


def _classes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        n, k = [], []
        for data in _bytes(b.column("text")):
            h = word_hashes(data)
            n.append(len(h))
            k.append(xxhash.xxh3_128_digest(h.tobytes()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(n, pa.int64()), pa.array(k, pa.binary())], names=["doc_id", "row", "n_words", "words"])


def repeats(docs: DataFrame, ws: str, window: int = 50) -> DataFrame:
    """(doc_id, row, at): for each row of docs (doc_id, row, text) with some, the covered windows' first words as
    binary arrays of little-endian unsigned 32-bit integers.

    A window is covered if the same words start in a row with a smaller doc_id. Rows with a null doc_id are not
    compared.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null")
    known = written(docs.mapInArrow(_classes, "doc_id long, row long, n_words long, words binary"), ws, "words")
    known = known.where(F.col("n_words") >= window)
    total = known.agg(F.sum("n_words")).first()[0]
    if not total:
        return spark.createDataFrame([], "doc_id long, row long, at binary")
    period, cover = cover_for(window)
    deal = _deal(total * len(cover) // period, spark)

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            doc, row, at, h = [], [], [], []
            for d, r, data in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), _bytes(b.column("text"))):
                p, a = anchors(word_hashes(data), window)
                doc.append(np.full(len(p), d, np.int64))
                row.append(np.full(len(p), r, np.int64))
                at.append(p.astype("<u4"))
                h.append(a)
            if sum(map(len, at)):
                h = np.concatenate(h)
                yield _move(h, None, np.concatenate(doc), np.concatenate(row), np.concatenate(at), deal, True, int(h[0] % np.uint64(1 << 31)))

    near = written(_found(docs.mapInArrow(hashed, _MOVED_SQL), True, False, deal), ws, "anchors")

    # of documents with equal words the smallest stands for all
    first = written(known.groupBy("words").agg(F.min("doc_id").alias("first")), ws, "first")
    known = known.join(first, "words").select("doc_id", "row", "n_words", "first")
    known = written(known, ws, "classes")
    own = near.join(known.where("doc_id = first").select("doc_id", "row").distinct(), ["doc_id", "row"], "left_semi")
    most = own.select(F.sum(F.length("at"))).first()[0] or 0
    deal_wide = _deal(min(most // 4 * period, total), spark)

    def extended(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            doc, row, at, one, two = [], [], [], [], []
            for d, r, near_at, data in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("at").to_pylist(), _bytes(b.column("text"))):
                h = word_hashes(data)
                n = len(h) - window + 1
                if n < 1:
                    continue
                a = np.frombuffer(near_at, "<u4").astype(np.int64)
                # windows that contain an anchor: they start up to period - 1 words before it
                mark = np.zeros(len(h) + period + 1, np.int32)
                np.add.at(mark, np.maximum(a - period + 1, 0), 1)
                np.add.at(mark, a + 1, -1)
                p = np.flatnonzero(np.cumsum(mark)[:n] > 0)
                doc.append(np.full(len(p), d, np.int64))
                row.append(np.full(len(p), r, np.int64))
                at.append(p.astype("<u4"))
                one.append(rolling(h, window, _FIRST)[p])
                two.append(rolling(h, window, _SECOND)[p])
            if sum(map(len, at)):
                one = np.concatenate(one)
                yield _move(one, np.concatenate(two), np.concatenate(doc), np.concatenate(row), np.concatenate(at), deal_wide, False, int(one[0] % np.uint64(1 << 31)))

    texts = docs.join(own, ["doc_id", "row"]).select("doc_id", "row", "at", "text")
    found = written(_found(texts.mapInArrow(extended, _MOVED_SQL), False, True, deal_wide), ws, "windows")
    # every window of a copy starts in its class's first document
    copies = known.where("doc_id > first").distinct().select("doc_id", "row", "n_words")

    def all_windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                n = b.column("n_words")[i].as_py() - window + 1
                at = np.arange(0, n, window, dtype="<u4")
                at = np.append(at, n - 1).astype("<u4")
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1), b.column("row").slice(i, 1), pa.array([at.tobytes()], pa.binary())], schema=_FOUND)

    return found.unionByName(copies.mapInArrow(all_windows, _FOUND_SQL))


def without(data: np.ndarray, at: list[bytes] | None, window: int, keep_spacing: bool) -> tuple[bytes, int, np.ndarray]:
    """(text, words, removed runs of words) of a text whose covered windows start at the words `at`."""
    start, end = word_spans(data)
    n, raw = len(start), data.tobytes()
    if not at:
        return raw if keep_spacing else b" ".join(raw.split()), n, np.zeros((0, 2), np.int64)
    p = np.frombuffer(b"".join(at), "<u4").astype(np.int64)
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, p, 1)
    np.add.at(mark, p + window, -1)
    gone = np.cumsum(mark)[:n] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
    if keep_spacing:  # a kept word keeps the white space before it
        lead = np.concatenate([[0], end[:-1]])
        return b"".join(raw[x:y] for x, y in zip(lead[~gone].tolist(), end[~gone].tolist())), n, edges
    return b" ".join(raw[x:y] for x, y in zip(start[~gone].tolist(), end[~gone].tolist())), n, edges


def remove_repeats(docs: DataFrame, window: int = 50, keep_spacing: bool = False) -> DataFrame:
    """docs' rows as (doc_id, n_words, n_removed, text, spans): text without the words that a covered window covers.

    A window is `window` consecutive words [^\\x20\\x09-\\x0D]+, unchanged, of one row; it is covered if its words also
    start in a row with a smaller doc_id. Windows are judged on the input, not on what is left. spans are the removed
    runs of words, start and end. The kept words are joined by one space; with keep_spacing they keep the white space
    before them instead, so that a text without repeats is unchanged. A null text has no words (and stays null with
    keep_spacing); shorter texts than a window stay whole; a row with a null doc_id keeps its words and removes none of
    others; rows that repeat with one doc_id don't remove each other's words; other columns are not looked at.
    """
    spark = docs.sparkSession
    prepare(spark)
    ws = workspace(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    found = repeats(rows, ws, window).groupBy("doc_id", "row").agg(F.collect_list("at").alias("at"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()), ("spans", span)])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n_words, removed, texts, spans = [], [], [], []
            for at, data, null in zip(b.column("at").to_pylist(), _bytes(b.column("text")), b.column("text").is_null().to_pylist()):
                text, n, edges = without(data, at, window, keep_spacing)
                n_words.append(n)
                removed.append(int((edges[:, 1] - edges[:, 0]).sum()))
                spans.append([{"start": int(x), "end": int(y)} for x, y in edges])
                texts.append(None if null and keep_spacing else text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(spans, span)], schema=schema)

    both = rows.join(found, ["doc_id", "row"], "left").select("doc_id", "at", "text")
    return both.mapInArrow(cut, "doc_id long, n_words long, n_removed long, text string, spans array<struct<start int, end int>>")


def cut_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs, columns as they are, with repeats cut out of text (n_chars recomputed where it is a column).

    A text without repeats is unchanged; a row whose words all go is left out.
    """
    spark = docs.sparkSession
    prepare(spark)
    ws = workspace(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    found = repeats(rows, ws, window).groupBy("doc_id", "row").agg(F.collect_list("at").alias("__at"))
    found = found.withColumnsRenamed({"doc_id": "__id", "row": "__row"})
    own = docs.withColumn("__text", F.xxhash64("text"))
    both = own.join(found, (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__text") == F.col("__row")), "left").select(*docs.columns, "__at")
    schema, place = docs.schema, docs.columns.index("text")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            kept, stay = [], []
            for at, data, null in zip(b.column("__at").to_pylist(), _bytes(b.column(place)), b.column(place).is_null().to_pylist()):
                text = None if null else without(data, at, window, True)[0]
                kept.append(text)
                stay.append(not at or bool(text.strip()))
            cut = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([cut if i == place else b.column(i) for i in range(len(schema))], names=schema.names).filter(pa.array(stay))

    out = both.mapInArrow(cut, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
