"""Fill-in-middle: texts cut into prefix, middle and suffix at code points, found by rank and select.

The code points of a batch of texts are a bitvector over its UTF-8 bytes, packed eight to a byte, with a directory of
the ones before each block of 512 bits. The ones in a text's range are its number of code points; a cut after k of them
is the byte that select finds for the rank before the text plus k. Texts are neither decoded nor copied for that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.shared import prepare

SENTINELS = ("<P>", "<S>", "<M>")
_BLOCK = 512
_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
_OUT_SQL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Boundaries:
    """Where the code points of UTF-8 bytes start: a packed bitvector with the number of ones before each block."""

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        packed = np.packbits((data & 0xC0) != 0x80)
        blocks = -(-max(self.size, 1) // _BLOCK)
        self.blocks = np.zeros((blocks, _BLOCK // 8), np.uint8)
        self.blocks.reshape(-1)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks).sum(axis=1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The ones before each byte position, of which none is negative or beyond the end."""
        block, rest = np.divmod(np.asarray(at, np.int64), _BLOCK)
        inside = np.minimum(block, len(self.blocks) - 1)
        bits = np.unpackbits(self.blocks[inside], axis=1)
        ones = np.where(np.arange(_BLOCK) < rest[:, None], bits, 0).sum(axis=1, dtype=np.int64)
        return self.before[block] + np.where(block < len(self.blocks), ones, 0)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte position of the k-th one, from 0; beyond the last one the end."""
        k = np.asarray(k, np.int64)
        out = np.full(len(k), self.size, np.int64)
        there = np.flatnonzero(k < self.before[-1])
        block = np.searchsorted(self.before, k[there], side="right") - 1
        ones = np.cumsum(np.unpackbits(self.blocks[block], axis=1), axis=1, dtype=np.int64)
        out[there] = block * _BLOCK + (ones == (k[there] - self.before[block] + 1)[:, None]).argmax(axis=1)
        return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four numbers below 2**32 from a document's id; without an id the text after the colon is empty."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(found[i : i + 4], "big") for i in range(0, 16, 4))


def arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes, marks: tuple[bytes, ...]) -> bytes:
    p, s, m = marks
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def rebuilt(form: str, output: bytes, marks: tuple[bytes, ...]) -> bytes:
    """The text that an output of `arranged` came from. No part holds a mark, and none can begin within another or at the
    end of a part, because each starts with its only `<` and ends with its only `>`: the first found is the one put there."""
    p, s, m = marks
    first, second = (p, s) if form == "psm" else (s, p)
    a = output.index(second, len(first))
    b = output.index(m, a + len(second))
    one, two, middle = output[len(first) : a], output[a + len(second) : b], output[b + len(m) :]
    return one + middle + two if form == "psm" else two + middle + one


def _checked(sentinels: tuple[str, str, str]) -> tuple[bytes, ...]:
    marks = tuple(x.encode() for x in sentinels)
    if len(set(marks)) != 3 or any(len(x) < 2 or x[:1] != b"<" or x[-1:] != b">" or x.count(b"<") + x.count(b">") != 2 for x in marks):
        raise ValueError("sentinels must be three different texts that hold < only at their start and > only at their end")
    return marks


def transform(docs: DataFrame, plain: int = 10, spm: int = 20, sentinels: tuple[str, str, str] = SENTINELS, seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of docs (doc_id, text).

    n is the number of code points. `plain` in a hundred texts, and those that are empty or hold a sentinel, stay as they
    are, with null lengths; of the others `spm` in a hundred are suffix, prefix, middle and the rest prefix, suffix,
    middle. Draws depend on doc_id and seed only: rows that repeat a doc_id are drawn alike, and those without one as if
    it were empty text. A null text is empty, texts of any length are cut whole, other columns are left out, whatever
    their names, and an empty table gives none.
    """
    marks = _checked(sentinels)
    prepare(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, offsets = _flat(b.column(1))
            ids = b.column(0).to_pylist()
            where = Boundaries(data)
            first = where.rank(offsets)
            n = np.diff(first)
            h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
            cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
            at = where.select((first[:-1, None] + cuts).ravel()).reshape(-1, 2)
            at = np.minimum(at, offsets[1:, None])
            forms, outputs = [], []
            for i, (x, y) in enumerate(at):
                a, z = offsets[i], offsets[i + 1]
                text = data[a:z].tobytes()
                form = "plain" if not text or h[i, 2] % 100 >= 100 - plain or any(m in text for m in marks) else "spm" if h[i, 3] % 100 < spm else "psm"
                forms.append(form)
                outputs.append(text if form == "plain" else arranged(form, text[: x - a], text[x - a : y - a], text[y - a :], marks))
            cut = np.array([f != "plain" for f in forms], bool)
            columns = [b.column(0), pa.array(n), pa.array(forms, pa.string())]
            columns += [pa.array(v, pa.int64(), mask=~cut) for v in (cuts[:, 0], cuts[:, 1] - cuts[:, 0])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(outputs, pa.binary()).cast(pa.string())], schema=_OUT)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _OUT_SQL)


def restore(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The rows of `transform` with the column text, rebuilt from form and output alone."""
    marks = _checked(sentinels)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = zip(b.column("form").to_pylist(), b.column("output").cast(pa.binary()).to_pylist())
            texts = [out if form == "plain" else rebuilt(form, out, marks) for form, out in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).cast(pa.string())], schema=_OUT.append(pa.field("text", pa.string())))

    return made.select(*_OUT.names).mapInArrow(run, _OUT_SQL + ", text string")
