"""What the operators of this subpackage share: where tables are written, how code reaches executors,
connected components, and tokenising through a table of words."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import itertools
import json
import os
import re
import tempfile
import unicodedata
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.shipping import ship

#: Rows and bytes of one Arrow batch sent to Python: bounds a worker's memory whatever the partition's size.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20
#: Of glibc; other C libraries have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches and let executors import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    ship(spark)


def workspace(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or the session's checkpoint folder, which driver and executors share.

    Only in local mode may a session have neither (tests): then a folder of this machine is used. On a cluster that
    raises, because each executor would write to its own disk.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base and (own := sc._jsc.sc().getCheckpointDir()).isDefined():
        base = own.get()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:" + os.path.join(tempfile.gettempdir(), "scorewright-checkpoints")
    path = f"{base.rstrip('/')}/scorewright-{uuid.uuid4().hex}"

    def remove() -> None:
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(remove)
    return path


def written(df: DataFrame, ws: str, name: str) -> DataFrame:
    """df as a Parquet table in the workspace: cuts the lineage and survives lost executors."""
    path = f"{ws}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with what each left free handed back to the system: idle workers otherwise hold on to their peak."""
    for b in it:
        yield b
        del b
        pa.default_memory_pool().release_unused()
        if _TRIM is not None:
            _TRIM(0)


def batches(columns: dict[str, object], schema: pa.Schema, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `rows` rows from whole columns."""
    arrays = [pa.array(columns[f.name], type=f.type) for f in schema]
    n = len(arrays[0]) if arrays else 0
    for i in range(0, n, rows):
        yield pa.RecordBatch.from_arrays([a.slice(i, rows) for a in arrays], schema=schema)


# --- connected components ---------------------------------------------------------------------------


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the edges (a, b) held in memory, as edges from each node to its smallest one."""
    if not len(a):
        return a, b
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    off = label != np.arange(len(ids))
    return ids[off], ids[label[off]]


def components(edges: DataFrame, ws: str) -> DataFrame:
    """(node, component) for every end of `edges` (a, b: long); component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, halves the pointers until they are flat and contracts
    the edges, so a round at least halves the nodes that still have edges. Nothing is collected; sums per hub are
    combined before the shuffle, and joins on hubs are left to the skew join of adaptive execution.
    """
    spark = edges.sparkSession
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ws, "edges")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), ws, "up")
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = written(up.join(over, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), ws, "up")
            if up.where("moved").isEmpty():
                break
            up = up.select("node", "up")
        up = up.select("node", "up")
        levels.append(up)
        left = edges.join(up.withColumnRenamed("node", "a"), "a").select("b", F.col("up").alias("a"))
        both_up = left.join(up.withColumnRenamed("node", "b"), "b").select("a", F.col("up").alias("b"))
        edges = written(both_up.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ws, "edges")
    if not levels:
        return spark.createDataFrame([], "node long, component long")
    labels = levels[0].withColumnRenamed("up", "component")
    for up in levels[1:]:
        over = up.select(F.col("node").alias("component"), F.col("up").alias("top"))
        labels = labels.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return written(labels, ws, "labels")


# --- tokenising by words ----------------------------------------------------------------------------


#: Code points whose class no Unicode version since 5.0 has changed, and their lower case neither: there `re` with the
#: classes spelled out splits as the tokenizers' own pattern does. Texts with others are split by the library.
_ASSIGNED = {c for c in map(chr, itertools.chain(range(0x250), range(0x2002, 0x2070))) if unicodedata.category(c) != "Cn"}
_PLAIN = sorted(c for c in _ASSIGNED if _ASSIGNED.issuperset(c.lower()))


def _spelled(test: Callable[[str], bool]) -> str:
    return "".join(re.escape(c) for c in _PLAIN if test(c))


_L, _N = (_spelled(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
#: White_Space of Unicode, as the tokenizers' \s has it.
_S = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _runs(chars: list[str]) -> str:
    """Ascending characters as the ranges of a class."""
    out, at = [], 0
    while at < len(chars):
        to = at
        while to + 1 < len(chars) and ord(chars[to + 1]) == ord(chars[to]) + 1:
            to += 1
        out.append(f"\\U{ord(chars[at]):08x}-\\U{ord(chars[to]):08x}")
        at = to + 1
    return "".join(out)


UNUSUAL = re.compile(f"[^{_runs(_PLAIN)}]")
#: The two patterns of the published tokenizers: byte-level, and words with white space dropped.
BYTE_LEVEL = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
WORD_LEVEL = "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"


def pattern(template: str) -> re.Pattern:
    """For texts in which UNUSUAL finds nothing."""
    return re.compile(template.format(L=_L, N=_N, S=_S))


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (chr(0x100 + i) for i in range(256))
    return [chr(b) if b in own else next(rest) for b in range(256)]


class Words(dict):
    """The serialised ids of words, learnt one by one as they turn up.

    It only saves time: a word's ids don't depend on its neighbours, because the tokenizers apply BPE within each
    match of their pattern. Beyond `limit` words all but the first `core`, among which are the frequent ones, go.
    """

    def __init__(self, encode: Callable[[str], bytes], limit: int = 400_000, core: int = 100_000):
        self.encode, self.limit, self.core = encode, limit, core

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.encode(word)
        return ids

    def joined(self, words: list[str]) -> bytes:
        if len(self) > self.limit:
            first = dict(itertools.islice(self.items(), self.core))
            self.clear()
            self.update(first)
        return b"".join(map(self.__getitem__, words))


class Published:
    """A tokenizer of the tokenizers library, file and all its defaults; ids equal Tokenizer.encode(text,
    add_special_tokens=False) of the whole text without truncation and padding.

    Plain texts are split by the tokenizer's own pattern and each distinct word is encoded once; other texts the library
    encodes whole. Ids are handed on in their serialised form, little-endian of 16 bits if the vocabulary allows.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        kind = self.library.pre_tokenizer.__class__.__name__
        self.lower = self.library.normalizer is not None
        if (kind, self.lower) not in {("ByteLevel", False), ("Sequence", True)}:
            raise ValueError(f"no word pattern is known for {path}")
        self.find = pattern(WORD_LEVEL if self.lower else BYTE_LEVEL).findall
        added = self.library.get_added_tokens_decoder()
        self.special = re.compile("|".join(re.escape(t.content) for t in added.values())) if added else None
        self.dtype = np.dtype("<u2" if max([self.library.get_vocab_size(with_added_tokens=True) - 1, *added]) < 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.symbols = dict(enumerate(byte_symbols()))
        self.core = None if self.lower else self._ranked(path)
        self.table = Words(self._word if self.core is None else self._piece)

    def _ranked(self, path: str):
        """A BPE over bytes with the file's merges, or none where ids don't follow the order of merges."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = {s: b for b, s in self.symbols.items()}
        vocab = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if all(c in back for c in t)}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        single = [vocab[bytes([b])] for b in range(256)]
        if made != sorted(made) or made and made[0] < max(single) or len(made) + 256 > len(vocab):
            return None
        keep = {*made, *single}
        return tiktoken.Encoding("own", pat_str=".", mergeable_ranks={t: i for t, i in vocab.items() if i in keep}, special_tokens={})._core_bpe

    def _piece(self, word: str) -> bytes:
        return array(self.code, self.core.encode_single_piece(word.encode())).tobytes()

    def _word(self, word: str) -> bytes:
        """The library's own BPE model on a single word, whose bytes it wants as printable characters."""
        found = self.library.model.tokenize(word.encode().decode("latin-1").translate(self.symbols))
        return array(self.code, [t.id for t in found]).tobytes()

    def plain(self, text: str) -> bool:
        return not UNUSUAL.search(text) and not (self.special and "<|" in text and self.special.search(text))

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def serial(self, text: str) -> bytes:
        """The ids of a text, of `dtype`."""
        if self.plain(text):
            return self.table.joined(self.find(text.lower() if self.lower else text))
        return np.array(self.whole(text), self.dtype).tobytes()

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.serial(text), self.dtype)

    def count(self, text: str) -> int:
        return len(self.serial(text)) // self.dtype.itemsize


_published: dict[str, Published] = {}


def published(path: str) -> Published:
    """One for each file and Python worker."""
    if path not in _published:
        _published[path] = Published(path)
    return _published[path]


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The column's texts; null is empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `most` in sum, or one row."""
    i = 0
    while i < len(sizes):
        j, total = i + 1, int(sizes[i])
        while j < len(sizes) and total + sizes[j] <= most:
            total += int(sizes[j])
            j += 1
        yield i, j
        i = j


