"""Byte-pair encoding and decoding from a tokenizers file, by batched merge rounds in arrays.

The distinct words of a batch form one flat array of symbols. A round looks every neighbouring pair up by binary
search over the sorted keys of the merge table, takes each word's lowest rank and merges its occurrences in all words
at once; words without a pair left drop out. The merges are this module's own; the tokenizers library only normalises
and splits texts with code points outside the plain ones, whose classes differ between Unicode versions.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.shared import UNUSUAL, WORD_LEVEL, byte_symbols, pattern, prepare, spans

class MergeTable:
    """Merge rules as sorted pair keys with their rank and the id they make."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        if not spec["normalizer"] or spec["decoder"] is not None or spec["pre_tokenizer"]["type"] != "Sequence":
            raise ValueError(f"{path} is not a tokenizer of lower-case words")
        vocab: dict[str, int] = model["vocab"]
        self.width = max(vocab.values()) + 1
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = added
        self.tokens = np.full(max([self.width - 1, *added.values()]) + 1, "", object)
        for t, i in [*vocab.items(), *added.items()]:
            self.tokens[i] = t
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        left, right, made = np.array(pairs, np.int64).T
        key, order = np.unique(left * self.width + right, return_index=True)
        self.key, self.rank, self.made = key, order.astype(np.int64), made[order]
        # merging all occurrences in one round equals merging them one by one only if a merge never makes a pair of
        # lower rank than its own; tables of which that isn't true are merged one occurrence a round
        born = np.full(self.width, -1, np.int64)
        np.maximum.at(born, made, np.arange(len(made)))
        self.in_order = bool((np.maximum(born[left], born[right]) < np.arange(len(made))).all())
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        self.find = pattern(WORD_LEVEL).findall
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str

    def words(self, text: str) -> list[str | int]:
        """The words of a text, normalised, and the ids of added tokens."""
        if not (self.special and "<|" in text):
            return self._words(text)
        parts = self.special.split(text)  # added tokens at odd places
        return [x for k, p in enumerate(parts) for x in ([self.added[p]] if k % 2 else self._words(p))]

    def _words(self, text: str) -> list[str]:
        if not UNUSUAL.search(text):
            return self.find(text.lower())
        normal = self.normal(text)
        return [normal[a:b] for _, (a, b) in self.split(normal)]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word, by merge rounds over all of them."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list = [None] * len(raw)
        for i, j in spans(length, 1 << 20):
            self._merge(raw[i:j], length[i:j], out, i)
        return out

    def _merge(self, raw: list[bytes], length: np.ndarray, out: list, base: int) -> None:
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[data]
        last = np.cumsum(length) - 1
        sym[last] = self.final[data[last]]
        word = np.repeat(np.arange(len(raw)), length)
        none = len(self.key)
        while len(sym):
            key = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.key, key), none - 1)
            rank = np.where((self.key[at] == key) & (word[:-1] == word[1:]), self.rank[at], none)
            rank = np.append(rank, none)
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, head)
            size = np.diff(np.concatenate([head, [len(sym)]]))
            over = best == none
            if over.any():
                for h, n in zip(head[over].tolist(), size[over].tolist()):
                    out[base + word[h]] = sym[h : h + n]
                stay = np.repeat(~over, size)
                sym, word, rank = sym[stay], word[stay], rank[stay]
                best, size = best[~over], size[~over]
                if not len(sym):
                    break
            hit = rank == np.repeat(best, size)
            # of overlapping occurrences (aaa) every second one counts, from the left
            run = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
            at_hit = np.flatnonzero(hit)
            start = run[np.searchsorted(run, at_hit, side="right") - 1]
            at_hit = at_hit[(at_hit - start) % 2 == 0]
            if not self.in_order:
                at_hit = at_hit[np.unique(word[at_hit], return_index=True)[1]]
            key = sym[at_hit] * self.width + sym[at_hit + 1]
            sym = sym.copy()
            sym[at_hit] = self.made[np.searchsorted(self.key, key)]
            stay = np.ones(len(sym), bool)
            stay[at_hit + 1] = False
            sym, word = sym[stay], word[stay]


class Learnt(dict):
    """The ids of words as bytes, learnt from `encode` a batch of words at a time; beyond `limit` words all but the
    first `core` go. Added tokens stand for themselves. It only saves time."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], limit: int = 200_000, core: int = 80_000):
        self.encode, self.limit, self.core = encode, limit, core

    def learn(self, words: set) -> None:
        if len(self) > self.limit:
            first = dict(itertools.islice(self.items(), self.core))
            self.clear()
            self.update(first)
        new = [w for w in words if w not in self]
        ids = [w for w in new if isinstance(w, int)]
        self.update((i, np.int32(i).tobytes()) for i in ids)
        if len(new) > len(ids):
            new = [w for w in new if isinstance(w, str)]
            self.update(zip(new, (x.astype("<i4").tobytes() for x in self.encode(new))))


_tables: dict[str, tuple[MergeTable, Learnt]] = {}


def _table(path: str) -> tuple[MergeTable, Learnt]:
    if path not in _tables:
        m = MergeTable(path)
        _tables[path] = m, Learnt(m.encode_words)
    return _tables[path]


def encode_texts(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of whole texts; strings of added tokens get their ids, as is the library's default."""
    merges, table = _table(path)
    split = [merges.words(t) for t in texts]
    table.learn(set().union(*split))
    parts = [b"".join(map(table.__getitem__, words)) for words in split]
    at = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)])
    return at, np.frombuffer(b"".join(parts), "<i4")


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text; a null text is empty and has no ids.

    Rows that repeat or lack a doc_id keep a row each; other columns are not looked at; an empty table gives none. A very
    long text is one row of a batch of its own: its words and ids are in memory once.
    """
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [x or "" for x in b.column(1).to_pylist()]
            at, ids = encode_texts(tokenizer, texts)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """encoded (doc_id, ids) with a column text: the tokens of ids joined by a space, as the file has no decoder.

    Null ids give a null text, empty ones an empty text.
    """
    prepare(encoded.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(_table(tokenizer)[0].tokens.tolist(), pa.string())
        for b in it:
            lists = b.column("ids")
            flat = lists.flatten()
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            at = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            text = pc.binary_join(pa.ListArray.from_arrays(at, tokens.take(flat)), " ")
            if lists.null_count:
                text = pc.if_else(lists.is_valid(), text, None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists.cast(schema[1].type), text], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
