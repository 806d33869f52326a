"""Token counts of whole texts with a published tokenizer.

Huge texts are encoded as overlapping chunks with offsets, so that neither the library's memory nor its time for one
call grows with a document. Two neighbours are spliced at a boundary that both encodings share and that is proven
stable: a place where the classes of the two characters around it alone tell that no match of the tokenizer's pattern,
whatever lies further to the left or right, goes across. So all ids left of it come from the left chunk and all ids
right of it from the right one as they would from the whole text. Where the tokens around it don't agree, the overlap
is widened to the left; where a chunk has no such place at all, it grows by its own length, so that the time stays in
proportion to the text. Strings of added tokens cut a text before anything else, as they do in the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.shared import Published, prepare, published, texts_of

#: Characters of a text that counts as huge, of a chunk, and of the overlap tried first.
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 256

#: Characters whose class is certain, whatever the Unicode version, and that no normalisation joins to a neighbour:
#: letters, digits, white space and marks; an apostrophe may begin a contraction and counts as none of them.
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_DIGIT = "0-9"
_SPACE = "\\t-\\r \u3000"
_MARK = "!-&(-/:-@\\[-`{-~\u2010-\u2018\u201a-\u201e\u3001\u3002\u300c-\u300f\uff01\uff0c\uff1a\uff1b\uff1f"
#: Stable places of the two patterns. Where white space is dropped, it cuts on both sides; where it may go with the
#: next word, only the place before it does.
_AROUND = "(?<=[{L}])(?=[{D}{M}'])|(?<=[{D}])(?=[{L}{M}])|(?<=[{M}])(?=[{L}{D}])"
STABLE_WORDS = re.compile(("(?<=[{S}])|(?=[{S}])|" + _AROUND).format(L=_LETTER, D=_DIGIT, S=_SPACE, M=_MARK))
STABLE_BYTES = re.compile(("(?<=[{L}{D}{M}])(?=[{S}])|" + _AROUND).format(L=_LETTER, D=_DIGIT, S=_SPACE, M=_MARK))


def _agree(left, right, q: int, low: int, high: int, most: int = 4) -> bool:
    """Whether both encodings have a token boundary at q and the same tokens around it, as far as both reach."""
    (ls, le, li), (rs, re_, ri) = left, right
    a, b = int(np.searchsorted(ls, q)), int(np.searchsorted(rs, q))
    if (a and le[a - 1] > q) or (b and re_[b - 1] > q):
        return False
    back = min(most, a, b - int(np.searchsorted(rs, low + 64)))
    ahead = min(most, int(np.searchsorted(le, high - 64)) - a, len(ri) - b)
    back, ahead = max(back, 0), max(ahead, 0)
    return all(np.array_equal(x[a - back : a + ahead], y[b - back : b + ahead]) for x, y in ((ls, rs), (li, ri)))


def chunked(tok: Published, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """(ids, starts) of the whole text, from overlapping chunks; starts are character offsets."""
    parts, at = [], 0
    for m in tok.special.finditer(text) if tok.special else ():
        parts += [(at, m.start(), False), (m.start(), m.end(), True)]
        at = m.end()
    found = []
    for a, b, whole in [*parts, (at, len(text), False)]:
        if b > a:
            i, s = _encode(tok, text[a:b]) if whole else _spliced(tok, text[a:b], chunk, overlap)
            found.append((i, s + a))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def _encode(tok: Published, text: str) -> tuple[np.ndarray, np.ndarray]:
    e = tok.library.encode(text, add_special_tokens=False)
    return np.array(e.ids, np.int32), np.array([a for a, _ in e.offsets], np.int64)


def _spliced(tok: Published, text: str, chunk: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """A text without added tokens."""
    stable = STABLE_WORDS if tok.lower else STABLE_BYTES

    def encode(a: int, b: int):
        e = tok.library.encode(text[a:b], add_special_tokens=False)
        at = np.array(e.offsets, np.int64).reshape(-1, 2) + a
        return at[:, 0], at[:, 1], np.array(e.ids, np.int32)

    out_i, out_s = [], []
    begin, end, cut, now = 0, min(chunk, len(text)), 0, None
    while end < len(text):
        wide, q, then = overlap, None, None
        while q is None:
            start = max(end - wide, begin)
            places = [m.start() for m in stable.finditer(text, start + 1, end) if m.start() > cut]
            if places:
                now = now or encode(begin, end)
                then = encode(start, min(end + chunk, len(text)))
                middle = (start + end) / 2
                q = next((p for p in sorted(places, key=lambda p: abs(p - middle)) if _agree(now, then, p, start, end)), None)
            if start == begin:
                break
            wide *= 2
        if q is None:  # nowhere to cut: the chunk doubles
            end, now = min(2 * end - begin, len(text)), None
            continue
        keep = (now[0] >= cut) & (now[0] < q)
        out_s.append(now[0][keep])
        out_i.append(now[2][keep])
        begin, end, cut, now = start, min(end + chunk, len(text)), q, then
    now = now or encode(begin, end)
    keep = now[0] >= cut
    return np.concatenate([*out_i, now[2][keep]]), np.concatenate([*out_s, now[0][keep]])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs.

    tokenizer: path of a tokenizers file, readable on every executor. A null text is empty: no bytes, no tokens. Rows
    that repeat or have a null doc_id keep a row each; other columns are not looked at; an empty table gives none. Texts
    of more than `huge` characters are counted by chunks, with or without added tokens in them; one without any stable
    place, such as a single word, is one call.
    """
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = published(tokenizer)
        for b in it:
            texts = texts_of(b, "text")
            n = [tok.count(t) if len(t) <= huge else len(chunked(tok, t)[0]) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
