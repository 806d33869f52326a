import hashlib
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scorewright.llm import bpe, packing, shared, tokencount, tokenfile

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "  ", "aaaaaaa aaaaaaaaaaaaaaaa", "<|endoftext|>", "x<|endoftext|>y <|startoftext|><|endoftext|>", "İstanbul ΣΑΣ ǅ ﬁ", "don't 'S 'LL I'Ll 12.5 ²³ ٣",
    "日本語　です", "áé Å Å", "\U0001f642\U0001f642 ok‍", "\x00\x01\x1c\x1f a\x85b\xa0c", "“quoted” – dash… œuvre €", "!!!'s ''s !'re", "A" * 3000,
    "é" * 300 + "1234567", " thin   x", "<|end", "a\n\n\nb   c \n ", "   lead", "word " * 3000, "ǰ ŉ ẞ ﻿bom",
]


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def ids_of(library, path, text):
    return library[path].encode(text or "", add_special_tokens=False).ids


def shapes():
    """Code points by themselves, inside a word, before and after digits, marks, spaces and contractions: all of them but
    for the large blocks of ideographs, syllables, private and unassigned ones, of which every 97th."""
    large = [(0x3400, 0xA000), (0xAC00, 0xD7A4), (0xD800, 0xF900), (0x10000, 0x1D000), (0x20000, 0x110000)]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c % 97 == 0 or not any(a <= c < b for a, b in large))]
    for i in range(0, len(points), 64):
        some = points[i : i + 64]
        yield " ".join(f"{c} a{c}B 1{c}2 !{c}? \u0130{c}x {c}'s\n{c}  {c}" for c in some)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_give_the_librarys_ids(library, path):
    tok = shared.Published(path)
    tok.table.limit, tok.table.core = 20, 5  # forgets again and again
    for some in (ODD, ODD[:7], ODD[::-1]):
        assert [tok.ids(t).tolist() for t in some] == [ids_of(library, path, t) for t in some]
        assert [tok.count(t) for t in some] == [len(ids_of(library, path, t)) for t in some]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_every_code_point_that_counts_as_plain(library, path):
    tok = shared.Published(path)
    for c in shared._PLAIN:
        for t in (c, f"a{c}B 1{c}2 !{c}? {c}'s", f"{c}ARI {c}{c} \n{c}  {c}"):
            assert tok.plain(t)
            assert tok.ids(t).tolist() == ids_of(library, path, t), hex(ord(c))


def test_merge_rounds_on_every_code_point(library):
    texts = list(shapes())
    for i in range(0, len(texts), 512):
        some = texts[i : i + 512]
        at, ids = bpe.encode_texts(WORD, some)
        want = [e.ids for e in library[WORD].encode_batch(some, add_special_tokens=False)]
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(some))] == want


def test_every_word_of_the_vocabulary_as_a_piece(library):
    """The BPE over bytes takes a piece that is a token at once; the merges lead to it, too."""
    tok = shared.Published(BYTE)
    assert tok.core is not None
    symbols = {c: i for i, c in enumerate(shared.byte_symbols())}
    for t in library[BYTE].get_vocab(with_added_tokens=False):
        if t != "<|endoftext|>":
            assert tok.core.encode_single_piece(bytes(symbols[c] for c in t)) == [x.id for x in library[BYTE].model.tokenize(t)]


def test_merge_rounds_give_the_librarys_ids(library):
    at, ids = bpe.encode_texts(WORD, ODD)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(ODD))] == [ids_of(library, WORD, t) for t in ODD]
    table = bpe.MergeTable(WORD)
    assert table.in_order
    table.in_order = False  # one occurrence a round gives the same
    words = ["banana", "aaaaaaaaa", "mississippi", "x"]
    assert [x.tolist() for x in table.encode_words(words)] == [x.tolist() for x in bpe.MergeTable(WORD).encode_words(words)]


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("text", ["plain words with, punctuation. " * 200, "日本語のテキスト、" * 300 + "漢" * 2000, "don't'x'll9's,'ll " * 200, "\u0130! a\u0301,b e\u0301=\u0338c " * 150, " \n\n  x\t\ty  " * 200, "<|endoftext|>" * 60 + "a " * 900 + "<|endoftext|>", "a" * 4000 + " tail " * 300, "日本語 テキスト " * 200, "a b<|endoftext|>" * 200, "1 2 3 " * 400, ". , ! " * 400, "x" * 5000, "Café Ó " * 300])
@pytest.mark.parametrize("chunk, overlap", [(500, 80), (97, 5)])
def test_chunks_splice_to_the_whole(library, path, text, chunk, overlap):
    ids, starts = tokencount.chunked(shared.published(path), text, chunk, overlap)
    whole = library[path].encode(text, add_special_tokens=False)
    assert ids.tolist() == whole.ids and starts.tolist() == [a for a, _ in whole.offsets]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_chunks_of_random_texts(library, path):
    rng = np.random.default_rng(5)
    bits = ["a", "Bc", "'s", "'", "!", "..", " ", "\n ", "12", "\u0130", "\u0301", "\u0338", "=", "漢字", "。", "\u3000", "é", "\u2019", "<|endoftext|>", "\ud55c", "\u11a8", "\u0181", "\u212b", "_", "-"]
    for _ in range(60):
        text = "".join(rng.choice(bits, 700))
        ids, starts = tokencount.chunked(shared.published(path), text, 120, 8)
        whole = library[path].encode(text, add_special_tokens=False)
        assert ids.tolist() == whole.ids and starts.tolist() == [a for a, _ in whole.offsets]


def test_time_of_a_text_without_boundaries(library):
    text = "".join(map(chr, np.random.default_rng(3).integers(0x4E00, 0x9FA5, 400_000)))
    began = time.process_time()
    ids, _ = tokencount.chunked(shared.published(WORD), text)
    assert time.process_time() - began < 4  # doubling a text doubles the time
    assert len(ids) == len(ids_of(library, WORD, text))


def table(spark):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(100, None, 1), (100, "again", 1), (None, "no id", 2)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids long").repartition(3)


def test_counts(spark, library):
    rows, docs = table(spark)
    got = sorted(map(tuple, tokencount.token_counts(docs, WORD, limit=5, huge=1000).collect()), key=repr)
    assert got == sorted(((i, len((t or "").encode()), n := len(ids_of(library, WORD, t)), n > 5) for i, t, _ in rows), key=repr)
    assert tokencount.token_counts(docs.limit(0), WORD).count() == 0


def test_encode_and_decode(spark, library):
    rows, docs = table(spark)
    got = {(r.doc_id, tuple(r.ids), r.text) for r in bpe.bpe_decode(bpe.bpe_encode(docs, WORD), WORD).collect()}
    assert got == {(i, tuple(x := ids_of(library, WORD, t)), library[WORD].decode(x, skip_special_tokens=False)) for i, t, _ in rows}
    assert bpe.bpe_decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), WORD).orderBy("doc_id").toPandas().text.tolist() == [None, ""]


def test_token_files(spark, library):
    rows, docs = table(spark)
    ws = shared.workspace(spark)
    folder = f"{ws}/tokens"
    manifest = tokenfile.write_token_files(docs, folder, ws, BYTE, file_bytes=200).collect()
    read = tokenfile.read_token_files(spark, folder).collect()
    base = {m.file: m.base for m in manifest}
    assert len(read) == len(rows) and len(manifest) > 1
    at = 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for r, (i, t, _) in zip(sorted(read, key=lambda r: base[r.file] + r.start), order):
        ids = [*ids_of(library, BYTE, t), 0]
        assert (r.doc_id, base[r.file] + r.start, r.n_tokens, bytes(r.ids)) == (i, at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    some = next(r for r in read if r.doc_id == 2)
    assert [x.tolist() for x in tokenfile.read_document(folder, some.file, 2)] == [[*ids_of(library, BYTE, ODD[2]), 0]]
    with pytest.raises(ValueError):
        data = tokenfile.Writer(b"", 0, 3)
        data.add(1, np.array([5, 6, 0], "<u2").tobytes())
        raw = data.bytes()
        tokenfile.TokenFile(lambda a, n: raw[a : a + n], len(raw), b"other")
    assert tokenfile.round_trip(docs.limit(0), BYTE)[0].count() == 0


def test_packing(spark, library):
    rows, docs = table(spark)
    got = packing.pack_documents(docs, BYTE, size=64).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for some in by.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at and len(r.ids) == 4 * r.length
            at += r.length
        assert at <= 64
    whole = {}
    for r in sorted(got, key=lambda r: r.piece):
        whole.setdefault(r.doc_id, []).append(r)
    for i, t, _ in rows:
        if i != 100 and i is not None:
            assert b"".join(bytes(r.ids) for r in whole[i]) == np.array([*ids_of(library, BYTE, t), 0], "<u4").tobytes()
            assert all(r.length == 64 for r in whole[i][1:]) and [r.start for r in whole[i]] == [sum(x.length for x in whole[i][:k]) for k in range(len(whole[i]))]
    assert len(by) >= -(-sum(r.length for r in got) // 64)
    assert packing.pack_documents(docs.limit(0), BYTE).count() == 0


def test_frequent_lengths_are_ranked_in_parts(spark):
    rows = spark.createDataFrame([(None if i < 30 else i % 7, "x", 30 + i % 3, i) for i in range(100)], "doc_id long, rank string, length long, sequence long").repartition(7)
    ws = shared.workspace(spark)
    got = packing.pack(rows, ws, 64).collect()
    assert len(got) == 100 and len({(r.sequence_id, r.offset) for r in got}) == 100 and len({r.sequence for r in got}) == 100
    assert len({r.sequence_id for r in got}) == 50
    assert packing.pack(rows.limit(0), ws, 64).count() == 0


def fewest(lengths, size):
    """The fewest sequences, by search over all ways to fill them."""
    best = [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in {room: i for i, room in enumerate(bins)}.values():
            if bins[i] >= lengths[k]:
                place(k + 1, [*bins[:i], bins[i] - lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, size - lengths[k]])

    place(0, [])
    return best[0]


def test_plan_against_the_fewest_sequences():
    rng = np.random.default_rng(12)
    more = 0
    for _ in range(60):
        size = int(rng.integers(8, 40))
        lengths = sorted((int(n) for n in rng.integers(1, size + 1, 9)), reverse=True)
        counts = {n: lengths.count(n) for n in lengths}
        plan = packing.plan(counts, size)
        held = {}
        for copies, some in plan:
            assert sum(some) <= size
            for n in some:
                held[n] = held.get(n, 0) + copies
        assert held == counts
        more += sum(c for c, _ in plan) - (best := fewest(lengths, size))
        assert sum(c for c, _ in plan) <= best + 1
    assert more <= 3


def test_query_packs_into_the_fewest(spark):
    from scorewright.llm import queries

    rows = queries.op7_best_fit_packing(spark, "/root/testdata/sf0.01").select("sequence_id", "length", "offset").collect()
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) == -(-total // 2048)  # no packing has fewer


def test_fullest_against_enumeration():
    rng = np.random.default_rng(6)
    for _ in range(60):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 30, 5), rng.integers(1, 4, 5))}
        room = int(rng.integers(0, 60))
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = packing.fullest(room, counts)
        assert sum(n * k for n, k in got) == max(s for s in sums if s <= room) and all(k <= counts[n] for n, k in got)
    assert sum(c * len(x) for c, x in packing.plan({5: 4, 3: 7, 8: 1}, 8)) == 12


def test_digests_of_the_queries(spark, library):
    from scorewright.llm import queries

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op3_bpe_round_trip(spark, folder).collect():
        ids = ids_of(library, WORD, docs[r.doc_id])
        text = library[WORD].decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    at = 0
    for r in queries.op5_token_files(spark, folder).orderBy("doc_id").collect():
        ids = [*ids_of(library, BYTE, docs[r.doc_id]), 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
