import functools
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from scorewright.llm import exact

SCHEMA = "doc_id long, text string, entry string, hash long"


@functools.cache
def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row."""
    of = {}
    for i, t, *_ in rows:
        of.setdefault(lowered(t), []).append(i)
    return sorted(((i, max((x for x in of[lowered(t)] if x is not None), default=None), len(of[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t, *_ in rows), key=repr)


def table():
    rng = random.Random(7)
    words = ["Über", "über", "ÜBER", "a", "A", "", None, "x" * 70_000, "X" * 70_000, "K", "K"]
    rows = [(i, rng.choice(words), "e", i) for i in range(300)]
    rows += [(299, "a", "again", 1), (299, "a", "again", 2), (None, "A", "no id", 3), (None, "only", "no id", 4), (None, "ONLY", "no id", 5)]
    return rows


@pytest.mark.parametrize("capacity", [exact.CAPACITY, 1])
def test_groups(spark, capacity):
    rows = table()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = exact.groups(docs, capacity).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == brute(rows)
    kept = [r for r in found if r.kept]
    assert len({r.text_sha256 for r in kept}) == len(kept) == len({lowered(r[1]) for r in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_rows_that_stay_keep_their_columns(spark):
    rows = table()
    kept = exact.keep_last(spark.createDataFrame(rows, SCHEMA)).collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "entry", "hash"}
    assert all(tuple(r) in rows for r in kept)
    assert sorted(lowered(r.text) for r in kept) == sorted({lowered(r[1]) for r in rows})
    assert {lowered(r.text): r.doc_id for r in kept} == {lowered(t): max((i for i, u, *_ in rows if lowered(u) == lowered(t) and i is not None), default=None) for _, t, *_ in rows}


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact.groups(docs).collect() == [] and exact.keep_last(docs).collect() == []


def test_directory_doubles_where_a_bucket_is_full():
    sizes = np.array([9, 1, 0, 0, 1, 1, 1, 1], float)
    slots, depths = exact.directory(sizes, 3)
    assert len(slots) == 8  # only the range of 9 needs three bits, and the directory has as many
    assert [int(depths[b]) for b in slots] == [3, 3, 2, 2, 2, 2, 2, 2]
    ranges = [[i for i, b in enumerate(slots) if b == x] for x in dict.fromkeys(slots)]
    assert ranges == [[0], [1], [2, 3], [4, 5], [6, 7]]
    assert len(exact.directory(sizes, 100)[0]) == 1
    own = exact.owners(slots, sizes, 2)
    assert list(own) == sorted(own) and set(own) == {0, 1}


def test_different_texts_with_one_hash_are_chained():
    press = zstandard.ZstdCompressor(level=1).compress
    texts = [b"one", b"two", b"one", b"three", b"two"]
    columns = {"bucket": [0] * 5, "hash": [7] * 5, "entry": range(5), "n": [1, 2, 3, 4, 5], "best": [10, None, 30, 40, 50], "frame": [press(t) for t in texts]}
    columns["frame"][2] = zstandard.ZstdCompressor(level=9, write_checksum=True).compress(b"one")
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})
    found = {r["entry"]: (r["chain"], r["keep_id"], r["group_size"], r["holds"]) for b in exact._chained(iter([batch.slice(0, 3), batch.slice(3)])) for r in b.to_pylist()}
    assert found == {0: (0, 30, 4, False), 2: (0, 30, 4, True), 1: (1, 50, 7, False), 4: (1, 50, 7, True), 3: (2, 40, 4, True)}


def test_a_hot_text_costs_its_owner_an_entry_a_task(spark):
    docs = spark.range(20_000, numPartitions=4).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the same', concat('text ', id)) AS text")
    from scorewright.llm.shared import prepare, workspace

    prepare(spark)
    entries, book, index = exact.build_index(docs, workspace(spark), capacity=1000)
    assert index.where("group_size = 6667").count() <= 4
    assert book.select("bucket").distinct().count() > 100 and entries.count() == index.count()
