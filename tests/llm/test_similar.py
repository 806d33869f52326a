import numpy as np

import corpus_pipeline
from scorewright.llm import simhash


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows, similarity=0.8):
    """The smallest id of each component of all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    return sorted({find(i) for i in sets})


def test_stage_against_all_pairs(spark):
    """Copies with edits that lie over 3 bits away go, others of less than 0.8 and strangers stay."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    rows, far = [], 0
    for g in range(12):
        text = list(rng.choice(words, 150))
        rows.append((100 * g, " ".join(text)))
        for k in range(1, 9):
            copy = text[:]
            for at in rng.choice(150, k, replace=False):
                copy[at] = f"edit{g}x{k}x{at}"
            rows.append((100 * g + k, " ".join(copy)))
            far += (simhash.simhash64(rows[-1][1], 5) ^ simhash.simhash64(rows[-1 - k][1], 5)).bit_count() > 3
            if k >= 4:
                text = copy
    rows += [(9001, "one two"), (9002, "One  TWO"), (9003, ""), (9004, " ")]
    want = kept(rows)
    assert far > 40 and 12 < len(want) < len(rows) - 30
    docs = spark.createDataFrame(rows + [(None, rows[0][1]), (0, rows[0][1])], "doc_id long, text string")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    got = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and got.count(None) == 1
    assert sorted(i for i in got if i is not None) == want


def test_stage_on_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 0


def test_rare_shingles_find_every_similar_pair(spark):
    """Of sets in components of their own, all pairs of 0.8 or more are among those proposed, and few others."""
    from pyspark.sql import functions as F

    from scorewright.llm import shared, similar

    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 62), 1 << 62, (6, 60))
    sets = []
    for k in range(240):
        own = base[k % 6].copy()
        edits = rng.choice(60, int(rng.integers(0, 16)), replace=False)
        own[edits] = rng.integers(-(1 << 62), 1 << 62, len(edits))
        sets.append(set(map(int, own[: int(rng.integers(50, 61))])))
    sets += [{1}, {1, 2}, {3}, set(range(9)), set(range(10))]
    rows = spark.createDataFrame([(i, len(x), i % 97, sorted(x)) for i, x in enumerate(sets)], "node long, n long, component long, shingles array<long>")
    shared.prepare(spark)
    found = {tuple(r) for r in similar.sharing_rare(rows, 0.8, shared.workspace(spark)).collect()}
    want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and i % 97 != j % 97 and len(x & y) >= 0.8 * len(x | y)}
    assert len(want) > 100 and want <= found and len(found) < 3 * len(want)
    assert similar.sharing_rare(rows.where(F.lit(False)), 0.8, shared.workspace(spark)).count() == 0
