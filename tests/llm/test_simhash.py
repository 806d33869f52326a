import re

import numpy as np
import pytest
import xxhash

from scorewright.llm import shared, simhash


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h)) if h else 0


def components(ids, fps, radius=3):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in zip(ids, fps):
        for j, b in zip(ids, fps):
            if (a ^ b).bit_count() <= radius and find(i) != find(j):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "One Two", "a b c", "Ä b c d", "ÀB ÀB ÀB ÀB", "x " * 500, "é\x1cz q r s"])
def test_fingerprint(text):
    assert simhash.simhash64(text) == brute(text)


def test_forest_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for n in rng.integers(0, 6, 200)], np.uint64)
    fp = np.unique(base[rng.integers(0, 40, 200)] ^ flips)
    shard = np.sort(rng.integers(0, 3, len(fp)))
    q, n = simhash.Forest(shard, fp).search(shard, fp, 3)
    near = (np.bitwise_count(fp[:, None] ^ fp) <= 3) & (shard[:, None] == shard)
    assert {*zip(q.tolist(), n.tolist())} == {*zip(*(x.tolist() for x in np.nonzero(near)))}


@pytest.mark.parametrize("n, radius", [(10, 3), (1 << 24, 3), (1 << 33, 3), (5, 1)])
def test_tables_lose_no_pair(n, radius):
    tables = simhash._tables(n, radius)
    rng = np.random.default_rng(2)
    for _ in range(200):
        off = sum(1 << int(k) for k in rng.choice(64, radius, replace=False))
        assert any(all(off >> s & ((1 << w) - 1) == 0 for s, w in t) for t in tables)


def union(ids, edges):
    low = {i: i for i in ids}
    for _ in ids:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_query_against_brute_force(spark):
    from scorewright.llm import queries

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    fps = {i: brute(t) for i, t in texts.items()}
    want = components(list(fps), list(fps.values()))
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op1_simhash_near_dedup(spark, folder).collect()}
    assert got == {(i, f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("tree_nodes", [4096, 3])
def test_links_against_brute_force(spark, tree_nodes):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 120)) for _ in range(12)]
    rows = [(i, texts[i]) for i in range(12)] + [(12 + i, texts[i % 4].replace(f" {texts[i % 4].split()[60 + i]} ", " zz ", 1)) for i in range(40)]
    rows += [(90, None), (91, ""), (92, " "), (93, texts[0]), (93, texts[0]), (None, texts[1])]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs, tree_nodes=tree_nodes).collect()
    assert len(got) == len(rows)
    fps = {i: brute(t) for i, t in rows if i is not None}
    want = components(list(fps), list(fps.values()))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == {(i, f"{fps[i]:016x}", want[i]) for i in fps}
    fps_df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for f, i in {f: i for i, f in sorted(fps.items(), reverse=True)}.items()], "fp long, rep long")
    cut_up = simhash.link_fingerprints(fps_df, shared.workspace(spark), 3, 1, finer=1).collect()  # shards cut up by finer keys
    by_fp = {f: i for i, f in sorted(fps.items(), reverse=True)}
    assert components(list(by_fp.values()), list(by_fp)) == {**{i: i for i in by_fp.values()}, **union(by_fp.values(), [(r.a, r.b) for r in cut_up])}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({*want.values()})


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, 200 + i) for i in range(50)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (140, 7)], "a long, b long")
    got = {r.node: r.component for r in shared.components(edges, shared.workspace(spark)).collect()}
    assert set(got) == {*range(100, 141), 7, *range(200, 250)} and set(got.values()) == {7}
