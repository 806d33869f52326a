import math
import re
from collections import Counter

import numpy as np
import pytest

from scorewright.operators import retrieval


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "id long, v array<double>")


def nearest(queries, rows, k):
    out = []
    for i, q in queries:
        found = sorted((-round(float(np.dot(q, x)), 9), j) for j, x in rows if j != i)[:k]
        out += [(i, r + 1, j) for r, (_, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block, clusters", [(4096, 256), (32, 8), (16, 1), (7, 64)])
def test_knn_by_blocks_and_clusters(spark, block, clusters):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 5)) * 4
    rows = [(i, np.round(centre[i % 6] + rng.normal(size=5) * 0.3, 3)) for i in range(240)]
    rows += [(1000 + i, np.array([9.0, 0, 0, 0, 0])) for i in range(90)]  # a third of all rows is one vector
    queries = rows[::5] + [(-1, np.zeros(5))]
    got = retrieval.knn(vectors(spark, queries), vectors(spark, rows + [(5000, None)]), "id", "v", 4, block, clusters)
    assert values(got.select("query_id", "rank", "neighbour_id"), "query_id", "rank") == nearest(queries, rows, 4)


def test_knn_leaves_clusters_out(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = np.eye(8) * 10
    rows = [(i, centre[i % 8] + rng.normal(size=8) * 0.1) for i in range(400)]
    met = []
    real = retrieval._nearest
    monkeypatch.setattr(retrieval, "_nearest", lambda asked, *rest: met.append(asked.count()) or real(asked, *rest))
    got = retrieval.knn(vectors(spark, rows), vectors(spark, rows), "id", "v", 3, 10, 40)
    assert values(got.select("query_id", "rank", "neighbour_id"), "query_id", "rank") == nearest(rows, rows, 3)
    assert met[0] == 400 and met[1] < 400 * 39 / 4


def test_knn_of_empty_tables(spark):
    none = vectors(spark, [])
    some = vectors(spark, [(1, [1.0, 2.0])])
    assert retrieval.knn(none, some, "id", "v", 2).count() == 0
    assert retrieval.knn(some, none, "id", "v", 2).count() == 0
    assert retrieval.knn(some, some, "id", "v", 2).count() == 0  # itself left out


def best(queries, docs, k, k1=1.5, b=0.75):
    words = lambda t: [w for w in re.split("[ \t\n]+", (t or "").lower()) if w]
    tf = {d: Counter(words(t)) for d, t in docs}
    mean = sum(sum(c.values()) for c in tf.values()) / len(tf)
    df = Counter(w for c in tf.values() for w in c)
    out = []
    for q, t in queries:
        score = {}
        for w, n in Counter(words(t)).items():
            idf = math.log((len(tf) - df[w] + 0.5) / (df[w] + 0.5) + 1)
            for d, c in tf.items():
                if w in c:
                    score[d] = score.get(d, 0) + n * idf * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * sum(c.values()) / mean))
        out += [(q, r + 1, d) for r, (_, d) in enumerate(sorted((-round(s, 6), d) for d, s in score.items())[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    share = 1 / np.arange(1, 120) ** 1.1
    draw = lambda n: " ".join(f"w{x}" for x in rng.choice(119, n, p=share / share.sum()))
    docs = [(i, draw(int(rng.integers(1, 60)))) for i in range(300)] + [(900, None), (901, ""), (902, "W0 w0  w0\tw0")]
    queries = [(i, draw(int(rng.integers(1, 9)))) for i in range(40)] + [(90, None), (91, "w0 w1 w0"), (92, "nowhere")]
    return queries, docs


@pytest.mark.parametrize("rare, salt_docs", [(4096, 65536), (40, 50), (10, 10), (0, 1000)])
def test_bm25_against_brute_force(spark, corpus, rare, salt_docs):
    queries, docs = corpus
    tables = [spark.createDataFrame(x, "id long, text string") for x in corpus]
    got = retrieval.bm25(tables[0], tables[1].withColumnRenamed("id", "doc"), "id", "doc", "text", 5, rare=rare, salt_docs=salt_docs)
    assert values(got.select("id", "rank", "doc"), "id", "rank") == best(queries, docs, 5)


def test_bm25_scores_fewer_rows_than_share_a_word(spark, corpus, monkeypatch):
    queries, docs = corpus
    tables = [spark.createDataFrame(x, "id long, text string") for x in corpus]
    scored = []
    real = retrieval._scored

    def counted(*a):
        out = real(*a)
        scored.append(out.count())
        return out

    monkeypatch.setattr(retrieval, "_scored", counted)
    rows = {}
    for rare in (4096, 40):
        scored.clear()
        retrieval.bm25(tables[0], tables[1].withColumnRenamed("id", "doc"), "id", "doc", "text", 5, rare=rare).count()
        rows[rare] = sum(scored)
    share = sum(len({*t.lower().split()} & {*(u or "").lower().split()}) for _, t in queries if t for _, u in docs)
    assert rows[40] < share / 3 and rows[4096] < share
