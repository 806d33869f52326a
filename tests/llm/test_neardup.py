import numpy as np
import pytest

from scorewright.llm import neardup


def brute(rows, threshold):
    def fine(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            (_, a, x), (_, b, y) = rows[i], rows[j]
            if i != j and x is not None and x == y and fine(a) and fine(b) and len(a) == len(b) and rows[i][0] is not None and rows[j][0] is not None:
                a, b = np.array(a, float), np.array(b, float)
                links[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold
    label = [r[0] for r in rows]
    for _ in range(n):
        for i, j in zip(*np.nonzero(links)):
            label[i] = label[j] = min(label[i], label[j])
    return sorted(((r[0], int(links[i].sum()), label[i], r[0] is None or label[i] == r[0]) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("chunk_rows, block_dims, threshold", [(4096, 16, 0.93), (5, 8, 0.93), (4096, 3, 0.8), (7, 64, 0.93)])
def test_against_brute_force(spark, chunk_rows, block_dims, threshold):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(4, 16))
    rows = [(100 - i, [float(np.float32(v)) for v in centre[i % 4] + rng.normal(size=16) * rng.choice([0.05, 0.25, 1.0])], int(rng.integers(0, 2))) for i in range(70)]
    rows += [(200 + i, rows[0][1], rows[0][2]) for i in range(5)] + [(200, rows[0][1], rows[0][2])]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] + [1.0] * 15, 0), (303, rows[0][1], None), (304, [], 0), (305, rows[0][1][:8], rows[0][2]), (306, [None] + [1.0] * 15, 0), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(i, v, x, 1) for i, v, x in rows], "vec_id long, embedding array<float>, label int, n int").repartition(3)
    got = sorted(map(tuple, neardup.near_duplicates(df, threshold, block_dims, chunk_rows).collect()), key=repr)
    assert got == brute(rows, threshold)


def test_scaled_and_extreme_vectors(spark):
    rows = [(1, [1e300, 1e300], "a"), (2, [1e-300, 1e-300], "a"), (3, [-1.0, -1.0], "a")]
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_range_join_prunes():
    """Of all pairs of a label few are compared under a block's budget, and every link is found."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    x, label = np.array(t["embedding"], np.float64), np.array(t["label"])
    pairs = 0
    job = neardup.Unit(0.93, 16)
    for k in np.unique(label):
        a = np.unique(x[label == k], axis=0)
        pairs += len(a) * (len(a) - 1) // 2
        got = {*()}
        for p, q in job.links(a, None):
            got |= {*zip(p.tolist(), q.tolist())}
        u = neardup.unit(a)
        want = np.argwhere(np.triu(np.einsum("ij,kj->ik", u, u) >= 0.93, 1))
        assert got == {*map(tuple, want.tolist())}
        half = len(a) // 2
        across = {(int(i), int(j) + half) for p, q in neardup.Unit(0.93, 16).links(a[:half], a[half:]) for i, j in zip(p, q)}
        assert across == {(i, j) for i, j in got if i < half <= j}
    assert job.compared < pairs / 10 and job.verified <= job.compared


def test_bitmaps_of_ranges():
    rng = np.random.default_rng(8)
    for n in (1, 63, 64, 700):
        part, asked = np.round(rng.normal(size=(n, 3)) * 8) / 8, np.round(rng.normal(size=(20, 3)) * 8) / 8
        r = neardup.Ranges(part)
        every = np.full((20, r.words), np.iinfo(np.uint64).max, np.uint64)
        inside = np.zeros((20, n), bool)
        inside[neardup.bit_pairs(r.within(asked, 0.5, every))] = True
        exact = (np.abs(asked[:, None] - part) <= 0.5).all(2)
        assert (inside >= exact).all() and (n > 256 or (inside == exact).all())
