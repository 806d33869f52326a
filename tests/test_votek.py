import random

from scorewright.operators import retrieval
from scorewright.plans import catalogue


def brute(near, select):
    """The reference's loop; (items in order, number before any are drawn)."""
    votes = {}
    for q, i in near:
        votes.setdefault(i, set()).add(q)
    ranked = sorted(votes.items(), key=lambda x: (-len(x[1]), x[0]))
    out = []
    for j, (i, own) in enumerate(ranked):
        if len(out) < select and not any(len(own & ranked[p][1]) >= len(own) for p in range(j)):
            out.append(i)
    return out


def test_vote_k_against_brute_force(spark):
    rng = random.Random(5)
    near = [(q, i) for q in range(40) for i in rng.sample(range(25), 3)] + [(q, 30) for q in (1, 2)] + [(1, 31)]
    items = spark.createDataFrame([(i,) for i in range(45)], "id long")
    votes = spark.createDataFrame(near, "query_id long, neighbour_id long")
    for select in (5, 40):
        want = brute(near, select)
        got = [r["item"] for r in retrieval.vote_k(votes, items, "id", select).orderBy("rank").collect()]
        assert got[: len(want)] == want and len(got) == len(set(got)) == select
    assert len(want) < 40


def test_every_vector_votes(spark, tmp_path):
    rows = [(i, [float(i % 7 == k) + 0.01 * ((i * (k + 3)) % 11) for k in range(8)]) for i in range(1, 41)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    e = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    near = [(r.query_id, r.neighbour_id) for r in retrieval.knn(e, e, "vec_id", "embedding", 10).collect()]
    assert len({q for q, _ in near}) == 40
    want = brute(near, 20)
    got = [r["item"] for r in catalogue.votek(spark, str(tmp_path)).orderBy("rank").collect()]
    assert want and got[: len(want)] == want and len(got) == 20
