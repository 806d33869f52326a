"""Cases of the findings of round 4."""

from datetime import datetime, timedelta

import numpy as np
from compare import connect, difference

from scorewright.functions import similarity
from scorewright.operators import retrieval
from scorewright.plans import catalogue, fitted


def shuffled(spark, run):
    """Rows that `run` writes to shuffles."""
    sc = spark.sparkContext

    def total():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_no_vector_is_shuffled_for_each_block(spark):
    x = np.round(np.random.default_rng(14).normal(size=(1200, 6)), 3)  # without clusters: none can be left out
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found = []
    count = shuffled(spark, lambda: found.extend(retrieval.knn(rows, rows, "id", "v", 3, 20, 8).collect()))
    scores = np.round(x @ x.T, 9)
    np.fill_diagonal(scores, -np.inf)
    best = [sorted(range(len(x)), key=lambda j: (-row[j], j))[:3] for row in scores]
    assert sorted((r.query_id, r["rank"], r.neighbour_id) for r in found) == [(i, k + 1, j) for i, b in enumerate(best) for k, j in enumerate(b)]
    # vectors four times, k rows a query of each of 8 parts twice, sums; blocks of 20 would have taken 60 times as many rows
    assert count < len(x) * (4 + 2 * 3 * retrieval.PARTS + 12)


def test_tables_meet_those_of_the_customers_next_order(spark, tmp_path):
    # customers take turns, so that the next key is another's order; 6 precedes 4, 4 and 8 share a day, 3 has no lines, 9 no customer
    orders = [(1, 7, 1), (2, 5, 1), (3, 5, 2), (4, 7, 5), (5, 5, 3), (6, 7, 2), (8, 7, 5), (9, None, 1), (10, None, 2)]
    lines = {1: ["A1", "B2"], 2: ["A1"], 4: ["A1", "A1"], 5: ["N3"], 6: ["A1", "N2"], 8: ["A1", "A1", "R1"], 9: ["A1"], 10: ["A1"]}
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate int").write.parquet(f"{tmp_path}/orders.parquet")
    rows = [(k, n, x[0] if x != "R1" else None, float(x[1])) for k, own in lines.items() for n, x in enumerate(own)]
    spark.createDataFrame(rows[::-1], "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    html = {k: "<table>" + "".join(f"<tr><td>{f or ''}</td><td>{q}</td></tr>" for i, _, f, q in rows if i == k) + "</table>" for k in lines}
    want = {2: (0.0, 0.0)}
    for k, after in ((1, 6), (6, 4), (4, 8)):
        a, b = map(similarity.table_tree, (html[k], html[after]))
        want[k] = tuple(round(1 - similarity.tree_distance(a, b, only) / max(a[2], b[2]), 6) for only in (False, True))
    got = {r.l_orderkey: (r.teds, r.teds_structure) for r in fitted.table_similarity(spark, str(tmp_path)).collect()}
    assert got == want


def test_intervals_without_dates_as_their_sql(spark, tmp_path):
    days = {1: [None, 0, 40, None, 41, 90], 2: [None], 3: [None, None, None], 4: [7, 7, None], None: [3, None, 80]}
    rows = [(k, None if n is None else datetime(1995, 1, 1) + timedelta(n)) for k, own in days.items() for n in own]
    spark.createDataFrame(rows, "o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    c = connect(str(tmp_path))
    c.execute("SET threads = 1")  # the SQL's two windows may order equal rows in two ways where there are more
    for name in ("merged_intervals", "interval_iou"):
        query = getattr(catalogue, name)
        assert difference(spark, c, query, catalogue.SQL[name], str(tmp_path)) == ""
    plan = catalogue.merged_intervals(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Sort [") == 1
