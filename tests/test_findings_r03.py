"""Cases of the findings of round 3."""

import json
import random

import numpy as np
import pandas as pd
from compare import connect, difference

from pyspark.sql import functions as F

from scorewright.functions import answers, correctness, similarity
from scorewright.functions import text as T
from scorewright.operators import fits, irt, overlap, ranking, ratings, retrieval, steps
from scorewright.plans import catalogue


def test_choice_letter_beside_accents(spark, tmp_path):
    rows = [(1, 0, "liberté, dé y"), (2, 0, "é b"), (3, 0, "yé x"), (4, 0, None), (5, 0, "a_ 1b c"), (6, 0, "D")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert difference(spark, connect(str(tmp_path)), catalogue.choice_letter, catalogue.SQL["choice_letter"], str(tmp_path)) == ""


def test_nearest_sites_by_leaves():
    rng = np.random.default_rng(2)
    x = np.round(rng.uniform(0, 9, (3000, 2)), 1)  # many rows repeat, many are equally near to two sites
    sites = np.concatenate([np.round(rng.uniform(0, 9, (300, 2)), 1), x[:20], x[:20]])
    d = ((x[:, None, :] - sites) ** 2).sum(2)
    at, far = irt.Near(x, 16)(sites)
    assert np.allclose(far, d.min(1)) and np.allclose(d[np.arange(len(x)), at], d.min(1))
    same = np.flatnonzero((sites[:, None, :] == sites).all(2).argmax(1) < np.arange(len(sites)))
    assert not np.isin(at, same).any()


def test_spread_draws_as_a_weighted_choice():
    x = np.round(np.random.default_rng(3).uniform(0, 9, (900, 2)), 1)
    rng, want = np.random.default_rng(7), []
    want.append(x[rng.integers(len(x))])
    d = ((x - want[0]) ** 2).sum(1)
    while len(want) < 200:
        want.append(x[rng.choice(len(x), p=d / d.sum())])
        d = np.minimum(d, ((x - want[-1]) ** 2).sum(1))
    assert irt.spread(x, 200, np.random.default_rng(7), irt._leaves(x, 16), 32).tolist() == np.array(want).tolist()
    assert irt.spread(x[:3].repeat(9, 0), 20, np.random.default_rng(7), irt._leaves(x[:3].repeat(9, 0), 4)).shape == (20, 2)


def test_merged_intervals_of_equal_rows(spark):
    rows = [(1, float(s), s + 30.0) for s in (0, 40, 40, 40, 60, 60, 200, 200)] * 3
    got = ranking.merge_intervals(spark.createDataFrame(rows, "k long, s double, e double"), "k", "s", "e").orderBy("start")
    assert [tuple(r) for r in got.collect()] == [(1, 0.0, 30.0), (1, 40.0, 90.0), (1, 200.0, 230.0)]


def test_tables_of_equal_shapes_side_by_side(monkeypatch):
    rng = random.Random(4)
    cell = lambda: f"<td>{rng.choice(['', 'A', '12.0', '45.00', 'é'])}</td>"
    plain = lambda: "<table>" + "".join(f"<tr>{''.join(cell() for _ in range(rng.choice((0, 1, 2, 2))))}</tr>" for _ in range(rng.randint(0, 4))) + "</table>"
    odd = [None, "no", "<table><tr><td>a<b>b</b></td></tr></table>", "<table><tr><td>&lt;b&gt;</td><td colspan=2>q</td></tr></table>", "<p><table><tr><th>a</th></tr><tr><td>1</td></tr>"]
    texts = [[plain() if rng.random() < 0.8 else rng.choice(odd) for _ in range(300)] for _ in range(2)]
    scalar, real = [], similarity.tree_distance
    monkeypatch.setattr(similarity, "tree_distance", lambda *a: scalar.append(a) or real(*a))
    similarity._shape_distance.cache_clear()
    got = similarity._both_teds(*map(pd.Series, texts))
    shapes = {tuple(similarity._flat(t)[0] for t in pair) for pair in zip(*texts) if all(map(similarity._flat, pair))}
    assert len(scalar) == len(shapes) < 250  # structures once for two shapes, contents without it
    for k, pair in enumerate(zip(*texts)):
        a, b = map(similarity.table_tree, pair)
        for contents in (True, False):
            want = 0.0 if a is None or b is None else 1.0 - real(a, b, not contents) / max(a[2], b[2], 1)
            assert abs(got[int(not contents)][k] - want) < 1e-12


def test_first_option_as_every_pattern_tried(spark):
    rng = random.Random(6)
    bits = ["A", "B", "C", "D", "x", " ", "\n", ".", "。", "：", ":", "答案", "是", "应该", "选项", "为", "选", "故", "只有", "对", "错误", "说法", "正确", "的", "答", "所以", "所有", "因此", "显然", "answer: ", "ANSWER:", "The answer is ", "the answer is option: ", "the correct answer is ", "boxed{", "}", "1", "1. ", "(", "𝒳", "$", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(3000)] + [None, "", "A" * 40, "x" * 40 + " B。"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def plainly(text, options="ABCD"):
        bare = T.stripped(text)
        found = [F.coalesce(T.empty_null(F.regexp_extract(bare, p, 1)), F.regexp_extract(bare, p, 0)) for p in [f"(?sU){q.format(options)}" for q in (*answers.OPTION_PATTERNS, *answers.CUSHION_PATTERNS)]]
        return F.array(*found)

    got = rows.select("t", answers.first_option(F.col("t")).alias("got"), plainly(F.col("t")).alias("all")).collect()
    for r in got:
        hold = [next(o for o in "ABCD" if o in f) for f in r["all"] if f and any(o in f for o in "ABCD")]
        assert r["got"] == (hold[0] if hold else ""), r["t"]
    # a text without any option, or without a pattern's words, is not searched for them
    plan = rows.select(answers.first_option(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains") + plan.lower().count("contains(") > 40


def test_overlaps_are_counted_without_a_shuffle_of_tokens(spark):
    rows = spark.createDataFrame([(1, "a b a c", "a a b d"), (2, None, "x"), (3, "", ""), (4, "a b c d e", "z a b c d")], "k long, p string, r string")
    counts = overlap.common_counts(rows, ["k"], overlap.words(F.col("p")), overlap.words(F.col("r")))
    assert {r.k: (r.n_a, r.n_b, r.both) for r in counts.collect()} == {1: (4, 4, 3), 2: (0, 1, 0), 3: (0, 0, 0), 4: (5, 5, 4)}
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    bleu = overlap.corpus_bleu(rows, ["k"], "p", "r").first()
    assert [round(x, 6) for x in bleu.precisions] == [round(x, 6) for x in (7 / 9, 4 / 7, 2 / 5, 1 / 3)]
    assert tuple(overlap.corpus_bleu(rows.limit(0), ["k"], "p", "r").first()) == (0.0, 0.0, [0.0] * 4)


def test_online_elo_of_packed_battles(spark, monkeypatch):
    monkeypatch.setattr(ratings, "PACK", 7)
    rng = random.Random(8)
    names = ["a", "b", "c", None]
    rows = [(i, rng.choice(names), rng.choice(names), rng.choice(["model_a", "model_b", "tie", None])) for i in range(500)]
    mixed = spark.createDataFrame(rng.sample(rows, len(rows)), "n long, model_a string, model_b string, winner string")
    want = {}
    for _, a, b, w in rows:
        x, y = want.get(a, 1000.0), want.get(b, 1000.0)
        moved = 4.0 * ({"model_a": 1.0, "model_b": 0.0}.get(w, 0.5) - 1 / (1 + 10 ** ((y - x) / 400)))
        want[a], want[b] = x + moved, y - moved
    df = ratings.online_elo(mixed, "n")
    got = {r.model: r.rating for r in df.collect()}
    assert got.keys() == want.keys() and all(abs(got[m] - want[m]) < 1e-9 for m in want)
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    assert ratings.online_elo(mixed.limit(0), "n").count() == 0


def test_step_outcomes_without_given_lengths(spark, monkeypatch):
    monkeypatch.setattr(steps, "ROWS", 3)
    rows = [(1, 1, True), (1, 2, None), (1, None, True), (2, 1, True), (2, 1, False), (2, 2, True), (2, None, None), (3, 2, True), (4, None, True), (5, 1, None)]
    rows = spark.createDataFrame(rows, "p int, s int, hit boolean")
    found = steps.step_outcomes(rows, "p", None, "s", "hit")
    got = {r.p: (r.steps, r.held, r.failed, r.complete, r.whole) for r in found.collect()}
    assert got == {1: (2, True, False, False, True), 2: (2, True, True, True, None)}
    given = rows.join(rows.groupBy("p").agg(F.max("s").alias("n")), "p")
    assert {r.p: (r.n, r.held, r.failed, r.complete, r.whole) for r in steps.step_outcomes(given, "p", "n", "s", "hit").collect()} == got


def test_reachable_clusters_come_in_parts():
    n, many = 300, 200
    rng = np.random.default_rng(9)
    v = rng.normal(size=(n, 4))
    pdf = pd.DataFrame({"id": range(n), "v": list(v), "cluster": np.zeros(n, np.int32), "least": np.full(n, np.nan)})
    parts = list(retrieval._reachable(iter([pdf]), rng.normal(size=(many, 4)), np.ones(many)))
    assert sum(map(len, parts)) == n * (many - 1) and max(map(len, parts)) <= retrieval.BLOCK


def test_style_fit_sends_strengths_to_the_battles(spark, monkeypatch):
    sent, real = [], fits.F.broadcast
    monkeypatch.setattr(fits.F, "broadcast", lambda df: sent.append(df.columns) or real(df))
    rows = [("a", "b", "model_a", 0.5), ("b", "c", "model_b", -0.5), ("a", "c", "tie", 0.0)]
    fits.style_bradley_terry(spark.createDataFrame(rows, "model_a string, model_b string, winner string, f double"), ["f"], rounds=1)
    assert sent == [["model_a", "sa"], ["model_b", "sb"]]


def test_bm25_hands_on_the_best_of_each_unit_only(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    draw = lambda n: rng.choice(" \t\n").join(f"W{min(rng.randrange(1, 60), rng.randrange(1, 60))}" for _ in range(n))
    docs = [(rng.randrange(150), draw(rng.randrange(40))) for _ in range(200)] + [(7, "w1 w2"), (7, "w2 w1"), (7, "w1  w3\n")]  # ids repeat
    asked = [(i, draw(rng.randrange(1, 9))) for i in range(30)] + [(90, ""), (91, "w1 w2 W1"), (92, "nowhere")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, real = [], retrieval._scored
    monkeypatch.setattr(retrieval, "_scored", lambda *a: rows.append(real(*a).count()) or real(*a))
    check = lambda: difference(spark, connect(str(tmp_path)), catalogue.bm25_topk, catalogue.SQL["bm25_topk"], str(tmp_path))
    assert check() == "" and rows[0] <= 5 * 32
    for name, n in {"BLOCK": 7, "UNIT_CHARS": 300, "UNIT_WORDS": 9, "SCORE_ROWS": 4}.items():  # several units, slots of words, blocks of queries
        monkeypatch.setattr(retrieval, name, n)
    assert check() == "" and len(rows) == 2
    named = spark.createDataFrame([(None if d == 3 else f"d{d}", t) for d, t in docs], "d string, text string")
    got = retrieval.bm25(spark.createDataFrame(asked, "q long, text string"), named, "q", "d", "text", 3)
    assert dict(got.dtypes)["d"] == "string" and got.count() > 60
    assert retrieval.bm25(spark.createDataFrame(asked, "q long, text string"), named.limit(0), "q", "d", "text", 3).count() == 0
    assert retrieval.bm25(spark.createDataFrame([], "q long, text string"), named, "q", "d", "text", 3).count() == 0


def test_multidim_fit_takes_as_many_tasks_as_responses_ask_for(spark, monkeypatch):
    rng = np.random.default_rng(12)
    theta, w = rng.normal(size=60), rng.normal(size=8)
    rows = [(f"i{i}", m, float(rng.random() < 1 / (1 + np.exp(w[i] - theta[m])))) for m in range(60) for i in range(8)]
    rows = spark.createDataFrame(rows, "item string, model int, score double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        fitted = fits.fit_multidim(rows, 2, rounds=2)
        assert [x.rdd.getNumPartitions() for x in fitted] == [1, 1]
        monkeypatch.setattr(fits, "ROWS", 200)
        monkeypatch.setattr(fits, "SENT", 0)
        other = fits.fit_multidim(rows, 2, rounds=2)
        assert other[1].rdd.getNumPartitions() == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for key, a, b in zip(("item", "model"), fitted, other):
        got, want = ({r[0]: np.hstack(r[1:]) for r in x.orderBy(key).collect()} for x in (a, b))
        assert got.keys() == want.keys() and all(np.allclose(got[x], want[x], atol=1e-9) for x in want)


def _answer_type_plainly(record):
    """`correctness.by_answer_type` with every value written out wherever it is read, and every verdict field asked."""
    field, raw = correctness.field, correctness.raw
    places = F.filter(F.map_entries(record), lambda e: F.lower(e["key"]).isin(*correctness.VERDICT_FIELDS))
    flags = F.transform(places, lambda e: F.struct(F.array_position(F.array(*map(F.lit, correctness.VERDICT_FIELDS)), F.lower(e["key"])).alias("place"), correctness.verdict(e["value"]).alias("flag")))
    known = F.array_sort(F.filter(flags, lambda x: x["flag"].isNotNull()))
    told = F.coalesce(*[correctness.verdict(raw(record, n)) for n in correctness.VERDICT_FIELDS], F.try_element_at(known, F.lit(1))["flag"])
    response, answer = field(record, "res", "prediction"), field(record, "answer")
    letter = lambda x: F.when(F.regexp_like(T.stripped(x), F.lit("^\\p{L}$")), F.upper(T.stripped(x))).otherwise(T.choice_letter(x, "A-Z"))
    kind, form = F.lower(T.stripped(field(record, "question_type"))), F.lower(T.stripped(field(record, "answer_type")))
    whole = lambda x: F.when(F.abs(T.whole_number(x)) < float("inf"), T.whole_number(x))
    cut = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    right = F.when(kind == "multi_choice", letter(response) == letter(field(record, "answer_option")))
    right = right.when(form == "integer", cut(whole(response)) == cut(whole(answer))).when(form == "float", T.whole_number(response) == T.whole_number(answer))
    p, a = (T.empty_null(T.collapsed(F.lower(x))) for x in (response, answer))
    right = right.otherwise((p == a) | F.contains(p, a) | F.contains(a, p))
    return F.coalesce(told, right.cast("int"), F.lit(0))


def test_answers_by_type_read_each_value_once(spark):
    rng = random.Random(13)
    values = [None, "", " ", "24", "24.9", "-24.2", "-0.5", "0", "inf", "-Infinity", "NaN", "2e-2", "0.02", "two", "A", " b ", "it is (B) here", "é", "A  red CAR", "red car", 24, 24.0, True, False, [1], ["24"], {"a": 1}]
    keys = {"res": values, "prediction": values, "answer": values, "answer_option": ["A", "b", "", None], "question_type": ["multi_choice", " Multi_Choice ", "free", None], "answer_type": ["integer", "Float ", "text", "", None]}
    odd = {"hit": [1, 0, None, "yes", [False], 0.7], "IF_RIGHT": ["failed", True, None], "Hit": [0, "x"], "is_correct": [["No"], None, 2]}
    records = [json.dumps({k: rng.choice(v) for k, v in keys.items() if rng.random() < 0.8} | {k: rng.choice(v) for k, v in odd.items() if rng.random() < 0.12}) for _ in range(3000)]
    rows = spark.createDataFrame([(r,) for r in [*records, None, "", "[1]", "{", '{"res": 1, "res": 2}']], "r string")
    got = correctness.dataset_correctness(F.col("r"), "mathvista_mini")
    plain = F.when(F.ltrim("r").startswith("{"), T.bound(F.from_json("r", "map<string,variant>"), _answer_type_plainly))
    out = rows.select("r", got.alias("got"), plain.alias("want")).collect()
    assert [r.r for r in out if r.got != r.want] == [] and {r.got for r in out} == {None, 0, 1}
    reads = lambda c: rows.select(c)._jdf.queryExecution().analyzed().toString().count("regexp_replace(")
    assert reads(got) < reads(plain) / 2
    judged = rows.select(correctness.dataset_correctness(F.col("r"), "simplevqa"))._jdf.queryExecution().analyzed().toString()
    assert judged.count("regexp_replace(") < 40  # 56 where each word looked for reads the words anew
