import pytest
from pyspark.sql import functions as F

from scorewright.operators import benchmarks as B
from scorewright.operators import sampling as S
from scorewright.sources import converters as C


def test_verdicts_and_fill(spark):
    games = spark.createDataFrame([("q1", "[[A>>B]]", False), ("q1", "[[A=B]]", True), ("q2", "no verdict", False), ("q3", "x [[B>A]] y", True)], "q string, t string, b boolean")
    scores = C.game_scores(games, "q", "t", "b")
    assert {r.q: r.score for r in scores.collect()} == {"q1": 0.75, "q2": 0.0, "q3": 0.75}
    universe = spark.createDataFrame([("q1",), ("q9",)], "q string")
    assert {r.q: (r.score, r.missing) for r in C.fill_missing(scores, universe, "q", worst=0.0).collect()} == {"q1": (0.75, False), "q9": (0.0, True)}
    assert {(r.fault, r.q) for r in C.unknown_items(scores, universe, "q").collect()} == {("unknown", "q2"), ("unknown", "q3")}


def test_ignored_in_one_model_is_dropped_from_all(spark):
    rows = spark.createDataFrame([("a", "m", True), ("a", "n", False), ("b", "m", None)], "item string, model string, ignored boolean")
    assert [r["item"] for r in C.drop_ignored(rows, "item", "ignored").collect()] == ["b"]


def test_groups_that_lack_rows_have_no_mean(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 0.0, 3.0), ("b", 1.0, 2.0)], "g string, s double, w double")
    got = {r.part: (r.score, r.complete) for r in B.grouped_macro(rows, "g", {"both": ["a", "b"], "more": ["a", "c"]}, "s", "w").collect()}
    assert got == {"both": (0.625, True), "more": (None, False)}


def test_steps_of_whole_problems(spark):
    rows = spark.createDataFrame([("p", True, 1.0), ("p", True, 1.0), ("q", True, 0.0), ("q", False, 1.0)], "p string, sel boolean, s double").withColumn("w", F.lit(1.0))
    got = B.step_accuracy(rows, "p", F.col("sel"), "s", "w").first()
    assert (round(got.step_accuracy, 6), got.problem_accuracy, got.n_problems) == (0.666667, 1.0, 1)


@pytest.mark.parametrize("answers, answer, want", [(["a"] * 4, "a", 1.0), (["a", "b", "c"], "a", (0 + 1 / 3 + 1 / 3) / 3), ([], "a", None)])
def test_consensus(spark, answers, answer, want):
    row = spark.createDataFrame([(answers,)], "x array<string>")
    assert row.select(B.consensus_score(F.col("x"), F.lit(answer)).alias("s")).first().s == (want if want is None else pytest.approx(want))


def test_draws_are_uniform_and_stable(spark):
    u = [r.u for r in spark.range(2000).select(S.uniform(3, "id").alias("u")).collect()]
    assert abs(sum(u) / len(u) - 0.5) < 0.02 and 0 < min(u) and max(u) < 1
    assert u == [r.u for r in spark.range(2000).repartition(7).orderBy("id").select(S.uniform(3, "id").alias("u")).collect()]
    rows = spark.range(300).withColumn("w", F.when(F.col("id") < 30, 0.0).otherwise(1.0))
    assert min(r.id for r in S.weighted_sample(rows, "id", "w", 50).collect()) >= 30
    got = S.bootstrap_mean(spark.range(200).withColumn("v", F.col("id").cast("double")), "id", "v", 80).first()
    assert got.low < got.mean < got.high and got.high - got.low < 40


def test_names(spark):
    rows = spark.createDataFrame([("m", "r1"), ("m", "r2"), ("n", "r1")], "name string, root string")
    assert {r.unique_name for r in S.unique_names(rows, "name", "root").collect()} == {"m", "m@@r2@@2", "n"}
