"""Extraction and comparison of answers, case by case."""

import pytest
from pyspark.sql import functions as F

from scorewright.functions import answers, correctness, times
from scorewright.functions import text as T

ONE = [
    (T.general_answer, "The  Cat_1 (a) sat, then", "Cat_1 sat"), (T.last_number, r"4.737 \times 10^{14}", 4.737), (T.last_number, "1.5e-3 or +.5", 0.5), (T.last_number, "1,000", 0.0), (T.last_number, "x 2.", 2.0),
    (T.without_reasoning, "Start<think>a\nb</think> End", "Start End"), (T.without_reasoning, "x</think> y</think>\tz\n", "z"), (T.without_reasoning, "<think>open", "<think>open"),
    (lambda c: T.without_reasoning(c, strip=False), "    return x", "    return x"), (lambda c: T.without_reasoning(c, "[a]", "(b"), "p[a]q(b r", "p r"),
    (T.whole_number, " -1e3 ", -1000.0), (T.whole_number, "1d", None), (T.whole_number, "-Infinity", float("-inf")), (T.last_capital, "aBcDe\n", "D"), (T.first_letters, "so BCD or A", "BCD"), (T.first_number, "a -3.5 b 4", -3.5),
    (lambda c: T.pattern_or_text(c, "is (\\w+)"), "it is  fine", "it is  fine"), (lambda c: T.pattern_or_text(c, "is (\\w+)"), "it is fine", "fine"), (lambda c: T.choice_letter(c, "AB", "C"), "(b)", "B"), (lambda c: T.choice_letter(c, "AB", "C"), "none", "C"),
    (answers.solution_answer, "a #### 1,234", "1234"), (answers.solution_answer, "none", None), (answers.prediction_answer, "is 3.50 Question: 7", "3.50"), (answers.prediction_answer, "x", "NULL"),
    (answers.any_number, "so 1.5 and 2e3", 2000.0), (answers.any_number, "a 12 b 1.5", 1.5), (answers.any_number, "none", None), (answers.free_text, " \\boxed{A  B}. ", "a b"), (answers.free_text, " .", None),
    (answers.hit_flag, "0.9", 0), (answers.hit_flag, "1.0", 1), (answers.hit_flag, "Yes", 1), (answers.hit_flag, "?", None), (answers.judge_flag, "不 正确", 0), (answers.judge_flag, "so it is correct", 1), (answers.judge_flag, "hm", None),
    (answers.latex_form, "\\dfrac12", "\\frac{1}{2}"), (answers.latex_form, "$x = .5$", "\\frac{1}{2}"), (answers.latex_form, "3/4", "\\frac{3}{4}"), (answers.latex_form, "\\left(1,\\ 2\\right)", "(1,2)"), (answers.latex_form, "\\sqrt3", "\\sqrt{3}"), (answers.latex_form, "10\\%", "10"), (answers.latex_form, None, None),
    (answers.first_option, "答案是 C", "C"), (answers.first_option, "The answer is (B), not the other", "B"), (answers.first_option, "nothing", ""), (lambda c: answers.first_option(c, cushion=False), "x-A-y", ""),
    (answers.letter_after_prefix, "The best answer is (E)", "E"), (lambda c: F.to_json(answers.boxes(c)), "[1, 2.5, 3, 4] 5", "[1.0,2.5,3.0,4.0]"), (lambda c: F.to_json(answers.boxes(c)), "1 2", None),
    (lambda c: times.weeks_and_days(c)["weeks"], "('12', '3')", 12), (lambda c: answers.code_similarity(c, F.lit("x = 1")), "# note\nx = 2\ny", 0.8), (lambda c: answers.count_share(c, F.lit("2")), "2 or 3", 0.5),
    (lambda c: times.length_bucket(c.cast("double")), "600", "(0, 10]"), (lambda c: times.length_bucket(c.cast("double")), "601", "(10, 20]"), (lambda c: times.length_bucket(c.cast("double")), "9999", "60+"),
]


def test_one_text_at_a_time(spark):
    rows = spark.createDataFrame([(t,) for _, t, _ in ONE], "t string").withColumn("k", F.monotonically_increasing_id())
    texts = spark.createDataFrame([(k, t) for k, (_, t, _) in enumerate(ONE)], "k int, t string")
    assert rows.count() == texts.count()
    for k, (column, _, want) in enumerate(ONE):
        got = texts.where(F.col("k") == k).select(column(F.col("t")).alias("x")).first().x
        assert got == (pytest.approx(want) if isinstance(want, float) else want), ONE[k]


@pytest.mark.parametrize("said, truth, want", [("12%", "0.12", 1), ("0.1259", "12%", 1), ("0.127", "12%", 0), ("nan", "1", 0), ("0", "0.0", 0), ("Yes", "yes", 1), ("inf", "1", 0), ("1_0", "10", 0)])
def test_relaxed(spark, said, truth, want):
    assert spark.createDataFrame([(said, truth)], "a string, b string").select(T.relaxed_match(F.col("a"), F.col("b")).alias("x")).first().x == want


def test_edit_scores_strip_all_white_space(spark):
    rows = spark.createDataFrame([("\nabc\t", "ABC"), ("a  b", "a b"), ("", "")], "a string, b string")
    assert [r.x for r in rows.select(T.anls(F.col("a"), F.col("b")).alias("x")).collect()] == [0.0, 0.0, 0.0]


def test_options_and_ends(spark):
    rows = spark.createDataFrame([("The answer is B.", 1), ("A", 2), ("a red wine", 3), ("red or green", 4), ("It seems that A long text here goes on and on", 5), (None, 6)], "t string, k int")
    choices = F.create_map(*[F.lit(x) for x in ("A", "red wine", "B", "green tea")])
    got = {r.k: r.x for r in rows.select("k", answers.option_of("t", choices).alias("x")).collect()}
    assert got == {1: "B", 2: "A", 3: "A", 4: None, 5: None, 6: None}
    ends = spark.createDataFrame([("x" * 400 + " is 42.", "42", True), ("42 " + "x" * 400, "42", False), ("no 421", "42", False), ("so a long answer here", "long answer", True), ("", "a", None), ("C++ it is", "C++", False)], "p string, a string, want boolean")
    assert [(r.x, r.want) for r in ends.select(answers.near_the_end(F.col("p"), F.col("a")).alias("x"), "want").collect()] == [(w, w) for w in (True, False, False, True, None, False)]


def test_rules(spark):
    one = lambda record, name: spark.createDataFrame([(record,)], "r string").select(correctness.dataset_correctness(F.col("r"), name).alias("x")).first().x
    assert one('{"HIT": "yes"}', "mmstar") == 1 and one('{"is_correct": [false, true]}', "theoremqa") == 0
    assert one('{"is_correct": 0.4}', "terminal_bench") is None and one('{"voted_correctness": 0, "binary_is_correct": 1}', "arenahard") == 0
    assert one('{"correct": true}', "tau2_bench_airline") == 1
    assert one('{"predictions": ["so 2.001"], "gold": "2"}', "scibench") == 1 and one('{"prediction": "Paris."  , "answer": "paris"}', "scibench") == 1
    assert one('{"judge_res": {"model_response": "未尝试"}}', "simplevqa") == 0 and one('{"judge_res.model_response": "正确"}', "simplevqa") == 1
    assert one('{"question_type": "multi_choice", "res": "x", "answer_option": "A"}', "mathvista_mini") == 0
    assert one('{"answer_type": "integer", "res": "-2.7", "answer": "-2"}', "mathvista_mini") == 1
    assert one('{"prediction": ["(b)"], "reference": "B"}', "openbookqa") == 1 and one('{"pred": "?"}', "simpleqa") == 0
    with pytest.raises(KeyError):
        one("{}", "no such set")


def test_dates(spark):
    got = spark.createDataFrame([("3/07/2024", "03/7/2024"), ("1/2/2024", "2/1/2024")], "a string, b string")
    assert [r.x for r in got.select(times.same_date(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False]
    with pytest.raises(Exception, match="not a date"):
        got.select(times.same_date(F.lit("13/40/2024"), F.col("b"))).collect()
