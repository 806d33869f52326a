import pytest
from pyspark.sql import functions as F

from scorewright.functions import instructions as I
from scorewright.functions.registry import Registry

CASES = [
    ("keywords:existence", {"words": ["Cat", "dog"]}, "a cat, a DOG", True), ("keywords:existence", {"words": ["c.t"]}, "cat", False), ("keywords:frequency", {"word": "ab", "n": 2}, "ab AB", True), ("keywords:frequency", {"word": "ab", "n": 2, "relation": "less than"}, "ab AB", False),
    ("keywords:forbidden_words", {"words": ["cat"]}, "category", True), ("keywords:forbidden_words", {"words": ["cat"]}, "a Cat.", False), ("keywords:letter_frequency", {"letter": "E", "n": 2}, "eE", True), ("length_constraints:number_words", {"n": 3}, "one two, trois", True),
    ("length_constraints:number_sentences", {"n": 2}, "One. Two!", True), ("length_constraints:number_paragraphs", {"n": 2}, "one *** two", True), ("length_constraints:number_paragraphs", {"n": 2}, "one *** *** two", False), ("length_constraints:number_paragraphs", {"n": 2}, "one *** two ***", True),
    ("length_constraints:nth_paragraph_first_word", {"paragraphs": 2, "nth": 2, "word": "second"}, "First one.\n\n'Second, two", True), ("length_constraints:nth_paragraph_first_word", {"paragraphs": 2, "nth": 3, "word": "x"}, "a\n\nb", False), ("detectable_content:number_placeholders", {"n": 2}, "[a] and [b]", True),
    ("detectable_content:postscript", {}, "text\nP. S. more", True), ("detectable_content:postscript", {"marker": "P.P.S"}, "text\nP.S. more", False), ("detectable_format:number_bullet_lists", {"n": 2}, "* a\n- b", True), ("detectable_format:number_bullet_lists", {"n": 1}, "** a\n", False),
    ("detectable_format:constrained_response", {}, "Well. My answer is no.", True), ("detectable_format:number_highlighted_sections", {"n": 1}, "some *text*", True), ("detectable_format:number_highlighted_sections", {"n": 1}, "a ** b", False), ("detectable_format:multiple_sections", {"splitter": "Section", "n": 2}, "Section 1 a Section 2 b", True),
    ("detectable_format:json_format", {}, '```json\n{"a": [1]}\n```', True), ("detectable_format:json_format", {}, "{a", False), ("detectable_format:title", {}, "<<My title>> x", True), ("detectable_format:title", {}, "<< >>", False), ("combination:two_responses", {}, "a****** b", True), ("combination:two_responses", {}, "a******a", False),
    ("combination:repeat_prompt", {"prompt": "Do it"}, " do IT now", True), ("startend:end_checker", {"phrase": "The end."}, '"... THE END." ', True), ("startend:start_checker", {"phrase": "Dear"}, "x\n dear all", True), ("startend:quotation", {}, ' "a" ', True), ("startend:quotation", {}, '"', False),
    ("change_case:english_capital", {}, "ALL CAPS 1", True), ("change_case:english_lowercase", {}, "all Low", False), ("change_case:capital_word_frequency", {"n": 2}, "NASA and ESA here", True), ("punctuation:no_comma", {}, "a, b", False), ("punctuation:no_comma", {}, "  ", False),
    ("keywords:key_sentences", {"wanted": ["It is so.", "No."], "n": 1}, "It is so. Yes.", True), ("paragraphs:rephrased", {"original": "a b c", "low": 1, "high": 2}, "b c d", True),
]


def test_strict(spark):
    rows = spark.createDataFrame([(i, t) for i, (_, _, t, _) in enumerate(CASES)], "i int, t string")
    out = rows.select("i", *[I.strict(F.col("t"), n, **a).alias(f"c{k}") for k, (n, a, _, _) in enumerate(CASES)]).orderBy("i").collect()
    assert {(n, t): out[k][f"c{k}"] for k, (n, _, t, _) in enumerate(CASES)} == {(n, t): w for n, _, t, w in CASES}
    assert {n for n, *_ in CASES} == set(I.CHECKS)


def test_loose(spark):
    row = spark.createDataFrame([("Sure, here:\nall fine\nBye, now",), (None,), ("*a, b*",)], "t string")
    assert [r.x for r in row.select(I.loose(F.col("t"), "punctuation:no_comma").alias("x")).collect()] == [True, False, False]


def test_names_are_unique():
    r = Registry("check")
    r.add("a")(len)
    with pytest.raises(ValueError):
        r.add("a")(len)
    with pytest.raises(KeyError):
        r["b"]
    with pytest.raises(ValueError):
        I.number_words(F.lit("a"), 1, "about")
