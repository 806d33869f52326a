"""Common subsequences, table trees and alignments against plain recursions; verdicts by JSON type."""

import functools
import json
import random

import pytest
from pyspark.sql import functions as F

from scorewright.functions import answers, correctness, similarity


@functools.cache
def slow_lcs(a, b):
    if not a or not b:
        return 0
    return slow_lcs(a[:-1], b[:-1]) + 1 if a[-1] == b[-1] else max(slow_lcs(a[:-1], b), slow_lcs(a, b[:-1]))


def test_common_subsequences():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcé", k=rng.randrange(14))) for _ in range(2))
        assert similarity.lcs_length(a, b) == slow_lcs(a, b)
    assert similarity.lcs_length("x" * 300, "yx" * 200) == 200


def test_code_similarity(spark):
    rows = [("ab", "abcd", 0.67), ("# no\n`x`\nab", "ab", 1.0), ("\n\nx = 1\ny", "x = 2", 0.8), ("// none", "", 1.0), ("// none", "a", 0.0), ("abc", "", 0.0), (None, "a", 0.0)]
    got = spark.createDataFrame([r[:2] for r in rows], "p string, r string").select(answers.code_similarity(F.col("p"), F.col("r")).alias("v")).collect()
    assert [r.v for r in got] == pytest.approx([r[2] for r in rows])
    best = spark.range(1).select(answers.best_code_similarity(F.lit("ab"), F.array(F.lit("zz"), F.lit("abcd"), F.lit("b"))).alias("v"), answers.best_code_similarity(F.lit("ab"), F.expr("array()").cast("array<string>")).alias("none"))
    assert tuple(best.first()) == pytest.approx((0.67, 0.0))


def nested(tree):
    """Children as nested tuples, from postorder nodes."""
    nodes, left, _ = tree
    stack = []
    for i, node in enumerate(nodes):
        kids = []
        while stack and stack[-1][0] >= left[i]:
            kids.append(stack.pop()[1])
        stack.append((left[i], (node, tuple(reversed(kids)))))
    return stack[0][1]


def slow_tree(a, b):
    """Ordered forests by removing their last roots."""

    def share(x, y):
        if x[0] != "td":
            return 0.0
        grid = [list(range(len(y[3]) + 1))]
        for i, s in enumerate(x[3], 1):
            grid.append([i])
            for j, t in enumerate(y[3], 1):
                grid[i].append(min(grid[i - 1][j] + 1, grid[i][j - 1] + 1, grid[i - 1][j - 1] + (s != t)))
        return grid[-1][-1] / max(len(x[3]), len(y[3]), 1)

    def size(f):
        return sum(1 + size(k) for _, k in f)

    @functools.cache
    def go(f, g):
        if not f or not g:
            return size(f) + size(g)
        (x, xs), (y, ys) = f[-1], g[-1]
        same = 1.0 if x[:3] != y[:3] else share(x, y)
        return min(go(f[:-1] + xs, g) + 1, go(f, g[:-1] + ys) + 1, go(xs, ys) + go(f[:-1], g[:-1]) + same)

    return go((a,), (b,))


def random_table(rng):
    cell = lambda: f"<td{rng.choice(['', ' colspan=2', ' rowspan=3'])}>{rng.choice(['', 'a', 'ab', 'x<b>y</b>', '1 2'])}</td>"
    rows = "".join("<tr>" + "".join(cell() for _ in range(rng.randrange(3))) + "</tr>" for _ in range(rng.randrange(1, 4)))
    return f"<p>x</p><table>{rng.choice(['{}', '<tbody>{}</tbody>', '<thead><tr><td>h</td></tr></thead>{}']).format(rows)}</table> tail"


def test_tree_distance_against_forests():
    rng = random.Random(2)
    for _ in range(60):
        a, b = similarity.table_tree(random_table(rng)), similarity.table_tree(random_table(rng))
        assert similarity.tree_distance(a, b) == pytest.approx(slow_tree(nested(a), nested(b)))
        assert similarity.tree_distance(a, a) == 0


def test_teds(spark):
    one = "<table><tr><td>ab</td><td>c</td></tr></table>"
    rows = [(one, one, 1.0), (one, "<table><tr><td>ax</td><td>c</td></tr></table>", 1 - 0.5 / 3), (one, "<table><tr><td>ab<td>c</table>", 1.0), (one, "<table><tr><td>ab</td></tr></table>", 1 - 1 / 3), (one, "no table", 0.0), (None, one, 0.0), ("", "", 0.0), ("<table></table>", "<table></table>", 1.0)]
    df = spark.createDataFrame([r[:2] for r in rows], "p string, t string")
    assert [r.v for r in df.select(similarity.teds()("p", "t").alias("v")).collect()] == pytest.approx([r[2] for r in rows])
    assert df.select(similarity.teds(True)("p", "t").alias("v")).collect()[1].v == 1.0


def test_elements_within_cells_count():
    assert similarity.table_tree("<table><tr><td>a<b>b</b><br></td></tr></table>")[2] == 4  # tr, td, b, br
    assert similarity.table_tree("<table><tr><td>a<b>b</b></td></tr></table>")[0][0] == ("td", 1, 1, ("a", "<b>", "b", "</b>"))


def test_meteor(spark):
    rows = [("the cat sat", "the cat sat", 1 - 0.5 / 27), ("on the mat sat the cat", "the cat sat on the mat", None), ("A b", "c d", 0.0), (None, "a", 0.0), ("", "", 0.0)]
    got = [r.v for r in spark.createDataFrame([r[:2] for r in rows], "h string, r string").select(similarity.meteor("h", "r").alias("v")).collect()]
    assert got[0] == pytest.approx(rows[0][2]) and got[2:] == [0.0] * 3
    # the hypothesis' last "the" takes the reference's last one: 6 matches in 6 chunks
    assert similarity.aligned("on the mat sat the cat".split(), "the cat sat on the mat".split()) == (6, 6)
    assert got[1] == pytest.approx(similarity.meteor_of(6, 6, 6, 6))


CASES = [
    ("livecodebench", {"is_correct": "0.7", "hit": 1}, 1), ("livecodebench", {"is_correct": "nan"}, None), ("livecodebench", {"is_correct": "\ttrue\n"}, 1), ("livecodebench", {"is_correct": 0.7}, 1),
    ("livecodebench", {"is_correct": [[0], 1]}, 0), ("livecodebench", {"IS_Correct": False}, 0), ("livecodebench", {"is_correct": []}, None), ("livecodebench", {"is_correct": {"a": 1}}, None),
    ("mbpp_plus", {"any_correct": 1.0}, 1), ("scicode", 1, 1), ("scicode", 0, 0), ("scicode", "what", 0), ("scicode", {"voted_correctness": 0}, 0), ("scicode", {"x": 1}, None),
    ("mathvista_mini", {"question_type": "multi_choice", "res": "(b)", "answer_option": "B"}, 1), ("mathvista_mini", {"res": "x"}, 0),
    ("commonsense_qa", {"prediction": "it is E", "references": ["E"]}, 1), ("openbookqa", {"prediction": "it is E", "references": ["E"]}, 0), ("openbookqa_fact", {"predictions": ["b"], "reference": "B"}, 1),
    ("c3", {"predictions": None, "prediction": "A", "reference": "A"}, 0), ("longbenchv2_0shot", {"prediction": "A", "reference": None}, 0), ("longbenchv2_0shot", "A", 0), ("simpleqa", "A", 1), ("simpleqa", {"predictions": "no letter"}, 0),
    ("simplevqa", {"judge_res": 0.5}, 1), ("simplevqa", {"judge_res": 0}, 0), ("simplevqa", {"judge_res": {"model_response": ["错误"]}}, 0), ("simplevqa", {"judge_res": "hm", "judge_res.model_response": True}, 1),
    ("osworld_verified", {"score": 1}, None), ("osworld_verified", {"binary_is_correct": 1}, 1), ("tau2_bench_retail", {"correct": "no", "is_correct": 1}, 0),
]


@pytest.mark.parametrize("dataset", sorted({c[0] for c in CASES}))
def test_verdicts_by_dataset_and_type(spark, dataset):
    own = [(json.dumps(r, ensure_ascii=False), want) for d, r, want in CASES if d == dataset]
    got = spark.createDataFrame(own, "record string, want int").select("record", "want", correctness.dataset_correctness(F.col("record"), dataset).alias("got")).collect()
    assert [(r.record, r.got) for r in got] == own


def test_options(spark):
    choices = {"A": "red wine", "B": "beer"}
    rows = [("B it is, and here are many more words to follow", None), ("I think it is (B).", "B"), ("Failed to obtain answer via API. B", None), ("Cannot determine the answer", "Z"), ("Z", "Z"), ("a glass of Red Wine", "A"), ("A or B", None), (None, None), ("A red one is A", None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "a string")
    got = df.select(answers.option_of(F.col("a"), F.create_map(*[F.lit(x) for kv in choices.items() for x in kv])).alias("v")).collect()
    assert [r.v for r in got] == [r[1] for r in rows]


def test_a_class_after_a_dropped_one_stays(spark):
    classes = F.array(*map(F.lit, ("red", "wine", "red wine", "beer")))
    got = spark.range(1).select(answers.class_share(F.lit("red wine"), F.lit("red wine"), classes).alias("v"), answers.class_share(F.lit("beer"), F.lit("red wine"), classes).alias("w")).first()
    assert (got.v, got.w) == (0.5, 0.0)  # "red" goes, "wine" is passed over
