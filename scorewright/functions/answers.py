"""Answers out of texts, and whether they are right, as columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.functions import similarity
from scorewright.functions import text as X

#: What a grade-school solution puts before its answer, and the cut of a run-on prediction. Fixed values.
GOLD_MARK, NEXT_QUESTION = "#### ", "Question:"
#: Phrases that models put before an option letter; two of them stand for two phrases each. Fixed values.
ANSWER_PREFIXES = (
    "The best answer is",
    "The correct answer is",
    "The answer is",
    "The answer",
    "The best option isThe correct option is",
    "Best answer:Best option:",
)


def solution_answer(solution: Column) -> Column:
    """The gold answer of a worked solution, without thousands' commas; null if it has no mark."""
    parts = F.split(solution, GOLD_MARK)
    return F.when(F.size(parts) > 1, F.replace(F.element_at(parts, 2), F.lit(","), F.lit("")))


def prediction_answer(prediction: Column) -> Column:
    """The last number before the next question, as a text; NULL as a word if there is none."""
    head = F.element_at(F.split(prediction, NEXT_QUESTION), 1)
    found = F.regexp_extract_all(head, F.lit("-?[0-9]+\\.[0-9]+|-?[0-9]+"), F.lit(0))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise("NULL")


def same_number(prediction: Column, gold: Column) -> Column:
    """Equal texts, or a number within 1e-6 of a whole one."""
    whole = F.when(F.regexp_like(X.stripped(gold), F.lit("^[-+]?[0-9]+$")), X.stripped(gold).try_cast("double"))
    return (prediction == gold) | F.coalesce(F.abs(X.whole_number(prediction) - whole) < 1e-6, F.lit(False))


def any_number(text: Column) -> Column:
    """A text that is a number, else its first number in scientific, then decimal, then whole notation; null without."""
    kinds = ("-?[0-9]+\\.?[0-9]*[eE][+-]?[0-9]+", "-?[0-9]+\\.[0-9]+", "-?[0-9]+")
    return F.coalesce(X.whole_number(text), *[X.empty_null(F.regexp_extract(text, k, 0)).try_cast("double") for k in kinds])


def numeric_match(prediction: Column, reference: Column, atol: float = 0.0, rtol: float = 1e-5) -> Column:
    """Whether the numbers of two texts are close; texts without a number are compared as such."""
    p, r = any_number(prediction), any_number(reference)
    return F.when(p.isNull() | r.isNull(), X.stripped(prediction) == X.stripped(reference)).otherwise(X.numeric_close(p, r, atol, rtol))


def exact_match(prediction: Column, references: Column) -> Column:
    """Whether the normalised prediction is one of the references, raw or normalised."""
    p = X.general_answer(prediction)
    return F.exists(references, lambda r: (r == p) | (X.general_answer(r) == p))


def free_text(value: Column) -> Column:
    """Lower case without a box around it, extra white space and punctuation at the ends; null if nothing is left."""
    bare = F.regexp_replace(F.lower(X.stripped(value)), "\\\\boxed\\{([^}]*)\\}", "$1")
    return X.empty_null(F.btrim(F.regexp_replace(bare, f"{X.SPACE}+", " "), F.lit(" \t\r\n\"'`.,;:!?")))


def similar_text(prediction: Column, answer: Column) -> Column:
    """Equal, or one within the other, in lower case with collapsed white space; null if either is empty."""
    return one_within(comparable(prediction), comparable(answer))


def comparable(text: Column) -> Column:
    """In lower case with collapsed white space; null if empty."""
    return X.empty_null(X.collapsed(F.lower(text)))


def one_within(p: Column, a: Column) -> Column:
    return (p == a) | F.contains(p, a) | F.contains(a, p)


def near_the_end(prediction: Column, answer: Column, short: int = 10, tail: int = 300) -> Column:
    """Whether a prediction gives an answer: equal but for case and white space, a short answer as a word within the
    last characters, a longer one anywhere. Null if either is null or empty."""
    p, a = X.empty_null(X.stripped(prediction)), X.empty_null(X.stripped(answer))
    same = X.collapsed(F.lower(p)) == X.collapsed(F.lower(a))
    quoted = F.regexp_replace(F.lower(a), "([^0-9A-Za-z])", "\\\\$1")
    word = F.regexp_like(F.right(p, F.lit(tail)), F.concat(F.lit("(?iU)(?:^|\\b)"), quoted, F.lit("(?:\\b|$)")))
    return F.when(same, True).when(F.length(a) <= short, word).otherwise(F.contains(F.lower(p), F.lower(a)))


def hit_flag(value: Column) -> Column:
    """A hit column as 0 or 1: numbers are cut to whole ones first, so 0.9 is 0; words otherwise; null if unknown."""
    number = X.whole_number(value)
    low = F.lower(X.stripped(value))
    return F.when(number.isNotNull(), (F.abs(number) >= 1).cast("int")).when(low.isin("true", "yes"), 1).when(low.isin("false", "no"), 0)


def as_share(accuracy: Column) -> Column:
    """An accuracy of 0 to 1; above 1 it is a percentage."""
    return F.when(accuracy > 1, accuracy / 100.0).otherwise(accuracy)


#: Verdicts of a judge that answers in Chinese or English: right, wrong, and parts that tell. Fixed values.
JUDGE_RIGHT = ("正确", "correct", "true", "1", "yes", "y")
JUDGE_WRONG = ("错误", "不正确", "未尝试", "incorrect", "wrong", "not_attempted", "notattempted", "false", "0", "no", "n")
JUDGE_WRONG_PARTS, JUDGE_RIGHT_PARTS = ("未尝试", "错误", "不正确"), ("正确", "correct")


def judge_flag(value: Column) -> Column:
    """A judge's verdict as 0 or 1: whole words first, then parts, the wrong ones before the right ones; else null."""
    return flag_of_words(judge_words(value))


def judge_words(value: Column) -> Column:
    """A judge's verdict in lower case without white space."""
    return F.regexp_replace(F.lower(value), X.SPACE, "")


def flag_of_words(low: Column) -> Column:
    """`judge_flag` of `judge_words`, which it reads for each word it looks for."""
    has = lambda parts: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts])
    return F.when(low == "", None).when(low.isin(*JUDGE_RIGHT), 1).when(low.isin(*JUDGE_WRONG), 0).when(has(JUDGE_WRONG_PARTS), 0).when(has(JUDGE_RIGHT_PARTS), 1)


def letter_after_prefix(text: Column, letters: str = "ABCDE") -> Column:
    """The first option letter once phrases that introduce an answer are gone; without any, of a text of up to ten words
    that is within "(a)", "(b)" and so on, that letter; else empty."""
    bare = reduce(lambda t, p: F.replace(t, F.lit(p), F.lit("")), ANSWER_PREFIXES, X.stripped(text))
    found = F.regexp_extract(bare, f"[{letters}]", 0)
    low = F.lower(bare)
    within = F.coalesce(*[F.when(F.contains(F.lit(f"({x.lower()})"), low), x) for x in letters], F.lit(""))
    lengthy = F.size(F.split(X.stripped(bare), f"{X.SPACE}+")) > 10
    return F.when(found != "", found).when(lengthy, "").otherwise(within)


def open_as_choice(rows_a: Column, answer: Column) -> tuple[Column, Column]:
    """Options A and B of an open question: its answer and a stand-in for all others; other questions keep A."""
    return F.coalesce(rows_a, answer), F.when(rows_a.isNull(), F.lit("Other Answers"))


def boxes(text: Column) -> Column:
    """The first four numbers of a text as [x1, y1, x2, y2]; null if there are fewer."""
    found = F.regexp_extract_all(text, F.lit("-?[0-9]+(?:\\.[0-9]+)?"), F.lit(0))
    return F.when(F.size(found) >= 4, F.transform(F.slice(found, 1, 4), lambda x: x.cast("double")))


def scaled_box(box: Column, width: Column, height: Column) -> Column:
    """A box in pixels: coordinates up to 1 are shares of the picture, up to 1000 thousandths of it."""
    most = F.array_max(box)
    unit = F.when(most <= 1, 1.0).when(most <= 1000, 1000.0)
    sizes = F.array(width, height, width, height)
    return F.when(unit.isNull(), box).otherwise(F.zip_with(box, sizes, lambda x, n: x / unit * n))


def code_similarity(prediction: Column, reference: Column) -> Column:
    """How alike the first line of code and the reference are, in hundredths: twice their longest common subsequence over
    the sum of their lengths; both empty are alike, and one of them alone isn't."""
    lines = F.filter(F.split(F.ltrim(prediction, F.lit("\n")), "\n"), lambda x: ~F.contains(x, F.lit("`")) & ~F.contains(x, F.lit("#")) & ~F.contains(x, F.lit("//")))
    return F.rint(100 * similarity.indel_ratio(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), reference)) / 100


def best_code_similarity(prediction: Column, references: Column, most: int = 8) -> Column:
    """The best of the first `most` references; 0 without any."""
    each = [F.coalesce(code_similarity(prediction, F.try_element_at(references, F.lit(k + 1))), F.lit(0.0)) for k in range(most)]
    return F.greatest(*each)


def count_share(prediction: Column, reference: Column) -> Column:
    """The share of a text's numbers that are the reference; 0 without numbers."""
    found = F.regexp_extract_all(prediction, F.lit("[0-9]+"), F.lit(0))
    return F.when(F.size(found) > 0, F.size(F.filter(found, lambda n: n == reference)) / F.size(found)).otherwise(0.0)


def retrieval_share(prediction: Column, reference: Column, mark: str = "Paragraph ") -> Column:
    """The share of a text's numbers that are the number of the paragraph that the reference names."""
    return count_share(prediction, F.regexp_extract(reference, f"{re.escape(mark)}([0-9]+)", 1))


def class_share(prediction: Column, reference: Column, classes: Column) -> Column:
    """1 over the number of classes that a prediction names if the reference is among them, else 0.

    A class within the reference's name doesn't count against it, but the one listed after such a class always stays: the
    published rule drops from the list that it walks through.
    """
    named = F.filter(classes, lambda c: F.contains(prediction, c))
    start = F.struct(F.filter(named, lambda c: F.lit(False)).alias("kept"), F.lit(False).alias("skip"))

    def walk(state: Column, c: Column) -> Column:
        drop = ~state["skip"] & F.contains(reference, c) & (c != reference)
        return F.struct(F.when(drop, state["kept"]).otherwise(F.array_append(state["kept"], c)).alias("kept"), F.coalesce(drop, F.lit(False)).alias("skip"))

    kept = F.aggregate(named, start, walk, lambda state: state["kept"])
    return F.when(F.array_contains(kept, reference), 1.0 / F.size(kept)).otherwise(0.0)


def _latex(text: str) -> str:
    """One spelling of a LaTeX answer: no spacing, sizing or units, fractions with braces, no leading zeros missing."""
    s = text.strip().strip("$").replace("\n", "")
    for gone in ("\\!", "\\left", "\\right", "^{\\circ}", "^\\circ", "\\$", "\\%", "%", "\\,", "\\;", "\\ "):
        s = s.replace(gone, "")
    s = s.replace("\\\\", "\\").replace("tfrac", "frac").replace("dfrac", "frac")
    s = re.sub(r"\\text\{ [^}]*\}\s*$", "", s)
    s = re.sub(r"\\(?:text|mathrm|mbox)\{([^}]*)\}", r"\1", s)
    s = re.sub(r"(^|[{\s,(\[])\.(?=\d)", r"\g<1>0.", s)
    if s.count("=") == 1 and len(s.split("=")[0].strip()) <= 2:
        s = s.split("=")[1]
    s = re.sub(r"\\sqrt\s*([^\s{\\])", r"\\sqrt{\1}", s)
    s = s.replace(" ", "")
    # \frac12 and \frac1{2} in full
    one = r"(\{(?:[^{}]|\{[^{}]*\})*\}|[^\s{}\\])"
    s = re.sub(rf"\\frac{one}{one}", lambda m: "\\frac" + "".join(g if g[0] == "{" else f"{{{g}}}" for g in m.groups()), s)
    if s == "0.5":
        s = "\\frac{1}{2}"
    return re.sub(r"^(-?\d+)/(-?\d+)$", r"\\frac{\1}{\2}", s)


@F.pandas_udf(T.StringType())
def latex_form(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """One spelling of LaTeX answers, so that equal ones compare equal; null stays null."""
    for s in parts:
        yield s.map(lambda x: None if x is None else _latex(x))


#: What stands for no answer, and refusals. Fixed values.
UNANSWERED = "Failed to obtain answer via API"
REFUSALS = (
    "Sorry, I can't help with images of people yet.",
    "I can't process this file.",
    "I'm sorry, but without the image provided",
    "Cannot determine the answer",
)
_MARKS = str.maketrans({c: " " for c in ".()[],:;!*#{}"})


@F.pandas_udf(T.StringType())
def option_of(answers: pd.Series, choices: pd.Series) -> pd.Series:
    """The option that an answer names: its only option letter if that is first met among the last four words, else the
    only option text within a short answer.

    choices: a map from letters to texts. Z stands for a refusal; null if none or several are named, or without an answer.
    """

    def one(answer: str | None, options) -> str | None:
        if answer is None or options is None or UNANSWERED in answer:
            return None
        if any(r in answer for r in REFUSALS):
            return "Z"
        options = dict(options)
        words = answer.translate(_MARKS).split()
        said = [k for k in options if k in words]
        if len(said) == 1 and words.index(said[0]) > len(words) - 5:
            return said[0]
        if not said and "Z" in words:
            return "Z"
        low = answer.lower()
        if len(low) > 2 * sum(len(str(v)) for v in options.values()):
            return None
        named = [k for k, v in options.items() if str(v).lower() in low]
        return named[0] if len(named) == 1 else None

    return pd.Series([one(a, c) for a, c in zip(answers, choices)])


#: Patterns that introduce an option in Chinese or English, in the order tried; {0} stands for the options. The one of two
#: halves is one pattern. Fixed values.
OPTION_PATTERNS = (
    r"答案是?\s*([{0}])",
    r"答案是?\s*：\s*([{0}])",
    r"答案是?\s*:\s*([{0}])",
    r"答案选项应?该?是\s*([{0}])",
    r"答案选项应?该?为\s*([{0}])",
    r"答案应该?是\s*([{0}])",
    r"答案应该?选\s*([{0}])",
    r"答案选项为?\s*：\s*([{0}])",
    r"答案选项为?\s+\(?\*?\*?([{0}])\*?\*?\)?",
    r"答案选项是?\s*:\s*([{0}])",
    r"答案为\s*([{0}])",
    r"答案选\s*([{0}])",
    r"选择?\s*([{0}])",
    r"故选?\s*([{0}])只有选?项?\s?([{0}])\s?是?对",
    r"只有选?项?\s?([{0}])\s?是?错",
    r"只有选?项?\s?([{0}])\s?不?正确",
    r"只有选?项?\s?([{0}])\s?错误",
    r"说法不?对选?项?的?是\s?([{0}])",
    r"说法不?正确选?项?的?是\s?([{0}])",
    r"说法错误选?项?的?是\s?([{0}])",
    r"([{0}])\s?是正确的",
    r"([{0}])\s?是正确答案",
    r"选项\s?([{0}])\s?正确",
    r"所以答\s?([{0}])",
    r"所以\s?([{0}][.。$]?$)",
    r"所有\s?([{0}][.。$]?$)",
    r"[\s，：:,]([{0}])[。，,\.]?$",
    r"[\s，,：:][故即]([{0}])[。\.]?$",
    r"[\s，,：:]因此([{0}])[。\.]?$",
    r"[是为。]\s?([{0}])[。\.]?$",
    r"因此\s?([{0}])[。\.]?$",
    r"显然\s?([{0}])[。\.]?$",
    r"答案是\s?(\S+)(?:。|$)",
    r"答案应该是\s?(\S+)(?:。|$)",
    r"答案为\s?(\S+)(?:。|$)",
    r"(?i)ANSWER\s*:\s*([{0}])",
    r"[Tt]he answer is:?\s+\(?([{0}])\)?",
    r"[Tt]he answer is:?\s+\(?\*?\*?([{0}])\*?\*?\)?",
    r"[Tt]he answer is option:?\s+\(?([{0}])\)?",
    r"[Tt]he correct answer is:?\s+\(?([{0}])\)?",
    r"[Tt]he correct answer is option:?\s+\(?([{0}])\)?",
    r"[Tt]he correct answer is:?.*?boxed\{{([{0}])\}}",
    r"[Tt]he correct option is:?.*?boxed\{{([{0}])\}}",
    r"[Tt]he correct answer option is:?.*?boxed\{{([{0}])\}}",
    r"[Tt]he answer to the question is:?\s+\(?([{0}])\)?",
    r"^选项\s?([{0}])",
    r"^([{0}])\s?选?项",
    r"(\s|^)[{0}][\s。，,：:\.$]",
    r"1.\s?(.*?)$",
    r"1.\s?([{0}])[.。$]?$",
)
CUSHION_PATTERNS = ("([{0}]):", "([{0}])")


#: What a text must hold for a pattern to match, longest first where one is part of another; and the patterns that match at
#: the end alone, within so many characters. Fixed values.
_NEEDED = ("答案应该是", "答案选项", "答案是", "答案应", "答案为", "答案选", "答案", "只有", "说法", "是正确的", "是正确答案", "所以答", "所以", "所有", "因此", "显然", "选项", "he answer is option", "he answer is", "he correct answer is option", "he correct answer is", "he correct option is", "he correct answer option is", "he answer to the question is", "选")
_END = 16


def _needed(pattern: str) -> str:
    """The longest of these words that every match of the pattern holds, or an empty text."""
    plain = re.sub(r".[?*]|\[[^]]*\][?*]?|\(\?i\).*", "\0", pattern)
    return next((w for w in sorted(_NEEDED, key=len, reverse=True) if w in plain), "")


def first_option(text: Column, options: str = "ABCD", cushion: bool = True) -> Column:
    """The option within what the first pattern finds that holds any, in the patterns' order; of several the first of the
    options. Empty if none. With the cushion any letter counts."""
    letter = lambda x: F.coalesce(*[F.when(F.contains(x, F.lit(o)), o) for o in options])

    def tried(bare: Column, end: Column, pattern: str) -> Column:
        """What a pattern finds; only the words that it needs are looked for where they aren't there."""
        p = f"(?sU){pattern.format(options)}"
        where = end if pattern.endswith(("?$", "?$)")) and "*" not in pattern and not pattern.startswith(("1.", "^")) else bare
        found = X.empty_null(F.regexp_extract(where, p, 1))
        if "(\\s|^)" in pattern or "(.*?)" in pattern:  # the others' first group is never empty
            found = F.coalesce(found, F.regexp_extract(where, p, 0))
        word = "1" if pattern.startswith("1.") else _needed(pattern)
        needs = [F.contains(where, F.lit(w)) for w in (word, *(["boxed{"] if "boxed" in pattern else [])) if w]
        return F.when(reduce(lambda a, b: a & b, needs), found) if needs else found

    def first(bare: Column) -> Column:
        def by_end(end: Column) -> Column:
            # a pattern is tried where none before it holds an option
            found = [tried(bare, end, p) for p in (*OPTION_PATTERNS, *(CUSHION_PATTERNS if cushion else ()))]
            return F.coalesce(*[X.bound(f, letter) for f in found], F.lit(""))

        some = reduce(lambda a, b: a | b, [F.contains(bare, F.lit(o)) for o in options])
        return F.when(some, X.bound(F.right(bare, F.lit(_END)), by_end)).when(bare.isNotNull(), "")

    return F.coalesce(X.bound(X.stripped(text), first), F.lit(""))


#: Punctuation that Chinese answers are compared without, beside ASCII's. Fixed value.
CHINESE_MARKS = "！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏."


def chinese_answer(text: Column) -> Column:
    """Lower case without punctuation of either kind and without white space."""
    return F.regexp_replace(F.translate(F.lower(text), CHINESE_MARKS + "!\"#$%&'()*+,-/:;<=>?@[\\]^_`{|}~", ""), X.SPACE, "")
