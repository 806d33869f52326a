"""Text extraction, normalisation and similarity as columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.functions.similarity import lcs_length

#: Spellings of yes and no that records use. Fixed values.
TRUE_WORDS = ("true", "1", "yes", "y", "success", "correct")
FALSE_WORDS = ("false", "0", "no", "n", "fail", "failed", "incorrect")


def correctness(value: Column, numbers: bool = False) -> Column:
    """1, 0 or null of a string that says in words whether an answer is right; with `numbers` also one that is a number,
    by whether it is 0."""
    low = F.lower(stripped(value))
    told = F.when(low.isin(*TRUE_WORDS), 1).when(low.isin(*FALSE_WORDS), 0)
    number = low.try_cast("double")
    return told.when(number.isNotNull(), (number != 0).cast("int")) if numbers else told


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def empty_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


#: A number within a text, and a coefficient times a power of ten in LaTeX. Fixed values.
NUMBER = "[-+]?((?:[0-9]+\\.?[0-9]*)|(?:\\.[0-9]+))(?:[eE][-+]?[0-9]+)?"
LATEX_POWER = "([-+]?[0-9]{1,30}(?:\\.[0-9]{0,30})?)\\s*\\\\times\\s*10\\s*\\^\\s*\\{?\\s*[-+]?[0-9]{1,10}\\s*\\}?"


def last_number(text: Column) -> Column:
    """The last number of a text as a double, of a LaTeX power of ten its coefficient; null if there is none."""
    found = F.regexp_extract_all(F.regexp_replace(text, LATEX_POWER, "$1"), F.lit(NUMBER), F.lit(0))
    return F.when(F.size(found) > 0, F.element_at(found, -1).cast("double"))


#: White space of any kind, as a class.
SPACE = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapsed(text: Column) -> Column:
    """Stripped, runs of white space as one space."""
    return F.regexp_replace(stripped(text), f"{SPACE}+", " ")


def whole_number(text: Column) -> Column:
    """A text that is one number as a double, infinities and NaN included; null otherwise."""
    bare = stripped(text)
    low = F.lower(F.regexp_replace(bare, "^[-+]", ""))
    sign = F.when(bare.startswith("-"), -1.0).otherwise(1.0)
    plain = F.regexp_like(bare, F.lit("^[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?$"))
    return F.when(plain, bare.try_cast("double")).when(low.isin("inf", "infinity"), sign * float("inf")).when(low == "nan", F.lit(float("nan")))


def numeric_close(a: Column, b: Column, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    """Whether a is within atol + rtol*|b| of the reference b."""
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def choice_letter(text: Column, letters: str = "ABCD", default: str | None = None, plain_edges: bool = False) -> Column:
    """The first stand-alone option letter of either case, in upper case; the default if there is none. With plain edges
    only ASCII letters, digits and underscores next to a letter make it part of a word."""
    before, after = ("(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])") if plain_edges else ("\\b", "\\b")
    found = empty_null(F.upper(F.regexp_extract(text, f"(?i){before}([{letters}]){after}", 1)))
    return found if default is None else F.coalesce(found, F.lit(default))


def last_letter(text: Column, letters: str = "ABCD") -> Column:
    found = F.regexp_extract_all(text, F.lit(f"[{letters}]"), F.lit(0))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def first_capital(text: Column) -> Column:
    """The first upper-case letter, or an empty text."""
    return F.regexp_extract(text, "(\\p{Lu})", 1)


def last_capital(text: Column) -> Column:
    """The last upper-case letter, or an empty text."""
    return F.regexp_extract(text, "(?s)^.*(\\p{Lu})", 1)


def first_letters(text: Column, letters: str = "A-D") -> Column:
    """The first run of option letters, or an empty text."""
    return F.regexp_extract(text, f"([{letters}]+)", 1)


def first_number(text: Column) -> Column:
    """The first number of a text as a double; null if there is none."""
    return empty_null(F.regexp_extract(text, "(-?[0-9]*\\.?[0-9]+)", 1)).cast("double")


def pattern_or_text(text: Column, pattern: str) -> Column:
    """The first group of a pattern, stripped, or the text where it isn't found."""
    return F.when(F.regexp_like(text, F.lit(pattern)), stripped(F.regexp_extract(text, pattern, 1))).otherwise(text)


def pattern_group(text: Column, pattern: str) -> Column:
    """The first group of a pattern, or an empty text."""
    return F.regexp_extract(text, pattern, 1)


def contains_any(text: Column, references: Column) -> Column:
    """1.0 if one of the references occurs in the text, in lower case, else 0.0."""
    return F.when(F.exists(references, lambda r: F.contains(F.lower(text), F.lower(r))), 1.0).otherwise(0.0)


def sorted_capitals(text: Column) -> Column:
    """The distinct capitals A-Z of a text in order."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Z]"), F.lit(0)))), "")


def general_answer(text: Column) -> Column:
    """The text up to its first newline, period or comma, without punctuation, articles in any case and extra spaces."""
    cut = F.regexp_extract(text, "^([^\\n.,]*)", 1)
    bare = F.regexp_replace(cut, f"[^\\p{{L}}\\p{{N}}_{SPACE[1:-1]}]", "")
    word = "[\\p{L}\\p{N}_]"
    return collapsed(F.regexp_replace(bare, f"(?i)(?<!{word})(a|an|the)(?!{word})", ""))


def short_answer(text: Column) -> Column:
    """The general answer in lower case."""
    return F.lower(general_answer(text))


def normal_answer(text: Column) -> Column:
    """Lower case without ASCII punctuation, English articles and extra white space."""
    bare = F.regexp_replace(F.lower(text), "[!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "(?U)\\b(a|an|the)\\b", " "), "[ \\t\\n\\r]+", " "))


def tagged(text: Column, tag: str, missing: str = "NO ANSWER FOUND") -> Column:
    """The body of the last <tag>, or the text for a missing one."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.when(F.size(found) > 0, F.btrim(F.element_at(found, -1), F.lit(" \t\n\r"))).otherwise(F.lit(missing))


def without_reasoning(text: Column, start: str = "<think>", end: str = "</think>", strip: bool = True) -> Column:
    """The text without its reasoning: what follows the last end tag if no start tag occurs, else all but the blocks
    between tags."""
    quoted = [re.escape(t) for t in (start, end)]
    after = F.element_at(F.split(text, quoted[1]), -1)
    only_end = ~F.contains(text, F.lit(start)) & F.contains(text, F.lit(end))
    out = F.when(only_end, after).otherwise(F.regexp_replace(text, f"(?s){quoted[0]}.*?{quoted[1]}", ""))
    return stripped(out) if strip else out


def yes_or_no(text: Column) -> Column:
    """Yes or No where exactly one of the two words occurs, else Unknown."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z]+", " "), " ")
    yes, no = F.array_contains(words, "yes"), F.array_contains(words, "no")
    return F.when(yes & ~no, "Yes").when(no & ~yes, "No").otherwise("Unknown")


def question_hash(text: Column) -> Column:
    """16 hex digits of the SHA-1 of a question with its white space collapsed."""
    return F.substring(F.sha1(F.regexp_replace(F.regexp_replace(text, "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", ""), "[ \\t\\n\\r]+", " ").cast("binary")), 1, 16)


def relaxed_match(prediction: Column, target: Column, tolerance: float = 0.05) -> Column:
    """Within a relative tolerance of a numeric, non-zero target; equal in lower case otherwise. A percentage is a
    hundredth of its number."""

    def number(x: Column) -> Column:
        return F.when(x.endswith("%"), whole_number(F.regexp_replace(x, "%+$", "")) / 100.0).otherwise(whole_number(x))

    p, t = number(prediction), number(target)
    return F.when(p.isNotNull() & t.isNotNull() & (t != 0), (F.abs(p - t) / F.abs(t) <= tolerance).cast("int")).otherwise((F.lower(prediction) == F.lower(target)).cast("int"))


def anls(prediction: Column, target: Column) -> Column:
    """Edit distance of lower-cased texts with collapsed white space over the longer raw length; 0 for two empty ones."""
    longer = F.greatest(F.length(prediction), F.length(target))
    return F.when(longer > 0, F.levenshtein(collapsed(F.lower(prediction)), collapsed(F.lower(target))) / longer).otherwise(0.0)


def nearest_choice(text: Column, choices: Column) -> Column:
    """The position from 0 of the choice at the smallest edit distance, the first of equal ones."""
    d = F.transform(choices, lambda c: F.levenshtein(text, c))
    return F.array_position(d, F.array_min(d)) - 1


def contains_share(text: Column, references: Column) -> Column:
    """The share of references that occur in the text, in lower case."""
    hits = F.filter(references, lambda r: F.contains(F.lower(text), F.lower(r)))
    return F.when(F.size(references) > 0, F.size(hits) / F.size(references))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the multisets of white-space tokens of two normalised texts."""
    x, y = (F.filter(F.split(c, " "), lambda w: F.length(w) > 0) for c in (a, b))
    count = lambda arr, w: F.size(F.filter(arr, lambda v: v == w))
    same = F.aggregate(F.transform(F.array_distinct(x), lambda w: F.least(count(x, w), count(y, w))), F.lit(0), lambda s, n: s + n)
    return F.when(same > 0, 2.0 * same / (F.size(x) + F.size(y))).otherwise(0.0)


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes [x1, y1, x2, y2]."""
    at = lambda c, i: F.element_at(c, i)
    w = F.greatest(F.least(at(a, 3), at(b, 3)) - F.greatest(at(a, 1), at(b, 1)), F.lit(0.0))
    h = F.greatest(F.least(at(a, 4), at(b, 4)) - F.greatest(at(a, 2), at(b, 2)), F.lit(0.0))
    area = lambda c: (at(c, 3) - at(c, 1)) * (at(c, 4) - at(c, 2))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def rouge_l(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of white-space tokens; a loop that no column expression has."""

    def one(p: str | None, r: str | None) -> float:
        a, b = (p or "").split(), (r or "").split()
        return 2.0 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0

    return pd.Series([one(p, r) for p, r in zip(prediction, reference)])


@F.pandas_udf(T.StringType())
def last_boxed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The content of the last \\boxed{...} with its braces balanced; null if there is none."""

    def one(text: str | None) -> str | None:
        at = (text or "").rfind("\\boxed{")
        if at < 0:
            return None
        depth, start = 0, at + 7
        for i in range(at + 6, len(text)):
            depth += (text[i] == "{") - (text[i] == "}")
            if not depth:
                return text[start:i]
        return None

    for s in parts:
        yield s.map(one)
