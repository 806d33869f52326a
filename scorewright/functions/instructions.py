"""Checks of verifiable instructions as columns, and their strict and loose readings.

A check takes the response column and its arguments and gives a boolean column. Loose reading accepts a response if any
of eight variants passes: with or without asterisks, and without its first line, its last line, or both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewright.functions.registry import Registry

CHECKS: Registry[Callable[..., Column]] = Registry("instruction check")
_SPACE = " \t\n\r\x0b\x0c"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE))


def _relation(n: Column, relation: str, bound: int) -> Column:
    if relation not in ("at least", "less than"):
        raise ValueError(f"unknown relation {relation!r}")
    return n >= bound if relation == "at least" else n < bound


def _quote(word: str) -> str:
    return "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _count(c: Column, regex: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(regex), F.lit(0)))


def n_words(c: Column) -> Column:
    return _count(c, "(?U)\\w+")


@CHECKS.add("keywords:existence")
def keywords(c: Column, words: list[str]) -> Column:
    """All keywords occur, whatever their case."""
    out = F.lit(True)
    for w in words:
        out = out & c.rlike(f"(?iu){_quote(w)}")
    return out


@CHECKS.add("keywords:frequency")
def keyword_frequency(c: Column, word: str, n: int, relation: str = "at least") -> Column:
    return _relation(_count(c, f"(?iu){_quote(word)}"), relation, n)


@CHECKS.add("keywords:forbidden_words")
def forbidden_words(c: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & ~c.rlike(f"(?iuU)\\b{_quote(w)}\\b")
    return out


@CHECKS.add("keywords:letter_frequency")
def letter_frequency(c: Column, letter: str, n: int, relation: str = "at least") -> Column:
    low = F.lower(c)
    return _relation(F.length(low) - F.length(F.replace(low, F.lit(letter.lower()), F.lit(""))), relation, n)


@CHECKS.add("length_constraints:number_words")
def number_words(c: Column, n: int, relation: str = "at least") -> Column:
    return _relation(n_words(c), relation, n)


@CHECKS.add("length_constraints:number_sentences")
def number_sentences(c: Column, n: int, relation: str = "at least") -> Column:
    """A sentence ends with a mark before white space or the end; text after the last one counts too."""
    pieces = F.filter(F.split(_strip(c), "(?<=[.!?])[\\s]+"), lambda s: F.length(_strip(s)) > 0)
    return _relation(F.size(pieces), relation, n)


@CHECKS.add("length_constraints:number_paragraphs")
def number_paragraphs(c: Column, n: int) -> Column:
    """Paragraphs are divided by ***; an empty one is only allowed at either end."""
    parts = F.transform(F.split(c, "\\s?\\*\\*\\*\\s?"), _strip)
    size = F.size(parts)
    inner = F.slice(parts, F.lit(2), F.greatest(size - 2, F.lit(0)))
    full = F.size(F.filter(parts, lambda p: F.length(p) > 0))
    return (full == n) & ~F.exists(inner, lambda p: F.length(p) == 0)


@CHECKS.add("length_constraints:nth_paragraph_first_word")
def nth_paragraph_first_word(c: Column, paragraphs: int, nth: int, word: str) -> Column:
    parts = F.transform(F.split(c, "\n\n"), _strip)
    full = F.size(F.filter(parts, lambda p: F.length(p) > 0))
    first = F.regexp_extract(F.lower(F.get(parts, F.lit(nth - 1))), "^['\"]?([^\\s.,?!'\"]*)", 1)
    return F.coalesce((full == paragraphs) & (first == word.lower()), F.lit(False))


@CHECKS.add("detectable_content:number_placeholders")
def placeholders(c: Column, n: int) -> Column:
    return _count(c, "\\[.*?\\]") >= n


@CHECKS.add("detectable_content:postscript")
def postscript(c: Column, marker: str = "P.S.") -> Column:
    known = {"P.S.": "\\s*p\\.\\s?s\\.", "P.P.S": "\\s*p\\.\\s?p\\.\\s?s"}
    return F.lower(c).rlike("(?m)" + known.get(marker, f"\\s*{_quote(marker.lower())}") + ".*$")


@CHECKS.add("detectable_format:number_bullet_lists")
def bullets(c: Column, n: int) -> Column:
    return _count(c, "(?m)^\\s*\\*[^\\*].*$") + _count(c, "(?m)^\\s*-.*$") == n


@CHECKS.add("detectable_format:constrained_response")
def constrained_response(c: Column, options: list[str] | None = None) -> Column:
    """One of the options occurs."""
    options = options or ["My answer is yes.", "My answer is no.", "My answer is maybe."]
    out = F.lit(False)
    for o in options:
        out = out | F.contains(_strip(c), F.lit(o))
    return out


@CHECKS.add("detectable_format:number_highlighted_sections")
def highlights(c: Column, n: int) -> Column:
    """*text* or **text** with something other than white space between."""
    single = F.size(F.filter(F.regexp_extract_all(c, F.lit("\\*([^\\n\\*]*)\\*"), F.lit(1)), lambda s: F.length(_strip(s)) > 0))
    double = F.size(F.filter(F.regexp_extract_all(c, F.lit("\\*\\*([^\\n\\*]*)\\*\\*"), F.lit(1)), lambda s: F.length(_strip(s)) > 0))
    return single + double >= n


@CHECKS.add("detectable_format:multiple_sections")
def sections(c: Column, splitter: str, n: int) -> Column:
    return F.size(F.split(c, f"\\s?{_quote(splitter)}\\s?\\d+\\s?")) - 1 >= n


@CHECKS.add("detectable_format:json_format")
def json_format(c: Column) -> Column:
    """A JSON value, with or without a code fence."""
    body = _strip(F.regexp_replace(_strip(c), "(?i)^```(json)?|```$", ""))
    return F.coalesce(F.try_parse_json(body).isNotNull(), F.lit(False))


@CHECKS.add("detectable_format:title")
def title(c: Column) -> Column:
    """<<a title>> that isn't blank."""
    return F.exists(F.regexp_extract_all(c, F.lit("<<([^\\n]+)>>"), F.lit(1)), lambda s: F.length(F.btrim(s, F.lit(_SPACE + "<>"))) > 0)


@CHECKS.add("combination:two_responses")
def two_responses(c: Column) -> Column:
    """Two different parts around ******; only the ends may be empty."""
    parts = F.transform(F.split(c, "\\*{6}"), _strip)
    full = F.filter(parts, lambda p: F.length(p) > 0)
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return (F.size(full) == 2) & ~F.exists(inner, lambda p: F.length(p) == 0) & (F.size(F.array_distinct(full)) == 2)


@CHECKS.add("combination:repeat_prompt")
def repeat_prompt(c: Column, prompt: str | Column) -> Column:
    p = F.lit(prompt) if isinstance(prompt, str) else prompt
    return F.startswith(F.lower(_strip(c)), F.lower(_strip(p)))


@CHECKS.add("startend:end_checker")
def ends_with(c: Column, phrase: str) -> Column:
    return F.endswith(F.lower(F.btrim(c, F.lit(_SPACE + '"'))), F.lit(phrase.strip().lower()))


@CHECKS.add("startend:start_checker")
def starts_with(c: Column, phrase: str) -> Column:
    return c.rlike(f"(?imu)^\\s*{_quote(phrase)}.*$")


@CHECKS.add("startend:quotation")
def quotation(c: Column) -> Column:
    s = _strip(c)
    return (F.length(s) > 1) & F.startswith(s, F.lit('"')) & F.endswith(s, F.lit('"'))


@CHECKS.add("change_case:english_capital")
def all_capital(c: Column) -> Column:
    """Upper case with a letter; the language itself isn't tested."""
    return (F.upper(c) == c) & c.rlike("\\p{L}")


@CHECKS.add("change_case:english_lowercase")
def all_lower(c: Column) -> Column:
    return (F.lower(c) == c) & c.rlike("\\p{L}")


@CHECKS.add("change_case:capital_word_frequency")
def capital_words(c: Column, n: int, relation: str = "at least") -> Column:
    return _relation(_count(c, "(?U)\\b\\p{Lu}[\\p{Lu}\\d]*\\b"), relation, n)


@CHECKS.add("punctuation:no_comma")
def no_comma(c: Column) -> Column:
    return ~F.contains(c, F.lit(","))


@CHECKS.add("keywords:key_sentences")
def key_sentences(c: Column, wanted: list[str], n: int) -> Column:
    have = F.transform(F.split(_strip(c), "(?<=[.!?])[\\s]+"), _strip)
    return F.size(F.array_intersect(have, F.array(*map(F.lit, wanted)))) == n


@CHECKS.add("paragraphs:rephrased")
def rephrased(c: Column, original: str | Column, low: int, high: int) -> Column:
    """The number of distinct words shared with the original lies between low and high."""
    o = F.lit(original) if isinstance(original, str) else original
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("(?U)\\w+"), F.lit(0)))
    return F.size(F.array_intersect(words(c), words(o))).between(low, high)


def variants(c: Column) -> Column:
    """The eight readings of a loose check."""
    lines = F.split(c, "\n")
    n = F.size(lines)
    cut = lambda a, b: _strip(F.array_join(F.slice(lines, F.lit(1 + a), F.greatest(n - a - b, F.lit(0))), "\n"))
    plain = [c, cut(1, 0), cut(0, 1), cut(1, 1)]
    return F.array(*plain, *[F.replace(p, F.lit("*"), F.lit("")) for p in plain])


def strict(c: Column, name: str, **arguments) -> Column:
    """Whether a response that isn't blank follows the instruction."""
    return F.coalesce((F.length(_strip(c)) > 0) & CHECKS[name](c, **arguments), F.lit(False))


def loose(c: Column, name: str, **arguments) -> Column:
    return F.exists(variants(F.coalesce(c, F.lit(""))), lambda v: (F.length(_strip(v)) > 0) & CHECKS[name](v, **arguments))
