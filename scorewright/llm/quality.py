"""Quality rules that clean line by line first: every line is judged on its own, failing lines are removed, and a
document is rejected if it loses too much of its words, beside the document-wide base rules.

Everything is DataFrame functions on one row: no shuffle, no Python. Windows of words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GAP = "[\\x20\\x09-\\x0D]+"


#: Marks of navigation bars, and phrases of legal, cookie and script boilerplate (looked for in lower case).
_SYMBOLS, _MARKS = "#*$%&|<>", "|»›•·"
BOILERPLATE = ("licensed under the ", "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "accept all cookies", "enable javascript", "lorem ipsum", "copyright (c)", "copyright ©", "click here to", "subscribe to our newsletter")


@dataclass(frozen=True)
class LineRules:
    """When a line fails. A line without words is neither good nor bad."""

    #: Characters of #*$%&|<> for each word.
    max_symbols: float = 0.4
    #: Marks that separate entries of a navigation bar, for each word, in lines with at least `nav_marks`.
    max_nav: float = 0.25
    nav_marks: int = 3
    #: Words that end in "!!" or "??" for each word.
    max_shouts: float = 0.3
    boilerplate: tuple[str, ...] = BOILERPLATE


@dataclass(frozen=True)
class QualityRules:
    """When a document fails; lines are judged first."""

    lines: LineRules = LineRules()
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    #: Share of a document's words that may go with removed lines.
    max_lost: float = 0.5


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def _words(text: Column) -> Column:
    body = _trim(text)
    return F.when(F.length(body) > 0, F.split(body, _GAP)).otherwise(F.array().cast("array<string>"))


def _has_boilerplate(text: Column, rules: LineRules) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in rules.boilerplate), F.lit(False))


def _has_marks(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in dict.fromkeys((*_SYMBOLS, *_MARKS, "!!", "??"))))


def _left(text: Column, chars: str) -> Column:
    """How many of the characters the text has."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_fails(line: Column, rules: LineRules) -> Column:
    """Whether a line with words breaks a rule."""
    n, nav = F.size(_words(line)), _left(line, _MARKS)
    shouts = F.size(F.regexp_extract_all(line, F.lit("(?:!!|\\?\\?)(?=[\\x20\\x09-\\x0D]|$)"), F.lit(0)))
    return (n > 0) & ((_left(line, _SYMBOLS) > rules.max_symbols * n) | ((nav >= rules.nav_marks) & (nav > rules.max_nav * n)) | (shouts > rules.max_shouts * n) | _has_boilerplate(line, rules))


def with_windows(df: DataFrame, words: str, k: int, to: str) -> DataFrame:
    """df with a hash of each window of k words, put together from windows half as long.

    Every length is a column of its own, so that none is computed twice.
    """

    def joined(df: DataFrame, a: str, b: str, shift: int, to: str) -> DataFrame:
        """Windows a[i] followed by b[i + shift]."""
        m = F.greatest(F.size(b) - shift, F.lit(0))
        return df.withColumn(to, F.zip_with(F.slice(a, F.lit(1), m), F.slice(b, F.lit(1 + shift), m), lambda x, y: F.xxhash64(x, y)))

    out, done, part, width = "", 0, words, 1
    while width <= k:
        if k & width:
            if out:
                df = joined(df, out, part, done, f"{to}_{done + width}")
            out, done = (f"{to}_{done + width}" if out else part), done + width
        if 2 * width <= k:
            df = joined(df, part, part, width, f"{to}{2 * width}")
            part = f"{to}{2 * width}"
        width *= 2
    return df.withColumn(to, F.col(out))


def assess(docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, cleaned_text, kept_words, kept.

    Words are [^\\x20\\x09-\\x0D]+; a null or empty text has none and fails the base rules. cleaned_text keeps the lines
    that don't fail, as they are; kept is false if base_failed or if more than max_lost of the words go with lines.
    Columns of docs with one of these names are replaced, others handed on; rows that repeat are judged alike; an empty
    table gives an empty result. Whole texts are read: a text's words are arrays of one row, in one executor's memory.
    """
    k = rules.window
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    new = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed cleaned_text kept_words kept".split()
    out = docs.drop(*new)
    out = out.withColumn("__words", _words(t))
    n = F.size("__words")
    out = with_windows(out, "__words", k, "__windows")
    size = F.size("__windows")
    # only texts with some repeated window go on: hashes are sorted with their places, equal neighbours are repeated
    pairs = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__sorted", F.when(F.size(F.array_distinct("__windows")) < size, pairs))
    same = F.zip_with(F.slice("__sorted", F.lit(1), size - 1), F.slice("__sorted", F.lit(2), size - 1), lambda a, b: a["h"] == b["h"])
    out = out.withColumn("__same", F.when(F.col("__sorted").isNotNull(), F.concat(F.array(F.lit(False)), same, F.array(F.lit(False)))))
    at = F.zip_with("__sorted", F.zip_with(F.slice("__same", F.lit(1), size), F.slice("__same", F.lit(2), size), lambda a, b: a | b), lambda x, r: F.when(r, x["i"]))
    out = out.withColumn("__at", F.when(F.col("__sorted").isNotNull(), F.sort_array(F.array_compact(at))))
    before = F.concat(F.array(F.lit(-k)), F.slice("__at", F.lit(1), F.size("__at") - 1))
    covered = F.aggregate(F.zip_with("__at", before, lambda i, p: F.least(i - p, F.lit(k))), F.lit(0), lambda s, x: s + x)
    # lines are judged one by one only where some line could fail
    lines = F.split(t, "\n", -1)
    worded = F.filter("__lines", lambda x: F.length(_trim(x)) > 0)
    suspect = _has_marks(t) | _has_boilerplate(t, rules.lines)
    out = out.withColumn("__lines", lines).withColumn("__good", F.when(suspect, F.filter("__lines", lambda x: ~line_fails(x, rules.lines))))
    out = out.withColumn("__whole", F.col("__good").isNull() | (F.size("__good") == F.size("__lines")))
    cleaned = F.array_join("__good", "\n")
    distinct_lines = F.size(F.array_distinct("__lines")) == F.size("__lines")
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.when(_has_marks(t), _left(t, _SYMBOLS)).otherwise(0).cast("long"),
        "n_dup_lines": F.when(distinct_lines, 0).otherwise(F.size(worded) - F.size(F.array_distinct(worded))).cast("long"),
        "n_repeat_words": F.coalesce(F.when(F.col("__at").isNotNull() & (F.size("__at") > 0), covered), F.lit(0)).cast("long"),
        "cleaned_text": F.when(F.col("__whole"), F.col(text_col).cast("string")).otherwise(cleaned),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))
    out = out.withColumn("kept_words", F.when(F.col("__whole"), F.col("n_words")).otherwise(F.size(_words(F.coalesce("cleaned_text", F.lit(""))))).cast("long"))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("kept_words") <= rules.max_lost * F.col("n_words")))
    return out.drop(*(c for c in out.columns if c.startswith("__") and c not in docs.columns))


def clean(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """docs without rejected rows and without failing lines; columns as before, n_chars recomputed where it is one."""
    # a column that isn't deterministic keeps the optimizer from copying the rules' expressions into the filter,
    # where each would be computed once for every use of it
    held = assess(docs, rules).withColumn("__held", F.monotonically_increasing_id())
    kept = held.where(F.col("kept") & (F.col("__held") >= 0))
    fresh = {"text": F.col("cleaned_text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length("cleaned_text").cast(docs.schema["n_chars"].dataType)
    return kept.withColumns(fresh).select(*docs.columns)
