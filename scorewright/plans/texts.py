"""Answers read from the texts that the driver's tables hold, as they are; the SQL extracts by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.functions import answers
from scorewright.functions import text as T
from scorewright.plans.catalogue import query, table

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
#: What a word is made of, for boundaries that know accented letters.
_EDGE = r"[^\p{L}\p{N}_]"


@query(rf"""
    WITH t AS (SELECT doc_id, text, list_extract(regexp_extract_all(text, '{_NUMBER}'), -1) AS x, list_extract(regexp_extract_all(string_split(text, 'Question:')[1], '-?\d+\.\d+|-?\d+'), -1) AS p FROM documents),
    a AS (SELECT doc_id, TRY_CAST(x AS DOUBLE) AS last, coalesce(p, 'NULL') AS predicted, TRY_CAST(nullif(regexp_extract(text, '-?\d*\.?\d+'), '') AS DOUBLE) AS first FROM t)
    SELECT doc_id, CASE WHEN abs(last) < 1e300 THEN last END AS last, predicted, CASE WHEN abs(first) < 1e300 THEN first END AS first FROM a""")
def document_numbers(spark, d):
    finite = lambda x: F.when(F.abs(x) < 1e300, x)
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", finite(T.last_number(t)).alias("last"), answers.prediction_answer(t).alias("predicted"), finite(T.first_number(t)).alias("first"))


@query(rf"""
    WITH n AS (SELECT page_id, html, regexp_extract_all(html, '\d+\.\d+|\d+') AS x FROM pages)
    SELECT page_id, len(x)::INTEGER AS numbers, coalesce(abs(TRY_CAST(list_extract(regexp_extract_all(html, '{_NUMBER}'), -1) AS DOUBLE)) <= 1e9, FALSE) AS small FROM n""")
def page_numbers(spark, d):
    t = F.col("html")
    small = F.coalesce(T.numeric_close(T.last_number(t), F.lit(0.0), 1e9, 0.0), F.lit(False))
    return table(spark, d, "pages").select("page_id", F.regexp_count(t, F.lit("[0-9]+\\.[0-9]+|[0-9]+")).alias("numbers"), small.alias("small"))


@query(rf"""
    SELECT doc_id, nullif(upper(regexp_extract(text, '(?:^|{_EDGE})([A-Da-d])(?:$|{_EDGE})', 1)), '') AS choice, list_extract(regexp_extract_all(text, '[ABCD]'), -1) AS last, regexp_extract(text, '[ABCD]+') AS run,
    regexp_extract(text, '\p{{Lu}}') AS capital, coalesce(list_extract(regexp_extract_all(text, '\p{{Lu}}'), -1), '') AS final_capital FROM documents""")
def document_letters(spark, d):
    t = F.col("text")
    letters = {"choice": T.choice_letter(t), "last": T.last_letter(t), "run": T.first_letters(t), "capital": T.first_capital(t), "final_capital": T.last_capital(t)}
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in letters.items()])


@query(r"""
    WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
    r AS (SELECT doc_id, t, regexp_extract(t, '[\s:,，：]([ABCD])[.,，。]?$', 1) AS at_end, CASE WHEN regexp_matches(t, '^[ABCD][\s.,:$，：。]') THEN left(t, 1) END AS at_start,
      coalesce(nullif(regexp_extract(t, '(?s)1.\s?(.*)$', 1), ''), regexp_extract(t, '(?s)1.\s?$')) AS item FROM t)
    SELECT doc_id, coalesce(nullif(at_end, ''), at_start, CASE WHEN contains(item, 'A') THEN 'A' WHEN contains(item, 'B') THEN 'B' WHEN contains(item, 'C') THEN 'C' WHEN contains(item, 'D') THEN 'D' END,
      nullif(regexp_extract(t, '([ABCD]):', 1), ''), regexp_extract(t, '[ABCD]')) AS option FROM r""")
def document_options(spark, d):
    return table(spark, d, "documents").select("doc_id", answers.first_option(F.col("text")).alias("option"))


@query(r"""
    WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(t, '[A-E]') THEN regexp_extract(t, '[A-E]') WHEN len(regexp_split_to_array(t, '\s+')) > 10 THEN ''
      ELSE coalesce(upper(nullif(regexp_extract(t, '\(([a-e])\)', 1), '')), '') END AS letter FROM t""")
def document_prefixed_letters(spark, d):
    return table(spark, d, "documents").select("doc_id", answers.letter_after_prefix(F.col("text")).alias("letter"))


@query(r"""
    WITH c AS (SELECT conv_id, turn, lower(text) AS t, lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS b FROM conversations),
    n AS (SELECT conv_id, turn, trim(regexp_replace(t, '\s+', ' ', 'g'), ' ') AS t, trim(regexp_replace(b, '\s+', ' ', 'g'), ' ') AS b FROM c)
    SELECT conv_id, turn, md5(trim(t, ' "''`.,;:!?')) AS plain, CASE WHEN t <> '' AND b <> '' THEN contains(t, b) OR contains(b, t) END AS alike FROM n""")
def turns_as_free_text(spark, d):
    c = table(spark, d, "conversations").selectExpr("conv_id", "turn", "text", "lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before")
    return c.select("conv_id", "turn", F.md5(answers.free_text(F.col("text")).cast("binary")).alias("plain"), answers.similar_text(F.col("text"), F.col("before")).alias("alike"))
