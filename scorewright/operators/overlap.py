"""Overlaps of token multisets: F1, BLEU and exact matches over pairs of texts.

A pair's tokens are counted where the pair is: no token is shuffled, and a pair costs its tokens and no nested loop.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda w: F.length(w) > 0)


def _common(orders: int):
    """A column function (tokens, tokens): for each n up to orders, [n-grams of the one, of the other, of their multiset
    intersection]."""

    def count(a: list[str], b: list[str], n: int) -> list[int]:
        x, y = ([*zip(*(side[i:] for i in range(n)))] if n > 1 else side for side in (a, b))
        return [len(x), len(y), (Counter(x) & Counter(y)).total() if x and y else 0]

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        sides = (tuple([] if s is None else s.tolist() for s in pair) for pair in zip(a, b))
        return pd.Series([[count(x, y, n) for n in range(1, orders + 1)] for x, y in sides], dtype=object)

    return run


def common_counts(rows: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """(keys, n_a, n_b, both): tokens of each side and of their multiset intersection, for every row of rows; keys are
    unique."""
    counts = rows.select(*keys, _common(1)(F.filter(a, lambda t: t.isNotNull()), F.filter(b, lambda t: t.isNotNull())).alias("__c"))
    return counts.select(*keys, *[F.col("__c")[0][i].alias(c) for i, c in enumerate(("n_a", "n_b", "both"))])


def f1(both: Column, n_a: Column, n_b: Column) -> Column:
    return F.when(both > 0, 2.0 * both / (n_a + n_b)).otherwise(0.0)


def token_f1(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, f1) of the white-space tokens of two normalised texts."""
    counts = common_counts(rows, keys, words(F.col(a)), words(F.col(b)))
    return counts.select(*keys, f1(F.col("both"), F.col("n_a"), F.col("n_b")).alias("f1"))


def answer_scores(rows: DataFrame, keys: list[str], prediction: str, references: str) -> DataFrame:
    """(keys, exact, f1): the best exact match and token F1 over several references, all normalised beforehand."""
    each = rows.select(*keys, F.col(prediction).alias("__p"), F.posexplode(references).alias("__r", "__ref"))
    counts = common_counts(each, [*keys, "__p", "__ref"], words(F.col("__p")), words(F.col("__ref")))
    exact = F.max((F.col("__p") == F.col("__ref")).cast("int"))
    return counts.groupBy(*keys).agg(exact.alias("exact"), F.max(f1(F.col("both"), F.col("n_a"), F.col("n_b"))).alias("f1"))


def corpus_bleu(rows: DataFrame, keys: list[str], prediction: str, reference: str, order: int = 4) -> DataFrame:
    """One row (bleu, brevity, precisions): clipped n-gram matches summed over all pairs, geometric mean, brevity penalty;
    0 if some order has no match."""
    counts = rows.select(_common(order)(words(F.col(prediction)), words(F.col(reference))).alias("c"))
    sums = [F.struct(F.lit(n + 1).alias("n"), *[F.sum(F.col("c")[n][i]).alias(c) for i, c in enumerate(("n_a", "n_b", "both"))]) for n in range(order)]
    found = counts.agg(F.explode(F.array(*sums)).alias("x")).select("x.*")
    precision = F.when(F.col("n_a") > 0, F.col("both") / F.col("n_a")).otherwise(0.0)
    total = found.agg(F.array_sort(F.collect_list(F.struct("n", precision.alias("p")))).alias("x"), F.max(F.when(F.col("n") == 1, F.col("n_a"))).alias("a"), F.max(F.when(F.col("n") == 1, F.col("n_b"))).alias("b"))
    ps = F.transform("x", lambda s: s["p"])
    brevity = F.when(F.col("a") > F.col("b"), 1.0).when(F.col("a") > 0, F.exp(1 - F.col("b") / F.col("a"))).otherwise(0.0)
    mean = F.when(F.array_min(ps) > 0, F.exp(F.aggregate(ps, F.lit(0.0), lambda s, v: s + F.log(v)) / order)).otherwise(0.0)
    return total.select((brevity * mean).alias("bleu"), brevity.alias("brevity"), ps.alias("precisions"))
