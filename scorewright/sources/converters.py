"""Benchmark-native scores as (item, score, missing) against a universe of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The score of A for a judge's verdict. Fixed values.
VERDICTS = {"A>>B": 1.0, "A>B": 0.75, "A=B": 0.5, "B>A": 0.25, "B>>A": 0.0}


def verdict_score(text: Column, evaluated_is_b: Column) -> Column:
    """A judge's bracketed verdict as the evaluated side's score; null if there is none, or none known."""
    found = F.regexp_extract(text, "\\[\\[([AB<>=]+)\\]\\]", 1)
    score = F.lit(None).cast("double")
    for k, v in VERDICTS.items():
        score = F.when(found == k, v).otherwise(score)
    return F.when(evaluated_is_b, 1.0 - score).otherwise(score)


def game_scores(games: DataFrame, item: str, text: str, evaluated_is_b: str) -> DataFrame:
    """(item, score): the mean of an item's games that have a verdict, 0 without one."""
    return games.groupBy(item).agg(F.coalesce(F.avg(verdict_score(F.col(text), F.col(evaluated_is_b))), F.lit(0.0)).alias("score"))


def fill_missing(scores: DataFrame, universe: DataFrame, item: str, worst: float = 0.0) -> DataFrame:
    """universe's rows with score and missing: an item without a score gets the worst one."""
    both = universe.join(scores.select(item, "score"), item, "left")
    return both.select(*universe.columns, F.coalesce("score", F.lit(worst)).alias("score"), F.col("score").isNull().alias("missing"))


def unknown_items(scores: DataFrame, universe: DataFrame, item: str) -> DataFrame:
    """Scores of items that the universe lacks, and items with two scores: both are faults."""
    lost = scores.join(universe.select(item), item, "left_anti").select(F.lit("unknown").alias("fault"), item)
    return lost.unionByName(scores.groupBy(item).count().where("count > 1").select(F.lit("duplicate").alias("fault"), item))


def edit_to_score(distance: Column) -> Column:
    """An edit distance of 0 to 1 as a score; a missing page counts as 1."""
    return 1.0 - F.least(F.greatest(F.coalesce(distance, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))


def drop_ignored(rows: DataFrame, item: str, ignored: str) -> DataFrame:
    """rows without the items that any model's record flags as ignored."""
    flagged = rows.where(F.col(ignored)).select(item).distinct()
    return rows.join(flagged, item, "left_anti")
