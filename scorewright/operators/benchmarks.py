"""Aggregates of particular benchmark families, over long per-item tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.operators.aggregates import mean_weighted


def skill_accuracy(rows: DataFrame, skills: str, score: str, weight: str) -> DataFrame:
    """(skill, accuracy, n): an item counts for every skill it lists, and once for Overall."""
    each = rows.select(F.explode(F.concat(F.array(F.lit("Overall")), F.array_distinct(skills))).alias("skill"), score, weight)
    return each.groupBy("skill").agg(mean_weighted(score, weight).alias("accuracy"), F.count("*").alias("n"))


def skill_accuracy_by_name(rows: DataFrame, listed: str, names: list[str], score: str) -> DataFrame:
    """(skill, accuracy, n): an item counts for each of a short list of names that its text contains."""
    hit = F.filter(F.array(*map(F.lit, names)), lambda s: F.contains(F.col(listed), s))
    return rows.select(F.explode(hit).alias("skill"), score).groupBy("skill").agg(F.avg(score).alias("accuracy"), F.count("*").alias("n"))


def accuracy_plus(rows: DataFrame, category: str, item: str, hit: str) -> DataFrame:
    """(category, acc, acc_plus, score): the share of right questions, of items with all right, and their sum."""
    items = rows.groupBy(category, item).agg(F.sum(hit).alias("h"), F.count(hit).alias("n"), F.min(hit).alias("all"))
    out = items.groupBy(category).agg((F.sum("h") / F.sum("n")).alias("acc"), F.avg("all").alias("acc_plus"))
    return out.withColumn("score", F.col("acc") + F.col("acc_plus"))


def figure_question_accuracy(rows: DataFrame, category: str, figure: str, question: str, hit: str) -> DataFrame:
    """(category, a_acc, f_acc, q_acc): answers, figures with every answer right, and questions with every answer right."""
    whole = lambda key, name: rows.groupBy(category, key).agg(F.min(hit).alias("h")).groupBy(category).agg(F.avg("h").alias(name))
    return rows.groupBy(category).agg(F.avg(hit).alias("a_acc")).join(whole(figure, "f_acc"), category).join(whole(question, "q_acc"), category)


def page_edit(rows: DataFrame, page: str, prediction: str, reference: str) -> DataFrame:
    """One row: edits over the longer lengths for each page, averaged over pages; two empty texts don't differ."""
    pages = rows.groupBy(page).agg(F.sum(F.levenshtein(prediction, reference)).alias("e"), F.sum(F.greatest(F.length(prediction), F.length(reference))).alias("n"))
    return pages.agg(F.avg(F.when(F.col("n") > 0, F.col("e") / F.col("n")).otherwise(0.0)).alias("edit_distance"), F.count("*").alias("n_pages"))


def micro_ratio(weights: DataFrame, pages: DataFrame, key: str, total: str, count: str) -> DataFrame:
    """One row: the weighted sum of totals over the weighted sum of counts; a page without results counts as zero."""
    both = weights.join(pages, key, "left")
    w = F.col("weight")
    return both.agg((F.sum(w * F.coalesce(total, F.lit(0.0))) / F.sum(w * F.coalesce(count, F.lit(0)))).alias("ratio"), F.count("*").alias("n"))


def grouped_macro(rows: DataFrame, group: str, parts: dict[str, list[str]], score: str, weight: str) -> DataFrame:
    """(part, score, n_groups, complete): the mean over a part's groups of their weighted means; null while a group lacks
    rows."""
    means = rows.groupBy(group).agg(mean_weighted(score, weight).alias("m"))
    out = None
    for name, groups in parts.items():
        own = means.where(F.col(group).isin(groups)).agg(F.avg("m").alias("s"), F.count("m").alias("n_groups"))
        own = own.select(F.lit(name).alias("part"), F.when(F.col("n_groups") == len(groups), F.col("s")).alias("score"), "n_groups", (F.col("n_groups") == len(groups)).alias("complete"))
        out = own if out is None else out.unionByName(own)
    return out


def step_accuracy(rows: DataFrame, problem: str, selected: Column, score: str, weight: str) -> DataFrame:
    """One row: weighted accuracy of the selected steps, and the share of problems all right of those with every step
    selected."""
    steps = rows.where(selected).agg(mean_weighted(score, weight).alias("step_accuracy"))
    whole = rows.groupBy(problem).agg(F.min(selected.cast("int")).alias("complete"), F.min(score).alias("right")).where("complete = 1")
    return steps.crossJoin(whole.agg(F.avg("right").alias("problem_accuracy"), F.count("*").alias("n_problems")))


def judge_agreement(rows: DataFrame, model: str, score: str, reference: str) -> DataFrame:
    """(model, rank_difference, score_difference): how far a judge's ranks and scores lie from the reference's; ranks by
    falling score, then name. rows has a line for each model."""
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc(c), model))
    return rows.select(model, F.abs(rank(score) - rank(reference)).cast("long").alias("rank_difference"), F.abs(F.col(score) - F.col(reference)).alias("score_difference"))


def log_weighted_mean(rows: DataFrame, updates: str, accuracy: str, base: float = 10.0) -> DataFrame:
    """One row: accuracies weighted by the logarithm of their number of updates, 2 at least."""
    w = F.log(F.greatest(F.col(updates), F.lit(2)).cast("double")) / F.log(F.lit(base))
    return rows.agg((F.sum(w * F.col(accuracy)) / F.sum(w)).alias("score"), F.count("*").alias("n"))


def consensus_score(answers: Column, answer: Column) -> Column:
    """Against ten or so reference answers: the mean over leaving one out of min(1, matches / 3)."""
    n = F.size(answers)
    matches = F.size(F.filter(answers, lambda a: a == answer))
    total = F.aggregate(answers, F.lit(0.0), lambda s, a: s + F.least(F.lit(1.0), (matches - (a == answer).cast("int")) / 3.0))
    return F.when(n > 0, total / n)
