"""Breakdowns and curves that particular reports need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.operators.aggregates import binary_scores, mean_weighted

#: Groups of the categories of a hallucination benchmark. Fixed values.
HALLUCINATION_GROUPS = {
    "discriminative-attribute-state": "Attribute",
    "discriminative-attribute-number": "Attribute",
    "discriminative-attribute-action": "Attribute",
    "discriminative-hallucination": "Existence",
    "discriminative-relation": "Relation",
    "relation": "Relation",
}


def category_average(rows: DataFrame, category: str, score: str, groups: dict[str, str] | None = None) -> DataFrame:
    """(category, accuracy) in percent by category, renamed by groups, and their plain mean as Avg ACC."""
    name = F.col(category)
    if groups:
        name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in groups.items() for x in kv]), name), name)
    per = rows.groupBy(name.alias("category")).agg((100 * F.avg(score)).alias("accuracy"))
    return per.unionByName(per.agg(F.lit("Avg ACC").alias("category"), F.avg("accuracy").alias("accuracy")))


def overall_and_categories(rows: DataFrame, score: str, *categories: str) -> DataFrame:
    """(level, value, accuracy) in percent: overall, then by each of the category columns, nulls left out."""
    out = rows.agg(F.lit("Overall").alias("level"), F.lit("Overall").alias("value"), (100 * F.avg(score)).alias("accuracy"))
    for c in categories:
        out = out.unionByName(rows.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg((100 * F.avg(score)).alias("accuracy")).select(F.lit(c).alias("level"), "value", "accuracy"))
    return out


def listed_category_f1(rows: DataFrame, categories: str, truth: Column, predicted: Column) -> DataFrame:
    """(split, accuracy, precision, recall, f1) for each category of a comma-separated list and Overall, which counts an
    item once for each category it lists."""
    each = rows.withColumn("__t", truth).withColumn("__p", predicted).withColumn("split", F.explode(F.split(categories, ",")))
    t, p = F.col("__t"), F.col("__p")
    cols = ["split", "accuracy", "precision", "recall", "f1"]
    overall = binary_scores(each, t, p).withColumn("split", F.lit("Overall")).select(*cols)
    return overall.unionByName(binary_scores(each, t, p, "split").select(*cols))


def contamination_classes(rows: DataFrame, kind: str, score: str) -> DataFrame:
    """(kind, accuracy, n): accuracies in percent of clean items, of those whose input, and whose input and label were seen,
    and of all."""
    agg = [(100 * F.avg(score)).alias("accuracy"), F.count("*").alias("n")]
    return rows.groupBy(kind).agg(*agg).unionByName(rows.agg(F.lit("all").alias(kind), *agg))


def precision_recall_curve(rows: DataFrame, truth: str, score: str, *keys: str) -> DataFrame:
    """(keys, score, precision, recall) at each distinct score from the highest: running sums over counts of distinct
    scores, within keys."""
    c = rows.groupBy(*keys, score).agg(F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tp, n = F.sum("pos").over(w), F.sum("n").over(w)
    total = F.sum("pos").over(Window.partitionBy(*keys))
    return c.select(*keys, score, (tp / n).alias("precision"), F.when(total > 0, tp / total).otherwise(0.0).alias("recall"))


def section_averages(rows: DataFrame, order: str, header: Column, value: str, table: str) -> DataFrame:
    """(table, section, average, n): rows between headers belong to the header before; a table's rows are few."""
    w = Window.partitionBy(table).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("__h", header.cast("int")).withColumn("section", F.sum("__h").over(w))
    return out.where("__h = 0").groupBy(table, "section").agg(F.avg(value).alias("average"), F.count(value).alias("n"))


def highlighted(rows: DataFrame, row: str, value: str, epsilon: float = 1e-6) -> DataFrame:
    """rows with best: within epsilon of the row's highest value."""
    return rows.withColumn("best", F.coalesce(F.max(value).over(Window.partitionBy(row)) - F.col(value) <= epsilon, F.lit(False)))


def weakest_token_mean(rows: DataFrame, text: str, logprob: str, share: float = 0.2) -> DataFrame:
    """(text, min_k): minus the mean of the lowest share of a text's token log probabilities, at least one of them."""
    lists = rows.groupBy(text).agg(F.array_sort(F.collect_list(logprob)).alias("x"))
    k = F.greatest(F.floor(F.size("x") * share), F.lit(1)).cast("int")
    return lists.select(text, (-F.aggregate(F.slice("x", F.lit(1), k), F.lit(0.0), lambda s, v: s + v) / k).alias("min_k"))


def reference_scores(matches: Column, dataset: str, threshold: float = 0.5) -> Column:
    """One score from the matches with several references, by the data set's kind: the mean, the best edit score above a
    threshold, or the best."""
    mean = F.aggregate(matches, F.lit(0.0), lambda s, v: s + v) / F.size(matches)
    if any(k in dataset for k in ("DocVQA", "InfoVQA")):
        best = 1 - F.array_min(matches)
        return F.when(best < threshold, 0.0).otherwise(best)
    if any(k in dataset for k in ("ChartQA", "OCRVQA")):
        return F.array_max(matches)
    return mean


def page_instances(rows: DataFrame, instance: str, value: str) -> DataFrame:
    """(page, total, count) of instances named <page>_[idx]."""
    page = F.regexp_extract(instance, "^(.*)_\\[?[0-9]+\\]?$", 1)
    return rows.groupBy(page.alias("page")).agg(F.sum(value).alias("total"), F.count(value).alias("count"))


def weighted_with_missing(weights: DataFrame, found: DataFrame, key: str, value: str, missing: float) -> DataFrame:
    """One row: the weighted mean over the weights' items; an item without a value has the missing one."""
    both = weights.join(found.select(key, value), key, "left")
    return both.agg(mean_weighted(F.coalesce(F.col(value), F.lit(missing)), F.col("weight")).alias("score"), F.sum(F.col(value).isNull().cast("long")).alias("n_missing"))


def rollout_totals(rows: DataFrame, logprob: str, tokens: str, reason: str) -> DataFrame:
    """(finish_reason, n, tokens, neg_logprob) of rollouts by how they ended, and overall (null)."""
    agg = [F.count("*").alias("n"), F.sum(tokens).alias("tokens"), (-F.sum(logprob)).alias("neg_logprob")]
    name = F.col(reason).alias("finish_reason")
    return rows.groupBy(name).agg(*agg).unionByName(rows.agg(F.lit(None).cast("string").alias("finish_reason"), *agg))


def filled_pivot(rows: DataFrame, row: str, column: str, names: list[str], score: str, fill: float = 0.0) -> DataFrame:
    """A row a subject with a mean for each setting, missing ones filled, and the mean of the row."""
    wide = rows.groupBy(row).pivot(column, names).agg(F.avg(score)).na.fill(fill, names)
    return wide.withColumn("row_mean", sum((F.col(f"`{n}`") for n in names[1:]), F.col(f"`{names[0]}`")) / len(names))


def style_features(battles: DataFrame, variables: dict[str, tuple[str, str]]) -> DataFrame:
    """battles with a feature for each variable (counts of both sides): (a - b) / (a + b + 1), standardised to deviation 1
    over all battles."""
    raw = {v: (F.col(a) - F.col(b)) / (F.col(a) + F.col(b) + 1.0) for v, (a, b) in variables.items()}
    rows = battles.withColumns({f"__{v}": c for v, c in raw.items()})
    stats = rows.agg(*[F.avg(f"__{v}").alias(f"__m_{v}") for v in variables], *[F.stddev_pop(f"__{v}").alias(f"__d_{v}") for v in variables])
    wide = rows.crossJoin(F.broadcast(stats))
    scaled = {v: (F.col(f"__{v}") - F.col(f"__m_{v}")) / F.when(F.col(f"__d_{v}") > 0, F.col(f"__d_{v}")).otherwise(1.0) for v in variables}
    return wide.select(*battles.columns, *[c.alias(v) for v, c in scaled.items()])
