"""Weighted, grouped and nested aggregates over long score tables.

Everything is one or two declarative group-bys; sums are combined before the shuffle, and no operator collects rows.
Missing scores stay null until the operator's own rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_weighted(score: str | Column, weight: str | Column) -> Column:
    """Sum of w*s by sum of w; null if there is no positive weight."""
    s, w = (F.col(x) if isinstance(x, str) else x for x in (score, weight))
    return F.when(F.sum(w) > 0, F.sum(s * w) / F.sum(w))


def trial_means(trials: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """One row for each key with the mean of its trials that have a score, and their number."""
    return trials.groupBy(*keys).agg(F.avg(score).alias(score), F.count(score).alias("n_trials"))


def subset_estimate(scores: DataFrame, subset: DataFrame, item: str, model: str, models: DataFrame, policy: str = "zero") -> DataFrame:
    """The full-score estimate of each model from a weighted subset of items.

    scores: (model, item, score); subset: (item, weight). Missing items count as zero and the weights are never
    renormalised; with policy "fail" a model with a missing item has a null estimate.
    """
    grid = models.select(model).distinct().crossJoin(F.broadcast(subset.groupBy().agg(F.sum("weight").alias("w_all"), F.count("*").alias("n_all"))))
    got = scores.join(subset, item).groupBy(model).agg(F.sum(F.col("score") * F.col("weight")).alias("ws"), F.count("score").alias("n_scored"))
    out = grid.join(got, model, "left").withColumn("n_scored", F.coalesce("n_scored", F.lit(0)))
    estimate = F.coalesce("ws", F.lit(0.0)) / F.col("w_all")
    if policy == "fail":
        estimate = F.when(F.col("n_scored") == F.col("n_all"), estimate)
    elif policy != "zero":
        raise ValueError(f"unknown policy {policy!r}")
    return out.select(model, estimate.alias("estimate"), "n_scored", (F.col("n_all") - F.col("n_scored")).alias("n_missing"))


def grouped_report(rows: DataFrame, split: str, groups: Sequence[str], score: str, weight: str | None = None) -> DataFrame:
    """Means for each split overall and by each of the groups, by grouping sets: (split, level, value, score, n)."""
    value = mean_weighted(score, weight) if weight else F.avg(score)
    named = rows.select(split, *groups, score, *([weight] if weight else []))
    sets = [[split], *([split, g] for g in groups)]
    out = named.groupingSets([[F.col(c) for c in s] for s in sets], split, *groups).agg(value.alias("score"), F.count(score).alias("n"), F.grouping_id().alias("gid"))
    level = F.lit("overall")
    for k, g in enumerate(groups):
        # a grouping column's bit is 0 where it is grouped by
        bit = len(groups) - 1 - k
        level = F.when(F.col("gid").bitwiseAND(F.lit(1 << bit)) == 0, F.lit(g)).otherwise(level)
    out = out.withColumn("level", level)
    picked = reduce(lambda acc, g: F.when(F.col("level") == g, F.col(g).cast("string")).otherwise(acc), groups, F.lit(None).cast("string"))
    return out.select(F.col(split), "level", F.coalesce(picked, F.lit("*")).alias("value"), "score", "n")


def group_breakdown(rows: DataFrame, group: str, score: str, weight: str) -> DataFrame:
    """Weighted and plain mean, count and weight of each value."""
    return rows.groupBy(group).agg(mean_weighted(score, weight).alias("weighted"), F.avg(score).alias("unweighted"), F.count("*").alias("n"), F.sum(weight).alias("weight_sum"))


def macro_micro(rows: DataFrame, task: str, score: str, weight: str) -> DataFrame:
    """One row: the mean over tasks of their weighted means, and the weighted mean over all items."""
    tasks = rows.groupBy(task).agg(F.sum(F.col(score) * F.col(weight)).alias("ws"), F.sum(weight).alias("w"))
    return tasks.agg(F.avg(F.when(F.col("w") > 0, F.col("ws") / F.col("w"))).alias("macro"), (F.sum("ws") / F.sum("w")).alias("micro"), F.count("*").alias("n_tasks"))


def nested_macro(rows: DataFrame, outer: str, inner: str, score: str) -> DataFrame:
    """The mean over inner groups of their means, for each outer group, and in turn over outer groups (outer null)."""
    tasks = rows.groupBy(outer, inner).agg(F.avg(score).alias("s"))
    per = tasks.groupBy(outer).agg(F.avg("s").alias("score"), F.count("*").alias("n_groups"))
    return per.unionByName(per.agg(F.lit(None).cast(rows.schema[outer].dataType).alias(outer), F.avg("score").alias("score"), F.sum("n_groups").alias("n_groups")))


def summary_groups(rows: DataFrame, group: str, score: str, weight: str, expected: int | None = None) -> DataFrame:
    """Naive, weighted, sum, population deviation and harmonic summaries.

    The harmonic mean takes non-positive scores as 1. With `expected` a group short of so many members keeps its row,
    without scores and with a reason in the column error.
    """
    s = F.col(score)
    floor = F.when(F.min(s) <= 0, F.count("*") / F.sum(1 / F.when(s <= 0, F.lit(1.0)).otherwise(s))).otherwise(F.count("*") / F.sum(1 / s))
    out = rows.groupBy(group).agg(F.avg(s).alias("naive_average"), mean_weighted(score, weight).alias("weighted_average"), F.sum(s).alias("total"), F.stddev_pop(s).alias("standard_deviation"), floor.alias("harmonic_mean"), F.count(s).alias("n"))
    if expected is None:
        return out
    whole = F.col("n") == expected
    reason = F.when(~whole, F.concat(F.lit(f"of {expected} members there are "), F.col("n").cast("string")))
    return out.select(group, *[F.when(whole, F.col(c)).alias(c) for c in out.columns if c not in (group, "n")], "n", reason.alias("error"))


def graded_f1(rows: DataFrame, key: str, grade: str, weight: str, digits: int | None = None) -> DataFrame:
    """Grades A correct, B wrong, C not attempted: share correct, share correct of attempted, harmonic mean."""
    w = {g: F.sum(F.when(F.col(grade) == g, F.col(weight)).otherwise(0)) for g in "AB"}
    out = rows.groupBy(key).agg(w["A"].alias("a"), w["B"].alias("b"), F.sum(weight).alias("w"))
    acc = F.when(F.col("w") > 0, F.col("a") / F.col("w")).otherwise(0.0)
    given = F.when(F.col("a") + F.col("b") > 0, F.col("a") / (F.col("a") + F.col("b"))).otherwise(0.0)
    if digits is not None:
        acc, given = F.bround(acc, digits), F.bround(given, digits)
    out = out.select(key, acc.alias("accuracy"), given.alias("accuracy_given_attempted"))
    both = F.col("accuracy") + F.col("accuracy_given_attempted")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("accuracy") * F.col("accuracy_given_attempted") / both).otherwise(0.0))


def binary_scores(rows: DataFrame, truth: Column, predicted: Column, *keys: str) -> DataFrame:
    """Accuracy, precision, recall, F1 and the Matthews correlation of 0/1 columns, for each key."""
    c = {n: F.sum(F.when(x, 1).otherwise(0)).cast("double").alias(n) for n, x in (("tp", (truth == 1) & (predicted == 1)), ("fp", (truth == 0) & (predicted == 1)), ("fn", (truth == 1) & (predicted == 0)), ("tn", (truth == 0) & (predicted == 0)))}
    out = rows.groupBy(*keys).agg(*c.values()) if keys else rows.agg(*c.values())
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return out.select(*keys, ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(tp * tn - fp * fn, root).alias("mcc"))


def pair_accuracy(rows: DataFrame, pair: Column, hit: str, weight: str) -> DataFrame:
    """One row: the share of complete pairs with both hits, plain and weighted by the pair's summed weight."""
    pairs = rows.groupBy(pair.alias("pair")).agg(F.min(hit).alias("hit"), F.sum(weight).alias("w"), F.count("*").alias("n")).where("n = 2")
    return pairs.agg(F.avg("hit").alias("pair_accuracy"), mean_weighted("hit", "w").alias("weighted_pair_accuracy"), F.count("*").alias("n_pairs"))


def all_of(rows: DataFrame, key: str, hit: Column) -> DataFrame:
    """(key, n, n_hit, all_hit): whether every rotation of a question is right."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(hit.cast("int")).alias("n_hit"), F.min(hit.cast("int")).alias("all_hit"))


def majority_vote(rows: DataFrame, item: str, vote: str, seed: int = 0) -> DataFrame:
    """(item, n_votes, yes, voted): missing votes don't count; ties fall by a hash of seed and item."""
    out = rows.where(F.col(vote).isNotNull()).groupBy(item).agg(F.count("*").alias("n_votes"), F.sum(vote).alias("yes"))
    tie = F.pmod(F.crc32(F.concat_ws(":", F.lit(str(seed)), F.col(item).cast("string")).cast("binary")), F.lit(2))
    return out.withColumn("voted", F.when(2 * F.col("yes") > F.col("n_votes"), 1).when(2 * F.col("yes") < F.col("n_votes"), 0).otherwise(tie).cast("int"))


def fit_thresholds(rows: DataFrame, task: str, model: str, score: str, start: float = 0.01, end: float = 0.99, num: int = 100) -> DataFrame:
    """(task, threshold, loss): the cut that brings each model's share of scores strictly above it closest to its
    mean score, on average over models; the first of equal ones.

    Scores are counted by how many cuts they exceed. A running sum over a model's counts, from the highest, is the number
    above every cut down to the next count, so that each model has one row a cut.
    """
    step = (end - start) / (num - 1)
    grid = [start + step * k for k in range(num)]
    cuts = F.array(*[F.lit(x) for x in grid])
    guess = F.least(F.greatest(F.floor((F.col(score) - start) / step) - 1, F.lit(0)), F.lit(num)).cast("int")
    # the cuts below the guess are exceeded; rounding can be off by one, so three more are compared
    more = [F.coalesce((F.col(score) > F.try_element_at(cuts, F.col("__g") + i)).cast("int"), F.lit(0)) for i in (1, 2, 3, 4)]
    counts = rows.withColumn("__g", guess).groupBy(task, model, (F.col("__g") + sum(more)).alias("above")).agg(F.count("*").alias("n"), F.sum(score).alias("s"))
    down, whole = Window.partitionBy(task, model).orderBy(F.desc("above")), Window.partitionBy(task, model)
    runs = counts.select(
        task,
        "above",
        F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("over"),
        F.lead("above", 1, 0).over(down).alias("low"),
        F.lag("above").over(down).isNull().alias("top"),
        F.sum("n").over(whole).alias("n"),
        F.sum("s").over(whole).alias("s"),
    )

    def cut_rows(on: Column, low: Column, high: Column, over: Column) -> Column:
        return F.when(on, F.transform(F.sequence(low, high), lambda k: F.struct(k.alias("k"), over.cast("long").alias("over")))).otherwise(F.array().cast("array<struct<k:int,over:bigint>>"))

    above_all = cut_rows(F.col("top") & (F.col("above") < num), F.least("above", F.lit(num - 1)), F.lit(num - 1), F.lit(0))
    own = cut_rows(F.col("above") > F.col("low"), F.col("low"), F.greatest(F.col("above") - 1, F.col("low")), F.col("over"))
    each = runs.select(task, "n", "s", F.explode(F.concat(above_all, own)).alias("c")).select(task, "n", "s", "c.k", "c.over", F.element_at(cuts, F.col("c.k") + 1).alias("threshold"))
    loss = each.groupBy(task, "k", "threshold").agg(F.avg(F.abs(F.col("over") / F.col("n") - F.col("s") / F.col("n"))).alias("loss"))
    best = loss.groupBy(task).agg(F.min_by(F.struct("k", "threshold", "loss"), F.struct(F.round("loss", 12), "k")).alias("b"))
    return best.select(task, "b.threshold", "b.loss")


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k), as a running product; null if n < k."""
    miss = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda p, i: p * (1.0 - F.lit(float(k)) / i))
    return F.when(n < k, None).when(c <= 0, F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(1.0 - miss)


def _choose(n: Column, k: Column) -> Column:
    """The binomial coefficient as a double; 0 outside 0 <= k <= n."""
    product = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0), lambda p, i: p * (n - k + i) / i)
    return F.when((k < 0) | (k > n), 0.0).when(k == 0, 1.0).otherwise(product)


def g_pass_at_k(n: Column, c: Column, k: int, threshold: float) -> Column:
    """The chance that at least ceil(threshold * k), and at least one, of k draws without return are right."""
    m = max(1, -int(-threshold * k // 1))
    terms = F.transform(F.sequence(F.lit(m), F.lit(k)), lambda j: _choose(c, j) * _choose(n - c, F.lit(k) - j))
    return F.when(n < k, None).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / _choose(n, F.lit(k)))


def dense_matrix(scores: DataFrame, item: str, model: str, score: str, missing: float = 0.0) -> DataFrame:
    """Every item for every model; a missing cell has the default. Only the distinct ids are multiplied."""
    grid = scores.select(item).distinct().crossJoin(scores.select(model).distinct())
    return grid.join(scores.select(item, model, score), [item, model], "left").withColumn(score, F.coalesce(score, F.lit(missing)))


def common_items(scores: DataFrame, item: str, model: str) -> DataFrame:
    """Items that every model has."""
    n = scores.select(model).distinct().groupBy().agg(F.count("*").alias("n_models"))
    return scores.groupBy(item).agg(F.countDistinct(model).alias("n")).join(F.broadcast(n), F.col("n") == F.col("n_models")).select(item)


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
