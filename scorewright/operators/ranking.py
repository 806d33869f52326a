"""Ranks, fidelity of subset scores, allocation and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal_rank(rows: DataFrame, score: str, tie: str, *keys: str) -> DataFrame:
    """rank 1 for the highest score, ties by `tie`, over all rows or within keys.

    rows hold one line for each model, so the window over all of them is small.
    """
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie)))


def fidelity(rows: DataFrame, full: str, part: str, tie: str) -> DataFrame:
    """One row: MAE and RMSE of part against full, and Spearman's correlation of ordinal ranks."""
    both = rows.withColumn("a", F.row_number().over(Window.orderBy(F.desc(full), tie))).withColumn("b", F.row_number().over(Window.orderBy(F.desc(part), tie)))
    error = F.col(part) - F.col(full)
    return both.agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.corr("a", "b").alias("spearman"), F.count("*").alias("n"))


def average_rank(value: str, *keys: str) -> Column:
    """Ascending rank with ties averaged."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*keys, value)) - 1) / 2.0


def auc_roc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: the area under the ROC curve by the rank sum, ties averaged.

    Ranks come from counts of distinct scores, so the ordered window holds those only.
    """
    c = rows.groupBy(score).agg(F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = c.withColumn("rank", below + (F.col("n") + 1) / 2.0)
    p, q = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return r.agg(((F.sum(F.col("pos") * F.col("rank")) - p * (p + 1) / 2.0) / (p * q)).alias("auc"), p.alias("n_pos"), q.alias("n_neg"))


def allocate(groups: DataFrame, key: str, size: str, ratio: float) -> DataFrame:
    """Anchors for each group: the floor of its share, at least 1, then one step by the largest remainders, one pass.

    groups has a row for each task; the target is the rounded (half to even) share of all items.
    """
    all_ = Window.partitionBy()
    g = groups.withColumn("exact", F.col(size) * ratio).withColumn("base", F.greatest(F.floor("exact"), F.lit(1)))
    g = g.withColumn("frac", F.round(F.col("exact") - F.floor("exact"), 9)).withColumn("delta", F.bround(F.sum(size).over(all_) * ratio) - F.sum("base").over(all_))
    g = g.withColumn("up", F.row_number().over(Window.orderBy(F.desc("frac"), key))).withColumn("down", F.row_number().over(Window.orderBy("frac", key)))
    n = F.when((F.col("delta") > 0) & (F.col("up") <= F.col("delta")), F.col("base") + 1).when((F.col("delta") < 0) & (F.col("down") <= -F.col("delta")), F.greatest(F.col("base") - 1, F.lit(1))).otherwise(F.col("base"))
    return g.select(key, size, n.cast("long").alias("n_anchors"))


def uniform_bin(accuracy: Column, bins: int, low: float = 0.0, high: float = 1.0) -> Column:
    """The bin [low, high) of an accuracy, the last one closed."""
    return F.least(F.floor((accuracy - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")


def merge_intervals(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end): overlapping or touching intervals of a key joined.

    Rows without start and end fall to the last interval of their key; if it has none, each stays by itself, as nulls.
    """
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = rows.withColumn("__new", F.when(far.isNull() | (F.col(start) > far), 1).otherwise(0))
    # both windows go over one sort of the rows, so of equal rows the first is new in either
    island = new.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(key, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("__island")


def interval_iou(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, iou) of two merged interval lists (key, start, end), keys of either; null for a key of nulls."""
    a, b = left.alias("a"), right.alias("b")
    cut = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")))
    inter = cut.groupBy(F.col(f"a.{key}").alias(key)).agg(F.sum(F.least("a.end", "b.end") - F.greatest("a.start", "b.start")).alias("inter"))
    size = left.unionByName(right).groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("total"))
    out = size.join(inter, key, "left").withColumn("inter", F.coalesce("inter", F.lit(0.0)))
    union = F.col("total") - F.col("inter")
    return out.select(key, F.when(union > 0, F.col("inter") / union).when(union.isNotNull(), 0.0).alias("iou"))
