"""Seeded sampling and resampling without a random state: draws are hashes of seed and key, the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in (0, 1) from 32 bits of the MD5 of seed and keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0


def sample_rows(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows with the smallest draws, in their order."""
    return rows.withColumn("__u", uniform(seed, key)).orderBy("__u", key).limit(n).drop("__u")


def weighted_sample(rows: DataFrame, key: str, weight: str | Column, n: int, seed: int = 0) -> DataFrame:
    """n rows without return, each next one in proportion to its weight; rows without a positive weight never."""
    w = F.col(weight) if isinstance(weight, str) else weight
    return rows.where(w > 0).withColumn("__k", F.round(-F.log(uniform(seed, key)) / w, 12)).orderBy("__k", key).limit(n).drop("__k")


def split_rows(rows: DataFrame, share: float, seed: int, *keys: str) -> DataFrame:
    """rows with train: whether a draw is below the share."""
    return rows.withColumn("train", uniform(seed, *keys) < share)


def bootstrap_mean(rows: DataFrame, key: str, value: str, rounds: int = 100, seed: int = 0, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """One row: the mean and a percentile interval over rounds of Poisson weights, the limit of drawing with return.

    A row's weights come from draws of its key, and rounds are summed before anything is shuffled.
    """
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    each = rows.select(key, value).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("u", uniform(seed, key, "round"))
    weight = sum((F.when(F.col("u") > s, 1).otherwise(0) for s in steps), F.lit(0))
    means = each.withColumn("w", weight).groupBy("round").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    interval = means.agg(F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(high)).alias("high"))
    return rows.agg(F.avg(value).alias("mean"), F.count(value).alias("n")).crossJoin(F.broadcast(interval))


def unique_names(rows: DataFrame, name: str, root: str) -> DataFrame:
    """rows with a unique name: a second row of a name in root order gets the root and its number attached."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(root))
    return rows.withColumn("__n", n).withColumn("unique_name", F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat_ws("@@", F.col(name), F.col(root).cast("string"), F.col("__n").cast("string")))).drop("__n")


def position_bias(rows: DataFrame, question: str, order: str | Column, verdict: str, banned: str) -> DataFrame:
    """One row: of questions judged twice, how often the second verdict repeats the first, not counting the banned one."""
    w = Window.partitionBy(question).orderBy(order)
    seen = rows.withColumn("__n", F.row_number().over(w)).withColumn("__first", F.first_value(verdict).over(w)).where("__n = 2")
    same = (F.col(verdict) == F.col("__first")) & (F.col(verdict) != banned)
    return seen.agg(F.count("*").alias("n_pairs"), F.sum(same.cast("long")).alias("n_biased"))
