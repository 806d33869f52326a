"""Ensembles of models whose accuracy falls into bins: by majority votes, or by mean scores.

Combinations are numbers whose bits are the candidates, the first one the highest, so that numbers of equal size in
falling order are combinations in their usual order. Candidates are few by nature: MOST bounds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewright.operators.ranking import uniform_bin

MOST = 20


def combinations(spark: SparkSession, n: int, descending: bool = False) -> DataFrame:
    """(combo, k, attempt) of all combinations of two or more of n candidates, attempts from 1: smallest first, or
    largest."""
    if n > MOST:
        raise ValueError(f"{n} candidates have too many combinations, {MOST} at most")
    rows = spark.range(1, 1 << n).select(F.col("id").alias("combo"), F.bit_count("id").cast("int").alias("k")).where("k >= 2")
    order = Window.orderBy(F.desc("k") if descending else F.asc("k"), F.desc("combo"))
    return rows.withColumn("attempt", F.row_number().over(order).cast("long"))


def member_bit(place: Column, n: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(n - 1) - place).cast("int"))


def members(spark: SparkSession, combos: DataFrame, n: int) -> DataFrame:
    """(combo, place) of each member."""
    places = spark.range(n).select(F.col("id").alias("place"))
    return combos.crossJoin(F.broadcast(places)).where(F.col("combo").bitwiseAND(member_bit(F.col("place"), n)) != 0)


def vote_accuracies(votes: DataFrame, combos: DataFrame, n: int, tie: Column) -> DataFrame:
    """(combo, k, attempt, accuracy) of majority votes over the items that a member has a vote for; missing votes don't
    count. votes: (item, place, vote 0 or 1); tie: the vote where both sides are equal, from item and attempt.

    An item's votes are two bit sets, so a combination is a few bit counts a row and nothing but sums is shuffled.
    """
    bit = member_bit(F.col("place"), n)
    items = votes.where("vote is not null").groupBy("item").agg(F.sum(bit).alias("__has"), F.sum(F.when(F.col("vote") == 1, bit).otherwise(0)).alias("__yes"))
    has, yes = (F.bit_count(F.col(c).bitwiseAND(F.col("combo"))) for c in ("__has", "__yes"))
    both = items.crossJoin(F.broadcast(combos)).select("combo", "k", "attempt", "item", has.alias("h"), yes.alias("y")).where("h > 0")
    right = F.when(2 * F.col("y") > F.col("h"), 1).when(2 * F.col("y") < F.col("h"), 0).otherwise(tie.cast("int"))
    return both.groupBy("combo", "k", "attempt").agg(F.avg(right).alias("accuracy"))


def fill_bins(votes: DataFrame, n: int, bins: int, low: float, high: float, tie: Column, descending: bool = False) -> DataFrame:
    """(bin, combo, k, attempt, accuracy): for each bin of [low, high] the first combination, in the order of attempts,
    whose majority votes fall into it.

    One size of combinations after the other, until every bin is filled: a round brings at most a row a bin to the driver.
    """
    spark = votes.sparkSession
    every = combinations(spark, n, descending)
    filled: list[tuple] = []
    for k in range(n, 1, -1) if descending else range(2, n + 1):
        found = vote_accuracies(votes, every.where(F.col("k") == k), n, tie)
        inside = found.where(F.round("accuracy", 12).between(low, high)).withColumn("bin", uniform_bin(F.round("accuracy", 12), bins, low, high))
        first = inside.groupBy("bin").agg(F.min_by(F.struct("combo", "k", "attempt", "accuracy"), "attempt").alias("r")).select("bin", "r.*")
        have = {r[0] for r in filled}
        filled += [tuple(r) for r in first.collect() if r[0] not in have]
        if len(filled) == bins:
            break
    return spark.createDataFrame(filled, "bin long, combo long, k int, attempt long, accuracy double")


def mean_bins(scores: DataFrame, bins: int) -> DataFrame:
    """(bin, combo, k, accuracy, names) of ensembles that average their members' scores over the items all models have:
    for each bin of the models' own range the one closest to its centre, of the sizes up to the first that leaves no bin
    empty; the smaller and earlier one on ties. scores: (model, item, score); models are ordered by their score.

    The mean of an ensemble is the mean of its members' means, so a row a model is all that is combined.
    """
    spark = scores.sparkSession
    n = scores.select("model").distinct().count()
    own = scores.groupBy("model").agg(F.avg("score").alias("own"))
    common = scores.groupBy("item").agg(F.countDistinct("model").alias("m")).where(F.col("m") == n).select("item")
    means = scores.join(common, "item").groupBy("model").agg(F.avg("score").alias("mean")).join(own, "model")
    places = means.withColumn("place", (F.row_number().over(Window.orderBy("own", "model")) - 1).cast("long"))  # a row a model
    span = own.agg(F.min("own").alias("low"), F.max("own").alias("high"))
    each = members(spark, combinations(spark, n), n).join(F.broadcast(places), "place")
    acc = each.groupBy("combo", "k", "attempt").agg(F.round(F.avg("mean"), 12).alias("accuracy"), F.transform(F.array_sort(F.collect_list(F.struct("place", "model"))), lambda s: s["model"].cast("string")).alias("names"))
    acc = acc.crossJoin(F.broadcast(span)).where("accuracy between round(low, 12) and round(high, 12)")
    width = (F.col("high") - F.col("low")) / bins
    acc = acc.withColumn("bin", F.least(F.floor((F.col("accuracy") - F.round("low", 12)) / width), F.lit(bins - 1)).cast("long"))
    distance = F.round(F.abs(F.col("accuracy") - (F.col("low") + (F.col("bin") + 0.5) * width)), 12)
    acc = acc.withColumn("distance", distance)
    # the size at which the last bin gets its first ensemble ends the search
    last = acc.groupBy("bin").agg(F.min("k").alias("k0")).agg(F.max("k0").alias("last"), F.count("*").alias("bins"))
    inside = acc.crossJoin(F.broadcast(last)).where((F.col("bins") < bins) | (F.col("k") <= F.col("last")))
    best = inside.groupBy("bin").agg(F.min_by(F.struct("combo", "k", "accuracy", "names"), F.struct("distance", "attempt")).alias("r"))
    return best.select("bin", "r.*")
