"""Joins that must fit: subsets against data sets, predictions against references, records of several models.

Where the rule is that a gap is an error, the gap raises when the rows are read: the check is part of the plan, nothing
is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.operators.lineage import cut


def require(rows: DataFrame, holds: Column, message: Column) -> DataFrame:
    """rows; reading one for which the condition isn't true raises the message. A filter, so that no choice of columns
    drops the check."""
    return rows.where(F.when(F.coalesce(holds, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean")))


def _said(text: str, value: str) -> Column:
    return F.concat(F.lit(f"{text}: "), F.coalesce(F.col(value).cast("string"), F.lit("null")))


def select_by_position(data: DataFrame, spec: DataFrame, position: str = "index", item: str = "id") -> DataFrame:
    """The rows of data at the spec's positions with its weight and its order (column place), for which positions must be
    unique and known and the ids of both sides the same; a missing weight is an error, too.

    data has its positions in `position` and ids in `item`; spec (position, item, weight), in the order of place.
    """
    n = F.count("*").over(Window.partitionBy(position))
    wanted = spec.select(position, F.col(item).cast("string").alias("__id"), "weight", "place").withColumn("__n", n)
    both = wanted.join(data.withColumn("__known", F.lit(True)), position, "left")
    both = require(both, F.col("__n") == 1, _said("position given twice", position))
    both = require(both, F.coalesce("__known", F.lit(False)), _said("no such position", position))
    both = require(both, F.col("__id").isNull() | (F.col("__id") == F.col(item).cast("string")), _said("another id at position", position))
    both = require(both, F.col("weight") >= 0, _said("no weight at position", position))
    return both.select(*data.columns, "weight", "place")


def select_by_value(data: DataFrame, spec: DataFrame, key: str = "index") -> DataFrame:
    """The rows of data whose key the spec names, with its weight; keys are compared as text, and a key that data lacks,
    that the spec repeats or that has no weight raises. Rows keep the order of data's own columns."""
    n = F.count("*").over(Window.partitionBy("__key"))
    wanted = spec.select(F.col(key).cast("string").alias("__key"), "weight").withColumn("__n", n)
    both = wanted.join(data.withColumn("__known", F.lit(True)).withColumn("__key", F.col(key).cast("string")), "__key", "left")
    both = require(both, F.col("__n") == 1, _said("key given twice", "__key"))
    both = require(both, F.coalesce("__known", F.lit(False)), _said("no such key", "__key"))
    both = require(both, F.col("weight") >= 0, _said("no weight for key", "__key"))
    return both.select(*data.columns, "weight")


def attach_weights(scored: DataFrame, spec: DataFrame, key: str) -> DataFrame:
    """scored with weight; a scored row outside the spec and a spec's row without a score raise."""
    both = scored.withColumn("__scored", F.lit(True)).join(spec.select(key, "weight", F.lit(True).alias("__wanted")), key, "full_outer")
    both = require(both, F.coalesce("__wanted", F.lit(False)), _said("scored but not in the subset", key))
    both = require(both, F.coalesce("__scored", F.lit(False)), _said("in the subset but not scored", key))
    return both.select(*scored.columns, "weight")


def same_items(records: DataFrame, item: str, model: str) -> DataFrame:
    """records, in which every model must have every item once; a gap or a second row raises."""
    models = records.select(model).distinct().groupBy().agg(F.count("*").alias("__models"))
    per = records.groupBy(item).agg(F.count("*").alias("__rows"), F.countDistinct(model).alias("__has")).crossJoin(F.broadcast(models))
    per = require(per, (F.col("__has") == F.col("__models")) & (F.col("__rows") == F.col("__models")), _said("not once for each model", item))
    return records.join(per.select(item), item)


def zipped(predictions: DataFrame, references: DataFrame, place: str) -> DataFrame:
    """Predictions beside references by an explicit place; a place that only one side has raises."""
    both = predictions.withColumn("__p", F.lit(True)).join(references.withColumn("__r", F.lit(True)), place, "full_outer")
    both = require(both, F.col("__p") & F.col("__r"), _said("only one side has place", place))
    return both.drop("__p", "__r")


def joined_scores(tables: Sequence[DataFrame], key: str, complete: bool = True) -> DataFrame:
    """Several score tables side by side by key, each with its own columns; only complete rows, or all."""
    out = reduce(lambda a, b: a.join(b, key, "full_outer"), tables)
    return out.na.drop() if complete else out


def id_order(rows: DataFrame, item: str) -> DataFrame:
    """rows with item_order: ids by number if all of them are numbers, else by text.

    Distinct ids are dealt into ranges of that order and written; a range's first rank is the number of ids before it, so
    windows run within ranges, and only the counts of ranges, a row a partition, are summed in one place.
    """
    number = F.col(item).cast("string").try_cast("double")
    ids = rows.select(item).distinct()
    all_numbers = F.broadcast(ids.agg(F.min(number.isNotNull()).alias("__all")))  # one row
    keyed = ids.crossJoin(all_numbers).select(item, F.when(F.col("__all"), number).alias("__x"), F.col(item).cast("string").alias("__y"))
    dealt = cut(keyed.repartitionByRange("__x", "__y").withColumn("__range", F.spark_partition_id()))
    before = F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")
    first = F.broadcast(dealt.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", before.alias("__first")))
    place = F.row_number().over(Window.partitionBy("__range").orderBy("__x", "__y")) - 1
    ranked = dealt.join(first, "__range").select(item, (F.col("__first") + place).cast("long").alias("item_order"))
    return rows.join(ranked, item)


def first_seen_order(rows: DataFrame, group: str, position: str) -> DataFrame:
    """(group, first_position, group_order): groups as they turn up; one row a group."""
    seen = rows.groupBy(group).agg(F.min(position).alias("first_position"))
    return seen.withColumn("group_order", (F.row_number().over(Window.orderBy("first_position", group)) - 1).cast("long"))


def list_layout(rows: DataFrame, ids: DataFrame, item: str) -> DataFrame:
    """rows with item_pos from a list of ids (item, place); an id that the list lacks raises."""
    both = rows.join(ids.select(item, F.col("place").alias("item_pos")), item, "left")
    return require(both, F.col("item_pos").isNotNull(), _said("not in the list of ids", item))


def unfold_pairs(spec: DataFrame, pair: str = "pair", weight: str = "weight") -> DataFrame:
    """(index, weight): both rows of each pair, 2p+1 and 2p+2, with half of its weight."""
    return spec.select(F.explode(F.array(2 * F.col(pair) + 1, 2 * F.col(pair) + 2)).alias("index"), (F.col(weight) / 2).alias("weight"))


def numbered_steps(problems: DataFrame, problem: str, steps: str, given: DataFrame | None = None) -> DataFrame:
    """(problem, step, sub_id, body): the steps of each problem from 1, without those given beforehand (sub_id)."""
    out = problems.select(problem, F.posexplode(steps).alias("at", "body"))
    out = out.select(problem, (F.col("at") + 1).alias("step"), F.concat_ws(".", F.col(problem).cast("string"), (F.col("at") + 1).cast("string")).alias("sub_id"), "body")
    return out if given is None else out.join(given.select("sub_id"), "sub_id", "left_anti").select(problem, "step", "sub_id", "body")


def named_models(rows: DataFrame, model: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """rows of the models included, all of them if none is named, without those excluded."""
    out = rows.where(F.col(model).cast("string").isin(*include)) if include else rows
    return out.where(~F.col(model).cast("string").isin(*exclude)) if exclude else out


def performance_band(models: DataFrame, score: str, low: float, high: float) -> DataFrame:
    """Models whose accuracy, as a share or a percentage, lies between two shares, both inclusive."""
    from scorewright.functions.answers import as_share

    return models.where(as_share(F.col(score)).between(low, high))


def row_slice(rows: DataFrame, position: str, size: int | float | str, key: str | None = None, seed: int | None = None) -> DataFrame:
    """A part of a data set by the size asked for: "[a:b]" positions like a slice, a number of rows below 1 a share, else a
    count, drawn by a hash of seed (the size itself if none is given) and key. Positions count from 0."""
    from scorewright.operators.sampling import sample_rows

    n = rows.agg((F.max(position) + 1).alias("__n"))
    if isinstance(size, str):
        start, end = (int(x) if x.strip() else None for x in size.strip("[] ").split(":"))
        at = lambda x, other: F.lit(other) if x is None else F.lit(x) if x >= 0 else F.greatest(F.col("__n") + x, F.lit(0))
        whole = rows.crossJoin(F.broadcast(n))
        return whole.where((F.col(position) >= at(start, 0)) & (F.col(position) < (F.col("__n") if end is None else at(end, 0)))).drop("__n")
    count = int(size * rows.count()) if 0 < size < 1 else int(size)
    return sample_rows(rows, key or position, count, int(size) if seed is None else seed)
