"""Full-set scores estimated from anchor items: task-balanced means, and item response predictions of the rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.operators.aggregates import mean_weighted
from scorewright.operators.irt import CLIP, item_curve


def task_balanced(scores: DataFrame, anchors: DataFrame, model: str, task: str, item: str, score: str, task_weights: DataFrame | None = None) -> DataFrame:
    """(model, full_score, part_score): means over tasks of each task's mean, over all items and weighted over anchors.

    anchors: (item, weight); task_weights: (task, task_weight) for a weighted mean over tasks. A task without an anchor
    raises when the result is read.
    """
    both = scores.join(anchors.select(item, F.col("weight").alias("__w")), item, "left")
    per = both.groupBy(model, task).agg(F.avg(score).alias("full"), mean_weighted(score, "__w").alias("part"), F.count("__w").alias("anchors"))
    part = F.when(F.col("anchors") > 0, F.col("part")).otherwise(F.raise_error(F.concat(F.lit("no anchor in task "), F.col(task).cast("string"))).cast("double"))
    per = per.withColumn("part", part)
    per = per.withColumn("__t", F.lit(1.0)) if task_weights is None else per.join(F.broadcast(task_weights.withColumnRenamed("task_weight", "__t")), task)
    return per.groupBy(model).agg(mean_weighted("full", "__t").alias("full_score"), mean_weighted("part", "__t").alias("part_score"))


def abilities(responses: DataFrame, items: DataFrame, model: str = "model", item: str = "item", score: str = "score", rounds: int = 100) -> DataFrame:
    """(model, theta: array<double>) of greatest likelihood from zero; items: (item, slope array, difficulty).

    A group is a model's responses to the items given, of which the caller passes the anchors. A step moves at most
    1.5 and a gradient below 1e-5 ends it, so models with all or no items right stop at a finite place.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.stack(pdf.slope.to_numpy()).astype(float)
        b, y = pdf.difficulty.to_numpy(float), pdf.score.to_numpy(float)
        theta = np.zeros(a.shape[1])
        for _ in range(rounds):
            z = np.clip(a * theta - b[:, None], -CLIP, CLIP).sum(1)
            p = 1 / (1 + np.exp(-z))
            grad = a.T @ (p - y)
            if np.abs(grad).max() < 1e-5:
                break
            hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(len(theta))
            theta -= np.clip(np.linalg.solve(hess, grad), -1.5, 1.5)
        return pd.DataFrame({"model": [pdf["model"].iloc[0]], "theta": [theta.tolist()]})

    kind = responses.schema[model].dataType.simpleString()
    rows = responses.join(items.select(item, "slope", "difficulty"), item).select(F.col(model).alias("model"), F.col(score).cast("double").alias("score"), "slope", "difficulty")
    return rows.groupBy("model").applyInPandas(fit, f"model {kind}, theta array<double>").withColumnRenamed("model", model)


def predicted_means(thetas: DataFrame, items: DataFrame, model: str = "model") -> DataFrame:
    """(model, predicted): the mean of the item curves over the items, for every model; the grid is the response matrix."""
    grid = thetas.crossJoin(items.select("slope", "difficulty"))
    return grid.groupBy(model).agg(F.avg(item_curve(F.col("theta"), F.col("slope"), F.col("difficulty"))).alias("predicted"))


def p_irt(scores: DataFrame, anchors: DataFrame, items: DataFrame, thetas: DataFrame | None = None, model: str = "model", item: str = "item", score: str = "score") -> DataFrame:
    """(model, full_score, data_part, predicted, part_score): the share of anchors times their plain mean, and the rest
    times the mean predicted for the items that aren't anchors. Without other items the data's part is the score."""
    ids = anchors.select(item).distinct()
    seen = scores.join(ids, item)
    thetas = abilities(seen, items, model, item, score) if thetas is None else thetas
    unseen = predicted_means(thetas, items.join(ids, item, "left_anti"), model)
    sizes = items.agg(F.count("*").alias("__n")).crossJoin(ids.agg(F.count("*").alias("__s")))
    out = scores.groupBy(model).agg(F.avg(score).alias("full_score")).join(seen.groupBy(model).agg(F.avg(score).alias("data_part")), model).join(unseen, model, "left")
    share = F.col("__s") / F.col("__n")
    return out.crossJoin(F.broadcast(sizes)).select(model, "full_score", "data_part", "predicted", F.coalesce(share * F.col("data_part") + (1 - share) * F.col("predicted"), F.col("data_part")).alias("part_score"))


def gp_irt_share(bias: DataFrame, variance: DataFrame, n_anchors: int) -> DataFrame:
    """One row (b, v, share): b the mean absolute error of the predictions on training models, v their mean variance over
    items; share = b^2 / (v / 4n + b^2), 0 if both are 0."""
    both = bias.agg(F.avg(F.abs(F.col("predicted") - F.col("truth"))).alias("b")).crossJoin(variance.agg(F.avg("v").alias("v")))
    square, noise = F.col("b") * F.col("b"), F.col("v") / (4.0 * n_anchors)
    return both.withColumn("share", F.when(square + noise > 0, square / (square + noise)).otherwise(0.0))


def gp_irt(scores: DataFrame, train: DataFrame, anchors: DataFrame, items: DataFrame, model: str = "model", item: str = "item", score: str = "score") -> DataFrame:
    """(model, full_score, part_score): the weighted anchor mean and the p-IRT estimate, mixed by gp_irt_share of the
    training models' responses."""
    ids = anchors.select(item).distinct()
    rest = items.join(ids, item, "left_anti")
    predicted = predicted_means(abilities(train.join(ids, item), items, model, item, score), rest, model)
    truth = train.join(ids, item, "left_anti").groupBy(model).agg(F.avg(score).alias("truth"))
    variance = train.groupBy(model).agg(F.var_pop(score).alias("v"))
    mix = gp_irt_share(predicted.join(truth, model), variance, ids.count())
    weighted = scores.join(anchors.select(item, "weight"), item).groupBy(model).agg(mean_weighted(score, "weight").alias("anchor_score"))
    base = p_irt(scores, anchors, items, None, model, item, score)
    out = base.join(weighted, model).crossJoin(F.broadcast(mix))
    return out.select(model, "full_score", (F.col("share") * F.col("anchor_score") + (1 - F.col("share")) * F.col("part_score")).alias("part_score"), "share")
