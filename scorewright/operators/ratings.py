"""Pairwise ratings: sufficient statistics in Spark, fits on those statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, BASE, START = 400.0, 10.0, 1000.0
#: Battles of a row that the online fold reads.
PACK = 512


def battle_counts(battles: DataFrame) -> DataFrame:
    """(model_a, model_b, outcome, n) with model_a < model_b; outcome is model_a's 1, 0.5 or 0."""
    won = F.when(F.col("winner") == "model_a", 1.0).when(F.col("winner") == "model_b", 0.0).otherwise(0.5)
    swap = F.col("model_a") > F.col("model_b")
    rows = battles.where("model_a <> model_b").select(F.least("model_a", "model_b").alias("a"), F.greatest("model_a", "model_b").alias("b"), F.when(swap, 1.0 - won).otherwise(won).alias("outcome"))
    return rows.groupBy(F.col("a").alias("model_a"), F.col("b").alias("model_b"), "outcome").agg(F.count("*").alias("n"))


def _strengths(a: np.ndarray, b: np.ndarray, y: np.ndarray, w: np.ndarray, n: int, ridge: float = 1e-6) -> np.ndarray:
    """Bradley-Terry log strengths by Newton's method; their mean is 0."""
    x = np.zeros(n)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x[a] - x[b], -30, 30)))
        grad = np.zeros(n)
        np.add.at(grad, a, w * (p - y))
        np.add.at(grad, b, -w * (p - y))
        h = w * p * (1 - p) + 1e-12
        hess = np.zeros((n, n))
        np.add.at(hess, (a, a), h)
        np.add.at(hess, (b, b), h)
        np.add.at(hess, (a, b), -h)
        np.add.at(hess, (b, a), -h)
        step = np.linalg.solve(hess + (ridge + 1e-9) * np.eye(n) + np.ones((n, n)) / n, grad + ridge * x)
        x -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-10:
            break
    return x - x.mean()


def _rate(pdf: pd.DataFrame, weights: np.ndarray | None = None) -> pd.DataFrame:
    names = sorted({*pdf.model_a, *pdf.model_b})
    at = {m: i for i, m in enumerate(names)}
    w = pdf.n.to_numpy(float) if weights is None else weights
    x = _strengths(pdf.model_a.map(at).to_numpy(), pdf.model_b.map(at).to_numpy(), pdf.outcome.to_numpy(float), w, len(names))
    return pd.DataFrame({"model": names, "rating": START + SCALE / np.log(BASE) * x})


def bradley_terry(counts: DataFrame, anchor: str | None = None) -> DataFrame:
    """(model, rating) by maximum likelihood; counts has a row for each pair and outcome, so one task fits it.

    With an anchor its rating is 1000 and the others move along.
    """
    out = counts.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: _rate(pdf), "model string, rating double")
    if anchor is None:
        return out
    base = out.where(F.col("model") == anchor).select((START - F.col("rating")).alias("shift"))
    return out.crossJoin(F.broadcast(base)).select("model", (F.col("rating") + F.col("shift")).alias("rating"))


def bootstrap(counts: DataFrame, rounds: int = 100, seed: int = 0) -> DataFrame:
    """(model, rating, low, high): median and 95% range of ratings over multinomial resamples, a task for each round."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["model_a", "model_b", "outcome"]).reset_index(drop=True)
        n = pdf.n.to_numpy()
        drawn = np.random.default_rng([seed, int(key[0])]).multinomial(n.sum(), n / n.sum())
        return _rate(pdf, drawn.astype(float))

    each = counts.crossJoin(counts.sparkSession.range(rounds).withColumnRenamed("id", "round"))
    rated = each.groupBy("round").applyInPandas(one, "model string, rating double")
    return rated.groupBy("model").agg(F.percentile("rating", F.lit(0.5)).alias("rating"), F.percentile("rating", F.lit(0.025)).alias("low"), F.percentile("rating", F.lit(0.975)).alias("high"))


def online_elo(battles: DataFrame, order: str, k: float = 4.0) -> DataFrame:
    """(model, rating) after battles in their order, each moving two ratings by k.

    Battles are sorted by ranges of their order in many tasks and packed, `PACK` to a row of about 9 bytes each; the fold,
    which the order binds, reads those rows one batch after the other in one task, whose memory is a row a model.
    """

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId(), 0
        for pdf in it:
            for i in range(0, len(pdf), PACK):
                own = pdf.iloc[i : i + PACK]
                codes, names = pd.factorize(np.concatenate([own["model_a"], own["model_b"]]), use_na_sentinel=False)
                codes = codes.astype(np.uint32).reshape(2, -1)
                yield pd.DataFrame({"part": [part], "seq": [seq], "names": [[None if pd.isna(m) else m for m in names]], "a": [codes[0].tobytes()], "b": [codes[1].tobytes()], "won": [own["won"].to_numpy(np.uint8).tobytes()]})
                seq += 1

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rating: dict[str, float] = {}
        for pdf in it:
            for names, a, b, won in zip(pdf["names"], pdf["a"], pdf["b"], pdf["won"]):
                now = [rating.get(m, START) for m in names]
                for i, j, w in zip(np.frombuffer(a, np.uint32).tolist(), np.frombuffer(b, np.uint32).tolist(), won):
                    x, y = now[i], now[j]
                    moved = k * (w / 2 - 1 / (1 + BASE ** ((y - x) / SCALE)))
                    now[i] = x + moved
                    now[j] = y - moved
                rating.update(zip(names, now))
        yield pd.DataFrame({"model": pd.Series(list(rating), dtype=object), "rating": pd.Series(list(rating.values()), dtype=float)})

    won = F.when(F.col("winner") == "model_a", 2).when(F.col("winner") == "model_b", 0).otherwise(1)  # in halves
    place = F.col(order).asc_nulls_last()
    rows = battles.select(order, "model_a", "model_b", won.alias("won")).repartitionByRange(place).sortWithinPartitions(place)
    packed = rows.mapInPandas(pack, "part int, seq int, names array<string>, a binary, b binary, won binary")
    return packed.repartition(1).sortWithinPartitions("part", "seq").mapInPandas(fold, "model string, rating double")


def win_rates(ratings: DataFrame, model: str = "model", rating: str = "rating") -> DataFrame:
    """(model_a, model_b, win_rate) of all pairs of models."""
    a = ratings.select(F.col(model).alias("model_a"), F.col(rating).alias("ra"))
    b = ratings.select(F.col(model).alias("model_b"), F.col(rating).alias("rb"))
    return a.crossJoin(b).where("model_a <> model_b").select("model_a", "model_b", (1 / (1 + F.pow(F.lit(BASE), (F.col("rb") - F.col("ra")) / SCALE))).alias("win_rate"))
