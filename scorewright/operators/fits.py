"""Fits whose data stay in Spark: each step is an aggregate of gradient and Hessian sums, or of expected counts, by item,
model or pair, and only those sums are solved. Rows of a group are never gathered."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.operators.irt import CLIP
from scorewright.operators.lineage import cut

_STEP = 1.5
#: Responses, or sums to solve, of a task on average; items whose parameters are sent to every task at most.
ROWS, SENT = 100_000, 65_536


def _chance(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-CLIP)), F.lit(CLIP))))


def _newton(rows: DataFrame, key: str, at: str, x: list[Column], z: Column, mean: list[float], precision: list[float], parts: int) -> DataFrame:
    """(key, at: array, moved): one penalised Newton step of each group's logistic regression of score on x, from its
    parameters `at`; z is the linear predictor there. The sums are solved in at most `parts` tasks."""
    k = len(x)
    p = _chance(z)
    grad = [F.sum((p - F.col("score")) * v) for v in x]
    hess = [F.sum(p * (1 - p) * x[i] * x[j]) for i in range(k) for j in range(i, k)]
    now = [F.first(F.col(at)[i]) for i in range(k)]  # single numbers: with an array in it the rows would be sorted by key
    sums = rows.groupBy(key).agg(F.array(*now).alias(at), F.array(*grad).alias("g"), F.array(*hess).alias("h")).coalesce(parts)
    prior_mean, prior = np.array(mean), np.array(precision)
    most = _STEP

    def solve(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(k)
        for pdf in it:
            if not len(pdf):
                continue
            now, g, h = (np.stack(pdf[c].to_numpy()).astype(float) for c in (at, "g", "h"))
            full = np.zeros((len(pdf), k, k))
            full[:, upper[0], upper[1]] = full[:, upper[1], upper[0]] = h
            step = np.linalg.solve(full + np.diag(prior), (g + prior * (now - prior_mean))[:, :, None])[:, :, 0]
            step = np.clip(step, -most, most)
            yield pd.DataFrame({key: pdf[key], at: list(now - step), "moved": np.abs(step).max(axis=1)})

    kind = rows.schema[key].dataType.simpleString()
    return sums.mapInPandas(solve, f"`{key}` {kind}, `{at}` array<double>, moved double")


def fit_multidim(responses: DataFrame, dims: int = 5, rounds: int = 40, tolerance: float = 1e-4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The D-dimensional two-parameter logistic model, by maximum a posteriori: (items, models).

    responses (item, model, score in [0, 1]); items (item, slope: array, difficulty), models (model, theta: array). The
    curve is the sigmoid of the sum over dimensions of slope * theta - difficulty, so the difficulty counts D times.
    Priors are N(0, 1) for abilities, N(1, 1) for the first slope, N(0, 1) for the others and N(0, 4) for difficulties.
    A round is a Newton step of all items given abilities and one of all models given items, each from sums of gradients
    and Hessians; rounds end when no parameter moves by `tolerance`. Null scores are left out, scores of the same item and
    model are averaged, items and models without a score are absent, and no responses give two empty tables.

    Responses are dealt by model once, to tasks of about `ROWS`, where each round finds the models' abilities beside them;
    a round's tasks grow with the responses, not with the session's number of shuffle partitions.
    """
    data = cut(responses.where("score is not null").groupBy("item", "model").agg(F.avg("score").alias("score")))

    def noise(key: str, d: int) -> Column:
        return (F.pmod(F.xxhash64(key, F.lit(d), F.lit(seed)), F.lit(2001)) / 1000.0 - 1.0) * 0.5

    share = F.least(F.greatest(F.avg("score"), F.lit(0.02)), F.lit(0.98))
    models = data.groupBy("model").agg(share.alias("p")).select("model", F.array(F.log(F.col("p") / (1 - F.col("p"))), *[noise("model", d) for d in range(1, dims)]).alias("theta"))
    items = data.select("item").distinct().select("item", F.array(F.lit(1.0), *[noise("item", d) for d in range(1, dims)], F.lit(0.0)).alias("w"))
    parts = max(1, -(-data.count() // ROWS))

    def by_model(rows: DataFrame) -> DataFrame:
        return cut(rows.repartition(parts, "model").sortWithinPartitions("model"))

    data, models, items = by_model(data), by_model(models), cut(items)
    n_items = items.count()
    item_parts, small = max(1, -(-n_items // ROWS)), F.broadcast if n_items <= SENT else lambda df: df
    theta, w = ([F.col(c)[d] for d in range(dims)] for c in ("theta", "w"))
    z = sum((t * a for t, a in zip(theta, w)), F.lit(0.0)) - dims * F.col("w")[dims]
    first = [1.0] + [0.0] * dims
    for _ in range(rounds):
        rows = data.join(models.select("model", "theta"), "model").join(small(items.select("item", "w")), "item")
        items = cut(_newton(rows, "item", "w", [*theta, F.lit(-float(dims))], z, first, [1.0] * dims + [0.25], item_parts))
        rows = data.join(models.select("model", "theta"), "model").join(small(items.select("item", "w")), "item")
        models = by_model(_newton(rows, "model", "theta", w, z, [0.0] * dims, [1.0] * dims, parts))
        moved = items.agg(F.max("moved").alias("m")).unionByName(models.agg(F.max("moved").alias("m"))).agg(F.max("m")).first()[0]
        if moved is None or moved < tolerance:
            break
    return items.select("item", F.slice("w", 1, dims).alias("slope"), F.col("w")[dims].alias("difficulty")), models.select("model", "theta")


def fit_2pl(responses: DataFrame, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """`fit_multidim` of one dimension as plain columns: items (item, slope, difficulty), models (model, theta)."""
    items, models = fit_multidim(responses, 1, rounds)
    return items.select("item", F.col("slope")[0].alias("slope"), "difficulty"), models.select("model", F.col("theta")[0].alias("theta"))


#: Parameters that each kind of item has: slope, difficulty, logit of the lower and of the upper limit; prior means and
#: precisions; and the values of those that a kind lacks.
KINDS = {"1pl": (1,), "2pl": (0, 1), "3pl": (0, 1, 2), "4pl": (0, 1, 3)}
_MEAN, _PRECISION, _FIXED = (1.0, 0.0, -1.4, 2.0), (1.0, 0.25, 1.0, 1.0), (1.0, 0.0, -math.inf, math.inf)


def _item_step(active: tuple[int, ...], nodes: np.ndarray, fixed: tuple[float, ...], prior_mean: tuple[float, ...], precision: tuple[float, ...]):
    """mapInPandas over (item, u, right, n): parameters that raise the expected penalised likelihood, and their log prior."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        on = list(active)
        mean, prec = np.array(prior_mean)[on], np.array(precision)[on]

        def curve(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b, low, high = (np.broadcast_to(np.array(fixed[i]), len(u)) if i not in on else u[:, on.index(i)] for i in range(4))
            a, b = a[:, None], b[:, None]
            low, high = (1 / (1 + np.exp(-v))[:, None] for v in (low, high))
            s = 1 / (1 + np.exp(-np.clip(a * (nodes - b), -30, 30)))
            d = (high - low) * s * (1 - s)
            grads = {0: d * (nodes - b), 1: -d * a, 2: (1 - s) * low * (1 - low), 3: s * high * (1 - high)}
            return np.clip(low + (high - low) * s, 1e-9, 1 - 1e-9), np.stack([grads[i] for i in on], axis=2)

        def value(u: np.ndarray, r: np.ndarray, n: np.ndarray) -> np.ndarray:
            p, _ = curve(u)
            return (r * np.log(p) + (n - r) * np.log1p(-p)).sum(axis=1) - 0.5 * (prec * (u - mean) ** 2).sum(axis=1)

        for pdf in it:
            if not len(pdf):
                continue
            u, r, n = (np.stack(pdf[c].to_numpy()).astype(float) for c in ("u", "right", "n"))
            best = value(u, r, n)
            for _ in range(5):
                p, j = curve(u)
                grad = (((r - n * p) / (p * (1 - p)))[:, :, None] * j).sum(axis=1) - prec * (u - mean)
                info = np.einsum("iq,iqk,iql->ikl", n / (p * (1 - p)), j, j) + np.diag(prec)
                step = np.clip(np.linalg.solve(info, grad[:, :, None])[:, :, 0], -1.5, 1.5)
                for _ in range(12):  # halved where the value would fall
                    new = value(u + step, r, n)
                    falls = new < best
                    if not falls.any():
                        break
                    step[falls] /= 2
                step[falls] = 0
                u = u + step
                best = value(u, r, n)
            yield pd.DataFrame({"item": pdf["item"], "u": list(u), "prior": -0.5 * (prec * (u - mean) ** 2).sum(axis=1)})

    return run


def fit_marginal(responses: DataFrame, kind: str = "2pl", rounds: int = 20, nodes: int = 21) -> tuple[DataFrame, DataFrame, list[float]]:
    """Items by marginal maximum a posteriori, EM over equally spaced abilities from -4 to 4: (items, models, values).

    responses (item, model, score in [0, 1]); items (item, slope, difficulty, low, high), models (model, theta: the mean of
    its posterior, loglik), values the penalised log-likelihood before each round, which never falls. `kind` is 1pl
    (difficulty), 2pl (and slope), 3pl (and a lower limit) or 4pl (an upper limit instead). The E-step joins responses with
    each item's log chances at the nodes and sums them by model, the M-step sums expected counts by item. Null scores are
    left out, scores of the same item and model are averaged, and no responses give two empty tables and no values.
    """
    on = KINDS[kind]
    data = cut(responses.where("score is not null").groupBy("item", "model").agg(F.avg("score").alias("score")))
    x = np.linspace(-4.0, 4.0, nodes)
    log_w = -0.5 * x**2
    log_w -= math.log(np.exp(log_w).sum())
    items = cut(data.select("item").distinct().select("item", F.array(*[F.lit(_MEAN[i]) for i in on]).alias("u"), F.lit(0.0).alias("prior")))

    def parameter(i: int) -> Column:
        return F.col("u")[on.index(i)] if i in on else F.lit(_FIXED[i])

    def limit(i: int) -> Column:
        return _chance(parameter(i)) if i in on else F.lit(float(i == 3))

    low, high = limit(2), limit(3)
    place = F.array(*[F.lit(float(v)) for v in x])
    chance = F.transform(place, lambda t: F.least(F.greatest(low + (high - low) * _chance(parameter(0) * (t - parameter(1))), F.lit(1e-9)), F.lit(1 - 1e-9)))
    step = _item_step(on, x, _FIXED, _MEAN, _PRECISION)
    values: list[float] = []
    kinds = dict(data.dtypes)
    posts = None
    for k in range(rounds + 1):
        curves = items.select("item", chance.alias("p"))
        rows = data.join(curves.select("item", F.transform("p", lambda p: F.log(p)).alias("yes"), F.transform("p", lambda p: F.log(1 - p)).alias("no")), "item")
        sums = [F.sum(F.col("score") * F.col("yes")[q] + (1 - F.col("score")) * F.col("no")[q]) + float(log_w[q]) for q in range(nodes)]
        per = rows.groupBy("model").agg(F.array(*sums).alias("s")).withColumn("top", F.array_max("s"))
        per = per.withColumn("e", F.transform("s", lambda v: F.exp(v - F.col("top")))).withColumn("sum", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
        posts = cut(per.select("model", F.transform("e", lambda v: v / F.col("sum")).alias("post"), (F.col("top") + F.log("sum")).alias("loglik")))
        total = posts.agg(F.sum("loglik")).first()[0]
        if total is None:
            break
        values.append(total + items.agg(F.sum("prior")).first()[0])
        if k == rounds:
            break
        rows = data.join(posts.select("model", "post"), "model")
        counts = rows.groupBy("item").agg(F.array(*[F.sum(F.col("score") * F.col("post")[q]) for q in range(nodes)]).alias("right"), F.array(*[F.sum(F.col("post")[q]) for q in range(nodes)]).alias("n"))
        items = cut(counts.join(items.select("item", "u"), "item").mapInPandas(step, f"item {kinds['item']}, u array<double>, prior double"))
    theta = F.aggregate(F.zip_with("post", place, lambda p, t: p * t), F.lit(0.0), lambda a, v: a + v)
    return items.select("item", parameter(0).alias("slope"), parameter(1).alias("difficulty"), low.alias("low"), high.alias("high")), posts.select("model", theta.alias("theta"), "loglik"), values


def style_bradley_terry(battles: DataFrame, features: list[str], ridge: float = 0.5, rounds: int = 25, tolerance: float = 1e-8, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Bradley-Terry strengths with style covariates, a ridge logistic regression: (ratings, coefficients).

    battles (model_a, model_b, winner, features); a battle's log odds are ln 10 times the difference of the strengths plus
    the features' coefficients. ratings (model, rating = 1000 + 400 * strength, n: battles), coefficients (feature,
    coefficient, odds_ratio). A Newton step is one aggregate by pair of models of gradients and Hessian blocks; those
    sums, a row for each pair that met, and the strengths, a row for each model, are what the driver holds. Winners other
    than the two models are draws, rows without a model, with a null feature or of a model against itself are left out,
    `weight` counts a battle more than once, and no battles give two empty tables.
    """
    spark = battles.sparkSession
    alpha, k = math.log(10.0), len(features)
    won = F.when(F.col("winner") == "model_a", 1.0).when(F.col("winner") == "model_b", 0.0).otherwise(0.5)
    kept = battles.where(" and ".join(["model_a <> model_b", *[f"`{f}` is not null" for f in features]]))
    count = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = cut(kept.select("model_a", "model_b", won.alias("y"), count.alias("c"), *[F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)]))
    n = {r.model: r.n for r in rows.select(F.col("model_a").alias("model"), "c").unionByName(rows.select(F.col("model_b").alias("model"), "c")).groupBy("model").agg(F.sum("c").alias("n")).collect()}
    names = sorted(n)
    at, m = {x: i for i, x in enumerate(names)}, len(names)
    beta = np.zeros(m + k)
    kind = dict(rows.dtypes)["model_a"]
    f = [F.col(f"f{i}") for i in range(k)]
    for _ in range(rounds if m else 0):
        strengths = spark.createDataFrame([(x, float(beta[i])) for x, i in at.items()], f"model {kind}, s double")  # a row a model
        sides = [F.broadcast(strengths.select(F.col("model").alias(f"model_{x}"), F.col("s").alias(f"s{x}"))) for x in "ab"]
        both = rows.join(sides[0], "model_a").join(sides[1], "model_b")
        p = _chance(sum((v * float(b) for v, b in zip(f, beta[m:])), alpha * (F.col("sa") - F.col("sb"))))
        error, h = F.col("c") * (p - F.col("y")), F.col("c") * p * (1 - p)
        sums = [F.sum(error), F.sum(h), *[F.sum(error * v) for v in f], *[F.sum(h * v) for v in f], *[F.sum(h * f[i] * f[j]) for i in range(k) for j in range(k)]]
        pairs = both.groupBy("model_a", "model_b").agg(F.array(*sums).alias("s")).collect()  # a row for each pair that met
        grad, hess = ridge * beta, ridge * np.eye(m + k)
        for r in pairs:
            a, b, s = at[r.model_a], at[r.model_b], np.array(r.s)
            grad[a] += alpha * s[0]
            grad[b] -= alpha * s[0]
            grad[m:] += s[2 : 2 + k]
            sign = np.array([alpha, -alpha])
            hess[np.ix_([a, b], [a, b])] += np.outer(sign, sign) * s[1]
            cross = np.outer(sign, s[2 + k : 2 + 2 * k])
            hess[np.ix_([a, b], range(m, m + k))] += cross
            hess[np.ix_(range(m, m + k), [a, b])] += cross.T
            hess[m:, m:] += s[2 + 2 * k :].reshape(k, k)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -_STEP, _STEP)
        if np.abs(step).max() < tolerance:
            break
    ratings = spark.createDataFrame([(x, 1000.0 + 400.0 * float(beta[i]), float(n[x])) for x, i in at.items()], f"model {kind}, rating double, n double")
    found = [(x, float(beta[m + i]), math.exp(beta[m + i])) for i, x in enumerate(features)] if m else []
    return ratings, spark.createDataFrame(found, "feature string, coefficient double, odds_ratio double")
