"""Fits from aggregates: parameters recovered, optima stationary, likelihoods that never fall."""

import math

import numpy as np
import pytest

from scorewright.operators import estimates, fits


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


def simulated(chance, seed):
    y = (np.random.default_rng(seed).random(chance.shape) < chance).astype(float)
    return [(f"i{i}", f"m{m}", float(y[m, i])) for m in range(y.shape[0]) for i in range(y.shape[1])]


SCHEMA = "item string, model string, score double"


@pytest.mark.parametrize("dims", [2, 5])
def test_curves_of_several_dimensions(spark, dims):
    rng = np.random.default_rng(dims)
    models, n = 120, 30
    theta, slope, b = rng.normal(size=(models, dims)), rng.normal(0.4, 1.2, (n, dims)), rng.normal(0, 1 / dims, n)
    chance = sigmoid(theta @ slope.T - dims * b)
    rows = spark.createDataFrame([*simulated(chance, 1), ("i0", "m0", None), ("unseen", "m0", None)], SCHEMA)
    items, found = fits.fit_multidim(rows, dims, rounds=7, tolerance=1e-3)
    a, t = {r.item: r for r in items.collect()}, {r.model: np.array(r.theta) for r in found.collect()}
    assert len(a) == n and len(t) == models
    fitted = np.array([[sigmoid(t[f"m{m}"] @ np.array(a[f"i{i}"].slope) - dims * a[f"i{i}"].difficulty) for i in range(n)] for m in range(models)])
    assert np.corrcoef(fitted.ravel(), chance.ravel())[0, 1] > (0.88 if dims == 2 else 0.8)
    thetas = estimates.abilities(rows.where("score is not null"), items)
    assert thetas.count() == models and len(thetas.first().theta) == dims
    both = estimates.p_irt(rows.where("score is not null"), items.limit(12).select("item"), items)
    errors = [abs(r.full_score - r.part_score) for r in both.select("full_score", "part_score").collect()]
    assert len(errors) == models and np.mean(errors) < 0.15


def test_optimum_is_stationary(spark):
    rng = np.random.default_rng(9)
    rows = simulated(sigmoid(rng.normal(size=(30, 1)) - rng.normal(size=12)), 2)
    items, models = fits.fit_multidim(spark.createDataFrame(rows, SCHEMA), 1, rounds=12, tolerance=1e-6)
    w, t = {r.item: (r.slope[0], r.difficulty) for r in items.collect()}, {r.model: r.theta[0] for r in models.collect()}
    grad = {}
    for i, m, y in rows:
        a, b = w[i]
        e = sigmoid(a * t[m] - b) - y
        for key, g in ((("a", i), e * t[m]), (("b", i), -e), (("t", m), e * a)):
            grad[key] = grad.get(key, 0) + g
    prior = {"a": lambda i: w[i][0] - 1, "b": lambda i: 0.25 * w[i][1], "t": lambda m: t[m]}
    assert max(abs(g + prior[k](x)) for (k, x), g in grad.items()) < 5e-2


def test_no_responses(spark):
    none = spark.createDataFrame([("i", "m", None)], SCHEMA)
    assert [x.count() for x in fits.fit_multidim(none, 2)] == [0, 0]
    items, models, values = fits.fit_marginal(none, "3pl")
    assert (items.count(), models.count(), values) == (0, 0, [])


@pytest.mark.parametrize("kind", ["1pl", "2pl", "3pl", "4pl"])
def test_marginal_fits(spark, kind):
    rng = np.random.default_rng(4)
    models, n = 300, 12
    theta, b = rng.normal(size=models), np.linspace(-1.5, 1.5, n)
    a = np.ones(n) if kind == "1pl" else rng.uniform(0.8, 2.0, n)
    low, high = np.full(n, 0.2 if kind == "3pl" else 0.0), np.full(n, 0.8 if kind == "4pl" else 1.0)
    chance = low + (high - low) * sigmoid(a * (theta[:, None] - b))
    items, found, values = fits.fit_marginal(spark.createDataFrame(simulated(chance, 5), SCHEMA), kind, rounds=4)
    assert len(values) == 5 and all(y >= x - 1e-6 for x, y in zip(values, values[1:]))
    got = {r.item: r for r in items.collect()}
    grid = np.linspace(-2, 2, 9)
    off = [abs(got[f"i{i}"].low + (got[f"i{i}"].high - got[f"i{i}"].low) * sigmoid(got[f"i{i}"].slope * (grid - got[f"i{i}"].difficulty)) - (low[i] + (high[i] - low[i]) * sigmoid(a[i] * (grid - b[i])))) for i in range(n)]
    assert np.mean(off) < 0.06
    est = {r.model: r.theta for r in found.collect()}
    assert np.corrcoef([est[f"m{m}"] for m in range(models)], theta)[0, 1] > 0.7


def dense(rows, names, k, ridge):
    """The same regression with one row a battle, by plain Newton steps."""
    x = np.zeros((len(rows), len(names) + k))
    y = np.array([{"model_a": 1.0, "model_b": 0.0}.get(r[2], 0.5) for r in rows])
    for i, r in enumerate(rows):
        x[i, names.index(r[0])], x[i, names.index(r[1])] = math.log(10), -math.log(10)
        x[i, len(names) :] = r[3:]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    return w


def test_style_control_equals_a_dense_fit(spark):
    rng = np.random.default_rng(8)
    names = [f"m{i}" for i in range(6)]
    rows = []
    for _ in range(500):
        a, b = rng.choice(6, 2, replace=False)
        f = rng.normal(size=2)
        z = 0.5 * (a - b) + 0.8 * f[0]
        rows.append((names[a], names[b], "tie" if rng.random() < 0.1 else "model_a" if rng.random() < sigmoid(z) else "model_b", float(f[0]), float(f[1])))
    want = dense(rows, names, 2, 0.5)
    odd = [("m0", "m0", "model_a", 1.0, 1.0), ("m0", None, "model_a", 1.0, 1.0), ("m0", "m1", "model_a", None, 1.0)]
    battles = spark.createDataFrame(rows + odd, "model_a string, model_b string, winner string, longer double, lists double")
    ratings, coefficients = fits.style_bradley_terry(battles, ["longer", "lists"])
    assert {r.model: r.rating for r in ratings.collect()} == pytest.approx({m: 1000 + 400 * want[i] for i, m in enumerate(names)}, abs=1e-4)
    got = {r.feature: (r.coefficient, r.odds_ratio) for r in coefficients.collect()}
    assert got["longer"] == pytest.approx((want[6], math.exp(want[6])), abs=1e-6) and got["lists"][0] == pytest.approx(want[7], abs=1e-6) and got["longer"][0] > 0.5
    empty = fits.style_bradley_terry(battles.where("false"), ["longer"])
    assert [x.count() for x in empty] == [0, 0]
