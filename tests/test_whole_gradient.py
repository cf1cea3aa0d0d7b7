"""Networks trained by the gradient over all rows."""

import numpy as np
import pandas as pd
import pytest

from emulon import Roles, fit
from emulon.models import sums
from emulon.models.network import Layout
from emulon.operators.split import folds
from emulon.plans.search import cross_validate, grid_search

ROLES = Roles("key", ("a", "b"), ("y",))


def data(n, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"key": range(n), "a": rng.uniform(-1, 1, n), "b": rng.uniform(-1, 1, n)})
    pdf["y"] = np.sin(2 * pdf["a"]) * pdf["b"]
    return pdf


def by_hand(pdf, layout, steps, rate, seed=42, adam=False):
    x, y, theta = pdf[["a", "b"]].to_numpy(), pdf[["y"]].to_numpy(), layout.initial(seed)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        _, g = layout.gradient(theta, x, y, None)
        if adam:
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        else:
            theta = theta - rate * g
    return theta


@pytest.mark.parametrize("partitions", [1, 64])
def test_steps_do_not_depend_on_partitions(spark, partitions, monkeypatch):
    pdf = data(100_000)
    df = spark.createDataFrame(pdf).repartition(partitions)
    model = fit("neural_network", df, ROLES, method="gradient", optimizer="SGD", epochs=2, learning_rate=0.5, n_layers=1, n_neurons=4)
    assert np.allclose(model.theta, by_hand(pdf, Layout((2, 4, 1), "tanh"), 2, 0.5), atol=1e-12)
    if partitions == 64:  # the same through the tree of sums in Spark
        monkeypatch.setattr(sums, "DRIVER_NUMBERS", 0)
        again = fit("neural_network", df, ROLES, method="gradient", optimizer="SGD", epochs=2, learning_rate=0.5, n_layers=1, n_neurons=4)
        assert np.allclose(again.theta, model.theta, atol=1e-13)


def test_adam_steps(spark):
    pdf = data(3000)
    model = fit("neural_network", spark.createDataFrame(pdf).repartition(3), ROLES, method="gradient", epochs=5, learning_rate=0.05, n_neurons=3)
    assert np.allclose(model.theta, by_hand(pdf, Layout((2, 3, 3, 1), "tanh"), 5, 0.05, adam=True), atol=1e-9)


def test_lbfgs_goes_far_below_plain_steps(spark):
    df = spark.createDataFrame(data(4000)).repartition(4)
    settings = dict(n_layers=1, n_neurons=8, epochs=25)
    steps = fit("neural_network", df, ROLES, method="gradient", optimizer="SGD", learning_rate=0.3, **settings)
    fast = fit("neural_network", df, ROLES, method="lbfgs", **settings)
    losses = [h[2] for h in fast.history]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.25 * steps.history[-1][2]


def test_folds_are_left_out(spark):
    pdf = data(900)
    df = spark.createDataFrame(pdf).repartition(3)
    params = dict(method="gradient", optimizer="SGD", epochs=2, learning_rate=0.5, n_layers=1, n_neurons=4)
    run = cross_validate("neural_network", df, ROLES, k=3, refit=False, **params)
    parted = folds(df, "key", 3).toPandas()
    layout = Layout((2, 4, 1), "tanh")
    for r in run.losses.collect():
        rest, held = parted[parted["fold"] != r["fold"]], parted[parted["fold"] == r["fold"]]
        losses = [float(((layout.forward(by_hand(rest, layout, n, 0.5), held[["a", "b"]].to_numpy()) - held[["y"]].to_numpy()) ** 2).mean()) for n in (1, 2)]
        assert r["loss"] == pytest.approx(min(losses))
    both = grid_search("neural_network", df, ROLES, {"method": ["gradient", "lbfgs", "rounds"]}, k=2, refit=False, epochs=2, n_neurons=3, partitions=1)
    assert both.table.count() == 6


def test_methods_are_checked(spark):
    df = spark.createDataFrame(data(50))
    with pytest.raises(ValueError, match="method"):
        fit("neural_network", df, ROLES, method="newton")
    with pytest.raises(ValueError, match="dropout"):
        fit("neural_network", df, ROLES, method="lbfgs", dropout_rate=0.2)
    gap = df.selectExpr("key", "if(key = 3, null, a) as a", "b", "y")
    with pytest.raises(Exception, match="must not be missing"):
        fit("neural_network", gap, ROLES, method="gradient", epochs=1)
