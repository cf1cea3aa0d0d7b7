import numpy as np
import pandas as pd
import pytest

from emulon import Roles, fit, load_model
from emulon.models import gram, network, support_vector
from emulon.models.landmarks import Kernel, _squared, _squared_by_product
from emulon.models.network import Layout, Network
from emulon.models.sums import sum_over_partitions
from emulon.plans.search import cross_validate, expand_grid, grid_search, hold_out, parse_options
from emulon.operators.split import folds

ROLES = Roles("key", ("a", "b"), ("y", "z"))


def data(n=60, seed=4):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"key": range(n), "a": rng.uniform(size=n), "b": rng.uniform(size=n)})
    pdf["y"] = 1 + 2 * pdf["a"] - 3 * pdf["a"] * pdf["b"] + 0.5 * pdf["b"] ** 2
    pdf["z"] = np.sin(4 * pdf["a"]) + pdf["b"]
    return pdf


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(data()).repartition(3, "key").cache()


def predictions(model, df, columns=("y", "z")):
    out = model.transform(df).orderBy("key").toPandas()
    return out[[f"pred_{c}" for c in columns]].to_numpy()


# ---- sums


@pytest.mark.parametrize("limit", [0, 10**9])
def test_sums_in_spark_and_on_the_driver(spark, monkeypatch, limit):
    from emulon.models import sums

    monkeypatch.setattr(sums, "DRIVER_NUMBERS", limit)
    monkeypatch.setattr(sums, "SLICE", 3)
    monkeypatch.setattr(sums, "GROUP", 2)
    df = spark.range(0, 100, 1, 7).selectExpr("cast(id as double) as v")

    def work(batches, part):
        total = sum(b["v"].sum() for b in batches)
        return {0: np.full(8, total), 3: np.array([1.0])}

    got = sum_over_partitions(df, work, 9, 7)
    assert np.array_equal(got[0], np.full(8, 4950.0)) and got[3][0] == 7


@pytest.mark.parametrize("mean", [0.0, 1e3, 1e6, 1e9])
def test_surface_on_columns_of_large_mean(spark, mean):
    x = np.random.default_rng(1).random(500)
    df = spark.createDataFrame([(i, float(mean + v), float(2 * (mean + v) + 1), 7.5) for i, v in enumerate(x)], "key int, a double, y double, c double")
    model = fit("response_surface", df, Roles(key="key", inputs=("a", "c"), outputs=("y",)), degree=1, include_bias=False)
    assert model.weights[:, 0] == pytest.approx([2.0, 0.0], abs=1e-5)
    got = np.array([r["pred_y"] - r["y"] for r in model.transform(df).collect()])
    assert np.abs(got).max() < 1e-6 * max(1.0, mean / 1e3)


def test_surface_of_many_terms(spark):
    rng = np.random.default_rng(2)
    names = [f"x{i}" for i in range(24)]
    x = rng.standard_normal((60, 24))
    df = spark.createDataFrame([(i, *map(float, r), float(r[0] * r[1] * r[2])) for i, r in enumerate(x)],
                               "key int, " + ", ".join(f"{n} double" for n in names) + ", y double")
    model = fit("response_surface", df, Roles(key="key", inputs=tuple(names), outputs=("y",)), degree=3)
    assert model.weights.shape == (2925, 1)


def test_missing_input_gives_missing_prediction(spark, rows):
    model = fit("response_surface", rows, ROLES, degree=1)
    model.weights[0, :] = 0.0
    gap = spark.createDataFrame([(1, None, 2.0)], "key int, a double, b double")
    assert model.transform(gap).head()["pred_y"] is None
    assert np.isnan(model.predict_block(np.array([[np.nan, 2.0]]))).all()


# ---- response surface


def test_surface_recovers_a_polynomial(spark, rows):
    model = fit("response_surface", rows, Roles("key", ("a", "b"), ("y",)), degree=2)
    c = {r["term"]: r["coefficient"] for r in model.coefficients(spark).collect()}
    wanted = {"intercept": 1, "a": 2, "b": 0, "a^2": 0, "a b": -3, "b^2": 0.5, "bias": 0}
    assert all(abs(c[t] - v) < 1e-9 for t, v in wanted.items())
    assert np.allclose(predictions(model, rows, ["y"])[:, 0], data()["y"])


@pytest.mark.parametrize("params", [{"degree": 3}, {"degree": 2, "fit_intercept": False}, {"degree": 2, "interaction_only": True}])
def test_surface_equals_dense_least_squares(rows, params):
    model = fit("response_surface", rows, ROLES, **params)
    pdf = data()
    x = model.map(pdf[["a", "b"]].to_numpy())
    w = np.linalg.lstsq(x, pdf[["y", "z"]].to_numpy(), rcond=None)[0]
    assert np.allclose(predictions(model, rows), x @ w, atol=1e-7)


def test_wide_surface_predicts_in_blocks(rows, monkeypatch):
    from emulon.models import response_surface

    model = fit("response_surface", rows, ROLES, degree=3)
    one = predictions(model, rows)
    monkeypatch.setattr(response_surface, "EXPRESSION_TERMS", 0)
    assert np.allclose(predictions(model, rows), one)


def test_positive_weights(rows):
    model = fit("response_surface", rows, ROLES, degree=2, positive=True)
    assert (model.weights >= 0).all()
    pdf = data()
    x = model.map(pdf[["a", "b"]].to_numpy())
    gap = pdf[["y", "z"]].to_numpy() - x @ model.weights - model.intercept
    slope = (x - x.mean(axis=0)).T @ gap  # optimality: no slope inside, none upward at zero
    assert (slope < 1e-6).all() and np.abs(slope[model.weights > 0]).max() < 1e-6


def test_missing_values_are_an_error(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, None, 2.0)], "key int, a double, y double")
    with pytest.raises(Exception, match="must not be missing"):
        fit("response_surface", df, Roles("key", ("a",), ("y",)), degree=1)


# ---- kernels


def test_squared_distances_agree():
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=(20, 3)), rng.normal(size=(7, 3))
    assert np.allclose(_squared(x, z), _squared_by_product(x, z))


def test_kernel_ridge_with_all_landmarks_is_exact(rows):
    pdf = data()
    x, y = pdf[["a", "b"]].to_numpy(), pdf[["y", "z"]].to_numpy()
    for gamma, value in ((2.0, 2.0), (None, 0.5)):
        model = fit("rbf", rows, ROLES, alpha=0.1, gamma=gamma, landmarks=len(pdf))
        k = np.exp(-value * _squared(x, x))
        assert np.allclose(predictions(model, rows), k @ np.linalg.solve(k + 0.1 * np.eye(len(x)), y), atol=1e-7)


GP_KERNELS = [
    ({"kernel": "RBF", "length_scale": 0.7, "constant": 0.3}, Kernel("RBF", length=0.7, constant=0.3)),
    ({"kernel": "Matern", "nu": 0.5}, Kernel("Matern", nu=0.5)),
    ({"kernel": "Matern", "nu": 1.5}, Kernel("Matern", nu=1.5)),
    ({"kernel": "Matern", "nu": 2.5}, Kernel("Matern", nu=2.5)),
    ({"kernel": "Matern", "nu": float("inf")}, Kernel("Matern", nu=float("inf"))),
    ({"kernel": "ExpSineSquared", "periodicity": 3.0}, Kernel("ExpSineSquared", period=3.0)),
]


@pytest.mark.parametrize("params,kernel", GP_KERNELS)
def test_gaussian_process_with_all_landmarks_is_exact(spark, params, kernel):
    pdf = data(30)
    df = spark.createDataFrame(pdf)
    model = fit("gaussian_process", df, ROLES, alpha=1e-2, landmarks=30, **params)
    x, y = pdf[["a", "b"]].to_numpy(), pdf[["y", "z"]].to_numpy()
    new = pd.DataFrame({"key": range(5), "a": [0.1, 0.3, 0.5, 0.7, 1.5], "b": [0.9, 0.2, 0.4, 0.6, -0.5]})
    t = new[["a", "b"]].to_numpy()
    noisy = kernel(x, x) + 1e-2 * np.eye(30)
    mean = kernel(t, x) @ np.linalg.solve(noisy, y)
    variance = kernel.diagonal(t) - np.einsum("ij,ji->i", kernel(t, x), np.linalg.solve(noisy, kernel(x, t)))
    out = model.transform(spark.createDataFrame(new)).orderBy("key").toPandas()
    # New points lie in the span of the landmarks only up to the kernel's own residual.
    inside = model.transform(df).orderBy("key").toPandas()
    at_rows = kernel(x, x) @ np.linalg.solve(noisy, y)
    own = kernel.diagonal(x) - np.einsum("ij,ji->i", kernel(x, x), np.linalg.solve(noisy, kernel(x, x)))
    assert np.allclose(inside[["pred_y", "pred_z"]], at_rows, atol=1e-6)
    assert np.allclose(inside["pred_std"], np.sqrt(np.maximum(own, 0)), atol=1e-4)
    assert np.allclose(out[["pred_y", "pred_z"]], mean, atol=1e-5)
    assert np.allclose(out["pred_std"], np.sqrt(np.maximum(variance, 0)), atol=1e-4)


def test_likelihood_from_statistics_is_exact(spark):
    pdf = data(25)
    model = fit("gaussian_process", spark.createDataFrame(pdf), ROLES, alpha=0.05, landmarks=25, length_scale=[0.3, 1.0, 5.0])
    x, y = pdf[["a", "b"]].to_numpy(), pdf[["y", "z"]].to_numpy()

    def exact(length):
        k = Kernel("RBF", length=length, constant=1.0)(x, x) + 0.05 * np.eye(25)
        _, size = np.linalg.slogdet(k)
        return sum(-0.5 * (c @ np.linalg.solve(k, c) + size + 25 * np.log(2 * np.pi)) for c in y.T)

    scores = {length: exact(length) for length in (0.3, 1.0, 5.0)}
    assert model.params["length_scale"] == max(scores, key=scores.get)
    assert np.isclose(model.log_likelihood, max(scores.values()), rtol=1e-8)


# ---- support vectors


def svr_objective(w, z, y, c, epsilon):
    return 0.5 * (w[1:] ** 2).sum(axis=0) + c * np.maximum(np.abs(z @ w - y) - epsilon, 0).sum(axis=0)


@pytest.mark.parametrize("params", [{"kernel": "linear"}, {"kernel": "rbf"}, {"kernel": "poly"}])
def test_support_vectors_reach_the_lowest_objective(rows, params):
    """No small move in any of many directions lowers the true (not rounded) objective by much."""
    model = fit("svr", rows, ROLES, C=2.0, epsilon=0.05, landmarks=60, **params)
    pdf = data()
    z = support_vector._design(model.map, pdf[["a", "b"]].to_numpy(), 2)
    y = pdf[["y", "z"]].to_numpy()
    best = svr_objective(model.weights, z, y, 2.0, 0.05)
    w, rng = model.weights.copy(), np.random.default_rng(0)
    low = best.copy()
    for step in range(4000):  # plain subgradient descent from the solution
        g = 2.0 * z.T @ (np.sign(z @ w - y) * (np.abs(z @ w - y) > 0.05))
        g[1:] += w[1:]
        w = w - 0.02 / (1 + step) * g
        low = np.minimum(low, svr_objective(w, z, y, 2.0, 0.05))
    for _ in range(300):
        low = np.minimum(low, svr_objective(model.weights + 0.02 * rng.normal(size=w.shape), z, y, 2.0, 0.05))
    assert (best <= low * 1.02 + 1e-3).all()


def test_support_vector_gamma_is_scaled(rows):
    model = fit("svr", rows, ROLES, landmarks=60)
    assert np.isclose(model.params["gamma"], 1 / (2 * data()[["a", "b"]].to_numpy().var()))


# ---- network


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(9, 3)), rng.normal(size=(9, 2))
    for name in ("tanh", "sigmoid", "leakyrelu", "relu"):
        layout = Layout((3, 4, 4, 2), name, "tanh")
        theta = layout.initial(1)
        _, g = layout.gradient(theta, x, y, rng)
        for i in rng.choice(len(theta), 12, replace=False):
            step = np.zeros_like(theta)
            step[i] = 1e-6
            up, down = (np.mean((layout.forward(theta + s, x) - y) ** 2) for s in (step, -step))
            assert abs((up - down) / 2e-6 - g[i]) < 1e-5


@pytest.mark.parametrize("optimizer", ["Adam", "SGD"])
def test_one_partition_is_the_sequential_algorithm(spark, optimizer):
    pdf = data(50)
    params = dict(epochs=3, batch_size=8, n_neurons=5, learning_rate=0.02, lr_step=2, lr_decrease_rate=0.5,
                  optimizer=optimizer, partitions=1, seed=3)
    model = fit("neural_network", spark.createDataFrame(pdf).repartition(4), ROLES, **params)
    ordered = folds_order(spark, pdf, 3)
    x, y = ordered[["a", "b"]].to_numpy(), ordered[["y", "z"]].to_numpy()
    layout = Layout((2, 5, 5, 2), "Tanh")
    theta = layout.initial(3)
    m, v, t, rate = np.zeros_like(theta), np.zeros_like(theta), 0, 0.02
    for epoch in range(3):
        rng = np.random.default_rng([3, epoch, 0, 0])
        order = rng.permutation(len(x))
        for start in range(0, len(x), 8):
            pick = order[start : start + 8]
            _, g = layout.gradient(theta, x[pick], y[pick], rng)
            if optimizer == "SGD":
                theta = theta - rate * g
                continue
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if (epoch + 1) % 2 == 0:
            rate *= 0.5
    assert np.allclose(model.theta, theta, atol=1e-10)


def folds_order(spark, pdf, seed):
    from emulon.functions.columns import unit_hash

    return spark.createDataFrame(pdf).withColumn("u", unit_hash("key", seed, "batch")).orderBy("u").toPandas()


def test_network_learns_and_repeats_itself(spark):
    df = spark.createDataFrame(data(400))
    params = dict(epochs=25, learning_rate=0.03, batch_size=8, partitions=3)
    one, two = (fit("neural_network", df.repartition(n), ROLES, **params) for n in (2, 5))
    assert np.array_equal(one.theta, two.theta)
    losses = [h[2] for h in one.history]
    assert losses[-1] < 0.2 * losses[0]


def test_early_stop_and_best_weights(spark):
    df = spark.createDataFrame(data(80))
    params = Network.complete(dict(epochs=40, patience=3, convergence_threshold=10.0, partitions=1))
    model = Network.fit(df, ROLES, params, validation=df)
    epochs = [h[0] for h in model.history if h[1] == "val"]
    assert len(epochs) == 4  # the first loss counts as an improvement, then three do not
    best = Network.fit(df, ROLES, {**params, "restore_best": True}, validation=df)
    assert not np.array_equal(best.theta, model.theta)


def test_plateau_schedule():
    job = network.NetworkJob(Network.complete({"schedule": "plateau", "plateau_patience": 1, "plateau_factor": 0.5}))
    job.rate = 1.0
    for epoch in range(5):
        network._after_epoch(job, epoch, 1.0)
    assert job.rate == 0.25


def test_dropout_is_off_when_predicting(rows):
    model = fit("neural_network", rows, ROLES, epochs=1, dropout_rate=0.5, partitions=1)
    assert np.array_equal(predictions(model, rows), predictions(model, rows))


# ---- all kinds


SMALL = {
    "response_surface": {},
    "rbf": {"landmarks": 20, "alpha": 0.01},
    "gaussian_process": {"landmarks": 20},
    "svr": {"landmarks": 20},
    "neural_network": {"epochs": 2, "partitions": 2},
}


@pytest.mark.parametrize("kind", SMALL)
def test_store_and_load(spark, rows, kind, tmp_path):
    model = fit(kind, rows, ROLES, **SMALL[kind])
    model.save(spark, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert type(again) is type(model) and again.outputs == model.outputs
    assert np.allclose(predictions(again, rows), predictions(model, rows), rtol=1e-12)


@pytest.mark.parametrize("kind", SMALL)
def test_one_output_has_one_column(spark, kind):
    df = spark.createDataFrame(data(16)).select("key", "a", "y")
    model = fit(kind, df, Roles("key", ("a",), ("y",)), **SMALL[kind])
    done = model.transform(df)
    assert "pred_y" in done.columns and done.where("pred_y is not null").count() == 16


def test_unknown_kind_and_parameter(rows):
    with pytest.raises(ValueError, match="unknown model kind"):
        fit("forest", rows, ROLES)
    with pytest.raises(ValueError, match="unknown parameters"):
        fit("rbf", rows, ROLES, degree=3)


# ---- validation and search


def test_cross_validation_equals_separate_fits(spark, rows):
    run = cross_validate("response_surface", rows, ROLES, k=4, degree=1)
    pdf = folds(rows, "key", 4).orderBy("key").toPandas()
    for r in run.losses.collect():
        held = pdf[pdf["fold"] == r["fold"]]
        kept = pdf[pdf["fold"] != r["fold"]]
        x = np.c_[np.ones(len(kept)), kept[["a", "b"]]]
        w = np.linalg.lstsq(x, kept[["y", "z"]].to_numpy(), rcond=None)[0]
        gap = np.c_[np.ones(len(held)), held[["a", "b"]]] @ w - held[["y", "z"]].to_numpy()
        assert np.isclose(r["loss"], (gap**2).mean())
    whole = fit("response_surface", rows, ROLES, degree=1)
    assert np.allclose(run.model.weights, whole.weights)
    assert np.isclose(run.mean_loss, np.mean([r["loss"] for r in run.losses.collect()]))


@pytest.mark.parametrize("kind", SMALL)
def test_cross_validation_of_every_kind(rows, kind):
    run = cross_validate(kind, rows, ROLES, k=3, **SMALL[kind])
    assert run.losses.count() == 3 and np.isfinite(run.mean_loss) and run.model is not None


def test_hold_out(spark, rows):
    val = spark.createDataFrame(data(20, seed=8))
    model, losses = hold_out("response_surface", rows, val, ROLES, degree=1)
    got = {r["split"]: r["loss"] for r in losses.collect()}
    gap = predictions(model, val) - data(20, seed=8)[["y", "z"]].to_numpy()
    assert np.isclose(got["val"], (gap**2).mean())


def test_grid_search_finds_the_true_degree(rows):
    run = grid_search("response_surface", rows, Roles("key", ("a", "b"), ("y",)), {"degree": "1|2"}, k=3)
    assert run.best_params == {"degree": 2} and run.model.params["degree"] == 2
    assert run.table.count() == 6


def test_options_and_grids():
    assert parse_options("1|0.5|relu|True|None") == [1, 0.5, "relu", True, None]
    assert len(expand_grid({"a": "1|2", "b": [3, 4, 5]})) == 6


def test_squared_error_from_statistics(rows):
    found = gram.total(gram.moments(rows, {"m": fit("response_surface", rows, ROLES).map}, ("a", "b"), ("y", "z"))["m"])
    w, b = gram.least_squares(found)
    pdf = data()
    x = fit("response_surface", rows, ROLES).map(pdf[["a", "b"]].to_numpy())
    gap = x @ w + b - pdf[["y", "z"]].to_numpy()
    assert np.allclose(found.squared_error(w, b), (gap**2).sum(axis=0), atol=1e-9)
