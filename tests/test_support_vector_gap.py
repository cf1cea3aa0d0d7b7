"""Support vectors with a certificate: objective, bound, gap."""

import numpy as np
import pandas as pd
import pytest

from emulon import Roles, fit, load_model
from emulon.models import support_vector
from tests.test_models import ROLES, data, svr_objective

LINE = Roles("key", ("x",), ("y",))


def on_a_line(n=500, noise=0.0, shift=0.0):
    rng = np.random.default_rng(1)
    x = shift + rng.uniform(0, 5, n)
    return pd.DataFrame({"key": range(n), "x": x, "y": 2 * (x - shift) + 1 + noise * rng.standard_normal(n)})


@pytest.mark.parametrize("tol", [1e-3, 1e-7])
def test_known_optimum(spark, tol):
    """Rows on a line: the flattest line inside the tube touches it at both ends."""
    pdf = on_a_line()
    model = fit("svr", spark.createDataFrame(pdf).repartition(3), LINE, kernel="linear", epsilon=0.1, C=1.0, tol=tol)
    span = pdf["x"].max() - pdf["x"].min()
    slope = 2 - 0.2 / span
    row = model.certificate(spark).head()
    assert row["converged"] and 0 <= row["gap"] <= tol * row["objective"]
    assert row["bound"] <= 0.5 * slope**2 * (1 + 1e-12) and 0.5 * slope**2 <= row["objective"] * (1 + 1e-9)
    assert abs(model.weights[1, 0] - slope) <= np.sqrt(2 * tol * row["objective"]) + 1e-9


@pytest.mark.parametrize("params", [{"kernel": "linear"}, {"kernel": "rbf"}, {"kernel": "poly"}])
def test_gap_holds_the_lowest_objective(spark, params):
    rows = spark.createDataFrame(data())
    model = fit("svr", rows, ROLES, C=2.0, epsilon=0.05, landmarks=60, tol=1e-4, **params)
    z = support_vector._design(model.map, data()[["a", "b"]].to_numpy(), 2)
    value = svr_objective(model.weights, z, data()[["y", "z"]].to_numpy(), 2.0, 0.05)
    assert np.allclose(value, model.objective, rtol=1e-9)
    done = model.certificate(spark).collect()
    assert all(r["converged"] and r["bound"] <= r["objective"] for r in done)
    rng = np.random.default_rng(0)
    for size in (1e-3, 1e-2, 0.1, 1.0):  # nothing goes below the bound
        for _ in range(200):
            tried = svr_objective(model.weights + size * rng.standard_normal(model.weights.shape), z, data()[["y", "z"]].to_numpy(), 2.0, 0.05)
            assert (tried >= model.bound).all()


def test_outputs_of_any_size(spark):
    pdf = data()
    pdf["y"], pdf["z"] = 1e6 * pdf["y"], 1e-4 * pdf["z"]
    model = fit("svr", spark.createDataFrame(pdf), Roles("key", ("a", "b"), ("y",)), kernel="linear", epsilon=1e4, C=1e6)
    assert model.certificate(spark).head()["converged"]


def test_a_fit_that_does_not_get_there_says_so(spark, monkeypatch):
    monkeypatch.setattr(support_vector, "MAX_WIDTHS", 2)
    with pytest.warns(UserWarning, match="not within tol"):
        model = fit("svr", spark.createDataFrame(on_a_line(noise=0.3)), LINE, kernel="linear", tol=1e-12)
    assert not model.certificate(spark).head()["converged"]


def test_certificate_is_stored(spark, tmp_path):
    model = fit("svr", spark.createDataFrame(on_a_line()), LINE, kernel="linear")
    model.save(spark, str(tmp_path / "m"))
    assert load_model(spark, str(tmp_path / "m")).certificate(spark).collect() == model.certificate(spark).collect()


def test_scaled_gamma_far_from_nought(spark):
    df = spark.createDataFrame(on_a_line(shift=1e8))
    want = 1 / on_a_line(shift=1e8)["x"].to_numpy().var()
    assert support_vector._scale_gammas(df, ["x"], None)[None] == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("keys", ["own", "null"])
def test_descents_on_shares_leave_few_scans_of_all_rows(spark, monkeypatch, keys):
    """A large table is searched from where its shares ended; the certificate is still about all rows."""
    pdf = on_a_line(n=6000, noise=0.3)
    rows = spark.createDataFrame(pdf).repartition(3)
    if keys == "null":  # no hash, so no share: the descent begins on all rows
        rows = rows.selectExpr("cast(null as bigint) as key", "x", "y")
    params = {"kernel": "rbf", "landmarks": 20, "epsilon": 0.1} if keys == "own" else {"kernel": "linear"}
    scans, seen = [], support_vector._scan
    monkeypatch.setattr(support_vector, "_scan", lambda table, *a: (scans.append(table.count()), seen(table, *a))[1])
    whole = fit("svr", rows, LINE, **params)
    before, scans[:] = len(scans), []
    monkeypatch.setattr(support_vector, "FIRST_ROWS", 300)
    model = fit("svr", rows, LINE, **params)
    last = scans.count(6000)
    assert 0 < last < before if keys == "own" else last == before == len(scans)
    z = support_vector._design(model.map, pdf[["x"]].to_numpy(), 1)
    assert np.allclose(svr_objective(model.weights, z, pdf[["y"]].to_numpy(), 1.0, 0.1), model.objective, rtol=1e-9)
    assert model.certificate(spark).head()["converged"] and model.bound[0] <= whole.objective[0] and whole.bound[0] <= model.objective[0]
