"""Kernel parameters found by climbing the likelihood."""

import numpy as np
import pandas as pd
import pytest

from emulon import Roles, fit
from emulon.models.landmarks import Kernel

ROLES = Roles("key", ("x",), ("y",))


def planted(spark, kernel, n=240, span=24.0, noise=1e-3, seed=5):
    rng = np.random.default_rng(seed)
    x = np.sort(rng.uniform(0, span, n))[:, None]
    cov = kernel(x, x) + noise * np.eye(n)
    y = np.linalg.cholesky(cov) @ rng.standard_normal((n, 4))  # four draws of one process
    pdf = pd.DataFrame({"key": range(n), "x": x[:, 0], **{f"y{i}": y[:, i] for i in range(4)}})
    return spark.createDataFrame(pdf), Roles("key", ("x",), tuple(f"y{i}" for i in range(4))), x, y


def dense(kernel, x, y, noise):
    cov = kernel(x, x) + noise * np.eye(len(x))
    half = np.linalg.cholesky(cov)
    inner = np.linalg.solve(half, y)
    return float(-0.5 * ((inner**2).sum() + y.shape[1] * (2 * np.log(np.diag(half)).sum() + len(x) * np.log(2 * np.pi))))


@pytest.mark.parametrize("start", [0.6, 2.5])
def test_planted_length_is_found(spark, start):
    df, roles, x, y = planted(spark, Kernel("Matern", nu=2.5, length=1.3))
    model = fit("gaussian_process", df, roles, kernel="Matern", nu=2.5, length_scale=start, alpha=1e-3, landmarks=240, refine=8)
    lengths = np.exp(np.linspace(np.log(0.8), np.log(2.0), 400))
    best = lengths[np.argmax([dense(Kernel("Matern", nu=2.5, length=v), x, y, 1e-3) for v in lengths])]
    assert abs(model.params["length_scale"] / best - 1) < 0.02
    assert abs(model.params["length_scale"] / 1.3 - 1) < 0.05  # what the draws themselves allow
    assert model.log_likelihood == pytest.approx(dense(Kernel("Matern", nu=2.5, length=model.params["length_scale"]), x, y, 1e-3), rel=1e-6)


def test_planted_length_within_two_percent(spark):
    df, roles, *_ = planted(spark, Kernel("RBF", length=0.8, constant=0.5), noise=1e-4, n=300, span=30)
    model = fit("gaussian_process", df, roles, kernel="RBF", length_scale=[0.3, 2.0], constant=1.0, alpha=1e-4, landmarks=300, refine=10)
    assert abs(model.params["length_scale"] / 0.8 - 1) < 0.02


def test_every_scan_can_only_help(spark):
    df, roles, *_ = planted(spark, Kernel("ExpSineSquared", length=1.0, period=3.0), noise=1e-2, n=120)
    values = [fit("gaussian_process", df, roles, kernel="ExpSineSquared", length_scale=1.5, periodicity=3.1, alpha=1e-2, landmarks=60, refine=r).log_likelihood
              for r in (0, 2, 6)]
    assert values == sorted(values) and values[-1] > values[0]
