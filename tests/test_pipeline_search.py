"""Preparation inside the folds, against fits that prepare each fold by hand."""

import numpy as np
import pandas as pd
import pytest

from emulon import Roles, fit
from emulon.operators.split import folds
from emulon.plans.pipeline_search import pipeline_search

ROLES = Roles("key", ("a", "b", "n"), ("y", "z"), ("n",))


def data(n=240, mean=0.0, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"key": range(n), "a": rng.uniform(-1, 2, n), "b": rng.exponential(2, n), "n": rng.integers(1, 4, n).astype(float)})
    pdf["y"] = 1 + 2 * pdf["a"] - pdf["a"] * pdf["b"] + pdf["n"] + 0.1 * rng.standard_normal(n)
    pdf["z"] = np.sin(pdf["a"]) + pdf["n"] ** 2
    pdf["a"] += mean
    pdf.loc[rng.random(n) < 0.2, "a"] = np.nan
    pdf.loc[rng.random(n) < 0.1, "b"] = np.nan
    pdf.loc[rng.random(n) < 0.3, "n"] = np.nan
    return pdf


def prepared(rest, rows, scaler):
    x = rows[["a", "b", "n"]].fillna(rest[["a", "b", "n"]].mean())
    filled = rest[["a", "b", "n"]].fillna(rest[["a", "b", "n"]].mean())
    for c in "ab":
        if scaler == "minmax":
            x[c] = (x[c] - filled[c].min()) / (filled[c].max() - filled[c].min())
        elif scaler == "standard":
            x[c] = (x[c] - filled[c].mean()) / filled[c].std(ddof=0)
    return x.to_numpy()


def terms(x, degree, bias):
    from emulon.operators.features import polynomial_terms

    return np.column_stack([np.prod(x[:, list(t)], axis=1) for t in polynomial_terms(range(3), degree, False, bias)])


@pytest.mark.parametrize("scaler", ["minmax", "standard", None])
@pytest.mark.parametrize("mean", [0.0, 1e4])
def test_surface_folds_equal_folds_prepared_by_hand(spark, scaler, mean):
    pdf = data(mean=mean)
    df = spark.createDataFrame(pdf).repartition(5)
    grid = {"degree": [1, 2, 3], "fit_intercept": [True, False]}
    run = pipeline_search("response_surface", df, ROLES, grid, k=3, scaler=scaler, include_bias=False)
    parted = folds(spark.createDataFrame(pdf), "key", 3).toPandas()
    got = {(r["params"], r["fold"]): r["loss"] for r in run.table.collect()}
    for degree in (1, 2, 3):
        for intercept in ("true", "false"):
            for f in range(3):
                rest, held = parted[parted["fold"] != f], parted[parted["fold"] == f]
                a, b = (terms(prepared(rest, p, scaler), degree, False) for p in (rest, held))
                if intercept == "true":
                    a, b = np.c_[np.ones(len(a)), a], np.c_[np.ones(len(b)), b]
                elif mean and scaler is None:
                    continue  # powers of a far column without a constant: the dense fit itself has few digits
                size = np.sqrt((a**2).sum(axis=0))
                w = np.linalg.lstsq(a / size, rest[["y", "z"]].to_numpy(), rcond=1e-12)[0]
                want = ((b / size @ w - held[["y", "z"]].to_numpy()) ** 2).mean()
                loss = got['{"degree": %d, "fit_intercept": %s}' % (degree, intercept), f]
                if not (mean and scaler is None):
                    assert np.isclose(loss, want, rtol=1e-6), (degree, intercept, f)
                assert np.isfinite(loss)
    for r in run.preparations.where("column = 'a'").collect():
        rest = parted[parted["fold"] != r["fold"]]["a"]
        centre, scale = {"minmax": (rest.min(), rest.max() - rest.min()), "standard": (rest.mean(), rest.fillna(rest.mean()).std(ddof=0)), None: (0, 1)}[scaler]
        assert np.allclose([r["fill"], r["centre"], r["scale"]], [rest.mean(), centre, scale])
    means = run.table.groupBy("candidate").avg("loss").toPandas()["avg(loss)"]
    assert np.isclose(run.best_loss, means.min())


def test_the_final_fit_scores_raw_rows(spark, tmp_path):
    from emulon import Scorer

    pdf = data()
    df = spark.createDataFrame(pdf)
    run = pipeline_search("response_surface", df, ROLES, {"degree": [2]}, k=3)
    x = prepared(pdf, pdf, "minmax")
    a = np.c_[np.ones(len(x)), terms(x, 2, False)]
    w = np.linalg.lstsq(a, pdf[["y", "z"]].to_numpy(), rcond=None)[0]
    run.scorer.save(spark, str(tmp_path / "s"))
    for scorer in (run.scorer, Scorer.load(spark, str(tmp_path / "s"))):
        out = scorer.transform(df).orderBy("key").toPandas()
        assert np.allclose(out[["pred_y", "pred_z"]], a @ w, atol=1e-8)
        assert out["a"].isna().equals(pdf["a"].isna())


def test_one_scan_serves_all_candidates(spark, monkeypatch):
    from emulon.plans import pipeline_search as module

    calls = []
    monkeypatch.setattr(module, "moments", lambda *a, f=module.moments: calls.append(1) or f(*a))
    pipeline_search("response_surface", spark.createDataFrame(data()), ROLES, {"degree": [1, 2], "include_bias": [True, False]}, k=3)
    assert calls == [1]


@pytest.mark.parametrize("kind, grid, extra", [
    ("rbf", {"alpha": [0.01, 1.0]}, {"landmarks": 30, "gamma": 1.0}),
    ("gaussian_process", {"alpha": [0.01]}, {"landmarks": 20}),
    ("svr", {"epsilon": [0.05]}, {"kernel": "linear"}),
    ("neural_network", {"learning_rate": [0.01, 0.05]}, {"epochs": 3, "partitions": 1}),
])
def test_other_kinds_are_trained_on_rows_prepared_for_each_fold(spark, kind, grid, extra):
    pdf = data(120)
    df = spark.createDataFrame(pdf)
    run = pipeline_search(kind, df, ROLES, grid, k=2, **extra)
    assert run.table.count() == 2 * len(next(iter(grid.values()))) and run.model.kind == kind
    assert np.isfinite([r["loss"] for r in run.table.collect()]).all()
    assert run.scorer.transform(df).where("pred_y is null").count() == 0
    if kind != "rbf":
        return
    parted = folds(df, "key", 2).toPandas()
    for f in (0, 1):  # the same fold by hand
        rest, held = parted[parted["fold"] != f], parted[parted["fold"] == f]
        names = ["a", "b", "n"]
        tables = [pd.DataFrame(prepared(rest, p, "minmax"), columns=names).assign(key=p["key"].to_numpy(), y=p["y"].to_numpy(), z=p["z"].to_numpy()) for p in (rest, held)]
        whole = spark.createDataFrame(pd.concat(tables))
        found = [r["loss"] for r in run.table.where(f"fold = {f}").orderBy("candidate").collect()]
        from emulon.plans.search import fold_losses
        from emulon.models import model_class
        cls = model_class("rbf")
        marked = whole.join(spark.createDataFrame(parted[["key", "fold"]]), "key")
        again = fold_losses("rbf", marked, ROLES, [cls.complete({"alpha": a, **extra}) for a in grid["alpha"]], only=[f])
        assert np.allclose(found, [x[f] for x in again], rtol=1e-6)


def test_what_cannot_be_prepared(spark):
    df = spark.createDataFrame(data(60))
    with pytest.raises(ValueError, match="scalers inside folds"):
        pipeline_search("response_surface", df, ROLES, {"degree": [1]}, scaler="robust")
    empty = df.selectExpr("key", "cast(null as double) as a", "b", "n", "y", "z")
    for kind in ("response_surface", "rbf"):
        with pytest.raises(ValueError, match="without any value"):
            pipeline_search(kind, empty, ROLES, {"seed": [1]} if kind == "rbf" else {"degree": [1]})


# ---- surfaces on columns of large mean


@pytest.mark.parametrize("degree, mean", [(3, 1e3), (2, 1e5), (2, 1e7), (3, 0.0)])
def test_surface_of_higher_degree_far_from_nought(spark, degree, mean):
    x = np.random.default_rng(1).random((400, 2))
    y = sum((v ** p * c) for p, c in zip(range(degree + 1), (1.0, -2.0, 3.0, 0.5)) for v in x.T) + x[:, 0] * x[:, 1]
    df = spark.createDataFrame([(i, float(mean + a), float(mean + b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "key int, a double, b double, y double")
    roles = Roles("key", ("a", "b"), ("y",))
    for p in ({}, {"fit_intercept": False}, {"include_bias": False}):
        model = fit("response_surface", df, roles, degree=degree, **p)
        out = model.transform(df).toPandas()
        tolerance = 1e-6 if mean < 1e6 else 2e-6  # the inputs themselves have lost digits
        assert np.abs(out["pred_y"] - out["y"]).max() < tolerance
        block = model.predict_block(out[["a", "b"]].to_numpy())
        assert np.allclose(block[:, 0], out["pred_y"])


def test_first_rows_unlike_the_others(spark):
    rng = np.random.default_rng(2)
    x = np.r_[np.full(1500, 5.0), 1e6 + rng.random(1500)]
    df = spark.createDataFrame([(i, float(v), float((v - 1e6) ** 2 if v > 10 else 0.0)) for i, v in enumerate(x)], "key int, a double, y double").coalesce(1)
    far = df.where("a > 10 or key < 1100")
    model = fit("response_surface", far, Roles("key", ("a",), ("y",)), degree=1)
    a, y = (far.toPandas()[c].to_numpy() for c in "ay")
    want = np.polyval(np.polyfit((a - a.mean()) / a.std(), y, 1), (a - a.mean()) / a.std())
    assert np.allclose(model.transform(far).toPandas()["pred_y"], want, atol=1e-6)


# ---- weights of at least nought


@pytest.mark.parametrize("n, k, seed", [(30, 8, 0), (500, 200, 1), (40, 60, 2)])
def test_active_sets_reach_the_lowest_error(n, k, seed):
    """Optimality: no weight below nought, no slope where a weight is free, none upward at nought."""
    import time

    from emulon.models.gram import _non_negative

    rng = np.random.default_rng(seed)
    x, y = rng.standard_normal((n, k)), rng.standard_normal((n, 2)) + 1
    x[:, 3] = x[:, 2]  # equal columns
    x[:, 5] = 0.0
    a, b = x.T @ x, x.T @ y
    start = time.perf_counter()
    w = _non_negative(a, b)
    assert time.perf_counter() - start < 5.0
    slope = b - a @ w
    size = np.abs(b).max()
    assert (w >= 0).all() and (slope < 1e-7 * size).all() and np.abs(slope[w > 0]).max() < 1e-7 * size


def test_active_sets_of_a_small_known_problem():
    from emulon.models.gram import _non_negative

    a = np.array([[2.0, 1.0], [1.0, 2.0]])
    assert np.allclose(_non_negative(a, np.array([[1.0, -1.0, 3.0], [-1.0, -1.0, 3.0]])), [[0.5, 0.0, 1.0], [0.0, 0.0, 1.0]])
    assert _non_negative(np.zeros((0, 0)), np.zeros((0, 1))).shape == (0, 1)
