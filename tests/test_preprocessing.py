import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emulon import PipelineSpec, Roles, prepare
from emulon.operators.forest import average_path
from emulon.operators.impute import fit_imputer
from emulon.operators.outliers import drop_outliers, fit_fences, isolation_scores
from emulon.operators.profile import boxplot_summary, profile, target_variance
from emulon.operators.scale import (
    TCP_MINMAX, fit_array_scaler, fit_output_scalers, fit_scalers, scaler_types)
from emulon.operators.split import folds, split


def table(spark, n=2000, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"key": [f"k{i}" for i in range(n)], "a": rng.normal(size=n), "b": rng.uniform(size=n),
                        "d": rng.integers(0, 3, n).astype(float)})
    pdf["y"] = 3 * pdf["a"] - pdf["b"]
    pdf["TCP_X_pos_list_0"] = pdf["a"] ** 2
    return spark.createDataFrame(pdf), pdf


ROLES = Roles("key", ("a", "b", "d"), ("y", "TCP_X_pos_list_0"), ("d",))


# ---- splits


def test_split_is_complete_and_near_its_shares(spark):
    df, pdf = table(spark)
    counts = {r["split"]: r["count"] for r in split(df, "key").groupBy("split").count().collect()}
    assert sum(counts.values()) == len(pdf)
    for name, share in (("test", 0.15), ("val", 0.15), ("train", 0.7)):
        assert abs(counts[name] - share * len(pdf)) < 5 * math.sqrt(len(pdf) * share * (1 - share))


def test_split_does_not_depend_on_partitions(spark):
    df, _ = table(spark)
    one = {r["key"]: r["split"] for r in split(df.repartition(1), "key").collect()}
    many = {r["key"]: r["split"] for r in split(df.repartition(13), "key").collect()}
    assert one == many
    other = {r["key"]: r["split"] for r in split(df, "key", seed=7).collect()}
    assert one != other


@pytest.mark.parametrize("n,test,val", [(101, 0.15, 0.15), (20, 0.2, None), (57, 0.3, 0.1), (10, 0.0, 0.5)])
def test_exact_split_counts(spark, n, test, val):
    df, _ = table(spark, n)
    counts = {r["split"]: r["count"] for r in split(df, "key", test, val, exact=True).groupBy("split").count().collect()}
    n_test = math.ceil(test * n)
    n_val = math.ceil(val / (1 - test) * (n - n_test)) if val else 0
    assert counts.get("test", 0) == n_test and counts.get("val", 0) == n_val
    assert counts["train"] == n - n_test - n_val


@pytest.mark.parametrize("test,val", [(1.0, 0.0), (-0.1, 0.0), (0.6, 0.4), (0.2, 1.0)])
def test_split_shares_are_checked(spark, test, val):
    df, _ = table(spark, 5)
    with pytest.raises(ValueError):
        split(df, "key", test, val)


def test_folds(spark):
    df, _ = table(spark, 503)
    sizes = sorted(r["count"] for r in folds(df, "key", 5, exact=True).groupBy("fold").count().collect())
    assert sizes == [100, 100, 101, 101, 101]
    loose = {r["fold"] for r in folds(df, "key", 5).collect()}
    assert loose == {0, 1, 2, 3, 4}


def test_folds_of_a_split_are_still_even(spark):
    """The rows of one split must not share a range of the fold hash."""
    df, _ = table(spark, 4000)
    train = split(df, "key", 0.5, None).where("split = 'train'")
    sizes = [r["count"] for r in folds(train, "key", 4).groupBy("fold").count().collect()]
    assert len(sizes) == 4 and min(sizes) > 0.8 * max(sizes)


# ---- imputation


def test_mean_of_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "a double")
    assert sorted(r["a"] for r in fit_imputer(df, ["a"]).transform(df).collect()) == [1.0, 2.0, 2.0, 3.0]


def test_column_without_values_is_an_error(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    with pytest.raises(ValueError, match="b"):
        fit_imputer(df, ["a", "b"])


def test_indicator_flags_only_columns_with_gaps(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 2.0)], "a double, b double")
    done = fit_imputer(df, ["a", "b"], "missing indicator").transform(df)
    assert done.columns == ["a", "b", "a_missing"]
    assert [tuple(r) for r in done.orderBy("b").collect()] == [(1.0, 1.0, False), (1.0, 2.0, True)]


# ---- scalers


def test_constant_column_becomes_zero(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "k double")
    for kind in ("minmax", "standard", "robust"):
        assert {r["k"] for r in fit_scalers(df, {"k": kind}).transform(df).collect()} == {0.0}


def test_scalers_against_numpy_and_back(spark):
    df, pdf = table(spark)
    fitted = fit_scalers(df, {"a": "minmax", "b": "standard", "y": "robust"})
    scaled = fitted.transform(df)
    got = scaled.orderBy("key").toPandas()
    ordered = pdf.sort_values("key").reset_index(drop=True)
    q1, q2, q3 = np.quantile(ordered["y"], [0.25, 0.5, 0.75])
    assert np.allclose(got["a"], (ordered["a"] - ordered["a"].min()) / np.ptp(ordered["a"]))
    assert np.allclose(got["b"], (ordered["b"] - ordered["b"].mean()) / ordered["b"].std(ddof=0))
    assert np.allclose(got["y"], (ordered["y"] - q2) / (q3 - q1))
    back = fitted.inverse(scaled).orderBy("key").toPandas()
    assert np.allclose(back[["a", "b", "y"]], ordered[["a", "b", "y"]])


def test_rules_and_unknown_scaler(spark):
    assert scaler_types(["y", "TCP_1"], "standard", [TCP_MINMAX]) == {"y": "standard", "TCP_1": "minmax"}
    df, _ = table(spark, 20)
    fitted = fit_output_scalers(df, ROLES, "standard", {"y": "robust"}, [TCP_MINMAX])
    assert {c: s.kind for c, s in fitted.by_column.items()} == {"y": "robust", "TCP_X_pos_list_0": "minmax"}
    with pytest.raises(ValueError):
        fit_scalers(df, {"a": "none"})


def test_array_scaler_round_trip(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0, 2.0]), (1, [3.0, 5.0, 4.0])], "id int, v array<double>")
    fitted = fit_array_scaler(df, "v")
    scaled = fitted.transform(df, "v")
    assert [r["v"] for r in scaled.orderBy("id").collect()] == [[0.0, 0.0, 0.0], [1.0, 0.0, 1.0]]
    assert [r["v"] for r in fitted.inverse(scaled, "v").orderBy("id").collect()] == [[1.0, 5.0, 2.0], [3.0, 5.0, 4.0]]


# ---- outliers


def test_missing_cell_is_kept_or_dropped(spark):
    df = spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in
                                enumerate([1, 2, 3, 4, 5, None, 100])], "key int, a double")
    keep = {r["key"] for r in fit_fences(df, ["a"]).transform(df).collect()}
    drop = {r["key"] for r in fit_fences(df, ["a"], nulls="drop").transform(df).collect()}
    assert keep == {0, 1, 2, 3, 4, 5} and drop == {0, 1, 2, 3, 4}


@pytest.mark.parametrize("method", ["isolation forest", "isolation_forest"])
def test_isolation_forest_removes_its_share_and_planted_points(spark, method):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(400, 3)), [[9, 9, 9], [-9, 9, 9], [9, -9, 9]]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(key=range(403)))
    kept = {r["key"] for r in drop_outliers(df, "key", ["a", "b", "c"], method).collect()}
    assert not kept & {400, 401, 402}
    assert abs((403 - len(kept)) / 403 - 0.05) < 0.02


def test_isolation_score_of_a_two_row_tree(spark):
    """Two rows are parted by one cut: both have path one, which is the norm, so the score is a half."""
    df = spark.createDataFrame([(0, 1.0), (1, 2.0)], "key int, a double")
    assert [r["anomaly"] for r in isolation_scores(df, "key", ["a"]).collect()] == [0.5, 0.5]
    assert average_path(1) == 0 and average_path(2) == 1
    assert abs(average_path(256) - (2 * (math.log(255) + 0.5772156649015329) - 2 * 255 / 256)) < 1e-12


def test_unknown_filter(spark):
    df, _ = table(spark, 5)
    with pytest.raises(ValueError):
        drop_outliers(df, "key", ["a"], "nothing")


# ---- profiles


def test_profile_boxplot_and_variance(spark):
    df, pdf = table(spark, 300)
    stats = {(r["column"], r["stat"]): r["value"] for r in profile(df, ["a", "d"], exact_distinct=True).collect()}
    assert stats["a", "count"] == 300 and stats["d", "distinct"] == 3
    assert np.isclose(stats["a", "std"], pdf["a"].std()) and np.isclose(stats["a", "q25"], pdf["a"].quantile(0.25))
    box = boxplot_summary(df, ["a"]).head()
    q1, q3 = pdf["a"].quantile([0.25, 0.75])
    inside = pdf["a"][pdf["a"].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))]
    assert box["whisker_low"] == inside.min() and box["outliers"] == 300 - len(inside)
    variance = {r["output"]: r["variance"] for r in target_variance(df, ["y", "TCP_X_pos_list_0"]).collect()}
    both = pdf[["y", "TCP_X_pos_list_0"]].to_numpy()
    assert np.isclose(variance["all"], both.var()) and np.isclose(variance["y"], pdf["y"].var())


# ---- the order of steps


def test_training_statistics_ignore_other_rows(spark):
    df, _ = table(spark)
    spec = PipelineSpec(filter="iqr", val=0.1)
    moved = df.join(split(df, "key", spec.test, spec.val, spec.seed).select("key", "split"), "key")
    moved = moved.withColumn("a", F.when(F.col("split") == "train", F.col("a")).otherwise(F.col("a") * 1000)).drop("split")
    one, two = prepare(df, ROLES, spec), prepare(moved, ROLES, spec)
    for a, b in ((one.input_scalers, two.input_scalers), (one.output_scalers, two.output_scalers)):
        for c in a.by_column:
            assert np.isclose(a.by_column[c].center, b.by_column[c].center, rtol=1e-12)
            assert np.isclose(a.by_column[c].scale, b.by_column[c].scale, rtol=1e-12)


def test_only_training_rows_are_filtered(spark):
    df, _ = table(spark)
    spec = PipelineSpec(filter="iqr", val=0.1)
    before = {r["split"]: r["count"] for r in split(df, "key", 0.15, 0.1).groupBy("split").count().collect()}
    after = {r["split"]: r["count"] for r in prepare(df, ROLES, spec).table.groupBy("split").count().collect()}
    assert after["test"] == before["test"] and after["val"] == before["val"] and after["train"] < before["train"]


def test_discrete_inputs_are_not_scaled(spark):
    df, _ = table(spark)
    done = prepare(df, ROLES, PipelineSpec(filter="iqr"))
    assert {r["d"] for r in done.table.select("d").distinct().collect()} == {0.0, 1.0, 2.0}


def test_roles_and_spec_are_checked(spark):
    with pytest.raises(ValueError):
        Roles("key", ("a",), ("y",), ("z",))
    with pytest.raises(ValueError):
        Roles("key", ("a",), ("a",))
    with pytest.raises(ValueError):
        PipelineSpec(metric="rmse")
    with pytest.raises(ValueError):
        PipelineSpec(test=0.6, val=0.5)
    assert PipelineSpec(filter="isolation_forest").filter == "isolation forest"
    df, _ = table(spark, 5)
    with pytest.raises(ValueError, match="nope"):
        Roles("key", ("nope",), ("y",)).check(df)


def test_rows_with_missing_cells_are_not_lost_as_outliers(spark):
    import numpy as np

    from emulon.operators.outliers import drop_outliers, lof_scores

    rng = np.random.default_rng(3)
    rows = [(i, float(1000 + v), None if i % 10 == 0 else float(1000 + w)) for i, (v, w) in enumerate(rng.standard_normal((300, 2)))]
    rows.append((300, 1500.0, 1500.0))
    df = spark.createDataFrame(rows, "k int, a double, y double").cache()
    kept = {r["k"] for r in drop_outliers(df, "k", ["a", "y"], "isolation forest").collect()}
    assert 300 not in kept and len([k for k in kept if k % 10 == 0]) >= 24
    scored = {r["k"]: r["lof"] for r in lof_scores(df, "k", ["a", "y"]).collect()}
    assert len(scored) == 301 and all((scored[k] is None) == (k % 10 == 0 and k < 300) for k in scored)
    assert {r["k"] for r in drop_outliers(df, "k", ["a", "y"], "lof").collect()} >= set(range(0, 300, 10))
    one = lof_scores(df.where("k = 5"), "k", ["a", "y"]).collect()
    assert [(r["k"], r["lof"]) for r in one] == [(5, None)]
