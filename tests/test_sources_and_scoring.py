import math

import numpy as np
import pandas as pd
import pytest

from emulon import PipelineSpec, Roles, Scorer, fit, score_row, train_and_evaluate
from emulon.operators import evaluate
from emulon.operators.features import expand_lists, expand_polynomial, family_values
from emulon.operators.scale import fit_scalers
from emulon.sources import store, tables
from emulon.streaming.scoring import monitor_errors, write_scores


# ---- sources


def test_bad_keys_are_refused(spark):
    x = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0)], "key int, a double")
    y = spark.createDataFrame([(1, 1.0), (3, 2.0)], "key int, y double")
    report = tables.pair_report(x, y, "key")
    assert (report.duplicate_inputs, report.duplicate_outputs, report.orphan_inputs, report.orphan_outputs) == (1, 0, 1, 1)
    with pytest.raises(ValueError, match="not unique"):
        tables.align(x, y, "key", orphans="drop")
    with pytest.raises(ValueError, match="without a partner"):
        tables.align(x.dropDuplicates(["key"]), y, "key")
    assert tables.align(x.dropDuplicates(["key"]), y, "key", orphans="drop").count() == 1


def test_pairing_by_position(spark):
    x = spark.range(0, 50, 1, 4).selectExpr("id as a")
    y = spark.range(0, 50, 1, 7).selectExpr("id * 2 as b")
    pair = tables.pair_by_position(x, y)
    assert pair.where("b = 2 * a").count() == 50
    with pytest.raises(ValueError):
        tables.pair_by_position(x, y.limit(10))


def test_decimal_comma(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("a;b\n1,5;2,25\nx;3\n")
    assert [tuple(r) for r in tables.read_decimal_comma(spark, str(path)).collect()] == [(1.5, 2.25), (None, 3.0)]
    assert {r["column"]: r["bad"] for r in tables.bad_cells(spark, str(path)).collect()} == {"a": 1, "b": 0}


def test_nan_is_missing_on_load(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("a,b\n1.0,NaN\n,2.0\n")
    assert [tuple(r) for r in tables.read_table(spark, str(path), "a double, b double").collect()] == [(1.0, None), (None, 2.0)]


def test_divide_and_pair_again(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "key int, a double, b double, y double")
    x, y = tables.write_divided(df, 2, str(tmp_path / "t"), "key")
    assert tables.read_pair(spark, x, y, "key").columns == ["key", "a", "b", "y"]
    with pytest.raises(ValueError):
        tables.divide_columns(df, 3, "key")


def test_bundle_reads_one_split_only(spark, tmp_path):
    path = str(tmp_path / "bundle")
    tables.write_bundle(spark.createDataFrame([(1, "train"), (2, "test")], "key int, split string"), path)
    one = tables.read_bundle(spark, path, "test")
    assert [r["key"] for r in one.collect()] == [2]
    assert "PartitionFilters: [isnotnull(split" in one._jdf.queryExecution().executedPlan().toString()


# ---- shaping


def test_lists(spark):
    df = spark.createDataFrame([(0, "[1.0, 2, None]"), (1, "[3]"), (2, None)], "id int, v string")
    wide = expand_lists(df)
    assert wide.columns == ["id", "v_0", "v_1", "v_2"]
    assert [tuple(r) for r in wide.orderBy("id").collect()] == [
        (0, 1.0, 2.0, None), (1, 3.0, None, None), (2, None, None, None)]
    assert expand_lists(df, ["v"], {"v": 1}).columns == ["id", "v_0"]


def test_polynomial_names(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    row = expand_polynomial(df, ["a", "b"], 2).head().asDict()
    assert row == {"1": 1.0, "a": 2.0, "b": 3.0, "a^2": 4.0, "a b": 6.0, "b^2": 9.0}


def test_families_match_inside_a_name(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "key int, my_TCP_A_pos_list_3 double, other double")
    assert [tuple(r) for r in family_values(df, "key", df.columns[1:]).collect()] == [
        (1, "TCP_A_pos_list", "my_TCP_A_pos_list_3", 1.0)]


# ---- evaluation


def test_number_format(spark):
    from emulon.functions.columns import format_number

    df = spark.createDataFrame([(0, 0.0), (1, 0.00005), (2, 1.5), (3, 20000.0), (4, -0.00002)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").selectExpr(format_number("x")).collect()]
    assert got == ["0.000000", "5.000000e-05", "1.500000", "2.000000e+04", "-2.000000e-05"]


def test_zero_truth(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0, 1.0), (2, 2.0, 1.0)], "key int, y double, pred_y double")
    table = {(r["output"], r["metric"]): r["value"] for r in evaluate.metrics(df, ["y"], ["mse", "mae", "mape"]).collect()}
    y, p = np.array([0.0, 1.0, 2.0]), np.ones(3)
    assert np.isclose(table["y", "mape"], np.mean(np.abs((y - p) / (y + 1e-10))) * 100)
    assert np.isclose(table["all", "mse"], 2 / 3)
    exact = spark.createDataFrame([(0, -1e-10, 1.0)], "key int, y double, pred_y double")
    assert evaluate.residuals(exact, "key", ["y"]).head()["error_pct"] is None
    with pytest.raises(ValueError):
        evaluate.metrics(df, ["y"], ["rmse"])


def test_histogram_against_numpy(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"y": rng.normal(size=500), "pred_y": rng.normal(size=500)})
    got = evaluate.histogram(spark.createDataFrame(pdf), ["y"]).orderBy("bin").toPandas()
    counts, edges = np.histogram(pdf["y"] - pdf["pred_y"], bins=50)
    assert got["rows"].tolist() == counts.tolist() and np.allclose(got["low"], edges[:-1])
    flat = spark.createDataFrame([(1.0, 1.0)] * 3, "y double, pred_y double")
    assert evaluate.histogram(flat, ["y"]).where("rows = 3").count() == 1


def test_diagnostics_of_perfect_predictions(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "y double, pred_y double")
    row = evaluate.diagnostics(df, ["y"]).head()
    assert row["bias"] == 0 and row["error_vs_pred"] is None and row["outliers"] == 0


def test_primary_metric_is_the_one_asked_for(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "y double, pred_y double")
    both = evaluate.metrics_both_scales(df, ["y"], fit_scalers(df, {"y": "minmax"}), ["mape"])
    assert np.isclose(evaluate.primary_metric(both, "mape"), 50, atol=1e-6)
    with pytest.raises(ValueError):
        evaluate.primary_metric(both, "mse")


# ---- scoring


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"key": range(300), "a": rng.uniform(5, 9, 300), "b": rng.uniform(-1, 1, 300)})
    pdf["y"] = 4 * pdf["a"] - pdf["b"] + 7
    df = spark.createDataFrame(pdf).cache()
    inputs, outputs = fit_scalers(df, {"a": "minmax", "b": "standard"}), fit_scalers(df, {"y": "robust"})
    model = fit("response_surface", outputs.transform(inputs.transform(df)), Roles("key", ("a", "b"), ("y",)), degree=1)
    return df, Scorer(model, inputs, outputs)


def test_rows_are_scored_by_name(spark, line, tmp_path):
    df, scorer = line
    assert np.isclose(score_row(spark, scorer, {"b": 0.5, "a": 6.0})["y"], 4 * 6 - 0.5 + 7)
    for wrong in ({"a": 1.0}, {"a": 1.0, "b": 2.0, "c": 3.0}):
        with pytest.raises(ValueError):
            score_row(spark, scorer, wrong)
    scorer.save(spark, str(tmp_path / "s"))
    again = Scorer.load(spark, str(tmp_path / "s"))
    mixed = df.select("y", "b", "key", "a")
    done = again.transform(mixed)
    assert done.columns == ["y", "b", "key", "a", "pred_y"]
    assert done.where("abs(pred_y - y) > 1e-9").count() == 0
    assert done.join(df.select("key", "a"), ["key", "a"]).count() == 300  # inputs come out as they went in


def test_stream_equals_batch(spark, line, tmp_path):
    df, scorer = line
    df.select("key", "a", "b").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key bigint, a double, b double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write_scores(stream, scorer, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).orderBy("key").toPandas()
    batch = scorer.transform(df.select("key", "a", "b")).orderBy("key").toPandas()
    assert np.array_equal(streamed["pred_y"], batch["pred_y"])


def test_errors_per_window(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", float(i)) for i in range(0, 600, 5)]
    df = spark.createDataFrame(rows, "key int, t string, y double").selectExpr("key", "cast(t as timestamp) as t", "y")
    df.selectExpr("key", "t as made", "y + 2 as pred_y").write.parquet(str(tmp_path / "p"))
    df.selectExpr("key", "t + interval 5 minutes as seen", "y").write.parquet(str(tmp_path / "t"))
    windows = monitor_errors(
        spark.readStream.schema("key int, made timestamp, pred_y double").parquet(str(tmp_path / "p")),
        spark.readStream.schema("key int, seen timestamp, y double").parquet(str(tmp_path / "t")),
        "key", ["y"], "made", "seen")
    query = (windows.writeStream.format("parquet").option("path", str(tmp_path / "o"))
             .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o")).toPandas()
    assert len(got) >= 7 and (got["rows"] == 12).all() and np.allclose(got["mse_y"], 4) and np.allclose(got["mae_y"], 2)


# ---- sinks


def test_report_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 2.5), (2, 4.0, 3.0)], "key int, y double, pred_y double")
    store.write_error_report(df, "key", ["y"], str(tmp_path / "r"))
    lines = {r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()}
    assert "row 1: y -> expected=2.000000, predicted=2.500000, error=0.500000, error%=25.000000%" in lines
    assert "Mean: y -> error=0.750000, error%=25.000000%" in lines
    paths = store.write_predictions(df, "key", ["y"], str(tmp_path / "p"))
    assert [spark.read.csv(p, header=True).count() for p in paths] == [2, 2]


# ---- the whole run


@pytest.mark.parametrize("validation,metric,flt,imputer", [
    ("cross", "mape", "isolation_forest", "simple"), ("single", "mae", "lof", "knn"), ("single", "mse", "iqr", "missing indicator")])
def test_training_run(spark, validation, metric, flt, imputer):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"key": range(400), "a": rng.uniform(size=400), "b": rng.uniform(size=400)})
    pdf["y"], pdf["TCP_X_pos_list_0"] = 5 + pdf["a"] - 2 * pdf["b"], 1 + pdf["a"] * pdf["b"]
    pdf.loc[::19, "b"] = math.nan
    run = train_and_evaluate(
        spark.createDataFrame(pdf), Roles("key", ("a", "b"), ("y", "TCP_X_pos_list_0")),
        PipelineSpec(kind="response_surface", validation=validation, val=0.2, metric=metric, filter=flt, imputer=imputer))
    assert run.metric is not None and run.validation_loss >= 0
    assert run.predictions.count() == run.prepared.part("test").count()
    scales = {r["scale"] for r in run.metrics.collect()}
    assert scales == {"scaled", "original"}
    assert {r["output"] for r in run.mean_errors.collect()} == {"y", "TCP_X_pos_list_0"}


def test_single_mode_without_validation_share_falls_back(spark):
    pdf = pd.DataFrame({"key": range(60), "a": np.linspace(0, 1, 60)})
    pdf["y"] = pdf["a"]
    run = train_and_evaluate(spark.createDataFrame(pdf), Roles("key", ("a",), ("y",)),
                             PipelineSpec(validation="single", val=0.0, filter="iqr", kind="neural_network",
                                          params={"epochs": 2, "partitions": 1}, folds=2))
    assert run.validation_loss is not None and run.losses.count() == 2


def test_null_keys_are_faults(spark):
    from emulon.sources.tables import align, pair_report

    x = spark.createDataFrame([(1, 1.0), (None, 2.0)], "k int, a double")
    y = spark.createDataFrame([(1, 1.0), (None, 2.0), (None, 3.0)], "k int, b double")
    report = pair_report(x, y, "k")
    assert (report.null_inputs, report.null_outputs, report.clean) == (1, 2, False)
    with pytest.raises(ValueError):
        align(x, y, "k")
    assert align(x, y, "k", orphans="drop").count() == 1


def test_positions_of_shuffled_rows_are_refused(spark, tmp_path):
    from emulon.sources.tables import number_rows

    spark.range(0, 100, 1, 4).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r["row_id"] for r in number_rows(df).collect()) == list(range(100))
    for moved in (df.repartition(3), df.orderBy("id"), df.groupBy("id").count(), df.join(df.withColumnRenamed("id", "other").limit(3)), df.limit(5)):
        with pytest.raises(ValueError, match="shuffled"):
            number_rows(moved)


def test_positions_need_only_the_plan_not_its_names(spark, tmp_path):
    from emulon.sources.tables import number_rows, pair_by_position

    path = str(tmp_path / "Exchange")
    spark.range(0, 60, 1, 3).selectExpr("id as ExchangeRate", "id % 7 as b").write.parquet(path)
    df = spark.read.parquet(path)
    assert sorted(r["row_id"] for r in number_rows(df).collect()) == list(range(60))
    kept = df.where("b <> 3").selectExpr("ExchangeRate * 2 as `Sort Exchange`")
    pair = pair_by_position(df.where("b <> 3"), kept).collect()
    assert len(pair) == 51 and all(r["Sort Exchange"] == 2 * r["ExchangeRate"] for r in pair)


def test_scoring_with_gaps_and_dotted_names(spark):
    import numpy as np

    from emulon import PipelineSpec, Roles, Scorer, prepare, train_and_evaluate

    rng = np.random.default_rng(4)
    rows = [(i, None if i % 7 == 0 else float(v), float(w), float(v + 2 * w)) for i, (v, w) in enumerate(rng.random((400, 2)))]
    df = spark.createDataFrame(rows, ["k", "x.1", "b", "y"])
    roles = Roles(key="k", inputs=("x.1", "b"), outputs=("y",))
    spec = PipelineSpec(kind="response_surface", params={"degree": 1}, filter="iqr")
    run = train_and_evaluate(df, roles, spec)
    new = spark.createDataFrame([(0.5, 0.5), (None, 0.5)], "`x.1` double, b double")
    got = run.scorer.transform(new).collect()
    assert got[0]["pred_y"] == pytest.approx(1.5, abs=0.2) and got[1]["pred_y"] is not None and got[1]["x.1"] is None
    prepared = prepare(df, roles, spec)
    again = prepared.transform(new.selectExpr("`x.1`", "b", "0.0D as y"))
    assert again.where("`x.1` is null").count() == 0


@pytest.mark.parametrize("imputer", ["knn", "missing indicator"])
def test_gaps_are_scored_as_they_were_filled_in_training(spark, tmp_path, imputer):
    import numpy as np

    from emulon import PipelineSpec, Roles, Scorer, train_and_evaluate

    rng = np.random.default_rng(6)
    rows = [(i, None if i % 9 == 0 else float(v), float(v + 0.01 * w), float(3 * v + w)) for i, (v, w) in enumerate(rng.random((300, 2)))]
    df = spark.createDataFrame(rows, "k int, a double, b double, y double")
    roles = Roles(key="k", inputs=("a", "b"), outputs=("y",))
    run = train_and_evaluate(df, roles, PipelineSpec(kind="response_surface", params={"degree": 1}, imputer=imputer, filter="iqr"))
    run.scorer.save(spark, str(tmp_path / "s"))
    new = spark.createDataFrame([(1, None, 0.25), (2, 0.5, 0.5), (3, None, None)], "id int, a double, b double")
    filled = run.prepared.imputer.transform(new).select("id", "a", "b")
    want = {r["id"]: r["pred_y"] for r in run.scorer.transform(filled).collect()}
    for scorer in (run.scorer, Scorer.load(spark, str(tmp_path / "s"))):
        got = scorer.transform(new).collect()
        assert {r["id"]: r["pred_y"] for r in got} == pytest.approx(want) and None not in want.values()
        assert {r["id"]: r["a"] for r in got} == {1: None, 2: 0.5, 3: None}
    if imputer == "knn":
        assert abs(want[1] - 1.25) < 0.5  # from neighbours, not from the mean
        (tmp_path / "none").mkdir()  # a stream's folder must be there
        stream = spark.readStream.schema("id int, a double, b double").parquet(str(tmp_path / "none"))
        with pytest.raises(ValueError, match="stream"):
            run.scorer.transform(stream)


def test_pairing_by_text_keys_shuffles_hashes(spark, monkeypatch):
    """Clean keys are told by their hashes; anything amiss is looked at key by key."""
    reports, exact = [], tables.pair_report
    monkeypatch.setattr(tables, "pair_report", lambda *a: (reports.append(a), exact(*a))[1])
    rows = [(f"a long key number {i}", float(i)) for i in range(50)]
    x = spark.createDataFrame(rows, "k string, a double")
    y = spark.createDataFrame(rows[::-1], "k string, b double")
    assert tables.align(x, y, "k").count() == 50 and not reports
    assert tables.align(x, y.limit(40), "k", "drop").count() == 40 and not reports
    assert tables.align(x.union(spark.createDataFrame([(None, 1.0)] * 2, x.schema)), y, "k", "drop").count() == 50 and not reports
    odd = {"twice": x.union(x.limit(1)), "orphan": x.limit(49), "null": x.union(spark.createDataFrame([(None, 1.0)], x.schema))}
    for n, left in enumerate(odd.values(), 1):
        with pytest.raises(ValueError):
            tables.align(left, y, "k")
        assert len(reports) == n
    numbers = spark.range(5).selectExpr("cast(id as int) as k")
    assert tables.align(numbers, spark.range(5).selectExpr("id as k"), "k").count() == 5 and len(reports) == 3
