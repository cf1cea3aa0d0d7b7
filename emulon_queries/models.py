"""Surrogates: fits, predictions, cross-validation, searches and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from emulon import PipelineSpec, Roles, Scorer, fit, prepare, train_and_evaluate
from emulon.models import load_model
from emulon.models.network import Layout, Network
from emulon.operators.evaluate import metrics
from emulon.operators.features import expand_polynomial
from emulon.operators.scale import fit_scalers
from emulon.operators.split import TEST, TRAIN, VAL, part
from emulon.plans.pipeline_search import pipeline_search
from emulon.plans.search import cross_validate, grid_search, hold_out
from emulon.runtime import scratch_path
from emulon.streaming.scoring import monitor_errors, write_scores
from emulon_queries import query
from emulon_queries.tables import (
    CONTINUOUS, EXPERIMENT_SQL, GAPS_SQL, OUTPUTS, ROLES, experiment, parted, read, rounded, split_sql, unit_sql, with_gaps)

SURFACE_INPUTS = ("l_extendedprice", "l_discount", "l_tax")
SURFACE = Roles("key", SURFACE_INPUTS, ("charge",))
LINE = Roles("key", ("l_extendedprice",), ("charge",))
TRAIN_SQL = f"{EXPERIMENT_SQL}, {split_sql()}, train AS (SELECT * FROM parted WHERE split = 'train')"
# Least-squares line of charge on price.
LINE_SQL = """line AS (SELECT regr_slope(charge, l_extendedprice) AS b, regr_intercept(charge, l_extendedprice) AS a
FROM {source})"""


# ----------------------------------------------------------------------------- response surface


@query("M1", f"""WITH {EXPERIMENT_SQL}
SELECT key, 1.0::DOUBLE AS "1", l_quantity, l_discount, l_tax,
       round(l_quantity * l_quantity, 6) AS "l_quantity^2", round(l_quantity * l_discount, 6) AS "l_quantity l_discount",
       round(l_quantity * l_tax, 6) AS "l_quantity l_tax", round(l_discount * l_discount, 6) AS "l_discount^2",
       round(l_discount * l_tax, 6) AS "l_discount l_tax", round(l_tax * l_tax, 6) AS "l_tax^2" FROM exp""")
def polynomial_features(spark, sf):
    return rounded(expand_polynomial(experiment(spark, sf), CONTINUOUS[:1] + CONTINUOUS[2:], 2, keep=["key"]), 6)


@query("M1", f"""WITH {EXPERIMENT_SQL}
SELECT key, l_quantity, l_discount, l_tax, round(l_quantity * l_discount, 6) AS "l_quantity l_discount",
       round(l_quantity * l_tax, 6) AS "l_quantity l_tax", round(l_discount * l_tax, 6) AS "l_discount l_tax",
       round(l_quantity * l_discount * l_tax, 7) AS "l_quantity l_discount l_tax" FROM exp""")
def interaction_features(spark, sf):
    """Products of different inputs only, and no bias."""
    table = expand_polynomial(experiment(spark, sf), CONTINUOUS[:1] + CONTINUOUS[2:], 3, True, False, keep=["key"])
    return rounded(table, {"l_quantity l_discount l_tax": 7})


@query("M2", f"""WITH {EXPERIMENT_SQL}, m AS (
  SELECT avg(l_extendedprice) AS mx, avg(l_discount) AS mz, avg(charge) AS my,
         covar_pop(l_extendedprice, l_extendedprice) AS xx, covar_pop(l_discount, l_discount) AS zz,
         covar_pop(l_extendedprice, l_discount) AS xz, covar_pop(l_extendedprice, charge) AS xy,
         covar_pop(l_discount, charge) AS zy FROM exp
), c AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS d FROM m)
SELECT 'l_extendedprice' AS term, round(b, 6) AS coefficient FROM c
UNION ALL SELECT 'l_discount', round(d, 3) FROM c
UNION ALL SELECT 'intercept', round(my - b * mx - d * mz, 3) FROM c""")
def plane_fit(spark, sf):
    """Least-squares plane of the charge on price and discount."""
    roles = Roles("key", ("l_extendedprice", "l_discount"), ("charge",))
    model = fit("response_surface", experiment(spark, sf), roles, degree=1, include_bias=False)
    return model.coefficients(spark).selectExpr(
        "term", "if(term = 'l_extendedprice', round(coefficient, 6), round(coefficient, 3)) as coefficient")


@query("M2", """SELECT term, CAST(coefficient AS DOUBLE) AS coefficient FROM (VALUES
  ('l_extendedprice', 1), ('l_extendedprice l_discount', -1), ('l_extendedprice l_tax', 1),
  ('l_extendedprice l_discount l_tax', -1)) v(term, coefficient)""")
def cubic_surface_fit(spark, sf):
    """The charge is a polynomial of degree three: the fit must find its four coefficients."""
    model = fit("response_surface", experiment(spark, sf), SURFACE, degree=3)
    return model.coefficients(spark).selectExpr("term", "round(coefficient, 4) + 0D as coefficient").where(
        "coefficient <> 0 and term <> 'intercept' and term like '%l_extendedprice%'")


@query("M2", f"""WITH {EXPERIMENT_SQL}, m AS (
  SELECT regr_slope(TCP_X_pos_list_0, l_discount) AS b, regr_intercept(TCP_X_pos_list_0, l_discount) AS a, avg(charge) AS c
  FROM exp)
SELECT 'TCP_X_pos_list_0' AS output, 'l_discount' AS term, round(b, 4) AS coefficient FROM m
UNION ALL SELECT 'TCP_X_pos_list_0', 'intercept', round(a, 4) FROM m
UNION ALL SELECT 'charge', 'l_discount', 0.0 FROM m
UNION ALL SELECT 'charge', 'intercept', round(c, 4) FROM m""")
def non_negative_fit(spark, sf):
    """Weights of at least zero: the charge falls with the discount, so its weight is zero."""
    roles = Roles("key", ("l_discount",), ("charge", "TCP_X_pos_list_0"))
    model = fit("response_surface", experiment(spark, sf), roles, degree=1, include_bias=False, positive=True)
    return rounded(model.coefficients(spark), 4)


@query("M3", f"WITH {EXPERIMENT_SQL} SELECT key, round(charge / 1000, 9) AS pred_charge FROM exp")
def cubic_surface_prediction(spark, sf):
    """Predictions of the degree-three surface reproduce the charge (shown in thousands)."""
    rows = experiment(spark, sf)
    model = fit("response_surface", rows, SURFACE, degree=3)
    return model.transform(rows).selectExpr("key", "round(pred_charge / 1000, 9) as pred_charge")


# ----------------------------------------------------------------------------- other surrogates


def _prepared(spark, sf):
    """Scaled experiment table, filtered by quartiles."""
    return prepare(experiment(spark, sf), ROLES, PipelineSpec(filter="iqr"))


def _test_errors(prepared, model):
    predictions = model.transform(prepared.part(TEST))
    return rounded(metrics(predictions, OUTPUTS, ["mse", "mae"]), 8)


@query("M4")
def kernel_ridge_errors(spark, sf):
    """Radial kernel ridge on landmark features; test errors."""
    prepared = _prepared(spark, sf)
    return _test_errors(prepared, fit("rbf", prepared.part(TRAIN), ROLES, alpha=1e-3, gamma=None))


@query("M5")
def gaussian_process_errors(spark, sf):
    """Gaussian process, length scale picked by likelihood; test errors and mean standard deviation."""
    prepared = _prepared(spark, sf)
    model = fit("gaussian_process", prepared.part(TRAIN), ROLES, length_scale=[0.5, 1.0, 2.0], landmarks=128)
    predictions = model.transform(prepared.part(TEST))
    table = metrics(predictions, OUTPUTS, ["mse", "mae"])
    std = predictions.agg(F.avg("pred_std").alias("value")).selectExpr("'all' as output", "'std' as metric", "value")
    return rounded(table.unionByName(std), 8)


@query("M5")
def gaussian_process_matern_errors(spark, sf):
    prepared = _prepared(spark, sf)
    return _test_errors(prepared, fit(
        "gaussian_process", prepared.part(TRAIN), ROLES, kernel="Matern", nu=2.5, landmarks=128))


@query("M5")
def gaussian_process_periodic_errors(spark, sf):
    prepared = _prepared(spark, sf)
    return _test_errors(prepared, fit(
        "gaussian_process", prepared.part(TRAIN), ROLES, kernel="ExpSineSquared", periodicity=20.0, landmarks=128))


@query("M6")
def support_vector_errors(spark, sf):
    """Support-vector regression, one model per output; test errors."""
    prepared = _prepared(spark, sf)
    return _test_errors(prepared, fit("svr", prepared.part(TRAIN), ROLES, epsilon=0.02, landmarks=64))


@query("M6")
def linear_support_vector_errors(spark, sf):
    prepared = _prepared(spark, sf)
    return _test_errors(prepared, fit("svr", prepared.part(TRAIN), ROLES, epsilon=0.02, kernel="linear"))


@query("M5")
def gaussian_process_ascent(spark, sf):
    """Length scale and constant after each number of refining scans, from a start far off; the likelihood can only rise."""
    train = _prepared(spark, sf).part(TRAIN)
    rows = []
    for scans in (0, 3):
        model = fit("gaussian_process", train, ROLES, length_scale=4.0, alpha=1e-2, landmarks=48, refine=scans)
        rows.append((scans, float(model.params["length_scale"]), float(model.params["constant"]), float(model.log_likelihood)))
    return rounded(spark.createDataFrame(rows, "scans int, length_scale double, constant double, log_likelihood double"), 4)


@query("M6", """WITH x AS (SELECT min(o_totalprice) / 1e5 AS low, max(o_totalprice) / 1e5 AS high FROM orders),
w AS (SELECT 2 - 0.2 / (high - low) AS slope, 2 * low + 1.1 AS at_low, low FROM x)
SELECT 'y' AS output, round(slope, 3) AS slope, round(at_low - slope * low, 3) AS intercept, round(0.5 * slope * slope, 3) AS objective,
       round(0.5 * slope * slope, 3) AS bound, TRUE AS converged FROM w""")
def support_vector_certificate(spark, sf):
    """Orders on a line: the flattest line in the tube touches it at both ends, so the lowest objective is known.

    Objective and lower bound must both meet it."""
    rows = read(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice / 1e5D AS x", "2 * o_totalprice / 1e5D + 1 AS y")
    model = fit("svr", rows, Roles("o_orderkey", ("x",), ("y",)), kernel="linear", epsilon=0.1, tol=1e-5)
    table = model.certificate(spark).withColumn("slope", F.lit(float(model.weights[1, 0]))).withColumn("intercept", F.lit(float(model.weights[0, 0])))
    return rounded(table.select("output", "slope", "intercept", "objective", "bound", "converged"), 3)


@query("M6")
def support_vector_gaps(spark, sf):
    """Objective, lower bound and gap of each output of a radial fit."""
    prepared = _prepared(spark, sf)
    model = fit("svr", prepared.part(TRAIN), ROLES, epsilon=0.02, landmarks=64)
    return rounded(model.certificate(spark), 6)


@query("M7, M8, M10, M12")
def network_losses(spark, sf):
    """Loss per epoch of a small network with dropout and a step schedule."""
    prepared = prepare(experiment(spark, sf), ROLES, PipelineSpec(filter="iqr", val=0.15))
    _, losses = hold_out(
        "neural_network", prepared.part(TRAIN), prepared.part(VAL), ROLES,
        n_neurons=16, activation="relu", dropout_rate=0.1, epochs=6, lr_step=3, lr_decrease_rate=0.5,
        learning_rate=0.01, partitions=8)
    return rounded(losses, 8)


@query("M9")
def network_early_stop(spark, sf):
    """Training ends when the validation loss no longer improves by the threshold."""
    prepared = prepare(experiment(spark, sf), ROLES, PipelineSpec(filter="iqr", val=0.15))
    _, losses = hold_out(
        "neural_network", prepared.part(TRAIN), prepared.part(VAL), ROLES,
        epochs=50, patience=2, convergence_threshold=1e-2, learning_rate=0.01, partitions=8)
    return losses.groupBy("split").agg(F.max("epoch").alias("epochs"), F.round(F.min("loss"), 8).alias("lowest"))


@query("M11")
def network_test_errors(spark, sf):
    prepared = _prepared(spark, sf)
    model = fit("neural_network", prepared.part(TRAIN), ROLES, epochs=8, learning_rate=0.01, partitions=8)
    return _test_errors(prepared, model)


# ----------------------------------------------------------------------------- validation and search


_FOLD_SQL = f"""{EXPERIMENT_SQL}, f AS (
  SELECT CAST(floor({unit_sql(purpose='fold')} * 5) AS INTEGER) AS fold, l_extendedprice AS x, charge AS y FROM exp
), lines AS (
  SELECT k.fold, regr_slope(f.y, f.x) AS b, regr_intercept(f.y, f.x) AS a
  FROM (SELECT DISTINCT fold FROM f) k JOIN f ON f.fold <> k.fold GROUP BY k.fold
)"""


@query("M14", f"""WITH {_FOLD_SQL}
SELECT fold, round(avg(pow(y - a - b * x, 2)) / 1000, 4) AS loss FROM f JOIN lines USING (fold) GROUP BY fold""")
def cross_validated_line(spark, sf):
    """Validation loss of a line in five folds (in thousands), all from one scan."""
    run = cross_validate("response_surface", experiment(spark, sf), LINE, degree=1, include_bias=False, refit=False)
    return run.losses.selectExpr("fold", "round(loss / 1000, 4) as loss")


@query("M14")
def cross_validated_surrogates(spark, sf):
    """Mean validation loss of every kind of surrogate on the same prepared rows."""
    train = _prepared(spark, sf).part(TRAIN)
    settings = {
        "response_surface": {},
        "rbf": {"alpha": 1e-3, "landmarks": 64},
        "gaussian_process": {"landmarks": 64},
        "svr": {"kernel": "linear", "epsilon": 0.02},
        "neural_network": {"epochs": 2, "learning_rate": 0.01, "partitions": 8},
    }
    losses = [(kind, cross_validate(kind, train, ROLES, k=3, refit=False, **params).mean_loss)
              for kind, params in settings.items()]
    return rounded(spark.createDataFrame(losses, "kind string, loss double"), 8)


@query("M15", f"""WITH {TRAIN_SQL}, {LINE_SQL.format(source='train')}
SELECT split, round(avg(pow(charge - a - b * l_extendedprice, 2)) / 1000, 4) AS loss
FROM parted, line WHERE split IN ('train', 'val') GROUP BY split""")
def hold_out_losses(spark, sf):
    """Training and validation loss after an explicit fit (in thousands)."""
    rows = parted(spark, sf)
    _, losses = hold_out("response_surface", part(rows, TRAIN), part(rows, VAL), LINE, degree=1)
    return losses.selectExpr("split", "round(loss / 1000, 4) as loss")


@query("M17", f"""WITH {EXPERIMENT_SQL}, f AS (
  SELECT CAST(floor({unit_sql(purpose='fold')} * 3) AS INTEGER) AS fold, l_extendedprice / 1000 AS x, charge / 1000 AS y FROM exp
), t AS (
  SELECT k.fold, regr_slope(f.y, f.x) AS b, regr_intercept(f.y, f.x) AS a, sum(f.x * f.y) / sum(f.x * f.x) AS b0,
         (sum(f.x * f.y) * sum(pow(f.x, 4)) - sum(f.x * f.x * f.y) * sum(pow(f.x, 3)))
           / (sum(f.x * f.x) * sum(pow(f.x, 4)) - pow(sum(pow(f.x, 3)), 2)) AS q1,
         (sum(f.x * f.x * f.y) * sum(f.x * f.x) - sum(f.x * f.y) * sum(pow(f.x, 3)))
           / (sum(f.x * f.x) * sum(pow(f.x, 4)) - pow(sum(pow(f.x, 3)), 2)) AS q2
  FROM (SELECT DISTINCT fold FROM f) k JOIN f ON f.fold <> k.fold GROUP BY k.fold
)
SELECT 1 AS degree, TRUE AS fit_intercept, fold, round(avg(pow(y - a - b * x, 2)), 6) AS loss FROM f JOIN t USING (fold) GROUP BY fold
UNION ALL
SELECT 1, FALSE, fold, round(avg(pow(y - b0 * x, 2)), 6) FROM f JOIN t USING (fold) GROUP BY fold
UNION ALL
SELECT 2, FALSE, fold, round(avg(pow(y - q1 * x - q2 * x * x, 2)), 6) FROM f JOIN t USING (fold) GROUP BY fold""")
def surface_grid_search(spark, sf):
    """Losses of all candidates of a surface search whose fits have a closed form."""
    rows = experiment(spark, sf).selectExpr("key", "l_extendedprice / 1000 as x", "charge / 1000 as y")
    run = grid_search("response_surface", rows, Roles("key", ("x",), ("y",)),
                      {"degree": "1|2", "fit_intercept": "true|false"}, k=3, refit=False, include_bias=False)
    table = run.table.selectExpr("from_json(params, 'degree int, fit_intercept boolean') as p", "fold",
                                 "round(loss, 6) as loss")
    return table.select("p.*", "fold", "loss").where("not (degree = 2 and fit_intercept)")


_PREPARED_FOLDS_SQL = f"""{GAPS_SQL}, f AS (
  SELECT CAST(floor({unit_sql(purpose='fold')} * 3) AS INTEGER) AS fold, l_extendedprice AS x, l_quantity AS q, charge / 1000 AS y FROM gaps
), k AS (SELECT DISTINCT fold FROM f), p AS (
  SELECT k.fold, avg(x) AS mx, min(x) AS ax, max(x) - min(x) AS sx, avg(q) AS mq, min(q) AS aq, max(q) - min(q) AS sq
  FROM k JOIN f ON f.fold <> k.fold GROUP BY k.fold
), z AS (
  SELECT p.fold, f.fold = p.fold AS held, y, (coalesce(x, mx) - ax) / sx AS u, (coalesce(q, mq) - aq) / sq AS v FROM p, f
)"""


@query("M17", f"""WITH {_PREPARED_FOLDS_SQL}, s AS (
  SELECT fold, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * y) AS uy, sum(v * y) AS vy,
         covar_pop(u, u) AS cuu, covar_pop(u, v) AS cuv, covar_pop(v, v) AS cvv, covar_pop(u, y) AS cuy, covar_pop(v, y) AS cvy,
         avg(u) AS mu, avg(v) AS mv, avg(y) AS my FROM z WHERE NOT held GROUP BY fold
), w AS (
  SELECT fold, TRUE AS fit_intercept, (cuy * cvv - cvy * cuv) / (cuu * cvv - cuv * cuv) AS b, (cvy * cuu - cuy * cuv) / (cuu * cvv - cuv * cuv) AS c, my, mu, mv FROM s
  UNION ALL SELECT fold, FALSE, (uy * vv - vy * uv) / (uu * vv - uv * uv), (vy * uu - uy * uv) / (uu * vv - uv * uv), 0, 0, 0 FROM s
)
SELECT fit_intercept, fold, round(avg(pow(y - my - b * (u - mu) - c * (v - mv), 2)), 5) AS loss FROM z JOIN w USING (fold) WHERE held GROUP BY ALL""")
def pipeline_search_losses(spark, sf):
    """Planes on two inputs with gaps; fill values and scales belong to the folds, and all losses come from one scan."""
    run = _pipeline_search(spark, sf, refit=False)
    return run.table.selectExpr("from_json(params, 'fit_intercept boolean').fit_intercept as fit_intercept", "fold", "round(loss, 5) as loss")


@query("M17", f"""WITH {_PREPARED_FOLDS_SQL}
SELECT fold, 'l_extendedprice' AS "column", round(mx, 5) AS fill, ax AS centre, sx AS scale FROM p
UNION ALL SELECT fold, 'l_quantity', round(mq, 8), aq, sq FROM p""")
def pipeline_search_preparations(spark, sf):
    """Fill value, centre and scale of each input by the rows outside each fold."""
    table = _pipeline_search(spark, sf, refit=False).preparations
    return table.selectExpr("fold", "column", "if(column = 'l_quantity', round(fill, 8), round(fill, 5)) as fill", "centre", "scale")


def _pipeline_search(spark, sf, **options):
    rows = with_gaps(experiment(spark, sf)).selectExpr("key", "l_extendedprice", "l_quantity", "charge / 1000 as y")
    return pipeline_search("response_surface", rows, Roles("key", ("l_extendedprice", "l_quantity"), ("y",)),
                           {"fit_intercept": [True, False]}, k=3, degree=1, include_bias=False, **options)


@query("M17, U1", f"""WITH {GAPS_SQL}, m AS (SELECT avg(l_extendedprice) AS m FROM gaps),
filled AS (SELECT key, coalesce(l_extendedprice, m) / 1000 AS x, charge / 1000 AS y FROM gaps, m),
line AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM filled)
SELECT key, round(a + b * x, 6) AS pred_y FROM filled, line""")
def pipeline_search_scores(spark, sf):
    """The winner of a search on rows with gaps, fitted on all of them, scores raw rows."""
    rows = with_gaps(experiment(spark, sf)).selectExpr("key", "l_extendedprice as x", "charge / 1000 as y")
    run = pipeline_search("response_surface", rows, Roles("key", ("x",), ("y",)), {"fit_intercept": [True, False]},
                          k=3, degree=1, include_bias=False)
    return run.scorer.transform(rows.select("key", "x")).selectExpr("key", "round(pred_y, 6) as pred_y")


@query("M17, S12")
def kernel_ridge_grid_search(spark, sf):
    """Ridge weights and kernel widths scored in shared scans; mean loss per candidate."""
    train = _prepared(spark, sf).part(TRAIN)
    run = grid_search("rbf", train, ROLES, {"alpha": [1e-3, 1e-1, 10.0], "gamma": [0.1, 1.0]}, k=3, refit=False,
                      landmarks=64)
    return run.table.groupBy("params").agg(F.round(F.avg("loss"), 8).alias("loss"))


@query("M17, M8")
def network_grid_search(spark, sf):
    """Optimisers and schedules trained together in the same rounds."""
    train = _prepared(spark, sf).part(TRAIN)
    run = grid_search("neural_network", train, ROLES, {"optimizer": "Adam|SGD", "schedule": "step|plateau"}, k=2,
                      refit=False, epochs=2, learning_rate=0.01, partitions=8)
    return run.table.groupBy("params").agg(F.round(F.avg("loss"), 8).alias("loss"))


# ----------------------------------------------------------------------------- scoring


@query("U1", """SELECT event_id, value, round(2 * value + 3, 6) AS pred_target FROM events""")
def score_by_name(spark, sf):
    """Rows scored by column name, in original units, with a stored scorer."""
    rows = read(spark, sf, "events").selectExpr("event_id", "value", "2 * value + 3 as target")
    return rounded(_line_scorer(spark, rows).transform(rows.select("value", "event_id")).select(
        "event_id", "value", "pred_target"), {"pred_target": 6}, keep=("value",))


def _line_scorer(spark, rows):
    """A line fitted on scaled rows, saved and loaded again."""
    inputs, outputs = fit_scalers(rows, {"value": "minmax"}), fit_scalers(rows, {"target": "standard"})
    roles = Roles("event_id", ("value",), ("target",))
    model = fit("response_surface", outputs.transform(inputs.transform(rows)), roles, degree=1)
    path = scratch_path(spark, "scorer")
    Scorer(model, inputs, outputs).save(spark, path)
    return Scorer.load(spark, path)


@query("U2, S11", f"""WITH {TRAIN_SQL}, {LINE_SQL.format(source='train')}
SELECT key, round((a + b * l_extendedprice) / 1000, 6) AS pred_charge FROM parted, line WHERE split = 'test'""")
def batch_prediction(spark, sf):
    """The test rows predicted with a model that was stored and loaded again (in thousands)."""
    rows = parted(spark, sf)
    model = fit("response_surface", part(rows, TRAIN), LINE, degree=1)
    path = scratch_path(spark, "model")
    model.save(spark, path)
    done = load_model(spark, path).transform(part(rows, TEST))
    return done.selectExpr("key", "round(pred_charge / 1000, 6) as pred_charge")


@query("U3", """SELECT event_id, round(2 * value + 3, 6) AS pred_target FROM events""")
def streaming_scores(spark, sf):
    """The events scored as a stream of files; every row arrives once."""
    rows = read(spark, sf, "events").selectExpr("event_id", "value", "2 * value + 3 as target")
    scorer = _line_scorer(spark, rows)
    source, target = scratch_path(spark, "events"), scratch_path(spark, "scores")
    rows.select("event_id", "value").write.parquet(source)
    stream = spark.readStream.schema("event_id bigint, value double").parquet(source)
    write_scores(stream, scorer, target).awaitTermination()
    return rounded(spark.read.parquet(target).select("event_id", "pred_target"), 6)


@query("U3", """WITH w AS (
  SELECT date_trunc('hour', ts) AS h, count(*) AS n, avg(pow(value * 1.02 - value, 2)) AS mse,
         avg(abs(value * 1.02 - value)) AS mae, avg(abs((value * 1.02 - value) / (value + 1e-10::DOUBLE)) * 100) AS mape
  FROM events GROUP BY 1)
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(n AS BIGINT) AS rows, round(mse, 5) AS mse_value,
       round(mae, 9) AS mae_value, round(mape, 6) AS mape_value
FROM w WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def streaming_error_windows(spark, sf):
    """Hourly errors of streamed predictions whose truth arrives some minutes later.

    The truth may take an hour and the watermark waits for another one, so the windows of the
    last two hours are still open when the stream ends.
    """
    events = read(spark, sf, "events").selectExpr("event_id", "cast(ts as timestamp) as ts", "value")
    left, right, target = (scratch_path(spark, n) for n in ("guesses", "truths", "errors"))
    events.selectExpr("event_id", "ts", "value * 1.02 as pred_value").write.parquet(left)
    events.selectExpr("event_id", "ts + interval 10 minutes as seen", "value").write.parquet(right)
    guesses = spark.readStream.schema("event_id bigint, ts timestamp, pred_value double").parquet(left)
    truths = spark.readStream.schema("event_id bigint, seen timestamp, value double").parquet(right)
    windows = monitor_errors(guesses, truths, "event_id", ["value"], "ts", "seen")
    (windows.writeStream.format("parquet").outputMode("append").option("path", target)
     .option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination())
    done = spark.read.parquet(target).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
    return rounded(done.drop("window_end"), {"mse_value": 5, "mae_value": 9})


@query("M2", """SELECT round(regr_slope(y, p), 6) AS slope, round(regr_intercept(y, p), 2) AS at_offset
FROM (SELECT l_extendedprice AS p, 2 * l_extendedprice + 0.5 * l_quantity AS y FROM lineitem)""")
def offset_line_fit(spark, sf):
    """A line on a column whose mean is far larger than its spread; the line's value at the offset, too."""
    rows = read(spark, sf, "lineitem").selectExpr("l_orderkey AS key", "l_extendedprice + 1e7D AS x", "2 * l_extendedprice + 0.5 * l_quantity AS y")
    model = fit("response_surface", rows, Roles(key="key", inputs=("x",), outputs=("y",)), degree=1, include_bias=False)
    slope = float(model.weights[0, 0])
    return rounded(spark.createDataFrame([(slope, float(model.intercept[0]) + slope * 1e7)], "slope double, at_offset double"),
                   {"slope": 6, "at_offset": 2})


@query("M2", """SELECT o_orderkey, round(power(o_totalprice / 1e5, 2) - 0.5 * (o_custkey / 1e3) * (o_totalprice / 1e5) + 3 * o_custkey / 1e3, 4) AS pred_y
FROM orders""")
def far_surface_prediction(spark, sf):
    """A surface of degree two on inputs that lie a hundred thousand times their spread from nought."""
    rows = read(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice / 1e5D + 1e5D AS a", "o_custkey / 1e3D - 1e5D AS b",
                                                "power(o_totalprice / 1e5D, 2) - 0.5D * (o_custkey / 1e3D) * (o_totalprice / 1e5D) + 3 * o_custkey / 1e3D AS y")
    model = fit("response_surface", rows, Roles("o_orderkey", ("a", "b"), ("y",)), degree=2)
    return rounded(model.transform(rows).select("o_orderkey", "pred_y"), 4)


# ----------------------------------------------------------------------------- networks with a closed form

STORED = Layout((2, 3, 1), "tanh")
STORED_WEIGHTS = [round(-1.2 + 0.2 * i, 1) for i in range(STORED.length)]
START = Layout((1, 1)).initial(42).tolist()
STEP = 0.1


def _stored_sql() -> str:
    (w, b), (v, c) = ([layer.tolist() for layer in pair] for pair in STORED.layers(np.array(STORED_WEIGHTS)))
    hidden = [f"tanh({w[0][j]!r}::DOUBLE * price + {w[1][j]!r}::DOUBLE * customer + {b[j]!r}::DOUBLE)" for j in range(3)]
    return " + ".join(f"{v[j][0]!r}::DOUBLE * {h}" for j, h in enumerate(hidden)) + f" + {c[0]!r}::DOUBLE"


@query("M11", f"""SELECT o_orderkey, round({_stored_sql()}, 9) AS pred_y
FROM (SELECT o_orderkey, o_totalprice / 1e5 AS price, o_custkey / 1e3 AS customer FROM orders)""")
def stored_network_prediction(spark, sf):
    """A network with fixed weights, stored, loaded again and applied to all orders."""
    path = scratch_path(spark, "network")
    Network(("price", "customer"), ("y",), Network.defaults, STORED, np.array(STORED_WEIGHTS)).save(spark, path)
    rows = read(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice / 1e5D AS price", "o_custkey / 1e3D AS customer")
    return rounded(load_model(spark, path).transform(rows).select("o_orderkey", "pred_y"), 9)


@query("M7", f"""WITH x AS (SELECT s_suppkey, s_acctbal / 1e4 AS x, 3 * s_acctbal / 1e4 + 1 AS y FROM supplier),
step AS (SELECT {START[0]!r}::DOUBLE - {STEP} * 2 * avg(({START[0]!r}::DOUBLE * x + {START[1]!r}::DOUBLE - y) * x) AS w,
                {START[1]!r}::DOUBLE - {STEP} * 2 * avg({START[0]!r}::DOUBLE * x + {START[1]!r}::DOUBLE - y) AS b FROM x)
SELECT s_suppkey, round(w * x + b, 9) AS pred_y FROM x, step""")
def network_gradient_step(spark, sf):
    """One step of steepest descent over all suppliers, from the seed's weights."""
    rows = read(spark, sf, "supplier").selectExpr("s_suppkey", "s_acctbal / 1e4D AS x", "3 * s_acctbal / 1e4D + 1 AS y")
    model = fit("neural_network", rows, Roles(key="s_suppkey", inputs=("x",), outputs=("y",)), n_layers=0, optimizer="SGD",
                method="gradient", learning_rate=STEP, epochs=1, seed=42)
    return rounded(model.transform(rows).select("s_suppkey", "pred_y"), 9)


@query("M7", f"""WITH RECURSIVE x AS (SELECT o_orderkey, o_totalprice / 1e5 AS x, 2 * o_totalprice / 1e5 - 1 AS y FROM orders),
s AS (SELECT avg(x) AS x, avg(y) AS y, avg(x * x) AS xx, avg(x * y) AS xy FROM x),
step AS (SELECT 0 AS n, {START[0]!r}::DOUBLE AS w, {START[1]!r}::DOUBLE AS b
         UNION ALL SELECT n + 1, w - {STEP} * 2 * (w * xx + b * x - xy), b - {STEP} * 2 * (w * x + b - y) FROM step, s WHERE n < 3)
SELECT o_orderkey, round(w * x + b, 8) AS pred_y FROM x, step WHERE n = 3""")
def network_gradient_steps(spark, sf):
    """Three steps along the gradient over all orders, which is a sum over the scan's own partitions."""
    rows = read(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice / 1e5D AS x", "2 * o_totalprice / 1e5D - 1 AS y")
    model = fit("neural_network", rows, Roles(key="o_orderkey", inputs=("x",), outputs=("y",)), n_layers=0, optimizer="SGD",
                method="gradient", learning_rate=STEP, epochs=3, seed=42)
    return rounded(model.transform(rows).select("o_orderkey", "pred_y"), 8)


@query("M7", """WITH x AS (SELECT o_orderkey, o_totalprice / 1e5 AS a, o_custkey / 1e3 AS b, sin(o_totalprice / 1e5) AS y, cos(o_custkey / 1e3) AS z FROM orders),
m AS (SELECT avg(a) AS a, avg(b) AS b, avg(y) AS y, avg(z) AS z, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb,
             covar_pop(a, y) AS ay, covar_pop(b, y) AS bY, covar_pop(a, z) AS az, covar_pop(b, z) AS bz FROM x)
SELECT o_orderkey, round(m.y + (m.ay * m.bb - m.bY * m.ab) / (m.aa * m.bb - m.ab * m.ab) * (x.a - m.a) + (m.bY * m.aa - m.ay * m.ab) / (m.aa * m.bb - m.ab * m.ab) * (x.b - m.b), 4) AS pred_y,
       round(m.z + (m.az * m.bb - m.bz * m.ab) / (m.aa * m.bb - m.ab * m.ab) * (x.a - m.a) + (m.bz * m.aa - m.az * m.ab) / (m.aa * m.bb - m.ab * m.ab) * (x.b - m.b), 4) AS pred_z
FROM x, m""")
def network_lbfgs_plane(spark, sf):
    """A network without hidden layers, taken by limited-memory BFGS to its lowest loss: the least-squares planes."""
    rows = read(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice / 1e5D AS a", "o_custkey / 1e3D AS b",
                                                "sin(o_totalprice / 1e5D) AS y", "cos(o_custkey / 1e3D) AS z")
    model = fit("neural_network", rows, Roles(key="o_orderkey", inputs=("a", "b"), outputs=("y", "z")), n_layers=0, method="lbfgs", epochs=60, seed=42)
    return rounded(model.transform(rows).select("o_orderkey", "pred_y", "pred_z"), 4)


# ----------------------------------------------------------------------------- kernel models with a closed form


def _two_landmarks_sql(kernel: str, alpha: float) -> str:
    """Kernel regression on the two orders of lowest hash: k(x)' (K'K + alpha M)^-1 K'y, a solve of two by two.

    ``kernel`` is SQL with {a} and {b} for its two points."""
    k1, k2 = kernel.format(a="x", b="z1"), kernel.format(a="x", b="z2")
    m11, m12, m22 = kernel.format(a="z1", b="z1"), kernel.format(a="z1", b="z2"), kernel.format(a="z2", b="z2")
    return f"""WITH rows AS (SELECT o_orderkey, o_totalprice / 1e5 AS x, o_custkey / 1e3 + o_totalprice / 1e5 AS y FROM orders),
marks AS (SELECT x, row_number() OVER (ORDER BY {unit_sql('o_orderkey', 42, 'landmark')}) AS i FROM rows),
z AS (SELECT max(x) FILTER (WHERE i = 1) AS z1, max(x) FILTER (WHERE i = 2) AS z2 FROM marks WHERE i <= 2),
k AS (SELECT o_orderkey, y, {k1} AS k1, {k2} AS k2 FROM rows, z),
s AS (SELECT sum(k1 * k1) AS a, sum(k1 * k2) AS b, sum(k2 * k2) AS d, sum(k1 * y) AS p, sum(k2 * y) AS q FROM k),
m AS (SELECT a + {alpha} * {m11} AS a, b + {alpha} * {m12} AS b, d + {alpha} * {m22} AS d, p, q FROM s, z)
SELECT o_orderkey, round((k1 * (d * p - b * q) + k2 * (a * q - b * p)) / (a * d - b * b), 6) AS pred_y FROM k, m"""


def _two_landmarks(spark, sf, kind: str, **params):
    rows = read(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice / 1e5D AS x", "o_custkey / 1e3D + o_totalprice / 1e5D AS y")
    model = fit(kind, rows, Roles(key="o_orderkey", inputs=("x",), outputs=("y",)), landmarks=2, seed=42, **params)
    return rounded(model.transform(rows).select("o_orderkey", "pred_y"), 6)


@query("M4", _two_landmarks_sql("exp(-0.5::DOUBLE * ({a} - {b}) * ({a} - {b}))", 0.25))
def kernel_ridge_of_two_landmarks(spark, sf):
    return _two_landmarks(spark, sf, "rbf", gamma=0.5, alpha=0.25)


@query("M5", _two_landmarks_sql("(exp(-({a} - {b}) * ({a} - {b}) / 4.5::DOUBLE) + 0.5::DOUBLE)", 0.25))
def gaussian_process_of_two_landmarks(spark, sf):
    return _two_landmarks(spark, sf, "gaussian_process", kernel="RBF", length_scale=1.5, constant=0.5, alpha=0.25)


# ----------------------------------------------------------------------------- the whole run


@query("entry: D1, I1, O1, N1, N5, M2, U2, N6, E1, E6", f"""WITH {TRAIN_SQL}
SELECT output, 0.0::DOUBLE AS mean_error FROM (SELECT unnest([{', '.join(f"'{c}'" for c in OUTPUTS)}]) AS output)
WHERE (SELECT count(*) FROM train) > 0""")
def surface_training_run(spark, sf):
    """Split, impute, filter, scale, fit a cubic surface, predict the test rows, back to original units."""
    run = train_and_evaluate(experiment(spark, sf), ROLES, PipelineSpec(
        kind="response_surface", params={"degree": 3}, filter="iqr", validation="cross"))
    return rounded(run.mean_errors.select("output", "mean_error"), 5)


@query("entry on a line: D1, I1, O1, N2, M2, U2, N6, E6", f"""WITH {GAPS_SQL}, {split_sql('gaps', val=0.0)},
train AS (SELECT l_extendedprice AS x, charge AS y FROM parted WHERE split = 'train'),
mean AS (SELECT avg(x) AS m FROM train),
filled AS (SELECT coalesce(x, m) AS x, y FROM train, mean),
q AS (SELECT quantile_cont(x, 0.25) AS x1, quantile_cont(x, 0.75) AS x3, quantile_cont(y, 0.25) AS y1, quantile_cont(y, 0.75) AS y3 FROM filled),
kept AS (SELECT x, y FROM filled, q WHERE x BETWEEN x1 - 1.5 * (x3 - x1) AND x3 + 1.5 * (x3 - x1)
         AND y BETWEEN y1 - 1.5 * (y3 - y1) AND y3 + 1.5 * (y3 - y1)),
line AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM kept)
SELECT 'charge' AS output, round(avg(abs(a + b * coalesce(l_extendedprice, m) - charge)), 4) AS mean_error
FROM parted, mean, line WHERE split = 'test'""")
def line_training_run(spark, sf):
    """The same run with a line on a column with gaps: split, fill values, fences and scalers all show in its errors."""
    roles = Roles("key", ("l_extendedprice",), ("charge",))
    run = train_and_evaluate(with_gaps(experiment(spark, sf)), roles, PipelineSpec(
        kind="response_surface", params={"degree": 1}, filter="iqr", validation="cross"))
    return rounded(run.mean_errors.select("output", "mean_error"), 4)
