"""Error tables of predictions."""

from __future__ import annotations

from emulon.operators import evaluate
from emulon.operators.scale import fit_output_scalers
from emulon_queries import query
from emulon_queries.tables import (
    OUTPUTS, PREDICTED_SQL, ROLES, experiment, predicted, rounded)

EPS = "1e-10::DOUBLE"
# Truth has six decimals and a prediction eight, so these roundings have no ties.
EXACT = {"y": 8, "pred": 8, "error": 8, "residual": 8}


def _predicted(spark, sf):
    return predicted(experiment(spark, sf))


def _metric_sql(name, cell, digits):
    return f"""WITH {PREDICTED_SQL}
SELECT output, '{name}' AS metric, round(avg({cell}), {digits}) AS value FROM long GROUP BY output
UNION ALL SELECT 'all', '{name}', round(avg({cell}), {digits}) FROM long"""


@query("E1", _metric_sql("mse", "(pred - y) * (pred - y)", 4))
def mean_squared_error(spark, sf):
    return rounded(evaluate.metrics(_predicted(spark, sf), OUTPUTS, ["mse"]), 4)


@query("E2", _metric_sql("mae", "abs(pred - y)", 6))
def mean_absolute_error(spark, sf):
    return rounded(evaluate.metrics(_predicted(spark, sf), OUTPUTS, ["mae"]), 6)


@query("E3", _metric_sql("mape", f"abs((y - pred) / (y + {EPS})) * 100", 6))
def mean_absolute_percentage_error(spark, sf):
    return rounded(evaluate.metrics(_predicted(spark, sf), OUTPUTS, ["mape"]), 6)


_SCALE = ", ".join(f"min({c}) AS a_{c}, max({c}) - min({c}) AS b_{c}" for c in OUTPUTS)
_BOTH = " UNION ALL ".join(
    f"SELECT '{c}' AS output, ({c} - a_{c}) / b_{c} AS y, (pred_{c} - a_{c}) / b_{c} AS pred FROM predicted, s"
    for c in OUTPUTS)


@query("E4, E13", f"""WITH {PREDICTED_SQL}, s AS (SELECT {_SCALE} FROM exp), scaled AS ({_BOTH})
SELECT 'scaled' AS scale, output, 'mae' AS metric, round(avg(abs(pred - y)), 6) AS value FROM scaled GROUP BY output
UNION ALL SELECT 'scaled', 'all', 'mae', round(avg(abs(pred - y)), 6) FROM scaled
UNION ALL SELECT 'scaled', output, 'mse', round(avg((pred - y) * (pred - y)), 6) FROM scaled GROUP BY output
UNION ALL SELECT 'scaled', 'all', 'mse', round(avg((pred - y) * (pred - y)), 6) FROM scaled
UNION ALL SELECT 'original', output, 'mae', round(avg(abs(pred - y)), 6) FROM long GROUP BY output
UNION ALL SELECT 'original', 'all', 'mae', round(avg(abs(pred - y)), 6) FROM long
UNION ALL SELECT 'original', output, 'mse', round(avg((pred - y) * (pred - y)), 3) FROM long GROUP BY output
UNION ALL SELECT 'original', 'all', 'mse', round(avg((pred - y) * (pred - y)), 3) FROM long""")
def metrics_in_both_scales(spark, sf):
    """Every metric on scaled values and again in original units, from one scan."""
    rows = _predicted(spark, sf)
    fitted = fit_output_scalers(rows, ROLES)
    scaled = rows.selectExpr(*[
        f"{fitted.by_column[c].apply(p + c)} as {p}{c}" for c in OUTPUTS for p in ("", "pred_")])
    table = evaluate.metrics_both_scales(scaled, OUTPUTS, fitted, ["mae", "mse"])
    return table.selectExpr(
        "scale", "output", "metric",
        "if(scale = 'original' and metric = 'mse', round(value, 3), round(value, 6)) as value")


@query("E5", f"""WITH {PREDICTED_SQL}
SELECT key, output, round(y, 8) AS y, round(pred, 8) AS pred, round(pred - y, 8) AS error,
       round((pred - y) / (y + {EPS}) * 100, 6) AS error_pct FROM long""")
def residual_table(spark, sf):
    return rounded(evaluate.residuals(_predicted(spark, sf), "key", OUTPUTS), {**EXACT, "error_pct": 6})


@query("E6", f"""WITH {PREDICTED_SQL}
SELECT output, round(avg(abs(pred - y)), 6) AS mean_error,
       round(avg(abs((pred - y) / (y + {EPS}) * 100)), 6) AS mean_error_pct FROM long GROUP BY output""")
def mean_errors_by_output(spark, sf):
    return rounded(evaluate.mean_errors(_predicted(spark, sf), OUTPUTS), 6)


@query("E7", f"WITH {PREDICTED_SQL} SELECT key, output, round(y, 8) AS y, round(pred, 8) AS pred FROM long")
def parity_pairs(spark, sf):
    return rounded(evaluate.parity(_predicted(spark, sf), "key", OUTPUTS), EXACT)


@query("E7", f"WITH {PREDICTED_SQL} SELECT round(min(y), 6) AS y_min, round(max(y), 6) AS y_max FROM long")
def parity_diagonal(spark, sf):
    return rounded(evaluate.parity_line(_predicted(spark, sf), OUTPUTS), 6)


@query("E8", f"""WITH {PREDICTED_SQL}, s AS (SELECT min(y - pred) AS low, max(y - pred) AS high FROM long),
w AS (SELECT low, (high - low) / 50 AS width FROM s),
b AS (SELECT CAST(least(floor((y - pred - low) / width), 49) AS INTEGER) AS bin, count(*) AS n FROM long, w GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(low + i * width, 6) AS low, round(low + (i + 1) * width, 6) AS high,
       CAST(coalesce(n, 0) AS BIGINT) AS rows
FROM range(50) r(i) CROSS JOIN w LEFT JOIN b ON b.bin = r.i""")
def residual_histogram(spark, sf):
    return rounded(evaluate.histogram(_predicted(spark, sf), OUTPUTS), 6)


@query("E9", f"""WITH {PREDICTED_SQL}
SELECT key, output, round(pred, 8) AS pred, round(y - pred, 8) AS residual FROM long""")
def residual_scatter_pooled(spark, sf):
    """Truth minus prediction against prediction, all outputs together."""
    return rounded(evaluate.residual_scatter(_predicted(spark, sf), "key", OUTPUTS, pooled=True), EXACT)


@query("E9", f"""WITH {PREDICTED_SQL}
SELECT key, output, round(pred, 8) AS pred, round(pred - y, 8) AS residual FROM long""")
def residual_scatter_by_output(spark, sf):
    """Prediction minus truth against prediction, per output."""
    return rounded(evaluate.residual_scatter(_predicted(spark, sf), "key", OUTPUTS), EXACT)


@query("E9", f"""WITH {PREDICTED_SQL}, s AS (
  SELECT output, min(pred) AS low, (max(pred) - min(pred)) / 20 AS width FROM long GROUP BY output)
SELECT output, CAST(least(floor((pred - low) / width), 19) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS rows,
       round(avg(pred - y), 5) AS mean_error, round(avg(abs(pred - y)), 5) AS mean_abs_error
FROM long JOIN s USING (output) GROUP BY 1, 2""")
def residual_means_by_prediction(spark, sf):
    return rounded(evaluate.residual_means_by_bin(_predicted(spark, sf), OUTPUTS), 5)


@query("E10", f"""WITH {PREDICTED_SQL}
SELECT key, output, round(y, 8) AS y, round(pred, 8) AS pred, round(pred - y, 8) AS error,
       round((pred - y) / (y + {EPS}) * 100, 6) AS error_pct, 'TCP_X_pos_list' AS family
FROM long WHERE output LIKE 'TCP%'""")
def residuals_of_families(spark, sf):
    return rounded(evaluate.residuals_by_family(_predicted(spark, sf), "key", OUTPUTS), {**EXACT, "error_pct": 6})


@query("E10", f"""WITH {PREDICTED_SQL}
SELECT 'TCP_X_pos_list' AS family, CAST(count(*) AS BIGINT) AS rows, round(avg(pred - y), 6) AS mean_error,
       round(avg(abs(pred - y)), 6) AS mean_abs_error, round(min(pred - y), 6) AS min_error,
       round(max(pred - y), 6) AS max_error FROM long WHERE output LIKE 'TCP%'""")
def family_error_summary(spark, sf):
    return rounded(evaluate.family_summary(_predicted(spark, sf), OUTPUTS), 6)


@query("E11", f"""WITH {PREDICTED_SQL}, e AS (SELECT output, pred, pred - y AS e FROM long),
f AS (SELECT output, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.75) AS q3 FROM e GROUP BY output),
m AS (SELECT output, avg(e) AS m FROM e GROUP BY output)
SELECT output, CAST(count(*) AS BIGINT) AS rows, round(avg(e), 5) AS bias, round(stddev_samp(e), 5) AS spread,
       round(avg(pow(e - m, 3)) / pow(var_pop(e), 1.5), 5) AS skewness,
       round(avg((e > 0)::INT), 6) AS share_over, round(avg((e < 0)::INT), 6) AS share_under,
       round(corr(e, pred), 6) AS error_vs_pred, round(corr(abs(e), pred), 6) AS abs_error_vs_pred,
       CAST(count(*) FILTER (WHERE e < q1 - 1.5 * (q3 - q1) OR e > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers
FROM e JOIN f USING (output) JOIN m USING (output) GROUP BY output""")
def residual_diagnostics(spark, sf):
    table = evaluate.diagnostics(_predicted(spark, sf), OUTPUTS)
    return rounded(table, {"bias": 5, "spread": 5, "skewness": 5})


