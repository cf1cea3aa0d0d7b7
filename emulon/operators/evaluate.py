"""Errors of predictions, as tables.

Predicted tables carry each output ``y`` next to its prediction ``pred_y``.  An error is
prediction minus truth; the pooled charts of residuals use truth minus prediction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulon.functions.columns import EPSILON, as_double, cells_to_rows, number, percent_error, quoted, text
from emulon.functions.quantiles import column_quantiles
from emulon.operators.features import FAMILIES, family_of
from emulon.operators.scale import Scalers
from emulon.roles import METRICS

BINS = 50  # fixed value: bins of the residual histogram


def _pair(output: str) -> tuple[str, str]:
    return as_double(f"pred_{output}"), as_double(output)


def _cell_error(metric: str, pred: str, y: str) -> str:
    if metric == "mse":
        return f"(({pred} - {y}) * ({pred} - {y}))"
    if metric == "mae":
        return f"abs({pred} - {y})"
    if metric == "mape":
        return f"(abs(try_divide({y} - {pred}, {y} + {number(EPSILON)})) * 100)"
    raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")


def metrics(df: DataFrame, outputs: Sequence[str], kinds: Sequence[str] = ("mse",)) -> DataFrame:
    """Long table ``(output, metric, value)``, with ``all`` for the mean over all cells.

    One aggregate over the wide table: nothing is exploded, nothing shuffled but one row per task.
    """
    aggregates, cells = [], []
    for m in kinds:
        for i, c in enumerate(outputs):
            cell = _cell_error(m, *_pair(c))
            aggregates += [f"sum({cell}) as {m}_s{i}", f"count({cell}) as {m}_n{i}"]
            cells.append(f"struct({text(c)} as output, {text(m)} as metric, try_divide({m}_s{i}, {m}_n{i}) as value)")
        total = " + ".join(f"coalesce({m}_s{i}, 0D)" for i in range(len(outputs)))
        rows = " + ".join(f"{m}_n{i}" for i in range(len(outputs)))
        cells.append(f"struct('all' as output, {text(m)} as metric, try_divide({total}, {rows}) as value)")
    return cells_to_rows(df.selectExpr(*aggregates), cells)


def metrics_both_scales(
    scaled: DataFrame, outputs: Sequence[str], scalers: Scalers, kinds: Sequence[str] = ("mse",)
) -> DataFrame:
    """The metrics on scaled values and again in original units, told apart by ``scale``.

    Both come from the same scan: the original values are further columns of the scaled rows.
    """
    units = scalers.only(outputs).by_column
    both = scaled.selectExpr(
        *[quoted(p + c) for c in outputs for p in ("", "pred_")],
        *[f"{units[c].undo(p + c)} as {quoted(f'{p}original:{c}')}" for c in outputs for p in ("", "pred_")],
    )
    aggregates, cells = [], []
    for scale, names in (("scaled", list(outputs)), ("original", [f"original:{c}" for c in outputs])):
        for m in kinds:
            tag = f"{scale}_{m}"
            for i, (c, name) in enumerate(zip(outputs, names)):
                cell = _cell_error(m, *_pair(name))
                aggregates += [f"sum({cell}) as {tag}_s{i}", f"count({cell}) as {tag}_n{i}"]
                cells.append(f"struct({text(scale)} as scale, {text(c)} as output, {text(m)} as metric, "
                             f"try_divide({tag}_s{i}, {tag}_n{i}) as value)")
            total = " + ".join(f"coalesce({tag}_s{i}, 0D)" for i in range(len(outputs)))
            rows = " + ".join(f"{tag}_n{i}" for i in range(len(outputs)))
            cells.append(f"struct({text(scale)} as scale, 'all' as output, {text(m)} as metric, "
                         f"try_divide({total}, {rows}) as value)")
    return cells_to_rows(both.selectExpr(*aggregates), cells)


def primary_metric(table: DataFrame, metric: str) -> float:
    """The scaled overall value of the metric that was asked for."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
    row = table.where(f"output = 'all' and metric = {text(metric)} and scale = 'scaled'").head()
    if row is None:
        raise ValueError(f"metric {metric!r} was not computed")
    return row["value"]


def residuals(df: DataFrame, key: str, outputs: Sequence[str]) -> DataFrame:
    """Long table ``(key, output, y, pred, error, error_pct)``."""
    cells = []
    for c in outputs:
        pred, y = _pair(c)
        cells.append(f"struct({text(c)} as output, {y} as y, {pred} as pred, {pred} - {y} as error, "
                     f"{percent_error(pred, y)} as error_pct)")
    return cells_to_rows(df, cells, [key])


def mean_errors(df: DataFrame, outputs: Sequence[str]) -> DataFrame:
    """Mean absolute error and mean absolute error in percent, one row per output."""
    parts = []
    for i, c in enumerate(outputs):
        pred, y = _pair(c)
        parts.append(f"struct({text(c)} as output, avg(abs({pred} - {y})) as mean_error, "
                     f"avg(abs({percent_error(pred, y)})) as mean_error_pct) as c{i}")
    return cells_to_rows(df.selectExpr(*parts), [f"c{i}" for i in range(len(parts))])


def parity(df: DataFrame, key: str, outputs: Sequence[str]) -> DataFrame:
    """Pairs of truth and prediction pooled over the outputs."""
    return residuals(df, key, outputs).select(key, "output", "y", "pred")


def parity_line(df: DataFrame, outputs: Sequence[str]) -> DataFrame:
    """Ends of the diagonal: smallest and largest truth over all outputs."""
    values = ", ".join(as_double(c) for c in outputs)
    cells = f"array({values})"
    return df.selectExpr(f"min(array_min({cells})) as y_min", f"max(array_max({cells})) as y_max")


def histogram(df: DataFrame, outputs: Sequence[str], bins: int = BINS) -> DataFrame:
    """Equal bins of truth minus prediction, pooled over outputs; the last bin is closed.

    The range comes from one aggregate; the counts are grouped by bin with map-side combine.
    """
    gaps = "array({})".format(", ".join(f"{y} - {pred}" for pred, y in map(_pair, outputs)))
    low, high = df.selectExpr(f"min(array_min({gaps}))", f"max(array_max({gaps}))").head()
    if low is None:
        low = high = 0.0
    if low == high:  # a single value: a range of one unit around it
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    cells = df.selectExpr(f"explode({gaps}) as gap").where("gap is not null")
    place = f"cast(least(floor((gap - {number(low)}) / {number(width)}), {bins - 1}) as int) as bin"
    counts = cells.selectExpr(place).groupBy("bin").agg(F.count(F.lit(1)).alias("rows"))
    edges = df.sparkSession.range(bins).selectExpr("cast(id as int) as bin")
    return edges.join(F.broadcast(counts), "bin", "left").selectExpr(  # at most ``bins`` rows
        "bin",
        f"{number(low)} + bin * {number(width)} as low",
        f"{number(low)} + (bin + 1) * {number(width)} as high",
        "coalesce(rows, 0L) as rows",
    )


def residual_scatter(df: DataFrame, key: str, outputs: Sequence[str], pooled: bool = False) -> DataFrame:
    """Residual against prediction: prediction minus truth per output, truth minus prediction pooled."""
    residual = "-error" if pooled else "error"
    return residuals(df, key, outputs).selectExpr(quoted(key), "output", "pred", f"{residual} as residual")


def residual_means_by_bin(df: DataFrame, outputs: Sequence[str], bins: int = 20) -> DataFrame:
    """Mean residual in equal bins of the prediction, per output: a scatter chart that stays small."""
    spans = df.selectExpr(*[f"{f}({_pair(c)[0]}) as {f}{i}" for i, c in enumerate(outputs) for f in ("min", "max")]).head()
    cells = []
    for i, c in enumerate(outputs):
        pred, y = _pair(c)
        low, high = spans[f"min{i}"] or 0.0, spans[f"max{i}"] or 0.0
        width = (high - low) / bins if high > low else 1.0
        place = f"cast(least(floor(({pred} - {number(low)}) / {number(width)}), {bins - 1}) as int)"
        cells.append(f"struct({text(c)} as output, {place} as bin, {pred} - {y} as error)")
    return cells_to_rows(df, cells).groupBy("output", "bin").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("error").alias("mean_error"), F.avg(F.abs("error")).alias("mean_abs_error"))


def residuals_by_family(
    df: DataFrame, key: str, outputs: Sequence[str], families: Sequence[str] = FAMILIES
) -> DataFrame:
    """Residual table of the outputs that belong to a family, with the ``family``."""
    member = {c: family_of(c, families) for c in outputs}
    chosen = [c for c in outputs if member[c]]
    if not chosen:
        raise ValueError("no output belongs to a family")
    names = ", ".join(f"{text(c)}, {text(member[c])}" for c in chosen)
    return residuals(df, key, chosen).withColumn("family", F.expr(f"map({names})[output]"))


def family_summary(df: DataFrame, outputs: Sequence[str], families: Sequence[str] = FAMILIES) -> DataFrame:
    """Pooled error moments per family, from per-column aggregates."""
    parts = []
    for f in families:
        errors = [f"({pred} - {y})" for pred, y in (_pair(c) for c in outputs if family_of(c, families) == f)]
        if not errors:
            continue
        rows = " + ".join(f"count({e})" for e in errors)
        total = " + ".join(f"coalesce(sum({e}), 0D)" for e in errors)
        size = " + ".join(f"coalesce(sum(abs({e})), 0D)" for e in errors)
        parts.append(
            f"struct({text(f)} as family, {rows} as rows, try_divide({total}, {rows}) as mean_error, "
            f"try_divide({size}, {rows}) as mean_abs_error, "
            f"array_min(array({', '.join(f'min({e})' for e in errors)})) as min_error, "
            f"array_max(array({', '.join(f'max({e})' for e in errors)})) as max_error) as c{len(parts)}")
    if not parts:
        raise ValueError("no output belongs to a family")
    return cells_to_rows(df.selectExpr(*parts), [f"c{i}" for i in range(len(parts))])


def _correlation(a: str, b: str) -> str:
    """Null where one side does not vary; ``corr`` itself would divide by zero."""
    return f"try_divide(covar_pop({a}, {b}), stddev_pop({a}) * stddev_pop({b}))"


def diagnostics(df: DataFrame, outputs: Sequence[str]) -> DataFrame:
    """What the residual charts are read for, as numbers per output: bias, spread, skewness,
    share over and under, dependence of the error on the prediction, and outlier count."""
    errors = [f"_error{i}" for i in range(len(outputs))]
    table = df.selectExpr(
        *[f"{_pair(c)[0]} - {_pair(c)[1]} as {e}" for c, e in zip(outputs, errors)],
        *[f"{_pair(c)[0]} as _pred{i}" for i, c in enumerate(outputs)])
    fences = column_quantiles(table, errors, [0.25, 0.75])
    parts = []
    for i, (c, e) in enumerate(zip(outputs, errors)):
        q1, q3 = fences[e] if fences[e][0] is not None else (0.0, 0.0)
        reach = 1.5 * (q3 - q1)
        pred = f"_pred{i}"
        parts.append(
            f"struct({text(c)} as output, count({e}) as rows, avg({e}) as bias, stddev_samp({e}) as spread, "
            f"if(var_pop({e}) > 0, skewness({e}), null) as skewness, "
            f"avg(cast({e} > 0 as double)) as share_over, avg(cast({e} < 0 as double)) as share_under, "
            f"{_correlation(e, pred)} as error_vs_pred, {_correlation(f'abs({e})', pred)} as abs_error_vs_pred, "
            f"count_if({e} < {number(q1 - reach)} or {e} > {number(q3 + reach)}) as outliers) as c{i}")
    return cells_to_rows(table.selectExpr(*parts), [f"c{i}" for i in range(len(parts))])


def loss_gap(losses: DataFrame) -> DataFrame:
    """Last training and validation loss and their gap, from a ``(epoch, split, loss)`` table."""
    last = losses.selectExpr(*[
        f"max_by(loss, epoch) filter (where split = '{s}') as {s}" for s in ("train", "val")])
    return last.withColumn("gap", F.expr("val - train"))
