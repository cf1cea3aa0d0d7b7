"""Table profile, box-plot summary and target variance, all from whole-table aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from emulon.functions.columns import as_double, cells_to_rows, number, quoted, text
from emulon.functions.quantiles import column_quantiles

# Fixed value: fences lie this many quartile ranges outside the quartiles.
FENCE = 1.5


def profile(df: DataFrame, columns: Sequence[str], exact_distinct: bool = False) -> DataFrame:
    """Long table ``(column, stat, value)`` of counts, moments, quartiles and extremes.

    Exact distinct counts take a shuffle of the values that differ; without them a sketch does."""
    quartiles = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    different = distinct_counts(df, columns) if exact_distinct else {}
    stats = {
        "count": "count({})",
        "missing": "count_if({} is null)",
        "distinct": "approx_count_distinct({}, 0.02)",
        "mean": "avg({})",
        "std": "stddev_samp({})",
        "min": "min({})",
        "max": "max({})",
        "zeros": "count_if({} = 0)",
        "negatives": "count_if({} < 0)",
    }
    one = df.selectExpr(*[
        f"cast({sql.format(as_double(c))} as double) as {s}{i}" for i, c in enumerate(columns) for s, sql in stats.items() if s != "distinct" or not exact_distinct
    ])
    cells = []
    for i, c in enumerate(columns):
        values = {s: number(different[c]) if s == "distinct" and exact_distinct else f"{s}{i}" for s in stats}
        values.update({q: "cast(null as double)" if v is None else number(v)
                       for q, v in zip(("q25", "q50", "q75"), quartiles[c])})
        cells += [f"struct({text(c)} as column, {text(s)} as stat, {v} as value)" for s, v in values.items()]
    return cells_to_rows(one, cells)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Different values of each column.  Columns are rows of one narrow table, whose copies go on the map side."""
    cells = cells_to_rows(df, [f"struct({i} as i, {as_double(c)} as x)" for i, c in enumerate(columns)])
    found = cells.where("x is not null").distinct().groupBy("i").count().collect()
    return {**dict.fromkeys(columns, 0), **{columns[r["i"]]: r["count"] for r in found}}


def boxplot_summary(df: DataFrame, columns: Sequence[str], factor: float = FENCE) -> DataFrame:
    """One row per column: quartiles, whiskers (last values inside the fences) and outlier count."""
    quartiles = {c: q for c, q in column_quantiles(df, columns, [0.25, 0.5, 0.75]).items() if q[0] is not None}
    parts = []
    for c, (q1, q2, q3) in quartiles.items():
        x = as_double(c)
        inside = f"{x} between {number(q1 - factor * (q3 - q1))} and {number(q3 + factor * (q3 - q1))}"
        parts.append(
            f"struct({text(c)} as column, {number(q1)} as q25, {number(q2)} as median, {number(q3)} as q75, "
            f"min(if({inside}, {x}, null)) as whisker_low, max(if({inside}, {x}, null)) as whisker_high, "
            f"count_if(not ({inside})) as outliers) as c{len(parts)}"
        )
    return cells_to_rows(df.selectExpr(*parts), [f"c{i}" for i in range(len(parts))])


def outlier_points(df: DataFrame, key: str, columns: Sequence[str], factor: float = FENCE) -> DataFrame:
    """The points beyond the fences as ``(key, column, value)`` rows."""
    cells = []
    for c, (q1, q3) in column_quantiles(df, columns, [0.25, 0.75]).items():
        if q1 is None:
            continue
        x = as_double(c)
        inside = f"{x} between {number(q1 - factor * (q3 - q1))} and {number(q3 + factor * (q3 - q1))}"
        cells.append(f"if({inside}, null, if({x} is null, null, struct({text(c)} as column, {x} as value)))")
    return df.selectExpr(
        quoted(key), f"explode(filter(array({', '.join(cells)}), p -> p is not null)) as p").select(key, "p.*")


def target_variance(df: DataFrame, outputs: Sequence[str]) -> DataFrame:
    """Sample variance per output and population variance over all output values pooled.

    The pooled variance is put together from per-column moments, so nothing is exploded.
    """
    spans = range(len(outputs))
    one = df.selectExpr(*[
        sql.format(as_double(c), i) for i, c in enumerate(outputs)
        for sql in ("var_samp({0}) as v{1}", "count({0}) as n{1}", "avg({0}) as m{1}", "var_pop({0}) as p{1}")
    ])
    one = one.selectExpr("*", " + ".join(f"n{i}" for i in spans) + " as total")
    one = one.selectExpr("*", "(" + " + ".join(f"n{i} * m{i}" for i in spans) + ") / total as mean")
    pooled = "(" + " + ".join(f"n{i} * (p{i} + pow(m{i} - mean, 2))" for i in spans) + ") / total"
    cells = [f"struct({text(c)} as output, v{i} as variance)" for i, c in enumerate(outputs)]
    return cells_to_rows(one, [*cells, f"struct('all' as output, {pooled} as variance)"])
