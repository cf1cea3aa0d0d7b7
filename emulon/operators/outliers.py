"""Outlier filters for the training rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulon.functions.columns import as_double, no_nan, number, quoted
from emulon.functions.quantiles import column_quantiles
from emulon.operators.forest import TREE_ROWS, TREES, anomaly_score, grow_forest
from emulon.operators.neighbours import attach_by_location, coordinates, local_outlier_factor
from emulon.runtime import cut_lineage, spread

# Fixed values of the filters.
FENCE = 1.5
CONTAMINATION = 0.05
LOF_NEIGHBOURS = 20
LOF_LIMIT = 1.5


@dataclass(frozen=True)
class FenceFilter:
    """Keeps rows whose columns all lie inside literal bounds."""

    bounds: Mapping[str, tuple[float, float]]
    keep_missing: bool = True

    def transform(self, df: DataFrame) -> DataFrame:
        missing = str(self.keep_missing).lower()
        inside = [
            f"coalesce({no_nan(as_double(c))} between {number(low)} and {number(high)}, {missing})"
            for c, (low, high) in self.bounds.items()
        ]
        return df.where(" and ".join(inside)) if inside else df


def fit_fences(
    train: DataFrame,
    columns: Sequence[str],
    factor: float = FENCE,
    nulls: str = "keep",
    approximate: bool = False,
) -> FenceFilter:
    """Bounds ``factor`` quartile ranges outside the quartiles.  A missing cell never drops a
    row with ``nulls='keep'`` and always does with ``nulls='drop'``."""
    if nulls not in ("keep", "drop"):
        raise ValueError("nulls is 'keep' or 'drop'")
    bounds = {}
    for c, (q1, q3) in column_quantiles(train, columns, [0.25, 0.75], approximate).items():
        if q1 is not None:
            bounds[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
        elif nulls == "drop":
            bounds[c] = (0.0, 0.0)  # nothing but missing cells: no row is kept
    return FenceFilter(bounds, nulls == "keep")


def isolation_scores(
    train: DataFrame, key: str, columns: Sequence[str], seed: int = 42, trees: int = TREES, rows: int = TREE_ROWS
) -> DataFrame:
    """The rows with their isolation score in column ``anomaly``."""
    n = train.count()
    nodes = grow_forest(train, key, columns, n, seed, trees, rows)
    return spread(train, key, n).withColumn("anomaly", anomaly_score(nodes, columns, min(rows, n)))


def drop_isolated(
    train: DataFrame, key: str, columns: Sequence[str], contamination: float = CONTAMINATION, seed: int = 42, **options
) -> DataFrame:
    """Drop the share ``contamination`` of rows with the highest isolation score."""
    # Written once: the quantile scans read the scores alone, and the rows that stay are not scored again.
    scored = cut_lineage(isolation_scores(train, key, columns, seed, **options))
    limit = column_quantiles(scored, ["anomaly"], [1 - contamination])["anomaly"][0]
    if limit is None:
        return train
    return scored.where(F.col("anomaly") <= limit).drop("anomaly")


def lof_scores(
    train: DataFrame, key: str, columns: Sequence[str], neighbours: int = LOF_NEIGHBOURS, **options
) -> DataFrame:
    """The rows with their local outlier factor in column ``lof``.

    A row with a missing cell has no place among the others, and a row alone has no neighbours: their factor is null.
    """
    rows = train.withColumn("x", coordinates(columns))
    missing = F.exists("x", lambda v: F.isnan(v))
    whole = train.where(" and ".join(f"{no_nan(as_double(c))} is not null" for c in columns))
    factors = local_outlier_factor(whole, key, columns, neighbours, **options)
    names = [quoted(c) for c in train.columns]
    placed = attach_by_location(rows.where(~missing), factors, train.count()).select(*names, "lof")
    return placed.unionByName(rows.where(missing).select(*names, F.lit(None).cast("double").alias("lof")))


def drop_outliers(
    train: DataFrame, key: str, columns: Sequence[str], method: str = "isolation forest", seed: int = 42, **options
) -> DataFrame:
    """Filter training rows with one of ``isolation forest``, ``lof`` or ``iqr``."""
    method = method.replace("_", " ")
    if method == "isolation forest":
        return drop_isolated(train, key, columns, seed=seed, **options)
    if method == "lof":
        scored = lof_scores(train, key, columns, **options)
        return scored.where(F.col("lof").isNull() | (F.col("lof") <= LOF_LIMIT)).drop("lof")
    if method == "iqr":
        return fit_fences(train, columns, **options).transform(train)
    raise ValueError(f"unknown filter {method!r}")
