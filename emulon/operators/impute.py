"""Imputation of inputs: fitted on the training rows, applied to any rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from emulon.functions.columns import as_double, no_nan, number, replace_columns
from emulon.operators.neighbours import impute_from_neighbours


def _clean(name: str) -> str:
    return no_nan(as_double(name))


@dataclass(frozen=True)
class MeanImputer:
    means: dict[str, float]
    flagged: tuple[str, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        new = {c: f"coalesce({_clean(c)}, {number(m)})" for c, m in self.means.items() if c in df.columns}
        flags = {f"{c}_missing": f"({_clean(c)} is null)" for c in self.flagged}
        return replace_columns(df, {**new, **flags})


@dataclass(frozen=True)
class NeighbourImputer:
    """Keeps the training table itself: the donors are looked up when rows are transformed."""

    donors: DataFrame
    key: str
    columns: tuple[str, ...]
    means: dict[str, float]
    k: int = 5

    def transform(self, df: DataFrame) -> DataFrame:
        return impute_from_neighbours(df, self.donors, self.key, self.columns, self.means, self.k)


def column_means(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Means of all columns in one scan; a column without any value is an error."""
    row = train.selectExpr(*[f"avg({_clean(c)}) as m{i}" for i, c in enumerate(columns)]).head()
    means = {c: row[f"m{i}"] for i, c in enumerate(columns)}
    empty = [c for c, m in means.items() if m is None]
    if empty:
        raise ValueError(f"columns without any value cannot be imputed: {empty}")
    return means


def fit_imputer(train: DataFrame, columns: Sequence[str], kind: str = "simple", key: str | None = None, k: int = 5):
    """``simple`` (mean), ``missing indicator`` (mean plus flag columns) or ``knn`` (which breaks
    ties between equally near rows by ``key``)."""
    means = column_means(train, columns)
    if kind == "simple":
        return MeanImputer(means)
    if kind == "missing indicator":
        row = train.selectExpr(*[f"bool_or({_clean(c)} is null) as m{i}" for i, c in enumerate(columns)]).head()
        return MeanImputer(means, tuple(c for i, c in enumerate(columns) if row[f"m{i}"]))
    if kind == "knn":
        if key is None:
            raise ValueError("the knn imputer needs the key column")
        return NeighbourImputer(train, key, tuple(columns), means, k)
    raise ValueError(f"unknown imputer {kind!r}")
