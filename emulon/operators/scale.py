"""Column scalers: one aggregate to fit, literal expressions to apply.

A scale that is zero (a constant column) is taken as one, so the column becomes zero.
Nothing is clipped: test rows may fall outside the range of the training rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulon.functions.columns import as_double, number, quoted, replace_columns
from emulon.functions.quantiles import array_quantiles, column_quantiles
from emulon.roles import SCALERS, Roles

TINY = 10 * 2.220446049250313e-16  # a scale below this counts as zero

Rule = tuple[Callable[[str], bool], str]


def prefix_rule(prefix: str, scaler: str) -> Rule:
    return (lambda name: name.startswith(prefix)), scaler


# Fixed value: outputs of this family have a scaler of their own.
TCP_MINMAX = prefix_rule("TCP", "minmax")
TCP_ROBUST = prefix_rule("TCP", "robust")


def scaler_types(columns: Iterable[str], default: str, rules: Sequence[Rule] = ()) -> dict[str, str]:
    """Scaler type per column: the first rule whose test holds, else the default."""
    return {c: next((s for test, s in rules if test(c)), default) for c in columns}


@dataclass(frozen=True)
class ColumnScale:
    kind: str
    center: float
    scale: float

    def apply(self, name: str) -> str:
        return f"(({as_double(name)} - {number(self.center)}) / {number(self.scale)})"

    def undo(self, name: str) -> str:
        return f"({as_double(name)} * {number(self.scale)} + {number(self.center)})"


@dataclass(frozen=True)
class Scalers:
    """Fitted scalers by column; works on batch and streaming DataFrames."""

    by_column: Mapping[str, ColumnScale]

    def transform(self, df: DataFrame) -> DataFrame:
        present = [c for c in self.by_column if c in df.columns]
        return replace_columns(df, {c: self.by_column[c].apply(c) for c in present})

    def inverse(self, df: DataFrame, prefixes: Sequence[str] = ("", "pred_")) -> DataFrame:
        """Back to original units, for the columns themselves and their predictions."""
        new = {
            p + c: s.undo(p + c)
            for c, s in self.by_column.items()
            for p in prefixes
            if p + c in df.columns
        }
        return replace_columns(df, new)

    def only(self, columns: Iterable[str]) -> "Scalers":
        return Scalers({c: self.by_column[c] for c in columns})


def fit_scalers(
    train: DataFrame, types: Mapping[str, str], approximate: bool = False
) -> Scalers:
    """Fit every column with its own scaler type: one scan, plus the quantile scans if any is robust."""
    unknown = sorted(set(types.values()) - set(SCALERS))
    if unknown:
        raise ValueError(f"unknown scaler {unknown}; one of {SCALERS}")
    robust = [c for c, kind in types.items() if kind == "robust"]
    plain = [c for c in types if c not in robust]
    fitted: dict[str, ColumnScale] = {}
    if plain:
        aggregates = []
        for i, c in enumerate(plain):
            first, second = ("min", "max") if types[c] == "minmax" else ("avg", "stddev_pop")
            aggregates += [f"{first}({as_double(c)}) as a{i}", f"{second}({as_double(c)}) as b{i}"]
        row = train.selectExpr(*aggregates).head()
        for i, c in enumerate(plain):
            a, b = row[f"a{i}"], row[f"b{i}"]
            if a is None:
                raise ValueError(f"column {c!r} has no values to fit a scaler on")
            fitted[c] = ColumnScale(types[c], a, _usable(b - a if types[c] == "minmax" else b))
    if robust:
        for c, (q1, q2, q3) in column_quantiles(train, robust, [0.25, 0.5, 0.75], approximate).items():
            if q1 is None:
                raise ValueError(f"column {c!r} has no values to fit a scaler on")
            fitted[c] = ColumnScale("robust", q2, _usable(q3 - q1))
    return Scalers({c: fitted[c] for c in types})


def _usable(scale: float) -> float:
    return 1.0 if abs(scale) < TINY else float(scale)


def fit_input_scalers(train: DataFrame, roles: Roles, kind: str = "minmax") -> Scalers:
    """Scalers of the continuous inputs; discrete inputs pass through unscaled."""
    return fit_scalers(train, dict.fromkeys(roles.continuous, kind))


def fit_output_scalers(
    train: DataFrame,
    roles: Roles,
    default: str = "minmax",
    types: Mapping[str, str] | None = None,
    rules: Sequence[Rule] = (),
) -> Scalers:
    """One independent scaler per output; ``types`` overrides the rules by name."""
    chosen = {**scaler_types(roles.outputs, default, rules), **(types or {})}
    return fit_scalers(train, {c: chosen[c] for c in roles.outputs})


@dataclass(frozen=True)
class ArrayScaler:
    """Scaler of a wide table kept as one array column; position i has its own parameters."""

    kind: str
    centers: Sequence[float]
    scales: Sequence[float]

    def transform(self, df: DataFrame, column: str) -> DataFrame:
        return self._zip(df, column, lambda x, p: (x - p["c"]) / p["s"])

    def inverse(self, df: DataFrame, column: str) -> DataFrame:
        return self._zip(df, column, lambda x, p: x * p["s"] + p["c"])

    def _zip(self, df, column, step):
        pairs = [f"struct({number(c)} as c, {number(s)} as s)" for c, s in zip(self.centers, self.scales)]
        params = F.expr(f"array({', '.join(pairs)})")
        return df.withColumn(column, F.zip_with(F.col(column).cast("array<double>"), params, step))


def fit_array_scaler(train: DataFrame, column: str, kind: str = "minmax") -> ArrayScaler:
    """Fit all positions of an array column: map-side combined, one group per position."""
    if kind not in SCALERS:
        raise ValueError(f"unknown scaler {kind!r}; one of {SCALERS}")
    if kind == "robust":
        quarters = array_quantiles(train, column, [0.25, 0.5, 0.75])
        empty = [i for i, (q1, *_) in enumerate(quarters) if q1 is None]
        if empty:
            raise ValueError(f"positions {empty[:5]} of {column!r} have no values to fit a scaler on")
        return ArrayScaler(kind, [q2 for _, q2, _ in quarters], [_usable(q3 - q1) for q1, _, q3 in quarters])
    cells = train.select(F.posexplode(F.col(quoted(column)).cast("array<double>")).alias("pos", "x"))
    first, second = (F.min, F.max) if kind == "minmax" else (F.avg, F.stddev_pop)
    rows = cells.groupBy("pos").agg(first("x").alias("a"), second("x").alias("b")).orderBy("pos").collect()
    scales = [_usable(r["b"] - r["a"] if kind == "minmax" else r["b"]) for r in rows]
    return ArrayScaler(kind, [r["a"] for r in rows], scales)
