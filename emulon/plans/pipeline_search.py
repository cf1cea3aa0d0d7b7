"""Searches in which preparation is a step inside the folds.

For each fold the fill values and the scales of the inputs are fitted on the rows outside of it, and applied to both sides, so
nothing of the validation rows leaks into them.  Outputs are taken as they are.

Response surfaces get all folds, all candidates and the final fit out of one scan (``models/filled.py``).  For the other kinds one
scan gives the column statistics of all folds; each fold then has a projection of its own, and its candidates are trained together.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulon.functions.columns import as_double, nan_to_null, no_nan, quoted
from emulon.models import fit, model_class
from emulon.models.base import Model
from emulon.models.filled import ColumnStats, GappedMap, Preparation, joined
from emulon.models.gram import first_look, moments, total
from emulon.models.response_surface import ResponseSurface
from emulon.operators.features import polynomial_terms
from emulon.operators.impute import MeanImputer
from emulon.operators.scale import ColumnScale, Scalers
from emulon.operators.split import folds
from emulon.plans.scoring import Scorer
from emulon.plans.search import candidate_id, expand_grid, fold_losses
from emulon.roles import Roles

KINDS = ("minmax", "standard", None)


@dataclass
class PipelineSearch:
    table: DataFrame  # candidate, params, fold, loss
    preparations: DataFrame  # fold, column, fill, centre, scale: fitted on the rows outside the fold
    best_params: dict[str, object]
    best_loss: float
    scorer: Scorer | None = None  # fitted on all rows, takes raw rows

    @property
    def model(self) -> Model | None:
        return self.scorer.model if self.scorer else None


def pipeline_search(
    kind: str,
    df: DataFrame,
    roles: Roles,
    grid: Mapping[str, object],
    k: int = 3,
    seed: int = 42,
    scaler: str | None = "minmax",
    refit: bool = True,
    exact: bool = False,
    **params,
) -> PipelineSearch:
    """Every combination of the grid on the same folds; missing inputs take the mean, continuous ones are scaled, by fold.

    The lowest mean loss wins (ties: the first) and is fitted on all rows, prepared by all rows."""
    if scaler not in KINDS:
        raise ValueError(f"scalers inside folds are {KINDS}; got {scaler!r}")
    roles.check(df)
    cls = model_class(kind)
    kinds = [scaler if c in roles.continuous else None for c in roles.inputs]
    choices = expand_grid(grid)
    candidates = [cls.complete({**params, **c}) for c in choices]
    rows = folds(nan_to_null(df.select(*map(quoted, roles.columns))), roles.key, k, seed, exact)
    search = (_SurfaceSearch if cls is ResponseSurface else _GeneralSearch)(kind, rows, roles, kinds, candidates, k)
    losses, outside = search.losses(), search.outside
    spark = df.sparkSession
    table = spark.createDataFrame([(i, candidate_id(c), f, loss) for i, (c, found) in enumerate(zip(choices, losses)) for f, loss in sorted(found.items())],
                                  "candidate int, params string, fold int, loss double")
    fitted = spark.createDataFrame([(f, c, float(p.fill[i]), float(p.centre[i]), float(p.scale[i]))
                                    for f, p in sorted(outside.items()) for i, c in enumerate(roles.inputs)],
                                   "fold int, column string, fill double, centre double, scale double")
    means = [math.fsum(found.values()) / len(found) for found in losses]
    best = int(np.argmin(means))
    scorer = _scorer(search.model(best), roles, kinds, search.whole) if refit else None
    return PipelineSearch(table, fitted, choices[best], means[best], scorer)


def _imputer(roles: Roles, prep: Preparation) -> MeanImputer:
    return MeanImputer({c: float(m) for c, m in zip(roles.inputs, prep.fill)})


def _scalers(roles: Roles, kinds: Sequence[str | None], prep: Preparation) -> Scalers:
    return Scalers({c: ColumnScale(kind, float(m), float(s)) for c, kind, m, s in zip(roles.inputs, kinds, prep.centre, prep.scale) if kind})


def _scorer(model: Model, roles: Roles, kinds: Sequence[str | None], prep: Preparation) -> Scorer:
    return Scorer(model, _scalers(roles, kinds, prep), Scalers({}), _imputer(roles, prep))


def _by_fold(stats: Mapping[int, ColumnStats], roles: Roles, kinds: Sequence[str | None]) -> tuple[dict[int, Preparation], Preparation]:
    """Preparations by the rows outside each fold, and by all rows."""
    if len(stats) < 2:
        raise ValueError("rows of at least two folds are needed")
    empty = [c for c, n in zip(roles.inputs, joined(list(stats.values())).n) if not n]
    if empty:
        raise ValueError(f"columns without any value cannot be imputed: {empty}")
    outside = {f: joined([s for g, s in sorted(stats.items()) if g != f]) for f in stats}
    alone = sorted({c for s in outside.values() for c, n in zip(roles.inputs, s.n) if not n})
    if alone:
        raise ValueError(f"columns with values in one fold only cannot be imputed: {alone}")
    return {f: s.prepared(kinds) for f, s in outside.items()}, joined([s for _, s in sorted(stats.items())]).prepared(kinds)


class _SurfaceSearch:
    """One scan of the raw rows; everything else is algebra on their inner products by fold."""

    def __init__(self, kind: str, rows: DataFrame, roles: Roles, kinds, candidates: Sequence[Mapping[str, object]], k: int):
        self.roles, self.candidates = roles, candidates
        shift, unit = first_look(rows, roles.inputs)
        self.maps = {}
        for p in candidates:
            key = str((p["degree"], p["interaction_only"]))
            self.maps.setdefault(key, GappedMap(roles.inputs, p["degree"], p["interaction_only"], shift, unit))
        ends: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.sums = moments(rows, self.maps, roles.inputs, roles.outputs, "fold", ends)
        one, by_fold = next((self.maps[key], sums) for key, sums in self.sums.items())
        self.outside, self.whole = _by_fold({f: one.stats(m, *ends[f]) for f, m in by_fold.items()}, roles, kinds)

    def _terms(self, p: Mapping[str, object]) -> list[tuple[int, ...]]:
        return polynomial_terms(range(len(self.roles.inputs)), int(p["degree"]), p["interaction_only"], p["include_bias"])

    def _of(self, p: Mapping[str, object]):
        key = str((p["degree"], p["interaction_only"]))
        return self.maps[key], self.sums[key]

    def losses(self) -> list[dict[int, float]]:
        out = []
        for p in self.candidates:
            raw, sums = self._of(p)
            found = {}
            for f, prep in self.outside.items():
                rest, held = (raw.moments_of(m, self._terms(p), prep) for m in (total({g: m for g, m in sums.items() if g != f}), sums[f]))
                error = held.squared_error(*ResponseSurface.solve(rest, p))
                found[f] = float(error.sum() / (held.rows * len(self.roles.outputs)))
            out.append(found)
        return out

    def model(self, candidate: int) -> Model:
        p = self.candidates[candidate]
        raw, sums = self._of(p)
        solved = ResponseSurface.solve(raw.moments_of(total(sums), self._terms(p), self.whole), p)
        return ResponseSurface(self.roles.inputs, self.roles.outputs, p, *solved)


class _GeneralSearch:
    """A scan for the statistics of all folds, then the candidates of each fold on rows prepared for it."""

    def __init__(self, kind: str, rows: DataFrame, roles: Roles, kinds, candidates: Sequence[Mapping[str, object]], k: int):
        self.kind, self.rows, self.roles, self.kinds, self.candidates, self.k = kind, rows, roles, kinds, candidates, k
        self.outside, self.whole = _by_fold(column_stats(rows, roles.inputs, "fold"), roles, kinds)

    def _prepared(self, prep: Preparation) -> DataFrame:
        return _scalers(self.roles, self.kinds, prep).transform(_imputer(self.roles, prep).transform(self.rows))

    def losses(self) -> list[dict[int, float]]:
        out: list[dict[int, float]] = [{} for _ in self.candidates]
        for f, prep in sorted(self.outside.items()):
            table = self._prepared(prep)
            for found, losses in zip(out, fold_losses(self.kind, table, self.roles, self.candidates, "fold", self.k, only=[f])):
                found[f] = losses[f]
        return out

    def model(self, candidate: int) -> Model:
        return fit(self.kind, self._prepared(self.whole), self.roles, **self.candidates[candidate])


def column_stats(rows: DataFrame, columns: Sequence[str], fold: str) -> dict[int, ColumnStats]:
    """Statistics of all columns by fold, in one aggregate."""
    cells = [no_nan(as_double(c)) for c in columns]
    parts = [f"{g}({c}) as {name}{i}" for i, c in enumerate(cells) for g, name in (
        ("count", "n"), ("avg", "m"), ("var_pop", "v"), ("min", "a"), ("max", "b"))]
    found = rows.groupBy(F.col(fold).cast("int").alias("f")).agg(F.count("*").alias("rows"), *map(F.expr, parts)).collect()

    def numbers(row, name: str, missing: float) -> np.ndarray:
        return np.array([missing if row[f"{name}{i}"] is None else float(row[f"{name}{i}"]) for i in range(len(cells))])

    return {r["f"]: ColumnStats(float(r["rows"]), n := numbers(r, "n", 0.0), numbers(r, "m", np.nan), numbers(r, "v", 0.0) * n,
                                numbers(r, "a", np.inf), numbers(r, "b", -np.inf)) for r in found}
