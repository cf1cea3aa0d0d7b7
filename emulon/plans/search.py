"""Cross-validation, hold-out losses and grid search.

Surfaces, kernel ridge and Gaussian processes score all folds and all candidates from
statistics grouped by fold: one scan for as many candidates as fit in a task.  Support
vectors and networks run all (candidate, fold) fits in the same rounds.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulon.functions.columns import quoted
from emulon.models import fit, model_class
from emulon.models import network, support_vector
from emulon.models.base import Model
from emulon.models.gaussian_process import GaussianProcess, log_marginal_likelihood
from emulon.models.gram import moments, total
from emulon.models.network import Network, NetworkJob
from emulon.models.support_vector import FitJob, SupportVector
from emulon.operators.evaluate import metrics
from emulon.operators.split import folds
from emulon.roles import Roles

TASK_NUMBERS = 8_000_000  # statistics that one task holds for all folds and candidates


# ----------------------------------------------------------------------------- parameter grids


def parse_options(text: str) -> list[object]:
    """``'a|b|c'`` as a list of typed values."""
    return [_typed(part.strip()) for part in str(text).split("|")]


def _typed(text: str) -> object:
    plain = {"true": True, "false": False, "none": None}
    if text.lower() in plain:
        return plain[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def expand_grid(grid: Mapping[str, object]) -> list[dict[str, object]]:
    """All combinations; a value is a list or text with ``|`` between the options."""
    options = {k: v if isinstance(v, (list, tuple)) else parse_options(v) for k, v in grid.items()}
    return [dict(zip(options, values)) for values in product(*options.values())]


def grid_table(spark: SparkSession, grid: Mapping[str, str]) -> DataFrame:
    """The combinations of textual options as a DataFrame, each with a ``candidate`` id by hash."""
    one = spark.range(1).select(*[F.split(F.lit(str(v)), r"\|").alias(k) for k, v in grid.items()])
    wide = reduce(lambda df, k: df.withColumn(k, F.explode(k)), grid, one)
    wide = wide.select(*[F.trim(k).alias(k) for k in grid])
    described = F.concat_ws("|", *[F.concat(F.lit(f"{k}="), F.col(k)) for k in grid])
    return wide.select(F.md5(described).alias("candidate"), *grid)


def candidate_id(params: Mapping[str, object]) -> str:
    return json.dumps(params, sort_keys=True, default=str)


# ----------------------------------------------------------------------------- fold losses


def fold_losses(
    kind: str, df: DataFrame, roles: Roles, candidates: Sequence[Mapping[str, object]], fold: str = "fold", k: int = 10,
    only: Sequence[int] | None = None,
) -> list[dict[int, float]]:
    """Validation mean squared error by fold for every candidate (complete parameter sets); ``k`` is the number of folds.

    With ``only``, of these folds."""
    cls = model_class(kind)
    if cls in (SupportVector, Network):
        numbers = _fold_numbers(df, fold) if only is None else list(only)
        return (_svr_losses if cls is SupportVector else _network_losses)(df, roles, candidates, fold, numbers)
    search = _GramSearch(cls, df, roles, candidates, fold, k)
    return [search.losses(i, only) for i in range(len(candidates))]


def _fold_numbers(df: DataFrame, fold: str) -> list[int]:
    return sorted(r[0] for r in df.select(F.col(fold).cast("int")).distinct().collect())


class _GramSearch:
    """Statistics by fold of every candidate of a kind that is solved from them."""

    def __init__(self, cls, df: DataFrame, roles: Roles, candidates: Sequence[Mapping[str, object]], fold: str, k: int):
        self.cls, self.roles = cls, roles
        # A Gaussian process with lists among its parameters picks by likelihood.
        self.groups = [cls.grid(p) if cls is GaussianProcess else [p] for p in candidates]
        firsts = {self._key(p): p for g in reversed(self.groups) for p in reversed(g)}
        self.maps = dict(zip(firsts, cls.prepare_maps(df, roles, list(firsts.values()))))
        self.stats: dict[str, dict] = {}
        for batch in _by_size(self.maps, len(roles.outputs), k):
            self.stats.update(moments(df, {k: self.maps[k] for k in batch}, roles.inputs, roles.outputs, fold))

    def _key(self, params) -> str:
        return str(self.cls.map_key(params))

    def _pick(self, group, sums) -> Mapping[str, object]:
        if len(group) == 1:
            return group[0]
        return max(group, key=lambda p: log_marginal_likelihood(sums[self._key(p)], float(p["alpha"])))

    def losses(self, candidate: int, only: Sequence[int] | None = None) -> dict[int, float]:
        """Each fold is predicted from the statistics of all others."""
        group, out = self.groups[candidate], {}
        for f in sorted(self.stats[self._key(group[0])] if only is None else only):
            sums = {self._key(p): total(self.stats[self._key(p)]) - self.stats[self._key(p)][f] for p in group}
            params = self._pick(group, sums)
            held = self.stats[self._key(params)][f]
            error = held.squared_error(*self.cls.solve(sums[self._key(params)], params))
            out[f] = float(error.sum() / (held.rows * len(self.roles.outputs)))
        return out

    def model(self, candidate: int) -> Model:
        """Fit on all rows, without another scan."""
        group = self.groups[candidate]
        sums = {self._key(p): total(self.stats[self._key(p)]) for p in group}
        params = self._pick(group, sums)
        key = self._key(params)
        return self.cls.from_moments(self.roles, params, sums[key], self.maps[key])


def _by_size(maps: Mapping[str, object], n_out: int, k: int):
    batch, size = [], 0
    for key, m in maps.items():
        numbers = k * (m.width + n_out + 1) ** 2
        if batch and size + numbers > TASK_NUMBERS:
            yield batch
            batch, size = [], 0
        batch.append(key)
        size += numbers
    yield batch


def _svr_losses(df, roles, candidates, fold, numbers) -> list[dict[int, float]]:
    jobs = [FitJob(p, f) for p in candidates for f in numbers]
    support_vector.train(df, roles, jobs, fold)
    models = [SupportVector(roles.inputs, [f"{i}_{c}" for c in roles.outputs], j.params, j.map, j.weights)
              for i, j in enumerate(jobs)]
    # Every row is predicted only by the models that left its fold out.
    errors = []
    rows = df
    for f in numbers:
        held = rows.where(F.col(fold) == f)
        mine = [(i, m) for i, (j, m) in enumerate(zip(jobs, models)) if j.fold == f]
        for _, m in mine:
            held = m.transform(held)
        cells = [F.avg(sum(((F.col(f"pred_{i}_{c}") - F.col(c)) ** 2 for c in roles.outputs), F.lit(0.0))
                       / len(roles.outputs)).alias(f"l{i}") for i, _ in mine]
        row = held.agg(*cells).head()
        errors += [(i, f, row[f"l{i}"]) for i, _ in mine]
    out: list[dict[int, float]] = [{} for _ in candidates]
    for i, f, loss in errors:
        out[i // len(numbers)][f] = loss
    return out


def _network_losses(df, roles, candidates, fold, numbers) -> list[dict[int, float]]:
    jobs = [NetworkJob(p, f) for p in candidates for f in numbers]
    together: dict[tuple, list] = {}  # fits that share their method, their partitions and their shuffling share the scans
    for job in jobs:
        together.setdefault((job.params["partitions"], job.params["seed"], job.params["method"]), []).append(job)
    for (partitions, *_), some in together.items():
        network.train(df, roles, some, fold, partitions)
    out: list[dict[int, float]] = [{} for _ in candidates]
    for i, job in enumerate(jobs):
        out[i // len(numbers)][job.fold] = job.best
    return out


# ----------------------------------------------------------------------------- operators


@dataclass
class CrossValidation:
    losses: DataFrame  # fold, loss
    mean_loss: float
    model: Model | None = None


def cross_validate(
    kind: str, df: DataFrame, roles: Roles, k: int = 5, seed: int = 42, refit: bool = True, exact: bool = False, **params
) -> CrossValidation:
    """Mean over folds of the validation loss; then, always, a fit on all rows."""
    roles.check(df)
    cls = model_class(kind)
    chosen = cls.complete(params)
    parted = folds(df.select(*map(quoted, roles.columns)), roles.key, k, seed, exact)
    model = None
    if cls in (SupportVector, Network):
        found = fold_losses(kind, parted, roles, [chosen])[0]
        model = fit(kind, df, roles, **params) if refit else None
    else:
        search = _GramSearch(cls, parted, roles, [chosen], "fold", k)
        found = search.losses(0)
        model = search.model(0) if refit else None
    table = df.sparkSession.createDataFrame(sorted(found.items()), "fold int, loss double")
    return CrossValidation(table, float(np.mean(list(found.values()))), model)


def hold_out(
    kind: str, train: DataFrame, val: DataFrame, roles: Roles, **params
) -> tuple[Model, DataFrame]:
    """Fit on the training rows; loss table ``(epoch, split, loss)`` on training and validation rows."""
    if kind == Network.kind:
        model = Network.fit(train, roles, Network.complete(params), validation=val)
        return model, model.losses(train.sparkSession)
    model = fit(kind, train, roles, **params)
    parts = []
    for name, rows in (("train", train), ("val", val)):
        overall = metrics(model.transform(rows), roles.outputs, ["mse"]).where("output = 'all'")
        parts.append(overall.select(F.lit(0).alias("epoch"), F.lit(name).alias("split"), F.col("value").alias("loss")))
    return model, parts[0].unionByName(parts[1])


@dataclass
class GridSearch:
    table: DataFrame  # candidate, params, fold, loss
    best_params: dict[str, object]
    best_loss: float
    model: Model | None = None


def grid_search(
    kind: str,
    df: DataFrame,
    roles: Roles,
    grid: Mapping[str, object],
    k: int = 3,
    seed: int = 42,
    refit: bool = True,
    exact: bool = False,
    **params,
) -> GridSearch:
    """Every combination of the grid on the same folds; the lowest mean loss wins and is refitted."""
    roles.check(df)
    cls = model_class(kind)
    choices = expand_grid(grid)
    parted = folds(df.select(*map(quoted, roles.columns)), roles.key, k, seed, exact)
    found = fold_losses(kind, parted, roles, [cls.complete({**params, **c}) for c in choices], k=k)
    rows = [(i, candidate_id(c), f, loss) for i, (c, losses) in enumerate(zip(choices, found))
            for f, loss in sorted(losses.items())]
    table = df.sparkSession.createDataFrame(rows, "candidate int, params string, fold int, loss double")
    means = table.groupBy("candidate").agg(F.avg("loss").alias("loss"))
    best = means.agg(F.min_by("candidate", F.struct("loss", "candidate")).alias("candidate"), F.min("loss").alias("loss")).head()
    winner = choices[best["candidate"]]
    model = fit(kind, df, roles, **{**params, **winner}) if refit else None
    return GridSearch(table, winner, best["loss"], model)
