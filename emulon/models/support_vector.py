"""Support-vector regression, one model per output, all outputs and fits in the same scans.

The epsilon-insensitive loss is minimised in the primal on landmark features (Chapelle
2007): its corners are rounded over a width that shrinks by turns, and Newton directions
come from a gradient and a curvature that are sums over the rows.  One scan tries several
dampings and lengths of the direction and takes the derivatives where the one that served best
before leads.  The descent starts from the ridge solution, which costs one scan; on large tables it runs first on shares of the rows, each
eight times the one before, so that few scans of all rows are left.  The last descent, and objective and bound, are always over all rows.

The slopes of the rounded loss, row by row, are a point of the dual problem; made to add up to nought, they give a lower bound of the
objective.  Every scan so tells a duality gap.  An output is done when its gap is at most ``tol`` of its objective; fits tell
objective, bound and whether they got there, and one that did not gives a warning.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulon.functions.columns import as_double, model_columns, unit_hash
from emulon.models.base import Model
from emulon.models.landmarks import Kernel, LandmarkMap, pick_landmarks
from emulon.models.sums import sum_over_partitions
from emulon.roles import Roles
from emulon.runtime import opened, share, worker_count

# Shares of the curvature's upper bound, and lengths, that are tried of each direction.
TRIALS = tuple((d, t) for t in (1.0, 0.5, 0.2, 0.05) for d in (1e-9, 1e-5, 1e-3, 1e-1))
FIRST_WIDTH = 0.03  # of the rounding, in spreads of the output
NARROWER = 3.0  # each width is so many times smaller than the one before
MAX_WIDTHS = 18
SETTLED = 1e-6  # relative decrease of the rounded objective that ends the work at a width
MAX_STEPS = 12  # at a width; a fit stops earlier when it settles
CURVATURE_NUMBERS = 4_000_000
FIRST_ROWS, GROWTH = 100_000, 8  # least rows of a share that a descent starts on, and how much larger the next one is
BLOCK_NUMBERS = 226_000  # features and trial values of a block of rows: few enough for a core's cache


class IdentityMap:
    """Features of the linear kernel: the inputs themselves."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x


@dataclass
class FitJob:
    """One fit: its settings, and the fold whose rows it must not see (None: all rows)."""

    params: Mapping[str, object]
    fold: int | None = None
    map: object = None
    weights: np.ndarray = None  # intercept first, one column per output
    objective: np.ndarray = None  # by output
    bound: np.ndarray = None  # what no weights can go below, by output

    @property
    def converged(self) -> np.ndarray:
        return self.objective - self.bound <= float(self.params["tol"]) * np.maximum(np.abs(self.objective), 1e-12)


class SupportVector(Model):
    kind = "svr"
    defaults = {"C": 1.0, "epsilon": 0.1, "kernel": "rbf", "gamma": "scale", "degree": 3, "landmarks": 256, "seed": 42, "tol": 1e-2}

    def __init__(self, inputs, outputs, params, feature_map, weights: np.ndarray, objective=None, bound=None):
        super().__init__(inputs, outputs, params)
        self.map, self.weights = feature_map, weights
        unknown = np.full(len(self.outputs), np.nan)
        self.objective, self.bound = (unknown if v is None else np.asarray(v).ravel() for v in (objective, bound))

    @classmethod
    def fit(cls, df: DataFrame, roles: Roles, params: Mapping[str, object]) -> "SupportVector":
        job = train(df, roles, [FitJob(params)])[0]
        if not job.converged.all():
            far = [c for c, ok in zip(roles.outputs, job.converged) if not ok]
            warnings.warn(f"support vectors of {far} are not within tol of the lowest objective; see certificate()", stacklevel=2)
        return cls(roles.inputs, roles.outputs, {**params, "gamma": gamma_of(job.map)}, job.map, job.weights, job.objective, job.bound)

    def certificate(self, spark: SparkSession) -> DataFrame:
        """Table ``(output, objective, bound, gap, converged)``: the lowest objective lies between bound and objective."""
        done = self.objective - self.bound <= float(self.params["tol"]) * np.maximum(np.abs(self.objective), 1e-12)
        rows = [(c, float(o), float(b), float(o - b), bool(d)) for c, o, b, d in zip(self.outputs, self.objective, self.bound, done)]
        return spark.createDataFrame(rows, "output string, objective double, bound double, gap double, converged boolean")

    def predict_block(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.weights[1:] + self.weights[0]

    def arrays(self):
        own = {"weights": self.weights, "objective": self.objective, "bound": self.bound}
        return own if isinstance(self.map, IdentityMap) else {**own, "landmarks": self.map.landmarks, "root": self.map.root}

    @classmethod
    def restore(cls, config, arrays):
        params = config["params"]
        if "landmarks" in arrays:
            kernel = Kernel(params["kernel"], gamma=params["gamma"], degree=int(params["degree"]))
            feature_map = LandmarkMap(kernel, arrays["landmarks"], arrays["root"])
        else:
            feature_map = IdentityMap(len(config["inputs"]))
        return cls(config["inputs"], config["outputs"], {**cls.defaults, **params}, feature_map, arrays["weights"],
                   arrays.get("objective"), arrays.get("bound"))


def gamma_of(feature_map) -> float | None:
    return getattr(getattr(feature_map, "kernel", None), "gamma", None)


def _scale_gammas(df: DataFrame, inputs: Sequence[str], fold: str | None) -> dict[int | None, float]:
    """``1 / (inputs x variance of all input values)``, without each fold and without none."""
    cells = [as_double(c) for c in inputs]
    sums = [F.expr(f"{f}({c})").alias(f"{name}{i}") for i, c in enumerate(cells) for f, name in (("count", "n"), ("avg", "m"), ("var_pop", "v"))]
    rows = df.groupBy((F.col(fold) if fold else F.lit(0)).alias("fold")).agg(*sums).collect()

    def gamma(kept):
        parts = [(r[f"n{i}"], r[f"m{i}"], r[f"v{i}"]) for r in kept for i in range(len(inputs)) if r[f"n{i}"]]
        n = sum(p[0] for p in parts)
        if not n:
            return 1.0
        mean = sum(p[0] * p[1] for p in parts) / n
        variance = sum(p[0] * (p[2] + (p[1] - mean) ** 2) for p in parts) / n
        return 1.0 / (len(inputs) * variance) if variance > 0 else 1.0

    out: dict[int | None, float] = {None: gamma(rows)}
    if fold and len(rows) > 1:
        out.update({r["fold"]: gamma([o for o in rows if o["fold"] != r["fold"]]) for r in rows})
    return out


def train(df: DataFrame, roles: Roles, jobs: list[FitJob], fold: str | None = None) -> list[FitJob]:
    """Run all fits together; returns the jobs with map and weights filled in."""
    for job in jobs:
        if job.params["kernel"] not in ("rbf", "linear", "poly", "sigmoid"):
            raise ValueError(f"unknown kernel {job.params['kernel']!r}")
    gammas = _scale_gammas(df, roles.inputs, fold)
    picks: dict[tuple, np.ndarray] = {}
    for job in jobs:
        p = job.params
        if p["kernel"] == "linear":
            job.map = IdentityMap(len(roles.inputs))
            continue
        wanted = (int(p["landmarks"]), int(p["seed"]))
        if wanted not in picks:
            picks[wanted] = pick_landmarks(df, roles.key, roles.inputs, *wanted)
        gamma = gammas[job.fold] if p["gamma"] in ("scale", None) else float(p["gamma"])
        job.map = LandmarkMap(Kernel(p["kernel"], gamma=gamma, degree=int(p["degree"])), picks[wanted])

    def rows(source: DataFrame) -> DataFrame:
        return source.select(
            *model_columns("x", roles.inputs),
            *model_columns("y", roles.outputs),
            (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"),
        )

    table = rows(df).persist(StorageLevel.MEMORY_AND_DISK)
    n_out = len(roles.outputs)
    n, *spreads = table.agg(F.count(F.lit(1)), *[F.stddev_pop(f"y{i}") for i in range(n_out)]).head()
    spreads = np.array([v if v and np.isfinite(v) else 1.0 for v in spreads])
    stages = [(table, 1.0)]
    draw = unit_hash(roles.key, 42, "descent")
    share_of = 1 / GROWTH
    try:
        while n * share_of >= FIRST_ROWS:
            some = rows(df.where(draw < share_of)).coalesce(worker_count(df.sparkSession)).persist(StorageLevel.MEMORY_AND_DISK)
            stages.insert(0, (some, n / max(1, some.count())))
            share_of /= GROWTH
        # keys that are null, or few, may deal a share too few rows to start on
        stages = [(some, weight) for some, weight in stages if n / weight >= min(n, FIRST_ROWS / 2)]
        widest = max(job.map.width for job in jobs) + 1
        together = max(1, CURVATURE_NUMBERS // (widest * widest * len(jobs)))
        for job in jobs:
            job.weights = np.zeros((job.map.width + 1, n_out))
            job.objective, job.bound = np.full(n_out, np.nan), np.full(n_out, np.nan)
        for start in range(0, len(roles.outputs), together):
            outputs = list(range(start, min(start + together, len(roles.outputs))))
            _minimise(stages, jobs, len(roles.inputs), outputs, spreads[outputs])
    finally:
        for some, _ in stages:
            some.unpersist()
    return jobs


def _minimise(stages: list[tuple[DataFrame, float]], jobs: list[FitJob], n_in: int, outputs: list[int], spreads: np.ndarray) -> None:
    """Descents on all stages, each from where the one before ended; a row of a stage counts as many times as its weight tells."""
    state: list[_Descent] = []
    for table, weight in stages:
        partitions = table.rdd.getNumPartitions()
        if not state:
            for job, (gram, cross) in zip(jobs, _inner_products(table, jobs, n_in, outputs, partitions)):
                c = weight * max(float(job.params["C"]), 1e-12)
                penalty = np.eye(len(gram)) / c
                penalty[0, 0] = 1e-9 / weight
                state.append(_Descent(np.linalg.solve(gram + penalty, cross), gram, FIRST_WIDTH * spreads, job.params, weight))
        else:
            state = [s.over(weight, FIRST_WIDTH * spreads) for s in state]
        while any(not s.done.all() for s in state):
            trials = {j: s.trials() for j, s in enumerate(state) if not s.done.all()}
            active = {j: np.flatnonzero(~state[j].done) for j in trials}
            found = _scan(table, jobs, trials, {j: state[j].width[active[j]] for j in trials}, n_in,
                          {j: [outputs[k] for k in active[j]] for j in trials}, partitions)
            for j in trials:
                state[j].take(trials[j], found[j])
    for job, s in zip(jobs, state):
        job.weights[:, outputs], job.objective[outputs], job.bound[outputs] = s.best, s.objective, s.bound


class _Descent:
    """Damped Newton descent of one fit; its outputs are separate problems, each with its own width."""

    def __init__(self, point: np.ndarray, gram: np.ndarray, width: np.ndarray, params: Mapping[str, object], weight: float = 1.0):
        self.point, self.gram, self.width, self.params, self.weight = point.copy(), gram, width.copy(), params, weight
        self.c, self.tol = weight * float(params["C"]), float(params["tol"])
        size, q = point.shape
        self.best, self.objective, self.bound = point.copy(), np.full(q, np.inf), np.zeros(q)
        self.value = np.full(q, np.inf)
        self.slope, self.curvature = np.zeros((size, q)), np.zeros((q, size, size))
        self.fresh = np.zeros(q, dtype=bool)  # value and derivatives belong to the point and the width
        self.favourite = np.zeros(q, dtype=int)
        self.turn, self.step = np.zeros(q, dtype=int), np.zeros(q, dtype=int)
        self.done = np.zeros(q, dtype=bool)
        self.ridge = np.eye(size)
        self.ridge[0, 0] = 1e-9  # the intercept is not penalised

    def over(self, weight: float, widest: np.ndarray) -> "_Descent":
        """The descent that goes on from here over other rows."""
        there = self.objective - self.bound <= self.tol * np.maximum(np.abs(self.objective), 1e-12)
        width = np.where(there, np.minimum(widest, self.width), widest)
        return _Descent(self.best, self.gram * (self.weight / weight), width, self.params, weight)

    def trials(self) -> np.ndarray:
        """Points to evaluate, of the outputs that are not done; the first one is where derivatives are taken."""
        out = np.repeat(self.point[None], len(TRIALS), axis=0)
        for k in np.flatnonzero(self.fresh & ~self.done):
            g = self.c * self.slope[:, k] + self.ridge @ self.point[:, k]
            ways = {d: np.linalg.solve(self.c * (self.curvature[k] + d * self.gram / self.width[k]) + self.ridge, g) for d in {d for d, _ in TRIALS}}
            for i, at in enumerate(np.roll(np.arange(len(TRIALS)), -self.favourite[k])):
                damping, length = TRIALS[at]
                out[i, :, k] -= length * ways[damping]
        return out[:, :, ~self.done]

    def take(self, trials: np.ndarray, found: "_Found") -> None:
        values = 0.5 * (trials[:, 1:] ** 2).sum(axis=1) + self.c * found.losses
        objective, bound = found.gap(trials[0], self.c, float(self.params["epsilon"]))
        for at, k in enumerate(np.flatnonzero(~self.done)):
            self.bound[k] = max(self.bound[k], bound[at])  # a bound holds, whichever point gave it
            if objective[at] < self.objective[k]:
                self.objective[k], self.best[:, k] = objective[at], trials[0, :, at]
            if self.objective[k] - self.bound[k] <= self.tol * max(abs(self.objective[k]), 1e-12):
                self.done[k] = True
                continue
            settled = False
            pick = 0
            if self.fresh[k]:
                low = int(np.argmin(values[:, at]))
                gain = self.value[k] - values[low, at]
                self.step[k] += 1
                settled = not gain > SETTLED * abs(self.value[k]) or self.step[k] >= MAX_STEPS
                if gain > 0:
                    # A first trial that does half as well as the best saves a scan for the derivatives.
                    pick = 0 if self.value[k] - values[0, at] >= 0.5 * gain else low
                    self.favourite[k] = (self.favourite[k] + low) % len(TRIALS)
                else:
                    pick = None
            if pick is not None:
                self.point[:, k], self.value[k] = trials[pick, :, at], values[pick, at]
                self.fresh[k] = pick == 0
                if pick == 0:
                    self.slope[:, k], self.curvature[k] = found.slope[:, at], found.curvature[at]
            if settled:
                self.turn[k], self.step[k], self.fresh[k] = self.turn[k] + 1, 0, False
                self.width[k] /= NARROWER
                self.done[k] = self.turn[k] >= MAX_WIDTHS


@dataclass
class _Found:
    """What a scan tells of one fit: rounded losses at the trial points, and more at the first of them."""

    losses: np.ndarray  # (trials, outputs)
    slope: np.ndarray  # (weights, outputs)
    curvature: np.ndarray  # (outputs, weights, weights)
    loss: np.ndarray  # not rounded
    pulled: np.ndarray  # sums of outputs pulled up, pulled down
    pulls: np.ndarray  # sums of features pulled up, pulled down

    def gap(self, point: np.ndarray, c: float, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """Objective at the point, and a bound below all objectives."""
        up, down = self.pulls
        # the intercept takes no part in the penalty: pulls must balance, so the stronger side is weakened
        level = np.minimum(up[0], down[0])
        u, d = (level / np.where(side[0] > 0, side[0], 1.0) for side in (up, down))
        w = c * (u * up[1:] - d * down[1:])
        bound = c * (u * self.pulled[0] - d * self.pulled[1]) - c * epsilon * (u * up[0] + d * down[0]) - 0.5 * (w**2).sum(axis=0)
        return 0.5 * (point[1:] ** 2).sum(axis=0) + c * self.loss, bound


def _rows(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    block = batch.iloc[:, :-1].to_numpy(dtype=float)
    if np.isnan(block).any():
        raise ValueError("inputs and outputs of a fit must not be missing; impute or drop them first")
    return block, batch["fold"].to_numpy()


def _design(feature_map, rows: np.ndarray, n_in: int) -> np.ndarray:
    return np.hstack([np.ones((len(rows), 1)), feature_map(rows[:, :n_in])])


def _block_rows(jobs, others: int = 0) -> int:
    return max(256, BLOCK_NUMBERS // (max(job.map.width + 1 for job in jobs) + others))


def _inner_products(table, jobs, n_in, outputs, partitions) -> list[tuple[np.ndarray, np.ndarray]]:
    """Inner products of the features, with themselves and with the outputs, for each fit."""
    shared = share(table.sparkSession, [(j, job.map, job.fold) for j, job in enumerate(jobs)])
    step = _block_rows(jobs)
    y_at = [n_in + o for o in outputs]

    def work(batches: Iterator[pd.DataFrame], part: int) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        fits = opened(shared)
        for batch in batches:
            block, fold = _rows(batch)
            for start in range(0, len(block), step):
                for j, feature_map, left_out in fits:
                    kept = block[start : start + step]
                    if left_out is not None:
                        kept = kept[fold[start : start + step] != left_out]
                    z = _design(feature_map, kept, n_in)
                    sums[j] = sums.get(j, 0.0) + (z.T @ np.hstack([z, kept[:, y_at]])).ravel()
        return sums

    size = sum((job.map.width + 1) * (job.map.width + 1 + len(outputs)) for job in jobs)
    totals = sum_over_partitions(table, work, size, partitions)
    shared.unpersist()
    if not totals:
        raise ValueError("no rows to fit on")
    products = [totals[j].reshape(job.map.width + 1, -1) for j, job in enumerate(jobs)]
    return [(p[:, : len(p)], p[:, len(p) :]) for p in products]


def _scan(table, jobs, trials, widths, n_in, outputs, partitions) -> dict[int, _Found]:
    """Losses at all trial points, derivatives and pulls at the first, for every active job."""
    shared = share(
        table.sparkSession, [(j, jobs[j].map, jobs[j].fold, float(jobs[j].params["epsilon"]), widths[j], points) for j, points in trials.items()])
    y_at = {j: [n_in + o for o in some] for j, some in outputs.items()}
    step = _block_rows([jobs[j] for j in trials], max(p.shape[0] * p.shape[2] for p in trials.values()))

    def work(batches: Iterator[pd.DataFrame], part: int) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        fits = opened(shared)
        for batch in batches:
            block, number = _rows(batch)
            for start in range(0, len(block), step):
                rows, fold = block[start : start + step], number[start : start + step]
                for j, feature_map, left_out, epsilon, width, points in fits:
                    kept = rows if left_out is None else rows[fold != left_out]
                    z, y = _design(feature_map, kept, n_in), kept[:, y_at[j]]
                    q = y.shape[1]
                    gaps = (z @ np.concatenate(points, axis=1)).reshape(len(z), -1, q)
                    gaps -= y[:, None, :]
                    gap = gaps[:, 0].copy()
                    losses = _loss(gaps, epsilon, width)
                    over = np.abs(gap) - epsilon
                    pull = -np.sign(gap) * np.clip(over / width, 0.0, 1.0)
                    up, down = np.maximum(pull, 0.0), np.maximum(-pull, 0.0)
                    bends = (over > 0) & (over < width)
                    curved = [z[bends[:, k]].T @ z[bends[:, k]] / width[k] for k in range(q)]
                    raised, lowered = z.T @ up, z.T @ down
                    new = np.concatenate([np.ravel(a) for a in (
                        losses, lowered - raised, curved, np.maximum(over, 0.0).sum(axis=0), (up * y).sum(axis=0), (down * y).sum(axis=0), raised, lowered)])
                    sums[j] = sums[j] + new if j in sums else new
        return sums

    def cut(numbers: np.ndarray, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return [part.reshape(s) for part, s in zip(np.split(numbers, ends[:-1]), shapes)]

    shapes = {j: [(t, q), (m, q), (q, m, m), (q,), (2, q), (2, m, q)] for j, (t, m, q) in ((j, p.shape) for j, p in trials.items())}
    totals = sum_over_partitions(table, work, sum(int(np.prod(s)) for some in shapes.values() for s in some), partitions)
    shared.unpersist()
    return {j: _Found(*cut(numbers, shapes[j])) for j, numbers in totals.items()}


def _loss(gap: np.ndarray, epsilon: float, width: np.ndarray) -> np.ndarray:
    """Rounded losses, added up over the rows; ``gap`` is used up."""
    over = np.abs(gap, out=gap)
    over -= epsilon
    np.maximum(over, 0.0, out=over)
    low = np.minimum(over, width)
    over -= 0.5 * low
    over *= low
    return over.sum(axis=0) / width
