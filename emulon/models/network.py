"""Feed-forward network fitted by data-parallel rounds.

With ``method="rounds"`` a round broadcasts the weights, every partition runs its mini-batches once in a random
order, and the results are averaged with the row counts as weights (local SGD).  With one
partition this is the sequential algorithm.

With ``method="gradient"`` an epoch is one step along the gradient over all rows: a sum over the partitions of the scan as they are, so the
result does not depend on them but for rounding.  ``method="lbfgs"`` takes that gradient for limited-memory BFGS steps; the lengths that a step
tries are judged in one further scan.

Several networks (folds of a cross-validation, candidates of a search) are trained in the same scans.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulon.functions.columns import model_columns, quoted, unit_hash
from emulon.models.base import Model
from emulon.models.sums import sum_over_partitions
from emulon.roles import Roles
from emulon.runtime import opened, plan_partitions, share

PARTITIONS = 8  # fewest workers of a round unless asked for otherwise
WORKER_ROWS = 500_000  # a worker of a round has so many rows on average, at most; results depend on the rows, not on the cluster
METHODS = ("rounds", "gradient", "lbfgs")
MEMORY = 10  # steps that limited-memory BFGS remembers
LENGTHS = (4.0, 2.0, 1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 1e-3)  # of a step of it, judged together
BLOCK_ROWS = 8192  # rows shuffled together
VALIDATION = -1  # fold number of explicit validation rows

# The optimiser's constants.
BETA1, BETA2, ADAM_EPSILON = 0.9, 0.999, 1e-8
LEAK = 0.01

ACTIVATIONS = {
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "relu": (lambda z: np.maximum(z, 0.0), lambda a: (a > 0).astype(float)),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500))), lambda a: a * (1 - a)),
    "leakyrelu": (lambda z: np.where(z > 0, z, LEAK * z), lambda a: np.where(a > 0, 1.0, LEAK)),
}


def _activation(name: str | None):
    return ACTIVATIONS.get((name or "").lower())


@dataclass(frozen=True)
class Layout:
    """Sizes and activations; the weights live in one flat vector."""

    sizes: tuple[int, ...]
    activation: str = "tanh"
    output_activation: str | None = None
    dropout: float = 0.0

    @property
    def length(self) -> int:
        return sum((a + 1) * b for a, b in zip(self.sizes, self.sizes[1:]))

    def layers(self, theta: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + (a + 1) * b]))
            at += (a + 1) * b
        return out

    def initial(self, seed: int) -> np.ndarray:
        """Uniform within one over the root of the layer's inputs."""
        rng = np.random.default_rng(seed)
        return np.concatenate([
            rng.uniform(-1, 1, (a + 1) * b) / math.sqrt(a) for a, b in zip(self.sizes, self.sizes[1:])
        ])

    def forward(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        act, out_act = _activation(self.activation), _activation(self.output_activation)
        layers = self.layers(theta)
        for i, (w, b) in enumerate(layers):
            x = x @ w + b
            if i < len(layers) - 1:
                x = act[0](x)
            elif out_act:
                x = out_act[0](x)
        return x

    def gradient(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray, rng) -> tuple[float, np.ndarray]:
        """Mean squared error over rows and outputs, and its gradient, for one mini-batch."""
        act, out_act = _activation(self.activation), _activation(self.output_activation)
        layers = self.layers(theta)
        values, masks = [x], []
        for i, (w, b) in enumerate(layers):
            z = values[-1] @ w + b
            if i < len(layers) - 1:
                a = act[0](z)
                mask = None
                if self.dropout > 0:
                    mask = (rng.random(a.shape) >= self.dropout) / (1 - self.dropout)
                masks.append((a, mask))
                values.append(a if mask is None else a * mask)
            else:
                values.append(out_act[0](z) if out_act else z)
        gap = values[-1] - y
        loss = float(np.mean(gap * gap))
        delta = 2.0 * gap / gap.size
        if out_act:
            delta = delta * out_act[1](values[-1])
        pieces = []
        for i in range(len(layers) - 1, -1, -1):
            pieces.append(np.concatenate([(values[i].T @ delta).ravel(), delta.sum(axis=0)]))
            if i:
                delta = delta @ layers[i][0].T
                a, mask = masks[i - 1]
                if mask is not None:
                    delta = delta * mask
                delta = delta * act[1](a)
        return loss, np.concatenate(pieces[::-1])


@dataclass
class NetworkJob:
    """One network in training: settings, left-out fold, and what the rounds change."""

    params: Mapping[str, object]
    fold: int | None = None
    layout: Layout = None
    state: np.ndarray = None  # weights, then Adam's two moments and step count
    rate: float = 0.0
    best: float = math.inf
    best_state: np.ndarray = None
    stale: int = 0
    plateau_best: float = math.inf
    plateau_stale: int = 0
    history: list[tuple[int, str, float]] = field(default_factory=list)
    done: bool = False
    steps: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # of weights and of gradients, for lbfgs
    last: tuple[np.ndarray, np.ndarray] | None = None  # weights and gradient before the latest step

    @property
    def theta(self) -> np.ndarray:
        return self.state[: self.layout.length]


def _epoch(layout: Layout, state: np.ndarray, rate: float, adam: bool, batch: int, x, y, rng) -> float:
    """One pass over a block in mini-batches; changes ``state`` and returns the summed loss."""
    size = layout.length
    theta = state[:size]
    order = rng.permutation(len(x))
    summed = 0.0
    for start in range(0, len(x), batch):
        rows = order[start : start + batch]
        loss, g = layout.gradient(theta, x[rows], y[rows], rng)
        if adam:
            m, v = state[size : 2 * size], state[2 * size : 3 * size]
            state[-1] += 1
            m += (1 - BETA1) * (g - m)
            v += (1 - BETA2) * (g * g - v)
            theta -= rate * (m / (1 - BETA1 ** state[-1])) / (np.sqrt(v / (1 - BETA2 ** state[-1])) + ADAM_EPSILON)
        else:
            theta -= rate * g
        summed += loss * len(rows)
    return summed


def train(
    table: DataFrame, roles: Roles, jobs: list[NetworkJob], fold: str | None = None, partitions: int | None = None
) -> list[NetworkJob]:
    """Train all jobs together.  Rows whose fold is a job's own are its validation rows; rows of
    fold -1 are validation rows of every job without a fold."""
    n_in, n_out = len(roles.inputs), len(roles.outputs)
    for job in jobs:
        _start(job, n_in, n_out)
    methods = {str(j.params["method"]) for j in jobs}
    if len(methods) > 1 or not methods <= set(METHODS):
        raise ValueError(f"the jobs of one training share one method out of {METHODS}; got {sorted(methods)}")
    whole = methods != {"rounds"}
    seed = int(jobs[0].params["seed"])
    rows = table.select(
        unit_hash(roles.key, seed, "batch").alias("u"),
        *model_columns("x", roles.inputs),
        *model_columns("y", roles.outputs),
        (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"),
    )
    if whole:
        rows = rows.drop("u")
        partitions = plan_partitions(rows)
    else:
        partitions = partitions or max(PARTITIONS, -(-table.count() // WORKER_ROWS))
        # Pinned partitions in a fixed order: the result depends on their number, on nothing else.
        rows = rows.repartition(partitions, "u").sortWithinPartitions("u").drop("u")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        validated = fold is not None
        epoch = 0
        while any(not j.done for j in jobs):
            active = [i for i, j in enumerate(jobs) if not j.done and epoch < int(j.params["epochs"])]
            for i, j in enumerate(jobs):
                j.done = j.done or i not in active
            if not active:
                break
            if whole:
                _whole_step(rows, jobs, active, n_in, epoch, partitions, seed)
            else:
                _round(rows, jobs, active, n_in, epoch, partitions, seed)
            losses = _validate(rows, jobs, active, n_in, n_out, partitions) if validated else {}
            for i in active:
                if not jobs[i].done:
                    _after_epoch(jobs[i], epoch, losses.get(i))
                elif i in losses:
                    jobs[i].best = min(jobs[i].best, losses[i])
            epoch += 1
    finally:
        rows.unpersist()
    return jobs


def _start(job: NetworkJob, n_in: int, n_out: int) -> None:
    p = job.params
    if _activation(p["activation"]) is None:
        raise ValueError(f"unknown activation {p['activation']!r}")
    hidden = (int(p["n_neurons"]),) * int(p["n_layers"])
    job.layout = Layout((n_in, *hidden, n_out), p["activation"], p["output_activation"], float(p["dropout_rate"]))
    theta = job.layout.initial(int(p["seed"]))
    job.rate = float(p["learning_rate"])
    job.state = np.concatenate([theta, np.zeros(2 * len(theta) + 1)]) if _is_adam(p) and p["method"] != "lbfgs" else theta
    if p["method"] == "lbfgs" and job.layout.dropout:
        raise ValueError("lbfgs compares losses along a line; it takes no dropout")


def _is_adam(params: Mapping[str, object]) -> bool:
    """Adam unless SGD is asked for; an unknown name falls back to Adam."""
    return str(params["optimizer"]).lower() != "sgd"


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and folds in blocks of ``BLOCK_ROWS``, whatever the size of Arrow batches."""
    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        while len(batch):
            part, batch = batch.iloc[: BLOCK_ROWS - n], batch.iloc[BLOCK_ROWS - n :]
            held.append(part)
            n += len(part)
            if n == BLOCK_ROWS:
                block = pd.concat(held)
                yield block.iloc[:, :-1].to_numpy(dtype=float), block["fold"].to_numpy()
                held, n = [], 0
    if held:
        block = pd.concat(held)
        yield block.iloc[:, :-1].to_numpy(dtype=float), block["fold"].to_numpy()


def _round(rows, jobs, active, n_in, epoch, partitions, seed) -> None:
    shared = share(rows.sparkSession, [
        (i, jobs[i].layout, jobs[i].state, jobs[i].rate, _is_adam(jobs[i].params), int(jobs[i].params["batch_size"]),
         jobs[i].fold)
        for i in active
    ])

    def work(batches: Iterator[pd.DataFrame], part: int) -> dict[int, np.ndarray]:
        networks = opened(shared)
        states = {i: state.copy() for i, _, state, *_ in networks}
        counts, losses = dict.fromkeys(states, 0), dict.fromkeys(states, 0.0)
        for number, (block, fold) in enumerate(_blocks(batches)):
            if np.isnan(block).any():
                raise ValueError("inputs and outputs of a fit must not be missing; impute or drop them first")
            for i, layout, _, rate, adam, size, left_out in networks:
                kept = block[(fold != VALIDATION) & ((left_out is None) | (fold != left_out))]
                if not len(kept):
                    continue
                rng = np.random.default_rng([seed, epoch, part, number])
                losses[i] += _epoch(layout, states[i], rate, adam, size, kept[:, :n_in], kept[:, n_in:], rng)
                counts[i] += len(kept)
        return {i: np.concatenate([s * counts[i], [losses[i], counts[i]]]) for i, s in states.items() if counts[i]}

    size = sum(len(jobs[i].state) + 2 for i in active)
    totals = sum_over_partitions(rows, work, size, partitions)
    shared.unpersist()
    for i in active:
        if i not in totals:
            raise ValueError("no rows to train on")
        jobs[i].state = totals[i][:-2] / totals[i][-1]
        jobs[i].history.append((epoch + 1, "train", float(totals[i][-2] / totals[i][-1])))


def _whole_step(rows, jobs, active, n_in, epoch, partitions, seed) -> None:
    """One step of every job along what the gradient over all its rows tells."""
    shared = share(rows.sparkSession, [(i, jobs[i].layout, jobs[i].theta, jobs[i].fold) for i in active])

    def work(batches: Iterator[pd.DataFrame], part: int) -> dict[int, np.ndarray]:
        networks = opened(shared)
        sums: dict[int, np.ndarray] = {}
        for number, (block, fold) in enumerate(_blocks(batches)):
            if np.isnan(block).any():
                raise ValueError("inputs and outputs of a fit must not be missing; impute or drop them first")
            for i, layout, theta, left_out in networks:
                kept = block[(fold != VALIDATION) & ((left_out is None) | (fold != left_out))]
                if len(kept):
                    rng = np.random.default_rng([seed, epoch, part, number])
                    loss, g = layout.gradient(theta, kept[:, :n_in], kept[:, n_in:], rng)
                    found = np.concatenate([g * len(kept), [loss * len(kept), len(kept)]])
                    sums[i] = sums[i] + found if i in sums else found
        return sums

    totals = sum_over_partitions(rows, work, sum(jobs[i].layout.length + 2 for i in active), partitions)
    shared.unpersist()
    directions: dict[int, np.ndarray] = {}
    for i in active:
        if i not in totals:
            raise ValueError("no rows to train on")
        job, g, loss = jobs[i], totals[i][:-2] / totals[i][-1], float(totals[i][-2] / totals[i][-1])
        job.history.append((epoch + 1, "train", loss))
        if job.params["method"] == "gradient":
            _move(job, g)
        else:
            directions[i] = _remembered_direction(job, g)
    if directions:
        _try_lengths(rows, jobs, directions, n_in, partitions)


def _move(job: NetworkJob, g: np.ndarray) -> None:
    """A step of the job's optimiser."""
    if not _is_adam(job.params):
        job.state = job.state - job.rate * g
        return
    size = job.layout.length
    theta, m, v, t = job.theta, job.state[size : 2 * size], job.state[2 * size : 3 * size], job.state[-1] + 1
    m, v = m + (1 - BETA1) * (g - m), v + (1 - BETA2) * (g * g - v)
    theta = theta - job.rate * (m / (1 - BETA1**t)) / (np.sqrt(v / (1 - BETA2**t)) + ADAM_EPSILON)
    job.state = np.concatenate([theta, m, v, [t]])


def _remembered_direction(job: NetworkJob, g: np.ndarray) -> np.ndarray:
    """Limited-memory BFGS: the gradient through the curvature of the latest steps."""
    if job.last is not None:
        s, y = job.theta - job.last[0], g - job.last[1]
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            job.steps = [*job.steps, (s, y)][-MEMORY:]
    job.last = (job.theta.copy(), g)
    d, kept = -g, []
    for s, y in reversed(job.steps):
        a = (s @ d) / (s @ y)
        d = d - a * y
        kept.append(a)
    if job.steps:
        s, y = job.steps[-1]
        d = d * ((s @ y) / (y @ y))
    else:
        d = d / max(1.0, float(np.sqrt(g @ g)))
    for (s, y), a in zip(job.steps, reversed(kept)):
        d = d + (a - (y @ d) / (s @ y)) * s
    if d @ g >= 0:  # no way down: forget
        job.steps = []
        d = -g / max(1.0, float(np.sqrt(g @ g)))
    return d


def _try_lengths(rows, jobs, directions, n_in, partitions) -> None:
    """The length of least loss; a job that no length brings down is done."""
    tried = (0.0, *LENGTHS)
    shared = share(rows.sparkSession, [(i, jobs[i].layout, jobs[i].theta, d, jobs[i].fold) for i, d in directions.items()])

    def work(batches: Iterator[pd.DataFrame], part: int) -> dict[int, np.ndarray]:
        networks = opened(shared)
        sums: dict[int, np.ndarray] = {}
        for block, fold in _blocks(batches):
            for i, layout, theta, d, left_out in networks:
                kept = block[(fold != VALIDATION) & ((left_out is None) | (fold != left_out))]
                if len(kept):
                    found = np.array([float(((layout.forward(theta + a * d, kept[:, :n_in]) - kept[:, n_in:]) ** 2).sum()) for a in tried])
                    sums[i] = sums[i] + found if i in sums else found
        return sums

    totals = sum_over_partitions(rows, work, len(tried) * len(directions), partitions)
    shared.unpersist()
    for i, d in directions.items():
        losses = np.where(np.isfinite(totals[i]), totals[i], np.inf)
        best = int(losses.argmin())
        if losses[best] < losses[0]:
            jobs[i].state = jobs[i].theta + tried[best] * d
        else:
            jobs[i].done = True


def _validate(rows, jobs, active, n_in, n_out, partitions) -> dict[int, float]:
    shared = share(
        rows.sparkSession, [(i, jobs[i].layout, jobs[i].theta, VALIDATION if jobs[i].fold is None else jobs[i].fold) for i in active])

    def work(batches: Iterator[pd.DataFrame], part: int) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        networks = opened(shared)
        for batch in batches:
            block, fold = batch.iloc[:, :-1].to_numpy(dtype=float), batch["fold"].to_numpy()
            for i, layout, theta, own in networks:
                kept = block[fold == own]
                if len(kept):
                    gap = layout.forward(theta, kept[:, :n_in]) - kept[:, n_in:]
                    sums[i] = sums.get(i, np.zeros(2)) + np.array([float((gap * gap).sum()), len(kept) * n_out])
        return sums

    totals = sum_over_partitions(rows, work, 2 * len(active), partitions)
    shared.unpersist()
    return {i: float(s[0] / s[1]) for i, s in totals.items()}


def _after_epoch(job: NetworkJob, epoch: int, loss: float | None) -> None:
    """Early stop first, then the learning-rate schedule."""
    p = job.params
    if loss is not None:
        job.history.append((epoch + 1, "val", loss))
        if loss < job.best - float(p["convergence_threshold"]):
            job.best, job.stale, job.best_state = loss, 0, job.state
        else:
            job.stale += 1
            if job.stale >= int(p["patience"]):
                job.done = True
                return
    if p["schedule"] == "plateau":
        watched = loss if loss is not None else job.history[-1][2]
        if watched < job.plateau_best * (1 - 1e-4):
            job.plateau_best, job.plateau_stale = watched, 0
        else:
            job.plateau_stale += 1
            if job.plateau_stale > int(p["plateau_patience"]):
                job.rate *= float(p["plateau_factor"])
                job.plateau_stale = 0
    elif (epoch + 1) % int(p["lr_step"]) == 0:
        job.rate *= float(p["lr_decrease_rate"])


class Network(Model):
    kind = "neural_network"
    defaults = {
        "n_layers": 2,
        "n_neurons": 10,
        "activation": "Tanh",
        "output_activation": None,
        "dropout_rate": 0.0,
        "method": "rounds",
        "optimizer": "Adam",
        "learning_rate": 0.001,
        "schedule": "step",
        "lr_step": 500,
        "lr_decrease_rate": 0.1,
        "plateau_patience": 10,
        "plateau_factor": 0.1,
        "epochs": 1000,
        "batch_size": 32,
        "patience": 50,
        "convergence_threshold": 1e-5,
        "restore_best": False,
        "partitions": None,
        "seed": 42,
    }

    def __init__(self, inputs, outputs, params, layout: Layout, theta: np.ndarray, history: Sequence[tuple] = ()):
        super().__init__(inputs, outputs, params)
        self.layout, self.theta, self.history = layout, theta, list(history)

    @classmethod
    def fit(
        cls, df: DataFrame, roles: Roles, params: Mapping[str, object], validation: DataFrame | None = None
    ) -> "Network":
        job = NetworkJob(params)
        fold = None
        if validation is not None:
            df = df.select(*map(quoted, roles.columns), F.lit(0).alias("_fold")).unionByName(
                validation.select(*map(quoted, roles.columns), F.lit(VALIDATION).alias("_fold")))
            fold = "_fold"
        train(df, roles, [job], fold, params["partitions"])
        return cls.from_job(roles, job)

    @classmethod
    def from_job(cls, roles: Roles, job: NetworkJob) -> "Network":
        theta = job.theta
        if job.params["restore_best"] and job.best_state is not None:
            theta = job.best_state[: job.layout.length]
        return cls(roles.inputs, roles.outputs, job.params, job.layout, theta, job.history)

    def losses(self, spark: SparkSession) -> DataFrame:
        """Loss per epoch as ``(epoch, split, loss)``."""
        return spark.createDataFrame(self.history, "epoch int, split string, loss double")

    def predict_block(self, x: np.ndarray) -> np.ndarray:
        return self.layout.forward(self.theta, x)

    def config(self):
        layout = self.layout
        return {**super().config(), "history": self.history,
                "layout": [layout.sizes, layout.activation, layout.output_activation, layout.dropout]}

    def arrays(self):
        return {"theta": self.theta}

    @classmethod
    def restore(cls, config, arrays):
        sizes, activation, output_activation, dropout = config["layout"]
        layout = Layout(tuple(sizes), activation, output_activation, dropout)
        history = [tuple(h) for h in config["history"]]
        return cls(config["inputs"], config["outputs"], config["params"], layout, arrays["theta"].ravel(), history)
