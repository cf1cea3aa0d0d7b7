"""Sufficient statistics of linear models on mapped features.

One scan gives, for every feature map and every fold, the matrix of inner products of
``[1, features, outputs]``.  A fit, all fits of a cross-validation (total minus fold)
and a whole grid of ridge weights are then small solves on the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulon.functions.columns import model_columns
from emulon.models.sums import LEAST_FROM, sum_over_partitions
from emulon.runtime import opened, plan_partitions, share

BLOCK_NUMBERS = 120_000
FOLDS_AT_MOST = 32  # folds assumed where their number is not known; more only make the driver's share larger


class FeatureMap(Protocol):
    """Maps a block of rows to ``width`` features.  A map may have ``centre(means)``: numbers near the
    means of its features, which are taken off before products are formed."""

    width: int

    def __call__(self, x: np.ndarray) -> np.ndarray: ...


@dataclass
class Moments:
    """Inner products over some rows of features and outputs, all less their shifts.

    ``inner`` has rows ``[1, features]`` and columns ``[1, features, outputs]``; of the outputs among themselves only
    the squares are needed.  Shifts keep columns of large mean and small spread from losing their digits.
    """

    inner: np.ndarray
    output_squares: np.ndarray
    shift: np.ndarray
    output_shift: np.ndarray

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.inner + other.inner, self.output_squares + other.output_squares, self.shift, self.output_shift)

    def __sub__(self, other: "Moments") -> "Moments":
        return Moments(self.inner - other.inner, self.output_squares - other.output_squares, self.shift, self.output_shift)

    @property
    def features(self) -> int:
        return len(self.inner) - 1

    @property
    def rows(self) -> float:
        return self.inner[0, 0]

    @property
    def feature_sums(self) -> np.ndarray:
        return self.inner[0, 1 : self.features + 1]

    @property
    def output_sums(self) -> np.ndarray:
        return self.inner[0, self.features + 1 :]

    @property
    def shifted_gram(self) -> np.ndarray:
        return self.inner[1:, 1 : self.features + 1]

    @property
    def shifted_cross(self) -> np.ndarray:
        return self.inner[1:, self.features + 1 :]

    @property
    def gram(self) -> np.ndarray:
        s, t = self.shift, self.feature_sums
        return self.shifted_gram + np.outer(s, t) + np.outer(t, s) + self.rows * np.outer(s, s)

    @property
    def cross(self) -> np.ndarray:
        s, u = self.shift, self.output_shift
        return self.shifted_cross + np.outer(s, self.output_sums) + np.outer(self.feature_sums, u) + self.rows * np.outer(s, u)

    @property
    def squares(self) -> np.ndarray:
        """Sum of squares of each output."""
        u = self.output_shift
        return self.output_squares + 2 * u * self.output_sums + self.rows * u * u

    def squared_error(self, weights: np.ndarray, intercept: np.ndarray) -> np.ndarray:
        """Sum of squared errors per output of a linear model on these rows."""
        c = intercept + self.shift @ weights - self.output_shift  # the intercept between shifted columns
        error = (self.output_squares - 2 * (weights * self.shifted_cross).sum(axis=0) - 2 * c * self.output_sums
                 + (weights * (self.shifted_gram @ weights)).sum(axis=0) + 2 * c * (self.feature_sums @ weights) + self.rows * c * c)
        return np.maximum(error, 0.0)


LOOK = 1024  # first rows that tell where columns lie


def first_look(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and spreads of the first rows; 0 and 1 where they have none.  Results do not depend on them beyond rounding."""
    head = df.select(*model_columns("x", columns)).limit(LOOK).toPandas().to_numpy(dtype=float)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # columns without any value
        mean, spread = (np.nan_to_num(f(head, axis=0), posinf=0.0, neginf=0.0) if len(head) else np.zeros(len(columns)) for f in (np.nanmean, np.nanstd))
    return mean, np.where(spread > 1e-12 * np.abs(mean), spread, 1.0)


def _shifts(df: DataFrame, maps: Sequence[FeatureMap], inputs: Sequence[str], outputs: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per map the shifts of its features and of the outputs; nought for maps without a centre.

    A map that has looked at the rows already knows both."""
    none = [(np.zeros(m.width), np.zeros(len(outputs))) for m in maps]
    unseen = [m for m in maps if hasattr(m, "centre") and getattr(m, "output_shift", None) is None]
    means = first_look(df, [*inputs, *outputs])[0] if unseen else None
    found = []
    for m, zero in zip(maps, none):
        if m in unseen:
            found.append((m.centre(means[: len(inputs)]), means[len(inputs) :]))
        else:
            found.append((m.centre(m.shift), m.output_shift) if hasattr(m, "centre") else zero)
    return found


def moments(
    df: DataFrame,
    maps: Mapping[str, FeatureMap],
    inputs: Sequence[str],
    outputs: Sequence[str],
    fold: str | None = None,
    extremes: dict[int, tuple[np.ndarray, np.ndarray]] | None = None,
) -> dict[str, dict[int, Moments]]:
    """``{map name: {fold: Moments}}`` in one scan; without ``fold`` all rows are fold 0.

    ``extremes``, if given, receives the least and largest value of each input by fold.  Inputs may be missing only where
    all maps have ``gaps``."""
    names, n_in, n_out = list(maps), len(inputs), len(outputs)
    widths = [maps[m].width + 1 for m in names]
    table = df.select(
        *model_columns("x", inputs),
        *model_columns("y", outputs),
        (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"),
    )
    # The mapped features of a block take rows x width doubles: few enough for a core's cache.
    step = max(256, BLOCK_NUMBERS // (max(widths) + n_out))
    shifts = _shifts(df, [maps[m] for m in names], inputs, outputs)
    shared = share(df.sparkSession, ([maps[m] for m in names], shifts))
    gaps = all(getattr(m, "gaps", False) for m in maps.values())
    bounded = extremes is not None

    def work(batches: Iterator[pd.DataFrame], part: int) -> dict[int, np.ndarray]:
        found: dict[int, np.ndarray] = {}
        feature_maps, offsets = opened(shared)
        for batch in batches:
            block, number = batch.iloc[:, :-1].to_numpy(dtype=float), batch["fold"].to_numpy()
            if np.isnan(block[:, n_in:] if gaps else block).any():
                raise ValueError("inputs and outputs of a fit must not be missing; impute or drop them first")
            for f in np.unique(number):
                rows = block[number == f]
                if bounded:
                    x = rows[:, :n_in]
                    ends = np.concatenate([np.where(np.isnan(x), np.inf, x).min(axis=0), np.where(np.isnan(x), np.inf, -x).min(axis=0)])
                    slot = LEAST_FROM + int(f)
                    found[slot] = np.minimum(found[slot], ends) if slot in found else ends
                for start in range(0, len(rows), step):
                    x, y = rows[start : start + step, :n_in], rows[start : start + step, n_in:]
                    for i, m in enumerate(feature_maps):
                        z = np.hstack([np.ones((len(x), 1)), m(x) - offsets[i][0]])
                        off = y - offsets[i][1]
                        slot = int(f) * len(names) + i
                        product = np.concatenate([(z.T @ np.hstack([z, off])).ravel(), (off * off).sum(axis=0)])
                        found[slot] = found[slot] + product if slot in found else product
        return found

    size = sum(w * (w + n_out) + n_out for w in widths) * (FOLDS_AT_MOST if fold else 1)
    totals = sum_over_partitions(table, work, size, plan_partitions(table))
    if bounded:
        extremes.update({slot - LEAST_FROM: (totals[slot][:n_in], -totals[slot][n_in:]) for slot in totals if slot >= LEAST_FROM})
        totals = {slot: numbers for slot, numbers in totals.items() if slot < LEAST_FROM}
    out: dict[str, dict[int, Moments]] = {m: {} for m in names}
    for slot, numbers in sorted(totals.items()):
        i = slot % len(names)
        inner = numbers[: len(numbers) - n_out].reshape(widths[i], widths[i] + n_out)
        out[names[i]][slot // len(names)] = Moments(inner, numbers[len(numbers) - n_out :], *shifts[i])
    if not totals:
        raise ValueError("no rows to fit on")
    return out


def total(parts: Mapping[int, Moments]) -> Moments:
    """Moments over all folds, added in fold order."""
    ordered = [parts[f] for f in sorted(parts)]
    out = ordered[0]
    for m in ordered[1:]:
        out = out + m
    return out


# ----------------------------------------------------------------------------- solvers


def least_squares(m: Moments, fit_intercept: bool = True, positive: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercept; directions without variance get weight zero."""
    n = m.rows
    mean, output_mean = m.feature_sums / n, m.output_sums / n
    if fit_intercept:
        gram, cross = m.shifted_gram - n * np.outer(mean, mean), m.shifted_cross - n * np.outer(mean, output_mean)
        raw = np.diag(m.shifted_gram)
    else:
        gram, cross = m.gram, m.cross
        raw = np.diag(gram)
    # A constant feature is left with the rounding noise of its products and of its values.
    noise = np.maximum(1e-12 * raw, n * (4e-16 * m.shift) ** 2)
    alive = np.diag(gram) > np.maximum(noise, 1e-300)
    size = np.where(alive, np.sqrt(np.where(alive, np.diag(gram), 1.0)), 1.0)
    a = np.where(np.outer(alive, alive), gram / np.outer(size, size), 0.0)
    b = np.where(alive[:, None], cross / size[:, None], 0.0)
    scaled = _non_negative(a, b) if positive else _symmetric_solve(a, b)
    weights = scaled / size[:, None]
    intercept = np.zeros(weights.shape[1])
    if fit_intercept:
        intercept = output_mean + m.output_shift - (mean + m.shift) @ weights
    return weights, intercept


def _symmetric_solve(a: np.ndarray, b: np.ndarray, cutoff: float = 1e-13) -> np.ndarray:
    values, vectors = np.linalg.eigh(a)
    keep = values > cutoff * max(values.max(initial=0.0), 1e-300)
    inner = np.where(keep, 1.0 / np.where(keep, values, 1.0), 0.0)
    return vectors @ (inner[:, None] * (vectors.T @ b))


def _non_negative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares with weights of at least zero, by active sets (Lawson & Hanson 1974) on the inner products."""
    return np.stack([_active_set(a, b[:, k]) for k in range(b.shape[1])], axis=1) if b.shape[1] else np.zeros_like(b)


def _active_set(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w, free = np.zeros(len(a)), np.zeros(len(a), dtype=bool)
    usable = np.diag(a) > 0
    enough = 1e-12 * max(1.0, float(np.abs(b).max(initial=0.0)))
    last = np.inf
    for _ in range(30 * len(a) + 30):
        slope = np.where(free | ~usable, -np.inf, b - a @ w)
        j = int(slope.argmax()) if len(a) else 0
        if not len(a) or slope[j] <= enough:
            return w
        free[j] = True
        while free.any():
            best = np.zeros(len(a))
            best[free] = _symmetric_solve(a[np.ix_(free, free)], b[free, None])[:, 0]
            wrong = free & (best <= 0)
            if not wrong.any():
                break
            # as far towards the best point as no weight falls below nought
            share = np.min(w[wrong] / np.maximum(w[wrong] - best[wrong], 1e-300))
            w = w + share * (best - w)
            free &= ~(wrong & (w <= 1e-15 * np.abs(w).max(initial=0.0)))
            w[~free] = 0.0
        w = np.where(free, best, 0.0) if free.any() else np.zeros(len(a))
        value = float(0.5 * w @ a @ w - b @ w)
        if value >= last:  # no further gain within rounding
            return w
        last = value
    raise RuntimeError("the active set of a non-negative fit did not settle")


def ridge(m: Moments, alpha: float) -> np.ndarray:
    """Ridge weights without intercept."""
    a = m.gram + alpha * np.eye(m.features)
    return np.linalg.solve(a, m.cross) if alpha > 0 else _symmetric_solve(a, m.cross)
