"""Moments of polynomials in filled and scaled inputs, from raw rows with missing cells.

A filled cell is ``x + fill * missing`` with ``x`` nought where it is missing, so a power of it is ``x^n + fill^n * missing``: a sum of two
columns that do not depend on the fill value.  The inner products of the products of such columns, gathered once
per fold, therefore hold those of the polynomial terms for every fill value and every scale.  Preparation can so be fitted again for
each fold of a cross-validation, on the rows outside of it, without another scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from math import comb

import numpy as np

from emulon.models.gram import Moments
from emulon.operators.features import polynomial_terms

Monomial = tuple[tuple[int, int], ...]  # (input, power) in order; power 0 stands for the mark of a missing cell


@dataclass(frozen=True)
class Preparation:
    """Fill value, centre and scale of each input."""

    fill: np.ndarray
    centre: np.ndarray
    scale: np.ndarray


@dataclass(frozen=True)
class ColumnStats:
    """Rows, and per input the values that are there: their number, mean, sum of squared deviations, least and largest."""

    rows: float
    n: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    least: np.ndarray
    largest: np.ndarray

    def prepared(self, kinds: Sequence[str | None]) -> Preparation:
        """Missing cells take the mean; then each input is scaled by its own kind (``minmax``, ``standard`` or none)."""
        fill = self.mean
        centre, scale = np.zeros(len(fill)), np.ones(len(fill))
        for i, kind in enumerate(kinds):
            if kind == "minmax":
                centre[i], scale[i] = self.least[i], self.largest[i] - self.least[i]
            elif kind == "standard":
                centre[i], scale[i] = fill[i], np.sqrt(self.deviation[i] / self.rows)
        tiny = 10 * np.finfo(float).eps
        return Preparation(fill, centre, np.where(np.abs(scale) < tiny, 1.0, scale))


def joined(parts: Sequence[ColumnStats]) -> ColumnStats:
    """Statistics of all rows of the parts."""
    n = sum(p.n for p in parts)
    mean = sum(p.n * np.nan_to_num(p.mean) for p in parts) / np.maximum(n, 1)
    deviation = sum(np.nan_to_num(p.deviation) + p.n * (np.nan_to_num(p.mean) - mean) ** 2 for p in parts)
    return ColumnStats(sum(p.rows for p in parts), n, np.where(n > 0, mean, np.nan), deviation,
                       np.min([p.least for p in parts], axis=0), np.max([p.largest for p in parts], axis=0))


class GappedMap:
    """Products of powers and of marks of missing cells, for all terms of a polynomial, of ``(x - shift) / unit``."""

    gaps = True  # rows may have missing inputs

    def __init__(self, inputs: Sequence[str], degree: int, interaction_only: bool, shift: np.ndarray, unit: np.ndarray):
        self.n_inputs, self.shift, self.unit = len(inputs), shift, unit
        # powers and squares of all inputs are always there: they hold the statistics of the columns
        terms = polynomial_terms(range(len(inputs)), int(degree), interaction_only, False)
        terms += [t for i in range(len(inputs)) for t in ((i, i),) if t not in terms]
        found: dict[Monomial, int] = {}
        for term in terms:
            for monomial in self._monomials(term):
                found.setdefault(monomial, len(found))
        self.monomials = list(found)
        self.place = found
        self.width = len(found)

    @staticmethod
    def _powers(term: Sequence[int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for i in term:
            out[i] = out.get(i, 0) + 1
        return out

    def _monomials(self, term: Sequence[int]) -> list[Monomial]:
        """Products of lower powers too, as scaling adds a constant to each input; marks stand for whole powers."""
        powers = self._powers(term)
        choices = [[None, 0, *range(1, n + 1)] for n in powers.values()]
        out = []
        for picked in product(*choices):
            monomial = tuple((i, p) for i, p in zip(powers, picked) if p is not None)
            if monomial:
                out.append(monomial)
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        missing = np.isnan(x)
        t = np.where(missing, 0.0, (x - self.shift) / self.unit)
        columns = {(i, 0): missing[:, i].astype(float) for i in range(self.n_inputs)}
        for monomial in self.monomials:
            for i, p in monomial:
                if p and (i, p) not in columns:
                    columns[i, p] = t[:, i] ** p
        out = np.ones((len(x), self.width))
        for j, monomial in enumerate(self.monomials):
            for factor in monomial:
                out[:, j] *= columns[factor]
        return out

    def stats(self, m: Moments, least: np.ndarray, largest: np.ndarray) -> ColumnStats:
        """Column statistics out of the inner products; extremes are of the raw values."""
        at = np.array([self.place[((i, 1),)] for i in range(self.n_inputs)])
        marks = np.array([self.place[((i, 0),)] for i in range(self.n_inputs)])
        n = m.rows - m.feature_sums[marks]
        safe = np.maximum(n, 1)
        mean = m.feature_sums[at] / safe
        deviation = np.maximum(np.diag(m.gram)[at] - n * mean**2, 0.0) * self.unit**2
        return ColumnStats(m.rows, n, np.where(n > 0, self.shift + self.unit * mean, np.nan), deviation, least, largest)

    def moments_of(self, m: Moments, terms: Sequence[Sequence[int]], prep: Preparation) -> Moments:
        """The moments of these terms of filled and scaled inputs.

        An input is ``alpha * t + beta`` of its shifted value, or of its shifted fill value where it is missing."""
        alpha, beta = self.unit / prep.scale, (self.shift - prep.centre) / prep.scale
        fill = (np.where(np.isnan(prep.fill), self.shift, prep.fill) - self.shift) / self.unit
        change = np.zeros((len(terms) + 1, self.width + 1))  # from [1, monomials] to [1, terms]
        change[0, 0] = 1.0
        for row, term in enumerate(terms, start=1):
            combination: dict[Monomial, float] = {(): 1.0}
            for i, n in self._powers(term).items():
                parts: dict[tuple[tuple[int, int], ...], float] = {(): beta[i] ** n}
                marked = 0.0
                for j in range(1, n + 1):
                    factor = comb(n, j) * alpha[i] ** j * beta[i] ** (n - j)
                    parts[((i, j),)] = factor
                    marked += factor * fill[i] ** j
                parts[((i, 0),)] = marked
                combination = {a + b: u * v for a, u in combination.items() for b, v in parts.items()}
            for monomial, factor in combination.items():
                change[row, self.place[monomial] + 1 if monomial else 0] += factor
        features = self.width + 1
        inner = np.hstack([change @ m.inner[:, :features] @ change.T, change @ m.inner[:, features:]])
        return Moments(inner, m.output_squares, np.zeros(len(terms)), m.output_shift)
