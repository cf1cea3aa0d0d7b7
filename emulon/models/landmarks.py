"""Kernel features from landmarks (Nystrom method, Williams & Seeger 2001).

The landmarks are the m training rows with the lowest key hash.  With all rows as
landmarks the features reproduce the kernel exactly; otherwise kernel models fitted on
them are approximations whose cost is m squared, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulon.functions.columns import model_columns, unit_hash

CUTOFF = 1e-12  # eigenvalues below this share of the largest one are left out


def pick_landmarks(df: DataFrame, key: str, inputs: Sequence[str], m: int, seed: int, n: int | None = None) -> np.ndarray:
    """Inputs of the m rows with the lowest hash: a filtered scan, then a short sort."""
    n = df.count() if n is None else n
    u = unit_hash(key, seed, "landmark")
    rows = df.select(u.alias("u"), *model_columns("x", inputs))
    if n > 4 * m + 64:
        rows = rows.where(F.col("u") < (4 * m + 64) / n)
    picked = rows.orderBy("u").limit(m).toPandas()
    z = picked.drop(columns="u").to_numpy(dtype=float)
    if np.isnan(z).any():
        raise ValueError("inputs of a fit must not be missing; impute or drop them first")
    return z


def _squared_by_product(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Squared distances as one matrix product: fast, and good enough under an exponential."""
    middle = z.mean(axis=0)
    x, z = x - middle, z - middle
    out = (x * x).sum(axis=1)[:, None] + (z * z).sum(axis=1)[None, :]
    products = x @ z.T
    products *= 2.0
    out -= products
    return np.maximum(out, 0.0, out=out)


def _squared(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Squared distances by differences: zero where it should be, for kernels of the distance itself."""
    out = np.zeros((len(x), len(z)))
    for d in range(x.shape[1]):
        out += (x[:, d][:, None] - z[:, d][None, :]) ** 2
    return out


@dataclass(frozen=True)
class Kernel:
    """A covariance function; ``name`` with its own parameters."""

    name: str
    gamma: float = 1.0
    length: float = 1.0
    constant: float = 0.0
    nu: float = 1.5
    period: float = 1.0
    degree: int = 3

    def __call__(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        if self.name == "linear":
            return x @ z.T
        if self.name == "poly":
            return (self.gamma * (x @ z.T)) ** self.degree
        if self.name == "sigmoid":
            return np.tanh(self.gamma * (x @ z.T))
        if self.name == "rbf":
            out = _squared_by_product(x, z)
            out *= -self.gamma
            return np.exp(out, out=out)
        if self.name == "RBF":
            out = _squared_by_product(x, z)
            out /= -(2 * self.length**2)
            np.exp(out, out=out)
            out += self.constant
            return out
        d = np.sqrt(_squared(x, z))
        if self.name == "ExpSineSquared":
            return np.exp(-2 * np.sin(np.pi * d / self.period) ** 2 / self.length**2)
        if self.name == "Matern":
            r = d / self.length
            if self.nu == 0.5:
                return np.exp(-r)
            if self.nu == 1.5:
                return (1 + np.sqrt(3) * r) * np.exp(-np.sqrt(3) * r)
            if self.nu == 2.5:
                return (1 + np.sqrt(5) * r + 5 * r**2 / 3) * np.exp(-np.sqrt(5) * r)
            if np.isinf(self.nu):
                return np.exp(-(r**2) / 2)
            raise ValueError("nu is 0.5, 1.5, 2.5 or inf")
        raise ValueError(f"unknown kernel {self.name!r}")

    def diagonal(self, x: np.ndarray) -> np.ndarray:
        if self.name in ("linear", "poly", "sigmoid"):
            return np.array([self(row[None, :], row[None, :])[0, 0] for row in x])
        return np.full(len(x), 1.0 + (self.constant if self.name == "RBF" else 0.0))


class LandmarkMap:
    """Features whose inner products are the kernel restricted to the landmarks."""

    def __init__(self, kernel: Kernel, landmarks: np.ndarray, root: np.ndarray | None = None):
        self.kernel, self.landmarks = kernel, landmarks
        if root is None:
            values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
            keep = values > CUTOFF * values.max()
            root = vectors[:, keep] / np.sqrt(values[keep])
        self.root = root
        self.width = root.shape[1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x, self.landmarks) @ self.root
