"""Gaussian-process regression on landmark features (subset of regressors, with the
deterministic training conditional variance of Quinonero-Candela & Rasmussen 2005).

Lists among the kernel parameters make a grid: the statistics of all combinations come
from one scan, and the one with the highest log marginal likelihood is kept.

With ``refine``, so many further scans climb from there.  Each gathers the statistics around the point reached, at small steps of the logarithm
of every continuous parameter; their likelihoods give the slope and the curvature, and so the next point (Newton's method).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame

from emulon.models.gram import Moments, moments, total
from emulon.models.kernel_ridge import KernelRidge
from emulon.models.landmarks import Kernel, LandmarkMap, pick_landmarks
from emulon.roles import Roles

SEARCHED = ("length_scale", "constant", "nu", "periodicity")
CLIMBED = {"RBF": ("length_scale", "constant"), "Matern": ("length_scale",), "ExpSineSquared": ("length_scale", "periodicity")}
FIRST_STEP, LEAST_STEP, LONGEST = 0.2, 1e-3, 1.0  # of a logarithm: between the points of a scan, and from one scan to the next


class GaussianProcess(KernelRidge):
    kind = "gaussian_process"
    defaults = {
        "kernel": "RBF",
        "alpha": 1e-3,
        "length_scale": 1.0,
        "constant": 1.0,
        "nu": 1.5,
        "periodicity": 1.0,
        "landmarks": 256,
        "seed": 42,
        "refine": 0,
    }

    def __init__(self, inputs, outputs, params, feature_map, weights, factor: np.ndarray):
        super().__init__(inputs, outputs, params, feature_map, weights)
        self.factor = factor  # inverse Cholesky factor of gram + alpha

    @staticmethod
    def kernel(inputs: Sequence[str], params: Mapping[str, object]) -> Kernel:
        if params["kernel"] not in ("RBF", "Matern", "ExpSineSquared"):
            raise ValueError(f"unknown kernel {params['kernel']!r}")
        return Kernel(
            params["kernel"], length=float(params["length_scale"]), constant=float(params["constant"]),
            nu=float(params["nu"]), period=float(params["periodicity"]),
        )

    @staticmethod
    def map_key(params: Mapping[str, object]) -> tuple:
        return tuple(v for name, v in sorted(params.items()) if name != "alpha")

    @classmethod
    def from_moments(cls, roles, params, m: Moments, feature_map: LandmarkMap) -> "GaussianProcess":
        a = m.gram + float(params["alpha"]) * np.eye(m.features)
        factor = np.linalg.inv(np.linalg.cholesky(a))
        return cls(roles.inputs, roles.outputs, params, feature_map, factor.T @ (factor @ m.cross), factor)

    @classmethod
    def grid(cls, params: Mapping[str, object]) -> list[dict[str, object]]:
        lists = [list(v) if isinstance(v := params[s], (list, tuple)) else [v] for s in SEARCHED]
        return [{**params, **dict(zip(SEARCHED, values))} for values in product(*lists)]

    @classmethod
    def fit(cls, df: DataFrame, roles: Roles, params: Mapping[str, object]) -> "GaussianProcess":
        candidates = cls.grid(params)
        z = pick_landmarks(df, roles.key, roles.inputs, int(params["landmarks"]), int(params["seed"]))
        tried = cls._judge(df, roles, candidates, z)
        best = max(tried, key=lambda t: t.likelihood)
        if int(params["refine"]):
            best = cls._climb(df, roles, best, z, int(params["refine"]))
        model = cls.from_moments(roles, best.params, best.sums, best.map)
        model.log_likelihood = best.likelihood
        return model

    @classmethod
    def _judge(cls, df: DataFrame, roles: Roles, candidates: Sequence[Mapping[str, object]], z: np.ndarray) -> list["_Tried"]:
        """Statistics and likelihoods of all candidates, from one scan."""
        maps = {str(i): LandmarkMap(cls.kernel(roles.inputs, p), z) for i, p in enumerate(candidates)}
        found = moments(df, maps, roles.inputs, roles.outputs)
        out = []
        for i, p in enumerate(candidates):
            sums = total(found[str(i)])
            out.append(_Tried(p, maps[str(i)], sums, log_marginal_likelihood(sums, float(p["alpha"]))))
        return out

    @classmethod
    def _climb(cls, df: DataFrame, roles: Roles, best: "_Tried", z: np.ndarray, scans: int) -> "_Tried":
        """The highest point that Newton's method finds in so many scans."""
        names = [n for n in CLIMBED[str(best.params["kernel"])] if float(best.params[n]) > 0]
        d = len(names)
        at, step, longest = np.log([float(best.params[n]) for n in names]), FIRST_STEP, LONGEST
        units = np.eye(d)
        offsets = [np.zeros(d), *(s * u for u in units for s in (1.0, -1.0)), *(units[i] + units[j] for i in range(d) for j in range(i))]
        for _ in range(scans if d else 0):
            points = [at + step * o for o in offsets]
            tried = cls._judge(df, roles, [{**best.params, **dict(zip(names, map(float, np.exp(p))))} for p in points], z)
            values, before = [t.likelihood for t in tried], best.likelihood
            if max(values) > best.likelihood:
                best = tried[int(np.argmax(values))]
            up, down, middle = np.array(values[1 : 2 * d : 2]), np.array(values[2 : 2 * d + 1 : 2]), values[0]
            slope, curve = (up - down) / (2 * step), np.diag((up + down - 2 * middle) / step**2)
            for k, (i, j) in enumerate([(i, j) for i in range(d) for j in range(i)]):
                mixed = (values[2 * d + 1 + k] - up[i] - up[j] + middle) / step**2
                curve[i, j] = curve[j, i] = mixed
            bends, axes = np.linalg.eigh(curve)
            along = axes.T @ slope
            # up along every axis: to the top where the surface bends down, else a bounded step
            move = axes @ np.where(bends < 0, along / np.maximum(-bends, 1e-12), np.sign(along) * longest)
            length = float(np.abs(move).max())
            if middle < before - 1e-9 * abs(before):  # the point aimed at is lower than the best so far: back to that, with shorter moves
                longest = longest / 3
                at, step = np.log([float(best.params[n]) for n in names]), max(min(step, longest / 2), LEAST_STEP)
            elif length < 1e-6:
                break
            else:
                at, step = at + move * min(1.0, longest / length), min(max(length / 2, LEAST_STEP), FIRST_STEP)
        return best

    def predict_block(self, x: np.ndarray) -> np.ndarray:
        phi = self.map(x)
        variance = (
            self.map.kernel.diagonal(x)
            - (phi**2).sum(axis=1)
            + float(self.params["alpha"]) * ((phi @ self.factor.T) ** 2).sum(axis=1)
        )
        return np.hstack([phi @ self.weights, np.sqrt(np.maximum(variance, 0.0))[:, None]])

    def prediction_names(self) -> list[str]:
        return [*super().prediction_names(), "pred_std"]

    def arrays(self):
        return {**super().arrays(), "factor": self.factor}

    @classmethod
    def restore(cls, config, arrays):
        feature_map = LandmarkMap(cls.kernel(config["inputs"], config["params"]), arrays["landmarks"], arrays["root"])
        return cls(config["inputs"], config["outputs"], config["params"], feature_map, arrays["weights"], arrays["factor"])


@dataclass
class _Tried:
    params: Mapping[str, object]
    map: LandmarkMap
    sums: Moments
    likelihood: float


def log_marginal_likelihood(m: Moments, alpha: float) -> float:
    """Summed over the outputs, from the sufficient statistics alone."""
    a = m.gram + alpha * np.eye(m.features)
    half = np.linalg.cholesky(a)
    inner = np.linalg.solve(half, m.cross)
    fit = (m.squares - (inner**2).sum(axis=0)) / alpha
    size = 2 * np.log(np.diag(half)).sum() + (m.rows - m.features) * np.log(alpha) + m.rows * np.log(2 * np.pi)
    return float(-0.5 * (fit + size).sum())
