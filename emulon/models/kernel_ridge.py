"""Kernel ridge regression with a radial kernel, on landmark features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame

from emulon.models.base import Model
from emulon.models.gram import Moments, moments, ridge, total
from emulon.models.landmarks import Kernel, LandmarkMap, pick_landmarks
from emulon.roles import Roles


class KernelRidge(Model):
    kind = "rbf"
    defaults = {"alpha": 1.0, "gamma": 1.0, "landmarks": 256, "seed": 42}

    def __init__(self, inputs, outputs, params, feature_map: LandmarkMap, weights: np.ndarray):
        super().__init__(inputs, outputs, params)
        self.map, self.weights = feature_map, weights

    @staticmethod
    def kernel(inputs: Sequence[str], params: Mapping[str, object]) -> Kernel:
        gamma = params["gamma"]
        return Kernel("rbf", gamma=1.0 / len(inputs) if gamma in (None, "None") else float(gamma))

    @staticmethod
    def map_key(params: Mapping[str, object]) -> tuple:
        return params["gamma"], params["landmarks"], params["seed"]

    @classmethod
    def prepare_maps(cls, df: DataFrame, roles: Roles, candidates: Sequence[Mapping[str, object]]) -> list[LandmarkMap]:
        """One map per candidate; candidates with equal landmark settings share the pick."""
        picks: dict[tuple, np.ndarray] = {}
        maps = []
        for p in candidates:
            wanted = (int(p["landmarks"]), int(p["seed"]))
            if wanted not in picks:
                picks[wanted] = pick_landmarks(df, roles.key, roles.inputs, *wanted)
            maps.append(LandmarkMap(cls.kernel(roles.inputs, p), picks[wanted]))
        return maps

    @staticmethod
    def solve(m: Moments, params: Mapping[str, object]) -> tuple[np.ndarray, np.ndarray]:
        weights = ridge(m, float(params["alpha"]))
        return weights, np.zeros(weights.shape[1])

    @classmethod
    def from_moments(cls, roles, params, m: Moments, feature_map: LandmarkMap) -> "KernelRidge":
        return cls(roles.inputs, roles.outputs, params, feature_map, cls.solve(m, params)[0])

    @classmethod
    def fit(cls, df: DataFrame, roles: Roles, params: Mapping[str, object]) -> "KernelRidge":
        feature_map = cls.prepare_maps(df, roles, [params])[0]
        found = moments(df, {"m": feature_map}, roles.inputs, roles.outputs)["m"]
        return cls.from_moments(roles, params, total(found), feature_map)

    def predict_block(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.weights

    def arrays(self):
        return {"landmarks": self.map.landmarks, "root": self.map.root, "weights": self.weights}

    @classmethod
    def restore(cls, config, arrays):
        feature_map = LandmarkMap(cls.kernel(config["inputs"], config["params"]), arrays["landmarks"], arrays["root"])
        return cls(config["inputs"], config["outputs"], config["params"], feature_map, arrays["weights"])
