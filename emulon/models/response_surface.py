"""Polynomial response surface: multi-output least squares on polynomial terms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from emulon.functions.columns import as_double, number, replace_columns
from emulon.models.base import Model
from emulon.models.gram import Moments, first_look, least_squares, moments, total
from emulon.operators.features import polynomial_terms, term_name
from emulon.roles import Roles

OFF_CENTRE = 30.0  # spreads between an input's shift and its mean beyond which a fit looks for a better shift
EXPRESSION_TERMS = 400  # beyond this many products the prediction runs in Arrow blocks


class PolynomialMap:
    """Polynomial terms of a block of rows, of the inputs less ``shift`` and divided by ``width``.

    Powers of a column of large mean and small spread are all but collinear; those of its shifted values are not."""

    def __init__(self, inputs: Sequence[str], degree: int, interaction_only: bool, include_bias: bool,
                 shift: np.ndarray | None = None, width: np.ndarray | None = None, output_shift: np.ndarray | None = None):
        self.inputs, self.output_shift = tuple(inputs), output_shift
        self.terms = polynomial_terms(self.inputs, int(degree), interaction_only, include_bias)
        position = {c: i for i, c in enumerate(inputs)}
        self.picks = [[position[c] for c in t] for t in self.terms]
        self.width = len(self.terms)
        self.shift = np.zeros(len(inputs)) if shift is None else shift
        self.unit = np.ones(len(inputs)) if width is None else width

    @property
    def is_raw(self) -> bool:
        return not self.shift.any() and (self.unit == 1).all()

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.is_raw:
            x = (x - self.shift) / self.unit
        out = np.ones((len(x), self.width))
        for j, pick in enumerate(self.picks):
            for i in pick:
                out[:, j] *= x[:, i]
        return out

    def centre(self, means: np.ndarray) -> np.ndarray:
        """The terms of the mean row."""
        return self(means[None, :])[0]

    def expanded(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the same terms of the raw inputs, and what is added to the constant."""
        out, constant = np.zeros_like(weights), np.zeros(weights.shape[1])
        place = {tuple(p): j for j, p in enumerate(self.picks)}
        for j, pick in enumerate(self.picks):
            factor = weights[j] / np.prod(self.unit[pick])
            for n in range(len(pick) + 1):
                for kept in combinations(range(len(pick)), n):
                    left = np.prod([-self.shift[i] for k, i in enumerate(pick) if k not in kept])
                    term = tuple(pick[k] for k in kept)
                    if term:
                        out[place[term]] += factor * left
                    else:
                        constant += factor * left
        return out, constant

    def off_centre(self, m: Moments) -> tuple[np.ndarray, np.ndarray] | None:
        """Better shifts and units, if the rows show that an input's mean is far outside its spread."""
        linear = [j for j, pick in enumerate(self.picks) if len(pick) == 1]
        mean = (m.feature_sums / m.rows)[linear]
        spread = np.sqrt(np.maximum(np.diag(m.shifted_gram)[linear] / m.rows - mean**2, 0.0))
        mean = mean + m.shift[linear]
        if not ((np.abs(mean) > OFF_CENTRE * spread) & (spread > 0)).any() and not ((spread > OFF_CENTRE) & (len(self.picks[-1]) > 1)).any():
            return None
        return self.shift + self.unit * mean, self.unit * np.where(spread > 0, spread, 1.0)


class ResponseSurface(Model):
    kind = "response_surface"
    defaults = {
        "degree": 2,
        "interaction_only": False,
        "include_bias": True,
        "fit_intercept": True,
        "positive": False,
    }

    def __init__(self, inputs, outputs, params, weights: np.ndarray, intercept: np.ndarray, local: PolynomialMap | None = None):
        """``weights`` and ``intercept`` belong to the terms of ``local``; the model shows those of the raw inputs."""
        super().__init__(inputs, outputs, params)
        self.map = self.feature_map(inputs, params)
        self.local = local or self.map
        self.local_weights, self.local_intercept = weights, intercept
        self.weights, self.intercept = weights, intercept
        if not self.local.is_raw:
            self.weights, constant = self.local.expanded(weights)
            if params["fit_intercept"]:
                self.intercept = intercept + constant
            else:
                self.weights[self.map.picks.index([])] += constant

    @staticmethod
    def feature_map(inputs: Sequence[str], params: Mapping[str, object], *look) -> PolynomialMap:
        return PolynomialMap(inputs, params["degree"], params["interaction_only"], params["include_bias"], *look)

    @staticmethod
    def may_shift(params: Mapping[str, object]) -> bool:
        """Shifted terms span the same surfaces where there is a constant; signs of weights belong to the raw terms."""
        return bool(params["include_bias"] or params["fit_intercept"]) and not params["positive"]

    @staticmethod
    def map_key(params: Mapping[str, object]) -> tuple:
        return params["degree"], params["interaction_only"], params["include_bias"], ResponseSurface.may_shift(params)

    @staticmethod
    def prepare_maps(df: DataFrame, roles: Roles, candidates: Sequence[Mapping[str, object]]) -> list[PolynomialMap]:
        look, n = (), len(roles.inputs)
        if any(map(ResponseSurface.may_shift, candidates)):
            mean, spread = first_look(df, [*roles.inputs, *roles.outputs])
            look = mean[:n], spread[:n], mean[n:]
        return [ResponseSurface.feature_map(roles.inputs, p, *(look if ResponseSurface.may_shift(p) else ())) for p in candidates]

    @staticmethod
    def solve(m: Moments, params: Mapping[str, object]) -> tuple[np.ndarray, np.ndarray]:
        return least_squares(m, params["fit_intercept"], params["positive"])

    @classmethod
    def from_moments(cls, roles, params, m: Moments, feature_map) -> "ResponseSurface":
        return cls(roles.inputs, roles.outputs, params, *cls.solve(m, params), feature_map)

    @classmethod
    def fit(cls, df: DataFrame, roles: Roles, params: Mapping[str, object]) -> "ResponseSurface":
        feature_map = cls.prepare_maps(df, roles, [params])[0]
        found = total(moments(df, {"m": feature_map}, roles.inputs, roles.outputs)["m"])
        better = feature_map.off_centre(found) if cls.may_shift(params) else None
        if better is not None:  # the first rows were not like the others
            feature_map = cls.feature_map(roles.inputs, params, *better, feature_map.output_shift)
            found = total(moments(df, {"m": feature_map}, roles.inputs, roles.outputs)["m"])
        return cls.from_moments(roles, params, found, feature_map)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """Table ``(output, term, coefficient)`` with the intercept as its own term."""
        rows = [
            (out, term_name(t) if t else "bias", float(self.weights[i, j]))
            for j, out in enumerate(self.outputs)
            for i, t in enumerate(self.map.terms)
        ]
        rows += [(out, "intercept", float(self.intercept[j])) for j, out in enumerate(self.outputs)]
        return spark.createDataFrame(rows, "output string, term string, coefficient double")

    def predict_block(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x).any(axis=1, keepdims=True), np.nan, self.local(x) @ self.local_weights + self.local_intercept)

    def transform(self, df: DataFrame) -> DataFrame:
        """A plain column expression, so prediction stays in generated JVM code."""
        if len(self.map.terms) * len(self.outputs) > EXPRESSION_TERMS:
            return super().transform(df)
        at = self.local
        shifted = {c: as_double(c) if at.is_raw else f"(({as_double(c)} - {number(at.shift[i])}) / {number(at.unit[i])})" for i, c in enumerate(self.inputs)}
        new = {}
        for j, out in enumerate(self.outputs):
            # a term of weight nought stays, so that a missing input gives a missing prediction as in Arrow blocks
            parts = [number(self.local_intercept[j])] + [
                " * ".join([number(self.local_weights[i, j]), *(shifted[c] for c in t)]) for i, t in enumerate(at.terms)
            ]
            new[f"pred_{out}"] = "(" + " + ".join(parts) + ")"
        return replace_columns(df, new)

    def arrays(self):
        return {"weights": self.local_weights, "intercept": self.local_intercept, "shift": self.local.shift, "unit": self.local.unit}

    @classmethod
    def restore(cls, config, arrays):
        inputs, params = config["inputs"], config["params"]
        shift, unit = (arrays[n].ravel() if n in arrays else None for n in ("shift", "unit"))  # models stored earlier have none
        return cls(inputs, config["outputs"], params, arrays["weights"], arrays["intercept"], cls.feature_map(inputs, params, shift, unit))
