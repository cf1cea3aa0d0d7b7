"""Column roles and the settings of a training run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Roles:
    """Which column is the row key, which are inputs and which are outputs.

    ``discrete`` names inputs that are imputed and filtered like the others but
    never scaled.
    """

    key: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    discrete: tuple[str, ...] = ()

    def __post_init__(self):
        for name in ("inputs", "outputs", "discrete"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        unknown = set(self.discrete) - set(self.inputs)
        if unknown:
            raise ValueError(f"discrete columns are not inputs: {sorted(unknown)}")
        names = [self.key, *self.inputs, *self.outputs]
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise ValueError(f"columns with more than one role: {twice}")

    @property
    def continuous(self) -> tuple[str, ...]:
        return tuple(c for c in self.inputs if c not in self.discrete)

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.key, *self.inputs, *self.outputs)

    def check(self, df: DataFrame, outputs: bool = True) -> None:
        wanted = self.columns if outputs else (self.key, *self.inputs)
        missing = [c for c in wanted if c not in df.columns]
        if missing:
            raise ValueError(f"columns not in the table: {missing}")


# Option names and defaults of a training run.
IMPUTERS = ("simple", "missing indicator", "knn")
SCALERS = ("minmax", "standard", "robust")
FILTERS = ("isolation forest", "lof", "iqr")
METRICS = ("mse", "mae", "mape")
KINDS = ("neural_network", "gaussian_process", "rbf", "response_surface", "svr")


@dataclass(frozen=True)
class PipelineSpec:
    """Settings of one training run; checked when it is made."""

    kind: str = "response_surface"
    params: Mapping[str, object] = field(default_factory=dict)
    test: float = 0.15
    val: float | None = 0.0
    seed: int = 42
    imputer: str = "simple"
    scaler: str = "minmax"
    output_scalers: Mapping[str, str] | None = None
    filter: str = "isolation forest"
    metric: str = "mse"
    validation: str = "cross"
    folds: int = 5

    def __post_init__(self):
        object.__setattr__(self, "filter", self.filter.replace("_", " "))
        object.__setattr__(self, "val", self.val or 0.0)
        for value, allowed, what in (
            (self.imputer, IMPUTERS, "imputer"),
            (self.scaler, SCALERS, "scaler"),
            (self.filter, FILTERS, "filter"),
            (self.metric, METRICS, "metric"),
            (self.kind, KINDS, "model kind"),
            (self.validation, ("cross", "single"), "validation mode"),
        ):
            if value not in allowed:
                raise ValueError(f"unknown {what} {value!r}; one of {allowed}")
        check_shares(self.test, self.val)


def check_shares(test: float, val: float | None) -> tuple[float, float]:
    """Shares of the test and validation rows, each in [0, 1) with a sum below 1."""
    val = val or 0.0
    if not 0 <= test < 1 or not 0 <= val < 1:
        raise ValueError("test and val must be at least 0 and below 1")
    if test + val >= 1:
        raise ValueError("test and val must sum to less than 1")
    return test, val
