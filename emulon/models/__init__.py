"""Regression surrogates: ``fit(kind, df, roles, **params)`` gives an object with ``transform``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emulon.models.base import Model, read_model
from emulon.models.gaussian_process import GaussianProcess
from emulon.models.kernel_ridge import KernelRidge
from emulon.models.network import Network
from emulon.models.response_surface import ResponseSurface
from emulon.models.support_vector import SupportVector
from emulon.roles import Roles

MODELS: dict[str, type[Model]] = {
    m.kind: m for m in (Network, GaussianProcess, KernelRidge, ResponseSurface, SupportVector)
}


def model_class(kind: str) -> type[Model]:
    if kind not in MODELS:
        raise ValueError(f"unknown model kind {kind!r}; one of {sorted(MODELS)}")
    return MODELS[kind]


def fit(kind: str, df: DataFrame, roles: Roles, **params) -> Model:
    """Fit one kind of surrogate on all rows of ``df``."""
    cls = model_class(kind)
    roles.check(df)
    return cls.fit(df, roles, cls.complete(params))


def load_model(spark: SparkSession, path: str) -> Model:
    config, arrays = read_model(spark, path)
    return model_class(config["kind"]).restore(config, arrays)
