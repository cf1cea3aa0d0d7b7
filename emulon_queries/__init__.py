"""Registered queries: each operator on the given tables, with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under its own name."""

    def register(run):
        if run.__name__ in REGISTRY:
            raise ValueError(f"two queries named {run.__name__}")
        REGISTRY[run.__name__] = Query(run.__name__, covers, run, sql)
        return run

    return register


def load() -> dict[str, Query]:
    from emulon_queries import evaluation, models, preprocessing, sources  # noqa: F401

    return REGISTRY
