"""What all surrogates share: parameters, prediction columns, storage."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulon.functions.columns import model_columns, no_nan, replace_columns
from emulon.roles import Roles


class Model:
    """A fitted surrogate.  ``transform`` adds ``pred_<output>`` columns to batch or streaming rows."""

    kind: ClassVar[str]
    defaults: ClassVar[dict[str, object]] = {}

    def __init__(self, inputs: Sequence[str], outputs: Sequence[str], params: Mapping[str, object]):
        self.inputs, self.outputs, self.params = tuple(inputs), tuple(outputs), dict(params)

    @classmethod
    def complete(cls, params: Mapping[str, object]) -> dict[str, object]:
        unknown = set(params) - set(cls.defaults)
        if unknown:
            raise ValueError(f"unknown parameters of {cls.kind}: {sorted(unknown)}")
        return {**cls.defaults, **params}

    @classmethod
    def fit(cls, df: DataFrame, roles: Roles, params: Mapping[str, object]) -> "Model":
        raise NotImplementedError

    def predict_block(self, x: np.ndarray) -> np.ndarray:
        """Predictions of a block of rows, one column per entry of ``prediction_names``."""
        raise NotImplementedError

    def prediction_names(self) -> list[str]:
        return [f"pred_{c}" for c in self.outputs]

    def transform(self, df: DataFrame) -> DataFrame:
        """Only the input columns travel to Python; everything else stays in the JVM."""
        predict = self.predict_block

        @F.pandas_udf("array<double>")
        def block(x: pd.DataFrame) -> pd.Series:
            return pd.Series(list(predict(x.to_numpy(dtype=float))))

        names = self.prediction_names()
        with_block = df.withColumn("_block", block(F.struct(*model_columns("x", self.inputs))))
        new = {name: no_nan(f"get(_block, {i})") for i, name in enumerate(names)}
        return replace_columns(with_block, new).drop("_block")

    # ---- storage: arrays as one table, settings as a one-row table

    def arrays(self) -> dict[str, np.ndarray]:
        return {}

    def config(self) -> dict[str, object]:
        return {"kind": self.kind, "inputs": self.inputs, "outputs": self.outputs, "params": self.params}

    @classmethod
    def restore(cls, config: Mapping[str, object], arrays: Mapping[str, np.ndarray]) -> "Model":
        raise NotImplementedError

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [
            (name, list(a.shape), i, [float(v) for v in line])
            for name, a in self.arrays().items()
            for i, line in enumerate(np.asarray(a, dtype=float).reshape(a.shape[0] if a.ndim > 1 else 1, -1))
        ]
        schema = "name string, shape array<int>, line int, values array<double>"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/arrays")
        spark.createDataFrame([(json.dumps(self.config()),)], "config string").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/config")


def read_model(spark: SparkSession, path: str) -> tuple[dict, dict[str, np.ndarray]]:
    config = json.loads(spark.read.parquet(f"{path}/config").head()["config"])
    table = spark.read.parquet(f"{path}/arrays").orderBy("name", "line").toPandas()
    arrays = {
        name: np.array(part["values"].tolist()).reshape(part["shape"].iloc[0])
        for name, part in table.groupby("name")
    }
    return config, arrays
