"""Scoring of new rows by column name: scale, predict, back to original units.

The same projection serves one row, a table and a stream.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulon.functions.columns import quoted
from emulon.models.base import Model
from emulon.operators.impute import MeanImputer, NeighbourImputer
from emulon.operators.scale import Scalers
from emulon.sources.store import read_donors, read_imputer, read_scalers, write_donors, write_scalers


@dataclass(frozen=True)
class Scorer:
    model: Model
    input_scalers: Scalers
    output_scalers: Scalers
    imputer: MeanImputer | NeighbourImputer | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows as they came, with ``pred_<output>`` columns in original units.

        With an imputer, missing inputs count as their fill values; without one, they give a missing prediction.  Fill values from
        neighbours are looked up in the training rows, which a stream cannot do.
        """
        if df.isStreaming and isinstance(self.imputer, NeighbourImputer):
            raise ValueError("a stream cannot take fill values from neighbours; score its batches, or fit with the mean")
        inputs = self.model.inputs
        missing = [c for c in inputs if c not in df.columns]
        if missing:
            raise ValueError(f"input columns not in the table: {missing}")
        kept = df.withColumn("_given", F.struct(*[F.col(quoted(c)).alias(c) for c in inputs]))
        filled = self.imputer.transform(kept) if self.imputer is not None else kept
        predicted = self.output_scalers.inverse(
            self.model.transform(self.input_scalers.transform(filled)), prefixes=("pred_",))
        return predicted.select(
            *[F.col("_given").getField(c).alias(c) if c in inputs else F.col(quoted(c)) for c in predicted.columns if c != "_given"])

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.save(spark, f"{path}/model")
        neighbours = isinstance(self.imputer, NeighbourImputer)
        means = MeanImputer(self.imputer.means) if neighbours else self.imputer
        write_scalers(spark, f"{path}/scalers", {"input": self.input_scalers, "output": self.output_scalers}, means)
        if neighbours:
            write_donors(self.imputer, f"{path}/donors")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Scorer":
        from emulon.models import load_model

        scalers = read_scalers(spark, f"{path}/scalers")
        imputer = read_imputer(spark, f"{path}/scalers")
        filled = read_donors(spark, f"{path}/donors", imputer.means) or (imputer if imputer.means else None)
        return cls(load_model(spark, f"{path}/model"), scalers["input"], scalers["output"], filled)


def score(df: DataFrame, scorer: Scorer) -> DataFrame:
    return scorer.transform(df)


def score_row(spark: SparkSession, scorer: Scorer, values: Mapping[str, float]) -> dict[str, float]:
    """Prediction for one set of named inputs, as ``{output: value}``."""
    wanted = set(scorer.model.inputs)
    if set(values) != wanted:
        raise ValueError(f"inputs must be exactly {sorted(wanted)}; got {sorted(values)}")
    ordered = [(float(values[c]),) for c in scorer.model.inputs]
    schema = ", ".join(f"{quoted(c)} double" for c in scorer.model.inputs)
    row = scorer.transform(spark.createDataFrame([tuple(v for (v,) in ordered)], schema)).head()
    return {c: row[f"pred_{c}"] for c in scorer.model.outputs}
