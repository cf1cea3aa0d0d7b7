"""A configured training run: split, impute, filter, scale, fit, predict, evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from emulon.functions.columns import nan_to_null, quoted
from emulon.models import Model
from emulon.models.network import Network
from emulon.operators.evaluate import mean_errors, metrics_both_scales, primary_metric
from emulon.operators.impute import MeanImputer, fit_imputer
from emulon.operators.outliers import drop_outliers
from emulon.operators.scale import TCP_MINMAX, Scalers, fit_scalers, scaler_types
from emulon.operators.split import TEST, TRAIN, VAL, part, split
from emulon.plans.scoring import Scorer
from emulon.plans.search import cross_validate, hold_out
from emulon.roles import PipelineSpec, Roles
from emulon.runtime import cut_lineage


@dataclass
class Prepared:
    """Scaled rows of all splits in one table, and what was fitted on the training rows."""

    table: DataFrame
    roles: Roles
    imputer: object
    input_scalers: Scalers
    output_scalers: Scalers

    def part(self, name: str) -> DataFrame:
        return part(self.table, name)

    def transform(self, df: DataFrame) -> DataFrame:
        """A new table through what was fitted on the training rows: filled, then scaled.  Outputs may be absent."""
        filled = self.imputer.transform(nan_to_null(df))
        present = [c for c in self.roles.outputs if c in df.columns]
        return self.output_scalers.only(present).transform(self.input_scalers.transform(filled))


def prepare(df: DataFrame, roles: Roles, spec: PipelineSpec = PipelineSpec()) -> Prepared:
    """Everything is fitted on the training rows; only they are filtered; all splits are scaled."""
    roles.check(df)
    # Keys are hashed once: the scans that follow read the written columns of the split they need.
    rows = split(nan_to_null(df.select(*map(quoted, roles.columns))), roles.key, spec.test, spec.val, spec.seed)
    rows = cut_lineage(rows, partition_by="split")
    imputer = fit_imputer(part(rows, TRAIN), roles.inputs, spec.imputer, key=roles.key)
    filled = imputer.transform(rows)
    if spec.imputer == "knn":
        filled = cut_lineage(filled)
    kept = drop_outliers(part(filled, TRAIN), roles.key, [*roles.inputs, *roles.outputs], spec.filter, spec.seed)
    if spec.filter != "iqr":
        kept = cut_lineage(kept)  # forest scores and neighbour factors are not worth computing twice
    types = {**dict.fromkeys(roles.continuous, spec.scaler),
             **scaler_types(roles.outputs, spec.scaler, [TCP_MINMAX]), **(spec.output_scalers or {})}
    fitted = fit_scalers(kept, types)  # inputs and outputs in the same scan
    inputs, outputs = fitted.only(roles.continuous), fitted.only(roles.outputs)
    whole = kept.unionByName(filled.where(filled["split"] != TRAIN))
    return Prepared(outputs.transform(inputs.transform(whole)), roles, imputer, inputs, outputs)


@dataclass
class TrainingRun:
    prepared: Prepared
    model: Model
    scorer: Scorer
    predictions: DataFrame  # scaled test rows with pred_ columns
    original: DataFrame  # the same in original units
    metrics: DataFrame  # scale, output, metric, value
    mean_errors: DataFrame
    losses: DataFrame | None
    validation_loss: float | None
    metric: float


def train_and_evaluate(df: DataFrame, roles: Roles, spec: PipelineSpec = PipelineSpec()) -> TrainingRun:
    """The whole run.  With ``validation='single'`` and a validation share the losses come from the
    validation rows, otherwise from cross-validation."""
    prepared = prepare(df, roles, spec)
    train = prepared.part(TRAIN)
    single = spec.validation == "single" and spec.val > 0
    losses = validation_loss = None
    if single:
        model, losses = hold_out(spec.kind, train, prepared.part(VAL), roles, **spec.params)
        validation_loss = losses.where("split = 'val'").orderBy("epoch", ascending=False).head()["loss"]
    else:
        run = cross_validate(spec.kind, train, roles, spec.folds, spec.seed, **spec.params)
        validation_loss, model = run.mean_loss, run.model
        if isinstance(model, Network):
            losses = model.losses(df.sparkSession)
    predictions = model.transform(prepared.part(TEST))
    table = metrics_both_scales(predictions, roles.outputs, prepared.output_scalers, [spec.metric])
    original = prepared.output_scalers.inverse(predictions)
    # marks of missing cells are no inputs of the model, so scoring needs only the fill values
    imputer = MeanImputer(prepared.imputer.means) if isinstance(prepared.imputer, MeanImputer) else prepared.imputer
    scorer = Scorer(model, prepared.input_scalers, prepared.output_scalers, imputer)
    return TrainingRun(
        prepared, model, scorer, predictions, original, table, mean_errors(original, roles.outputs), losses,
        validation_loss, primary_metric(table, spec.metric),
    )
