"""Fitted parameters, predictions, metrics and error reports as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from emulon.functions.columns import format_number, percent_error, quoted, text
from emulon.operators.evaluate import mean_errors, residuals
from emulon.operators.impute import MeanImputer, NeighbourImputer
from emulon.operators.scale import ColumnScale, Scalers

PARAMETERS = "position int, column string, role string, scaler string, center double, scale double, impute_value double"


def parameter_table(
    spark: SparkSession, scalers: Mapping[str, Scalers], imputer: MeanImputer | None = None
) -> DataFrame:
    """Fitted parameters, one row per column and role."""
    means = imputer.means if imputer is not None else {}
    rows, seen = [], set()
    for role, fitted in scalers.items():
        for c, s in fitted.by_column.items():
            rows.append((len(rows), c, role, s.kind, float(s.center), float(s.scale), means.get(c)))
            seen.add(c)
    rows += [(len(rows) + i, c, "input", None, None, None, m)
             for i, (c, m) in enumerate((c, m) for c, m in means.items() if c not in seen)]
    return spark.createDataFrame(rows, PARAMETERS)


def write_scalers(
    spark: SparkSession, path: str, scalers: Mapping[str, Scalers], imputer: MeanImputer | None = None
) -> None:
    parameter_table(spark, scalers, imputer).coalesce(1).write.mode("overwrite").parquet(path)


def read_scalers(spark: SparkSession, path: str) -> dict[str, Scalers]:
    """Scalers by role; the table has one row per column, so it is read whole."""
    out: dict[str, dict[str, ColumnScale]] = {"input": {}, "output": {}}
    for r in spark.read.parquet(path).where("scaler IS NOT NULL").orderBy("position").collect():
        out.setdefault(r["role"], {})[r["column"]] = ColumnScale(r["scaler"], r["center"], r["scale"])
    return {role: Scalers(columns) for role, columns in out.items()}


def read_imputer(spark: SparkSession, path: str) -> MeanImputer:
    rows = spark.read.parquet(path).where("impute_value IS NOT NULL").orderBy("position").collect()
    return MeanImputer({r["column"]: r["impute_value"] for r in rows})


def write_donors(imputer: NeighbourImputer, path: str) -> None:
    """The training rows that a neighbour imputer looks up, and its settings."""
    spark = imputer.donors.sparkSession
    imputer.donors.select(*map(quoted, [imputer.key, *imputer.columns])).write.mode("overwrite").parquet(f"{path}/rows")
    settings = [(imputer.key, list(imputer.columns), imputer.k)]
    spark.createDataFrame(settings, "key string, columns array<string>, k int").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def read_donors(spark: SparkSession, path: str, means: dict[str, float]) -> NeighbourImputer | None:
    """The stored imputer; None where there is none."""
    try:
        settings = spark.read.parquet(f"{path}/settings").head()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return NeighbourImputer(spark.read.parquet(f"{path}/rows"), settings["key"], tuple(settings["columns"]), means, settings["k"])


def write_predictions(original: DataFrame, key: str, outputs: Sequence[str], path: str) -> tuple[str, str]:
    """Predictions and expected values in original units, each a headered CSV with the key."""
    paths = (f"{path}/predictions", f"{path}/expected")
    original.select(key, *[F.col(f"pred_{c}").alias(c) for c in outputs]).write.mode("overwrite").option(
        "header", True).csv(paths[0])
    original.select(key, *outputs).write.mode("overwrite").option("header", True).csv(paths[1])
    return paths


def write_metrics(table: DataFrame, path: str) -> None:
    """The long metric table as JSON lines."""
    table.write.mode("overwrite").json(path)


def write_search(table: DataFrame, best: Mapping[str, object], path: str) -> None:
    """All candidates of a grid search, and the best parameters as one JSON line."""
    table.write.mode("overwrite").parquet(f"{path}/candidates")
    row = [(str(k), None if v is None else str(v)) for k, v in best.items()]
    table.sparkSession.createDataFrame(row, "parameter string, value string").coalesce(1).write.mode(
        "overwrite").json(f"{path}/best")


def error_report(original: DataFrame, key: str, outputs: Sequence[str]) -> DataFrame:
    """One text line per row and, first, a line of means: ``(key, line)`` with a null key for the means."""
    table = original.select(key, *outputs, *[f"pred_{c}" for c in outputs])
    pieces = []
    for c in outputs:
        pred, y = quoted(f"pred_{c}"), quoted(c)
        values = {"expected=": y, ", predicted=": pred, ", error=": f"({pred} - {y})", ", error%=": percent_error(pred, y)}
        shown = ", ".join(f"{text(name)}, {format_number(v)}" for name, v in values.items())
        pieces.append(f"concat({text(c + ' -> ')}, {shown}, '%')")
    rows = table.selectExpr(f"cast({quoted(key)} as string) as key", f"concat_ws(' | ', {', '.join(pieces)}) as line")
    order = ", ".join(text(c) for c in outputs)
    piece = (f"concat(output, ' -> error=', {format_number('mean_error')}, ', error%=', "
             f"{format_number('mean_error_pct')}, '%')")
    means = mean_errors(table, outputs).selectExpr(f"struct(array_position(array({order}), output) as at, {piece} as piece) as p")
    head = means.selectExpr(
        "cast(null as string) as key",
        "concat('Mean: ', concat_ws(' | ', transform(array_sort(collect_list(p)), p -> p.piece))) as line")
    return head.unionByName(rows)


def write_error_report(original: DataFrame, key: str, outputs: Sequence[str], path: str) -> None:
    report = error_report(original, key, outputs)
    line = F.when(F.col("key").isNull(), F.col("line")).otherwise(F.concat(F.lit("row "), F.col("key"), F.lit(": "), F.col("line")))
    report.select(line.alias("value")).write.mode("overwrite").text(path)


__all__ = [
    "error_report",
    "parameter_table",
    "read_donors",
    "read_imputer",
    "read_scalers",
    "residuals",
    "write_donors",
    "write_error_report",
    "write_metrics",
    "write_predictions",
    "write_scalers",
    "write_search",
]
